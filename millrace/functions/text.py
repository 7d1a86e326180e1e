"""Text kernel: normal forms, tokens, shingles, similarity, masks and estimates as columns."""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space of Python's str.split.
SPACES = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: A token is a run of letters, digits and underscores, or one other sign.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


#: Signs that NFC leaves as they are wherever they stand: Latin with its marks composed, points,
#: currencies, Cyrillic, kana, Han and Hangul syllables.
COMPOSED = r"\x00-\u02ff\u0400-\u0482\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u20a0-\u20bf\u3001-\u3029\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3"


@F.pandas_udf(T.StringType())
def put_together(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column) -> Column:
    """Only texts with a sign that NFC may change go to Python."""
    return F.coalesce(put_together(F.when(text.rlike(f"[^{COMPOSED}]"), text)), text)


@F.pandas_udf(T.StringType())
def casefold(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else x.casefold())


def collapsed(text: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, f"{SPACES}+", " "))


def composed_and_collapsed(x: str) -> str:
    return " ".join(unicodedata.normalize("NFC", x).split())


def lines_stripped(x: str) -> str:
    return "\n".join([line.rstrip() for line in x.splitlines()]).strip()


def composed_and_stripped(x: str) -> str:
    return lines_stripped(unicodedata.normalize("NFC", x))


def each(texts: pa.Array, change: Callable[[str], str]) -> pa.Array:
    return pa.array([None if x is None else change(x) for x in texts.to_pylist()], pa.string())


@cache
def text_udf(change: Callable[[str], str]):
    """One function object for each change, so that Spark sees equal calls as one."""
    return F.arrow_udf(lambda texts: each(texts, change), T.StringType())


@cache
def texts_udf(change: Callable[[str], str]):
    def run(lists: pa.Array) -> pa.Array:
        ends = np.cumsum([0, *(n or 0 for n in lists.value_lengths().to_pylist())])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each(lists.flatten(), change), mask=lists.is_null())

    return F.arrow_udf(run, T.ArrayType(T.StringType()))


def changed(text: Column, change: Callable[[str], str]) -> Column:
    """The text as Python changes it, whose splits and strips go through a text once."""
    return text_udf(change)(F.make_valid_utf8(text))


def changed_each(texts: Column, change: Callable[[str], str]) -> Column:
    """The same for each text of an array."""
    return texts_udf(change)(F.transform(texts, F.make_valid_utf8))


def norm(text: Column) -> Column:
    """NFC and collapsed white space: the key of text equality."""
    return changed(text, composed_and_collapsed)


def canonical(text: Column, composed: bool = True) -> Column:
    """NFC, lines ended by \\n and stripped at their right, stripped as a whole."""
    return changed(text, composed_and_stripped if composed else lines_stripped)


def is_blank(text: Column) -> Column:
    """Looks no further than to the first sign that is no white space."""
    return ~F.coalesce(text, F.lit("")).rlike(f"[^{SPACES[1:]}")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """As Python's str.split."""
    return F.filter(F.split(text, f"{SPACES}+"), lambda w: w != "")


def grams(parts: Column, n: int) -> Column:
    """All runs of n parts, joined by spaces; none where there are fewer."""
    joined = parts
    for j in range(1, n):
        shifted = F.slice(parts, j + 1, F.greatest(F.size(parts), F.lit(1)))
        joined = F.zip_with(joined, shifted, lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(parts) >= n, F.slice(joined, 1, F.size(parts) - n + 1)).otherwise(F.array().cast("array<string>"))


def folded_tokens(text: Column) -> Column:
    """Tokens for comparing: case is folded by lower and for sharp s."""
    return tokens(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")))


def shingle_keys(parts: Column, n: int = 3, least: int = 12) -> Column:
    """Distinct 8-byte keys (16 hex digits of md5) of the runs of n tokens, sorted; none where
    there are fewer than `least` tokens. Give the tokens as a column that is computed already."""
    keys = F.sort_array(F.array_distinct(F.transform(grams(parts, n), lambda g: F.substring(F.md5(g), 1, 16))))
    return F.when(F.size(parts) >= least, keys).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.try_divide(shared.cast("double"), F.size(a) + F.size(b) - shared)


def containment(part: Column, whole: Column) -> Column:
    """The share of the first set that the second holds."""
    return F.try_divide(F.size(F.array_intersect(part, whole)).cast("double"), F.size(part))


def sizes_allow(a: Column, b: Column, threshold: float) -> Column:
    return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b)


# What language marks look away from, and what has no language to tell.
LANGUAGE_MASKS = (r"(?s)```.*?```", r"`[^`\n]+`", r"https?://\S+", r"(?s)\\\[.*?\\\]|\$\$.*?\$\$")
CHOICE_LETTER = r"^[A-Ea-e]$"
NUMERIC_ANSWER = r"^(?:####\s*)?[-+\d.,%$ /\\{}()=]+$"
# End of fixed values.


def masked_for_language(text: Column) -> Column:
    """Code blocks, code spans, URLs and displayed formulas as spaces: for language marks only."""
    for pattern in LANGUAGE_MASKS:
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(text)


def is_neutral(text: Column) -> Column:
    """Numbers, signs or a single choice letter: no language to tell."""
    t = F.trim(text)
    return t.rlike(r"^[\p{N}\P{L}_]+$") & ~t.rlike(r"\p{L}") & (t != "") | t.rlike(CHOICE_LETTER) | t.rlike(NUMERIC_ANSWER)


def ends_of(text: Column, n: int = 4000, beyond: int = 6000) -> Column:
    """The first n characters, and of longer texts the last n too."""
    return F.when(F.length(text) > beyond, F.array(F.left(text, F.lit(n)), F.right(text, F.lit(n)))).otherwise(F.array(F.left(text, F.lit(n))))


def token_estimate(text: Column, fallback: bool = False) -> Column:
    size = F.octet_length(text)
    return (size + 16 if fallback else F.ceil(size / 4) + 16).cast("long")


def truncated(text: Column, most: int, marker: str = "...[truncated]") -> Column:
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(0, most - len(marker)))), F.lit(marker)))


def redacted(text: Column, *secrets: str) -> Column:
    for s in filter(None, secrets):
        text = F.replace(text, F.lit(s), F.lit("[REDACTED]"))
    return text


def scrubbed(value: Column, kind: T.DataType, *secrets: str) -> Column:
    """A nested value with the secrets redacted in all of its strings, however deep; names of
    fields and keys of maps stay."""
    if isinstance(kind, T.StringType):
        return redacted(value, *secrets)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: scrubbed(x, kind.elementType, *secrets))
    if isinstance(kind, T.MapType):
        return F.transform_values(value, lambda _, x: scrubbed(x, kind.valueType, *secrets))
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*[scrubbed(value[f.name], f.dataType, *secrets).alias(f.name) for f in kind.fields]))
    return value


def without_fields(value: Column, kind: T.DataType, hidden: tuple[str, ...]) -> Column:
    """A nested value without the fields and map keys of these names, however deep. A struct that
    has hidden fields only becomes null."""
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: without_fields(x, kind.elementType, hidden))
    if isinstance(kind, T.MapType):
        return F.transform_values(F.map_filter(value, lambda k, _: ~k.isin(*hidden)), lambda _, x: without_fields(x, kind.valueType, hidden))
    if isinstance(kind, T.StructType):
        told = [without_fields(value[f.name], f.dataType, hidden).alias(f.name) for f in kind.fields if f.name not in hidden]
        return F.when(value.isNotNull(), F.struct(*told)) if told else F.lit(None)
    return value


def rounded(x: Column, digits: int) -> Column:
    """Doubles rounded as Python's round does: the decimal nearest to the binary value itself,
    ties to even. 2.675 is a little less than its name and gives 2.67."""

    @F.arrow_udf(T.DoubleType())
    def run(values: pa.Array) -> pa.Array:
        return pa.array([v if v is None or not math.isfinite(v) else round(v, digits) for v in values.to_pylist()], pa.float64())

    return run(x.cast("double"))
