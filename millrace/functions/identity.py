"""Identity: canonical JSON, digests, group keys, seeded orders and folds."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import changed_each, collapsed, is_blank, lines_stripped, nfc, norm

MESSAGE = "struct<role:string,content:string>"


def json_text(value) -> str:
    """Sorted keys, no spaces, letters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value: Column) -> Column:
    return F.sha2(value, 256)


def message_json(messages: Column) -> Column:
    """Messages as canonical JSON: fields in the order of their names."""
    return F.to_json(F.transform(messages, lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role"))), {"ignoreNullFields": "false"})


def non_assistant(messages: Column) -> Column:
    return F.filter(messages, lambda m: m["role"] != "assistant")


def family_text(messages: Column) -> Column:
    return F.array_join(F.transform(non_assistant(messages), lambda m: m["content"]), "\n")


def group_key(messages: Column) -> Column:
    """One family whatever the assistants said: the digest of the other canonical messages.
    NFC is taken as given (see nfc_messages)."""
    said = non_assistant(messages)
    texts = changed_each(F.transform(said, lambda m: m["content"]), lines_stripped)
    return digest(message_json(F.zip_with(said, texts, lambda m, t: F.struct(m["role"].alias("role"), t.alias("content")))))


def fingerprint(messages: Column) -> Column:
    """Digest of the (role, normed content) pairs; null contents and blank system messages are left out."""
    told = F.filter(messages, lambda m: m["content"].isNotNull() & ~((m["role"] == "system") & is_blank(m["content"])))
    return digest(F.to_json(F.transform(told, lambda m: F.array(m["role"], collapsed(m["content"])))))


def prompt_of(messages: Column) -> Column:
    """Without the last message, where an assistant says it."""
    n = F.size(messages)
    return F.when((n > 0) & (F.get(messages, n - 1)["role"] == "assistant"), F.slice(messages, 1, n - 1)).otherwise(messages)


def conversation_seed(messages: Column) -> Column:
    """What stands before the first assistant message."""
    first = F.array_position(F.transform(messages, lambda m: m["role"]), "assistant").cast("int")
    return F.when(first > 0, F.slice(messages, 1, first - 1)).otherwise(messages)


def draw_key(seed: int | str, domain: str, key: Column) -> Column:
    """A seeded pseudo-random order that any engine repeats: the digest of the JSON list."""
    head = json_text([seed, domain])[:-1]
    return digest(F.concat(F.lit(head + ',"'), key.cast("string"), F.lit('"]')))


def colon_key(seed: int | str, domain: str, key: Column) -> Column:
    return digest(F.concat(F.lit(f"{seed}:{domain}:"), key.cast("string")))


def unit_interval(hex_digest: Column) -> Column:
    """The first 64 bits of a digest, as a share of 2**64."""
    return F.conv(F.substring(hex_digest, 1, 16), 16, 10).cast("decimal(20,0)") / F.lit(str(2**64)).cast("decimal(20,0)")


def text_key(text: Column) -> Column:
    return digest(norm(text))


def tag(key: bytes):
    """HMAC-SHA256 tags of strings under a key, as a function of columns."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(key, x.encode(), hashlib.sha256).hexdigest())

    return run


def tag_holds(key: bytes):
    @F.pandas_udf("boolean")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and hmac.compare_digest(hmac.new(key, x.encode(), hashlib.sha256).hexdigest(), y) for x, y in zip(s, t, strict=True)])

    return run


def nfc_messages(messages: Column) -> Column:
    """Messages in NFC, whole as JSON: what stands around texts there composes with nothing. Texts
    of ASCII stay as they are."""
    return F.from_json(nfc(F.to_json(messages, {"ignoreNullFields": "false"})), f"array<{MESSAGE}>")


def lines_unified(source: Column) -> Column:
    return F.replace(F.replace(source, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
