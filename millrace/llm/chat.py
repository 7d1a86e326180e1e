"""Chat formatting by schema fingerprints, in DataFrame operations only.

A layout is known by a hash of its nested field paths. A registry maps fingerprints to
declarations of where roles and texts are, from which canonical turns are made. The template
marks each turn and escapes control strings inside texts, so that it can be read back.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ready

START, END = "<|im_start|>", "<|im_end|>"
TURNS = "array<struct<role:string,text:string>>"


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """The paths of all fields below a type; [] stands for an array's elements."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, f"{at}[]")
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}"))
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value worked out once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: JSON strings of any length that fits a row: the reader's own limit would make longer ones null.
ANY_LENGTH = {"maxStringLen": str((1 << 31) - 1), "maxNestingDepth": "1000"}


def in_some(maps: Column, name: str) -> Column:
    return F.exists(maps, lambda e: F.map_contains_key(e, name))


def json_fingerprint(whole: Column, paths: list[str]) -> Column:
    """The same hash for a JSON object (its fields, as text), row by row, of those of the paths that it
    has; an array's elements all count, and an empty array is a path of its own. Other fields do
    not count. Null where there is no object or it has none of the paths."""
    arrays = sorted({p.split("[].")[0] for p in paths if "[]." in p})
    elements = [F.from_json(F.element_at(whole, a[1:]), "array<map<string,string>>", ANY_LENGTH).alias(a[1:]) for a in arrays]
    parsed = F.struct(whole.alias("whole object"), *elements)

    def has(x: Column, path: str) -> Column:
        array, _, name = path.partition("[]")
        if not name:
            return F.size(x[array[1:]]) == 0 if "[]" in path else F.map_contains_key(x["whole object"], path[1:])
        return in_some(x[array[1:]], name[1:])

    every = sorted([*paths, *(f"{a}[]" for a in arrays)])
    found = bound(parsed, lambda x: F.array_compact(F.array(*[F.when(has(x, p), F.lit(p)) for p in every])))
    return bound(found, lambda f: F.when(F.size(f) > 0, F.left(F.sha2(F.array_join(f, "\n"), 256), F.lit(16))))


@dataclass(frozen=True)
class Layout:
    """Where a layout has its turns: an array with a role and a text field (`turns`), or single
    fields in order, each with the role that it speaks for (`fields`); empty optional fields are
    left out. `roles` renames roles; others stay."""

    name: str
    paths: tuple[str, ...]
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def keys(self) -> tuple[str, ...]:
        """Of the whole layout, and of one without turns."""
        return (fingerprint(list(self.paths)), *([fingerprint([f".{self.turns[0]}[]"])] if self.turns else []))


SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: Layouts that are known from the start; a caller may give more.
LAYOUTS = (
    Layout("messages", (".messages[].role", ".messages[].content"), turns=("messages", "role", "content")),
    Layout("messages_text", (".messages[].role", ".messages[].text"), turns=("messages", "role", "text")),
    Layout("conversations", (".conversations[].from", ".conversations[].value"), turns=("conversations", "from", "value"), roles=SPEAKERS),
    Layout("prompt_response", (".prompt", ".response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", (".prompt", ".completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system_prompt_response", (".system", ".prompt", ".response"), fields=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question_answer", (".question", ".answer"), fields=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", (".instruction", ".input", ".output"), fields=(("user", "instruction+input"), ("assistant", "output"))),
    Layout("instruction_only", (".instruction", ".output"), fields=(("user", "instruction"), ("assistant", "output"))),
)


def turns_of(layout: Layout, get: Callable[[str], Column], elements: Callable[[str], Column]) -> Column:
    """The canonical turns, from how to get a field's text and an array of (role, text)."""
    if layout.turns:
        renamed = lambda r: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in layout.roles.items() for x in kv]), r), r) if layout.roles else r
        return F.transform(elements(layout.turns[0]), lambda m: F.struct(renamed(m[layout.turns[1]]).alias("role"), F.coalesce(m[layout.turns[2]], F.lit("")).alias("text"))).cast(TURNS)
    made = []
    for role, names in layout.fields:
        parts = [F.when(get(n) != "", get(n)) for n in names.split("+")]
        made.append(F.when(F.coalesce(*parts).isNotNull() | F.lit(role != "system"), F.struct(F.lit(role).alias("role"), F.concat_ws("\n\n", *parts).alias("text"))))
    return F.filter(F.array(*made), lambda t: t.isNotNull()).cast(TURNS)


def canonical(df: DataFrame, key: str, layouts: tuple[Layout, ...] = LAYOUTS, json: str | None = None) -> DataFrame:
    """key, layout, turns. A typed table has one fingerprint, of its columns but the key; with
    `json`, each row's text is fingerprinted and mixed layouts may stand in one table. Fields that
    no layout names are left aside; rows of unknown layouts have null layout and turns; null texts
    are empty."""
    ready(df.sparkSession)
    known = sorted({p for x in layouts for p in x.paths})
    if json is None:
        rest = [f for f in df.schema.fields if f.name != key]
        mark = fingerprint([p for p in field_paths(T.StructType(rest)) if p in known])
        layout = next((x for x in layouts if mark in x.keys), None)
        turns = turns_of(layout, lambda n: F.col(f"`{n}`").cast("string"), lambda n: F.col(f"`{n}`")) if layout else F.lit(None).cast(TURNS)
        return df.select(F.col(key), F.lit(layout.name if layout else None).cast("string").alias("layout"), turns.alias("turns"))
    text = F.col(json)

    def read(x: Column) -> Column:
        name, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
        for y in reversed(layouts):
            hit = x["mark"].isin(*y.keys)
            get = lambda n: F.element_at(x["whole"], n)
            array = lambda n, y=y, get=get: F.from_json(get(n), f"array<struct<`{y.turns[1]}`:string,`{y.turns[2]}`:string>>", ANY_LENGTH)
            name = F.when(hit, F.lit(y.name)).otherwise(name)
            turns = F.when(hit, turns_of(y, get, array)).otherwise(turns)
        return F.struct(name.alias("layout"), turns.alias("turns"))

    marked = lambda whole: bound(F.struct(whole.alias("whole"), json_fingerprint(whole, known).alias("mark")), read)
    told = bound(F.from_json(text, "map<string,string>", ANY_LENGTH), marked)
    return df.select(F.col(key), told.alias("__told")).select(key, "__told.layout", "__told.turns")


#: Turn tables, one message a row: fingerprints of their columns besides the key, and where they have turn, role and text.
TURN_ROWS = (
    (fingerprint([".turn", ".role", ".text"]), ("turn", "role", "text")),
    (fingerprint([".turn", ".role", ".content"]), ("turn", "role", "content")),
    (fingerprint([".turn", ".from", ".value"]), ("turn", "from", "value")),
)


def turn_rows(df: DataFrame, key: str = "conv_id", strict: bool = True) -> DataFrame:
    """key, turn, role, text of a table with one message a row, by its columns' fingerprint. Not
    strict, columns that a known table does not name are left aside, and the first known table
    that the columns hold counts."""
    paths = field_paths(T.StructType([f for f in df.schema.fields if f.name != key]))
    for mark, names in TURN_ROWS:
        if fingerprint(paths if strict else [p for p in paths if p[1:] in names]) == mark:
            return df.select(key, *[F.col(f"`{a}`").alias(b) for a, b in zip(names, ("turn", "role", "text"), strict=True)])
    raise ValueError(f"no known turn table: {df.columns}")


def escaped(text: Column) -> Column:
    r"""Control strings start with <|. Each < with any number of \ before a | gets one \ more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def header(role: Column) -> Column:
    """Roles also may hold anything; a role ends at the first line break."""
    return F.replace(F.replace(escaped(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def role_of(text: Column) -> Column:
    return unescaped(F.replace(F.replace(text, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def rows_of(folded: DataFrame, key: str) -> DataFrame:
    """Canonical turns as one row a turn. A record of unknown layout is one row without turn, role
    and text, so that its key does not get lost."""
    known = F.col("turns").isNotNull()
    none = F.array(F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text")))
    each = folded.select(F.col(key), known.alias("known"), F.posexplode(F.coalesce("turns", none)).alias("turn", "m"))
    return each.select(key, F.when(F.col("known"), F.col("turn").cast("long")).alias("turn"), F.col("m.role").alias("role"), F.col("m.text").alias("text"))


def format_rows(rows: DataFrame, key: str = "conv_id", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """key, formatted, loss_spans from one row a turn (turn, role, text).

    loss_spans has each turn's (start, length) in code points of `formatted`, from 1; length 0
    outside the loss. Turns with equal numbers follow by role and text; null roles and texts are
    empty; rows with a null key are one conversation. Places are running sums over the rows, so
    that only the finished string of a conversation has to fit one row.
    """
    ready(rows.sparkSession)
    r = rows.select(F.col(key).alias("key"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    r = r.withColumn("head", F.concat(F.lit(START), header(F.col("role")), F.lit("\n"))).withColumn("body", escaped(F.col("text")))
    whole = F.concat("head", "body", F.lit(f"{END}\n"))
    line = Window.partitionBy("key").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = r.withColumn("part", whole).withColumn("no", F.row_number().over(Window.partitionBy("key").orderBy("turn", "role", "text")))
    r = r.withColumn("at", F.sum(F.length("part").cast("long")).over(line) - F.length("part"))
    length = F.when(F.col("role").isin(*trained), F.length("body")).otherwise(0).cast("long")
    folded = r.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", "part", (F.col("at") + F.length("head") + 1).alias("start"), length.alias("length")))).alias("turns"))
    return folded.select(
        F.col("key").alias(key),
        F.array_join(F.transform("turns", lambda t: t["part"]), "").alias("formatted"),
        F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length"))).alias("loss_spans"),
    )


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row a turn from what was formatted: no, role, text, and the text under the loss mask
    (null where the mask has none)."""
    f = formatted.select(F.col(key).alias("key"), F.split("formatted", r"<\|im_start\|>").alias("parts"), "loss_spans")
    each = f.select("key", F.posexplode(F.arrays_zip(F.slice("parts", 2, F.greatest(F.size("parts") - 1, F.lit(0))).alias("part"), F.col("loss_spans").alias("span"))).alias("no", "t"))
    each = each.select("key", "no", F.col("t.part").alias("part"), F.col("t.span.start").alias("start"), F.col("t.span.length").alias("length"))
    line = Window.partitionBy("key").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("part") + len(START)
    each = each.withColumn("at", F.sum(size.cast("long")).over(line) - size)
    named = F.substring_index("part", "\n", 1)
    rest = F.substring("part", F.length(named) + 2, F.length("part"))
    body = F.left(rest, F.length(rest) - len(END) - 1)
    masked = F.substring("part", (F.col("start") - F.col("at") - len(START)).cast("int"), F.col("length").cast("int"))
    return each.select(F.col("key").alias(key), "no", role_of(named).alias("role"), unescaped(body).alias("text"), F.when(F.col("length") > 0, unescaped(masked)).alias("loss_text"), F.col("at"), size.alias("size"))


def digests(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, all from what was formatted."""
    t = read_back(formatted, key).withColumnRenamed(key, "key")
    line = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    g = t.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("no", line.alias("line"), F.coalesce("loss_text", F.lit("")).alias("loss")))).alias("t"), F.sum(F.col("size").cast("long")).alias("formatted_chars"))
    loss = F.array_join(F.transform("t", lambda x: x["loss"]), "")
    return g.select(
        F.col("key").alias(key),
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: x["line"]), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
