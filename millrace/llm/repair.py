"""Conversation structure repair: the cheapest edits that make a conversation's roles legal.

Roles must read `(s?(ua)+)?`. A recursive DuckDB query inside hash-partitioned batches advances one
turn of all its conversations in each recursion, and keeps, for each state that the grammar was
entered in and each it can be in now, the least cost and the least edits at that cost. Two different
edits of equal cost are never one the beginning of the other (more letters on the same rows are
insertions, which cost), so the least string of a part stays the least within any whole.

A conversation is cut into pieces of `PIECE` rows, which may lie in different tasks; a piece's costs
from state to state are the steps of the next level, and so on until one piece is left. What a task
holds is bounded by its batch, except the one thing that the result asks for as a whole: the edits,
and the repaired text that is hashed, of a conversation are each one string.
"""

from __future__ import annotations

from itertools import product

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.scans import Blocks
from .common import WORD, kept, ready

#: Rows in a piece of a conversation, and rows in a batch, more or less.
PIECE, BATCH = 128, 20_000

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3

#: States: nothing yet, after system, after user, after assistant; and what a role's initial makes of each.
STATES = range(4)
NEXT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}

#: What still has to be inserted at the end of a conversation, by state.
ENDS = {0: (0, ""), 1: (2 * INSERT, "IJ"), 2: (INSERT, "J"), 3: (0, "")}


def moves() -> pa.Table:
    """Of a row's kind and each pair of states, the least cost and plan. A plan's letters are D
    (delete), I and J (insert a user's and an assistant's row), K (keep), R and S (make it a
    user's, an assistant's); a bar follows the row's own letter. They are in the order of the
    edits' initials D, I, K, R."""
    inserted = lambda state: [("I", 2)] if state != 2 else [("J", 3)]
    out = []
    for initial, must_go, cut in product(("s", "u", "a", "-"), (False, True), (False, True)):
        for p in STATES:
            ways, ready_ = {}, [("", p)]
            for _ in range(2):
                ready_ += [(s + letter, q) for s, at in ready_[-1:] for letter, q in inserted(at)]
            for before, at in ready_:
                cost = INSERT * len(before)
                options = [(DELETE, "D", at)]
                if not must_go:
                    options += [(KEEP + CUT * cut, "K", q) for q in [NEXT.get(initial, {}).get(at)] if q is not None]
                    options += [(REROLE + CUT * cut, letter, NEXT[to][at]) for letter, to in (("R", "u"), ("S", "a")) if at in NEXT[to]]
                for more, letter, q in options:
                    ways[q] = min(ways.get(q, (1 << 30, "")), (cost + more, f"{before}{letter}|"))
            out += [{"kind": f"{initial}{int(must_go)}{int(cut)}", "p": p, "q": q, "cost": cost, "plan": plan} for q, (cost, plan) in ways.items()]
    return pa.Table.from_pylist(out)


ROW_STEPS = "SELECT k, seg, i, m.p, m.q, m.cost + (n - 1) * {delete} AS cost, replace(m.plan, '|', repeat('D', n - 1) || '|') AS plan FROM batch JOIN moves m USING (kind)"
PIECE_STEPS = "SELECT k, seg, i, p, q, cost, plan FROM batch"
ADVANCE = """
WITH RECURSIVE step AS MATERIALIZED ({steps}),
ends AS (SELECT k, seg, max(i) AS n FROM step GROUP BY ALL),
dp(k, n, i, p, q, cost, plan) USING KEY (k, p, q) AS (
  SELECT k, n, -1, p, p, CAST(0 AS BIGINT), '' FROM ends, range(4) r(p) WHERE seg > 0 OR p = 0
  UNION
  SELECT k, n, i, p, q, b.cost, b.plan FROM (
    SELECT d.k, d.n, s.i, d.p, s.q, min({{'cost': CAST(d.cost + s.cost AS BIGINT), 'plan': d.plan || s.plan}}) AS b
    FROM dp d JOIN step s ON s.k = d.k AND s.i = d.i + 1 AND s.p = d.q GROUP BY d.k, d.n, s.i, d.p, s.q))
SELECT k, CAST(p AS INTEGER) AS p, CAST(q AS INTEGER) AS q, cost, plan FROM dp WHERE i = n
"""
PIECES = "conv string, seg long, p int, q int, cost long, plan string"


def advance(rows: DataFrame, groups: int, whole: bool) -> DataFrame:
    """Rows (conv, seg, i and either kind and n, or p, q, cost and plan) to a row for each piece
    (conv, seg) and each pair of states that it can lead from and to."""
    steps = PIECE_STEPS if whole else ROW_STEPS.format(delete=DELETE)
    sql = ADVANCE.format(steps=steps)

    def run(t: pa.Table) -> pa.Table:
        names = t.group_by(["conv", "seg"]).aggregate([])
        names = names.append_column("k", pa.array(range(len(names)), pa.int64()))
        with duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""}) as con:
            con.register("moves", moves())
            con.register("given", t)
            con.register("names", names)
            con.execute("CREATE TEMP TABLE batch AS SELECT names.k, given.* FROM given JOIN names USING (conv, seg)")
            con.execute("CREATE TEMP TABLE found AS " + sql)
            out = con.execute("SELECT conv, seg, p, q, cost, plan FROM found JOIN names USING (k)").to_arrow_table()
        return out.cast(pa.schema([("conv", pa.string()), ("seg", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("plan", pa.string())]))

    g = F.pmod(F.xxhash64("conv", "seg"), F.lit(groups)).cast("int")
    return rows.withColumn("g", g).groupBy("g").applyInArrow(run, PIECES)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, drawn by a checksum of conversation and turn; n copies of each row."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), draw.alias("draw")).where("draw <> 0")
    said = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), F.when(F.col("draw") == 3, 2).otherwise(1).alias("n"))


#: Characters of a text that rows of one turn and role are ordered by; then its digest.
HEAD = 256


def keyed(rows: DataFrame) -> DataFrame:
    """With conv (conv_id as text, empty for null) and x, the text's digest."""
    return rows.select("*", F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.sha2("text", 256).alias("x"))


def faulty(rows: DataFrame) -> DataFrame:
    """Each different row once, with how often it stands there (n), whether it has to go and
    whether it breaks off. Texts stay behind: x tells which."""
    blank = ~F.rlike("text", F.lit(WORD))
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = keyed(rows).select("conv", "turn", "role", "x", F.left("text", F.lit(HEAD)).alias("head"), "n", blank.alias("blank"), (~blank & ~last.isin(".", "!", "?")).alias("cut"))
    rows = rows.groupBy("conv", "turn", "role", "x").agg(*[F.first(c).alias(c) for c in ("head", "blank", "cut")], F.sum("n").cast("long").alias("n"))
    first = rows.groupBy("conv", "role", "x").agg(F.min(F.struct("turn")).alias("f"))
    rows = rows.join(first, ["conv", "role", "x"]).withColumn("again", ~F.col("blank") & ~F.col("turn").eqNullSafe(F.col("f.turn"))).drop("f")
    initial = F.substring("role", 1, 1)
    kind = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"), (F.col("blank") | F.col("again")).cast("int"), F.col("cut").cast("int"))
    return rows.withColumns({"initial": initial, "kind": kind})


def ordered(rows: DataFrame) -> DataFrame:
    """Adds pos, a row's place in its conversation (by turn, nulls first, then role and text), and
    the role's initial before it."""
    b = Blocks(rows, ["conv"], ["turn", "role", "head", "x"])
    return b.scan(sums={"pos": F.lit(1).cast("long")}, lags={"before": F.col("initial")}).frame().drop("head")


def repaired(rows: DataFrame) -> DataFrame:
    """conv, cost and plan of conversations whose rows have conv, pos, kind and n."""
    size = rows.agg(F.count("*").alias("n"), F.max("pos").alias("most")).first()
    at = F.col("pos") - 1
    steps = rows.select("conv", F.floor(at / PIECE).cast("long").alias("seg"), (at % PIECE).cast("int").alias("i"), "kind", "n")
    pieces, count, whole = None, -(-size["n"] // BATCH) or 1, False
    last = ((size["most"] or 1) - 1) // PIECE
    while True:
        pieces = advance(steps, max(1, count), whole)
        if last == 0:
            break
        steps = pieces.select("conv", F.floor(F.col("seg") / PIECE).cast("long").alias("seg"), (F.col("seg") % PIECE).cast("int").alias("i"), "p", "q", "cost", "plan")
        last, count, whole = last // PIECE, -(-count * 16 // PIECE), True
    ends = F.create_map(*[x for q, (c, s) in ENDS.items() for x in (F.lit(q), F.struct(F.lit(c).cast("long").alias("cost"), F.lit(s).alias("plan")))])
    end = F.element_at(ends, F.col("q"))
    best = F.min(F.struct((F.col("cost") + end["cost"]).alias("cost"), F.concat("plan", end["plan"]).alias("plan")))
    return pieces.where("p = 0").groupBy("conv").agg(best.alias("b")).select("conv", "b.*")


def edited(rows: DataFrame, plans: DataFrame, said: DataFrame) -> DataFrame:
    """conv and its repaired text: `role:text` of each row, joined by newlines. Only the rows that
    stay fetch their texts, from `said`."""
    tokens = plans.select("conv", F.posexplode(F.split("plan", "[|]")).alias("at", "token")).withColumn("pos", F.col("at").cast("long") + 1)
    d = tokens.join(rows.select("conv", "pos", "turn", "role", "x"), ["conv", "pos"], "left")
    texts = keyed(said).groupBy("conv", F.col("turn").alias("t_"), "role", "x").agg(F.first("text").alias("text"))
    d = d.join(texts, (d["conv"] == texts["conv"]) & F.col("turn").eqNullSafe(F.col("t_")) & (d["role"] == texts["role"]) & (d["x"] == texts["x"]), "left").select(d["conv"], "pos", "token", d["role"], "text")
    put = F.replace(F.replace(F.regexp_extract("token", "^[IJ]*", 0), F.lit("I"), F.lit("user:\n")), F.lit("J"), F.lit("assistant:\n"))
    letter = F.regexp_extract("token", "^[IJ]*([DKRS]?)", 1)
    who = F.when(letter == "K", F.col("role")).when(letter == "R", "user").when(letter == "S", "assistant")
    own = F.coalesce(F.concat(who, F.lit(":"), "text", F.lit("\n")), F.lit(""))
    lines = d.select("conv", "pos", F.concat(put, own).alias("lines")).where("lines <> ''")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "lines"))), lambda x: x["lines"]), "")
    return lines.groupBy("conv").agg(text.alias("t")).select("conv", F.expr("left(t, length(t) - 1)").alias("repaired"))


def repair(turns: DataFrame, damage: bool = True) -> DataFrame:
    """conv_id, counts of faults and gaps, cost, audit (the edits' initials) and the repaired text
    of every conversation; `damage` applies the contract's damage first.

    Null role or text: one space, which is blank; null conv_id: a conversation of its own; null
    turns come first and leave no gap. Rows of one turn are ordered by role, by the first HEAD characters of the text and by
    its sha256; equal rows
    are duplicates. Roles with other initials have to be changed or deleted. Empty and very long
    texts are rows as any other, other columns take no part, and an empty table has no rows.
    """
    ready(turns.sparkSession)
    said = damaged(turns) if damage else damaged_not(turns)
    rows = kept(ordered(faulty(said)))
    one = lambda c: c.cast("long")
    pair = F.concat("before", "initial")
    illegal = F.when(F.col("before").isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0) + F.col("n") - 1
    blank, again = F.col("blank"), F.col("again")
    counts = rows.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"),
        F.sum(F.when(blank, F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(blank, 0).when(again, F.col("n")).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(one(F.col("cut") & ~again & ~blank)).alias("truncated"),
        F.sum(illegal).alias("illegal"),
    )
    plans = kept(repaired(rows))
    audits = plans.select("conv", "cost", F.translate("plan", "JS|", "IR").alias("audit"))
    every = turns.select("conv_id").distinct().withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    out = every.join(counts, "conv", "left").join(audits, "conv", "left").join(edited(rows, plans, said), "conv", "left")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired", F.lit("")).alias("repaired"))


def damaged_not(turns: DataFrame) -> DataFrame:
    """The rows as they are, nulls as one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), text("role"), text("text"), F.lit(1).alias("n"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
