"""Running sums, maxima and previous rows within a key, however many rows the key has.

Rows are dealt by ranges of (key, order) into blocks, so that a key with a third of all rows covers
many blocks. Each block scans its own rows; what the blocks before it add to a key (the carry) comes
from one row for each block and key, and only a block's first key can have begun before it. So no
task holds more than a block, and what is broadcast is one row for each block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import kept

BLOCK, TIE, ROW = "__block", "__tie", "__row"


class Blocks:
    """Rows in blocks, to which `scan` adds columns.

    `order` (columns, ascending with nulls first, or Columns such as F.desc) should be total; rows
    that tie in it come in the order of a hash of the row, and rows equal in all columns are alike.
    `deal` may name shorter columns to deal the rows by, in the same order as `order` (the first
    characters of a text, say). The blocks are written to the checkpoint folder once, as their
    bounds are drawn from a sample.
    """

    def __init__(self, df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], parts: int | None = None, deal: Sequence[Column | str] | None = None):
        parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        hashed = [c for c, kind in df.dtypes if "map<" not in kind and kind != "variant"]
        df = df.withColumn(TIE, F.xxhash64(*hashed))
        self.keys, self.order = list(keys), [*order, TIE]
        by = [*self.keys, *(deal or self.order)]
        self.rows = kept(df.repartitionByRange(parts, *by).withColumn(BLOCK, F.spark_partition_id()))

    def scan(self, sums: dict[str, Column] | None = None, maxima: dict[str, Column] | None = None, lags: dict[str, Column] | None = None) -> Blocks:
        """Adds running sums and maxima, own row included, and values of the row before."""
        sums, maxima, lags = sums or {}, maxima or {}, lags or {}
        local = Window.partitionBy(BLOCK, *self.keys).orderBy(*self.order)
        upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        state = {f"__s_{n}": F.sum(c).over(upto) for n, c in sums.items()} | {f"__m_{n}": F.max(c).over(upto) for n, c in maxima.items()}
        state |= {f"__l_{n}": c for n, c in lags.items()}
        rows = self.rows.withColumns(state)
        rows = rows.withColumns({ROW: F.row_number().over(local)} | {f"__p_{n}": F.lag(f"__l_{n}").over(local) for n in lags})
        # the state after a block's last row of a key is what that block adds to it
        added = rows.groupBy(BLOCK, *self.keys).agg(F.max_by(F.struct(F.lit(1).alias("there"), *state), ROW).alias("t")).select(BLOCK, *self.keys, "t.*")
        blocks = Window.partitionBy(*self.keys).orderBy(BLOCK)
        before = blocks.rowsBetween(Window.unboundedPreceding, -1)
        carry = {c: F.sum(c).over(before) if c.startswith("__s_") else F.max(c).over(before) if c.startswith("__m_") else F.lag(c).over(blocks) for c in state}
        carry = added.select(BLOCK, *self.keys, F.lag("there").over(blocks).alias("there"), *[e.alias(c) for c, e in carry.items()]).where("there = 1")
        carry = carry.select(F.col(BLOCK).alias("__b"), *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(self.keys)], *[F.col(c).alias(f"{c}_before") for c in state])
        on = F.col(BLOCK) == F.col("__b")
        for i, k in enumerate(self.keys):
            on &= F.col(k).eqNullSafe(F.col(f"__k_{i}"))
        rows = rows.join(F.broadcast(carry), on, "left")  # a row for each block at most
        told = {n: F.coalesce(F.col(f"__s_{n}") + F.col(f"__s_{n}_before"), F.col(f"__s_{n}"), F.col(f"__s_{n}_before")) for n in sums}
        told |= {n: F.greatest(f"__m_{n}", f"__m_{n}_before") for n in maxima}
        told |= {n: F.when(F.col(ROW) == 1, F.col(f"__l_{n}_before")).otherwise(F.col(f"__p_{n}")) for n in lags}
        out = object.__new__(Blocks)
        out.keys, out.order = self.keys, self.order
        out.rows = rows.select(*self.rows.columns, *[e.alias(n) for n, e in told.items()])
        return out

    def add(self, **columns: Column) -> Blocks:
        """Adds columns made of a row's own."""
        out = object.__new__(Blocks)
        out.keys, out.order, out.rows = self.keys, self.order, self.rows.withColumns(columns)
        return out

    def frame(self) -> DataFrame:
        return self.rows.drop(BLOCK, TIE)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str, parts: int | None = None) -> DataFrame:
    """Adds each row's number within its key, from 1."""
    return Blocks(df, keys, order, parts).scan(sums={name: F.lit(1).cast("long")}).frame()


def joined(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on columns of one name, in which null meets null."""
    right = right.withColumnsRenamed({c: f"__on_{c}" for c in on})
    same = F.lit(True)
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"__on_{c}"))
    return left.join(right, same, how).drop(*[f"__on_{c}" for c in on])


def beside(df: DataFrame, *totals: Column) -> DataFrame:
    """The rows with sums over all of them beside: the one row of sums is joined, no task sees all."""
    one = df.agg(*totals).withColumn("__one", F.lit(1))
    return df.withColumn("__one", F.lit(1)).join(F.broadcast(one), "__one").drop("__one")


#: Spans of values with more rows than this are cut into so many bins again; smaller ones are sorted.
SORTED, BINS = 100_000, 4096
#: Spans are broadcast up to so many.
FEW_SPANS = 100_000


def quantiles(df: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """by, n, q: exact quantiles of each group's numbers, interpolated between the two nearest.

    Each rank that is asked for is narrowed down: a pass counts a span's values in bins and keeps
    the bins that hold such a rank, until a span has one value only or rows few enough to sort.
    No task ever holds more than that, or a row for each bin. Nulls and what is no finite number
    do not count; a group without numbers has n 0 and null quantiles.
    """
    by = list(by)
    base = df.select(*by, F.col(value).alias("__x")).where(F.abs(F.col("__x").cast("double")) < F.lit(float("inf")))
    size = base.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    place = [(F.col("__n") - 1) * F.lit(float(p)) for p in shares]
    ranks = F.array_distinct(F.array(*[f(p).cast("long") for p in place for f in (F.floor, F.ceil)]))
    size = kept(size.withColumn("__ranks", ranks))
    spans = size.select(*by, "__lo", "__hi", F.lit(0).cast("long").alias("__below"), F.col("__n").alias("__c"), "__ranks")
    found = []
    while True:
        found.append(spans.where("__lo = __hi").select(*by, F.explode("__ranks").alias("__r"), F.col("__lo").alias("__v")))
        spans = spans.where("__lo < __hi")
        few, most = spans.agg(F.count("*"), F.coalesce(F.max("__c"), F.lit(0))).first()
        if not few:
            break
        small = F.broadcast(spans) if few <= FEW_SPANS else spans
        rows = joined(base, small, by).where("__x BETWEEN __lo AND __hi")
        if most <= SORTED:
            w = Window.partitionBy(*by, "__lo").orderBy("__x")
            at = rows.withColumn("__r", F.col("__below") + F.row_number().over(w) - 1).where(F.array_contains("__ranks", F.col("__r")))
            found.append(at.select(*by, "__r", F.col("__x").alias("__v")))
            break
        less = lambda x, y: F.col(x).cast("double") / 2 - F.col(y).cast("double") / 2  # noqa: E731  halves: no overflow
        if isinstance(base.schema["__x"].dataType, T.IntegralType):  # differences first: large numbers side by side differ as doubles too
            exact = lambda x, y: F.coalesce(F.try_subtract(x, y).cast("double") / 2, less(x, y))
        else:
            exact = less
        share = F.try_divide(exact("__x", "__lo"), exact("__hi", "__lo"))
        bin_ = F.coalesce(F.least(F.lit(BINS - 1), F.floor(share * BINS)), (F.col("__x") > F.col("__lo")).cast("long"))
        cut = rows.groupBy(*by, "__below", F.col("__lo").alias("__of"), bin_.alias("__bin")).agg(F.first("__ranks").alias("__ranks"), F.count("*").alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
        w = Window.partitionBy(*by, "__of").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        cut = cut.withColumn("__below", F.col("__below") + F.sum("__c").over(w) - F.col("__c"))
        cut = cut.withColumn("__ranks", F.filter("__ranks", lambda r: (r >= F.col("__below")) & (r < F.col("__below") + F.col("__c"))))
        spans = kept(cut.where(F.size("__ranks") > 0).select(*by, "__lo", "__hi", "__below", "__c", "__ranks"))
    values = found[0]
    for f in found[1:]:
        values = values.unionByName(f)
    told = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__at")) if by else values.agg(F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__at"))
    g = joined(size, told, by)
    at = lambda r: F.element_at("__at", r.cast("long")).cast("double")
    mixed = [F.when(F.floor(p) == F.ceil(p), at(p)).otherwise((F.ceil(p) - p) * at(F.floor(p)) + (p - F.floor(p)) * at(F.ceil(p))) for p in place]
    q = g.select(*by, F.col("__n").alias("n"), F.array(*mixed).alias("q"))
    every = df.select(*by).distinct() if by else df.agg(F.lit(1).alias("__g")).select()
    return joined(every, q, by, "left").select(*by, F.coalesce("n", F.lit(0)).cast("long").alias("n"), "q")
