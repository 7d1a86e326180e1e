"""Profiles: summaries, shares, histograms, thresholds, longest rows, distribution of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Blocks, beside, joined, quantiles

QUANTILES = (("min", 0.0), ("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99), ("max", 1.0))


def summary(df: DataFrame, by: list[str], value: str, prefix: str = "") -> DataFrame:
    """n, mean and exact, linearly interpolated quantiles of each group."""
    g = quantiles(df, by, value, [p for _, p in QUANTILES])
    mean = df.groupBy(*by).agg(F.avg(value).alias(f"{prefix}mean"))
    return joined(g, mean, by).select(*by, F.col("n").alias(f"{prefix}n"), f"{prefix}mean", *[F.get("q", i).alias(f"{prefix}{n}") for i, (n, _) in enumerate(QUANTILES)])


def source_profile(df: DataFrame, source: str, size: str, row: str) -> DataFrame:
    """Per source: the summary of size, its share of rows and of characters, first and last row."""
    base = beside(summary(df, [source], size), F.sum("n").alias("__rows"))
    more = df.groupBy(source).agg(F.sum(size).alias("chars"), F.min(row).alias("first_row"), F.max(row).alias("last_row"))
    more = beside(more, F.sum("chars").alias("__chars"))
    both = joined(base, more, [source])
    return both.withColumn("char_share", F.col("chars") / F.col("__chars")).withColumn("fraction", F.col("n") / F.col("__rows")).drop("__rows", "__chars")


def frequencies(df: DataFrame, by: list[str], item: Column) -> DataFrame:
    """Counts of an item, which may be exploded from an array."""
    return df.select(*by, item.alias("item")).groupBy(*by, "item").agg(F.count("*").alias("count"))


def map_keys(df: DataFrame, by: list[str], json: str) -> DataFrame:
    return frequencies(df, by, F.explode(F.json_object_keys(json)))


def over_thresholds(df: DataFrame, by: list[str], value: str, limits: list[int]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.count_if(F.col(value) > n).alias(f"over_{n}") for n in limits])


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts in bins (edge, next edge]; values outside count nowhere."""
    x, bin_ = F.col(value), F.lit(None).cast("int")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        bin_ = F.when((x > a) & (x <= b), i).otherwise(bin_)
    return df.select(bin_.alias("bin")).where("bin is not null").groupBy("bin").agg(F.count("*").alias("count"))


def differences(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select((F.col(a) - F.col(b)).alias("difference")).groupBy("difference").agg(F.count("*").alias("count"))


def longest(df: DataFrame, size: str, row: str, n: int = 10) -> DataFrame:
    """The n longest rows, equal ones in input order."""
    return df.orderBy(F.desc(size), row).limit(n)


def most_common(df: DataFrame, item: str, n: int = 10) -> DataFrame:
    return df.groupBy(item).agg(F.count("*").alias("count")).orderBy(F.desc("count"), item).limit(n)


def rollup(df: DataFrame, by: list[str], size: str) -> DataFrame:
    """Subtotals by all prefixes of the keys; level tells which keys are summed over."""
    return df.rollup(*by).agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.sum(size).alias("chars"))


def cumulative(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds ecdf, the share of its group's rows that are up to each row's value."""
    c = df.groupBy(*by, value).agg(F.count("*").alias("__n"))
    upto = Blocks(c, by, [value]).scan(sums={"__upto": F.col("__n")}).frame()
    whole = c.groupBy(*by).agg(F.sum("__n").alias("__whole"))
    share = joined(upto, whole, by).select(*by, value, (F.col("__upto") / F.col("__whole")).alias("ecdf"))
    return joined(df, share, [*by, value])


def page(df: DataFrame, order: list[str], offset: int, n: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(n)


def text_page(text: Column, offset: int, n: int) -> Column:
    return F.substring(text, offset + 1, n)


def next_position(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.coalesce(F.max(column), F.lit(-1)) + 1).alias("next_position"))
