"""Seeded orders, folds, keep-first, round-robin over strata, quotas and samples - all by hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import draw_key, unit_interval


def hash_order(df: DataFrame, seed: int, domain: str, key: str) -> DataFrame:
    """A global order that every engine repeats."""
    return df.orderBy(draw_key(seed, domain, F.col(key)), key)


def hash_sample(df: DataFrame, seed: int, domain: str, key: str, n: int) -> DataFrame:
    return hash_order(df, seed, domain, key).limit(n)


def reservoir(df: DataFrame, by: list[str], seed: int, key: str, n: int) -> DataFrame:
    """A uniform sample of n rows of each section: the n least hashes stand in for a reservoir."""
    w = Window.partitionBy(*by).orderBy(draw_key(seed, "reservoir", F.col(key)), key)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")


def held_out(key: Column, seed: int, fraction: float, domain: str = "holdout") -> Column:
    return unit_interval(draw_key(seed, domain, key)) < F.lit(fraction)


def keep_first(df: DataFrame, by: list[str], *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def turns(df: DataFrame, within: list[str], stratum: str, *order: Column | str) -> DataFrame:
    """Adds turn (from 0), a row's place in its stratum. Going round the strata takes rows by
    (turn, stratum); a row that is skipped later has used its turn."""
    w = Window.partitionBy(*within, stratum).orderBy(*order)
    return df.withColumn("turn", F.row_number().over(w) - 1)


def round_robin(df: DataFrame, within: list[str], stratum: str, target: int, *order: Column | str) -> DataFrame:
    """The first `target` rows of each source, round its strata, with their position. A row of a
    later turn than `target` has so many before it; ranks are cut in each task before rows meet."""
    first = Window.partitionBy(*within, stratum).orderBy(*order)
    d = df.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= target)
    w = Window.partitionBy(*within).orderBy("turn", stratum)
    d = d.withColumn("position", F.row_number().over(w)).where(F.col("position") <= target)
    return d.withColumn("turn", F.col("turn") - 1).withColumn("position", F.col("position") - 1)


def batches(df: DataFrame, source: str, position: str, size: int, need: dict[str, int]) -> DataFrame:
    """The next batch: round the sources in their order, each at most what it still needs."""
    names = F.array(*map(F.lit, need))
    wanted = F.element_at(F.create_map(*[x for k, v in need.items() for x in (F.lit(k), F.lit(min(v, size)))]), F.col(source))
    rank = F.row_number().over(Window.partitionBy(source).orderBy(position))
    d = df.where(F.col(source).isin(*need)).withColumn("turn", rank).where(F.col("turn") <= wanted)
    return d.withColumn("source_place", F.array_position(names, F.col(source))).orderBy("turn", "source_place").limit(size)


def quota(df: DataFrame, by: str, n: Column | int, *order: Column | str) -> DataFrame:
    """The first n rows of each group; what was filtered before takes no place."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
