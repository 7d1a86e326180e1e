"""Connected components of a table of links, by alternating stars (Kiveris et al. 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept


def components(links: DataFrame) -> DataFrame:
    """v, component (the smallest node that v reaches) of all nodes in links (a, b).

    Each round is joins and aggregates of the links, which shrink towards stars; nothing is
    gathered but a count and a checksum, and each round's links are written to the checkpoint
    folder. A node with very many links meets its minimum in a join that Spark can split.
    """
    seen = [F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))]
    edges = kept(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).distinct())
    state = edges.agg(*seen).first()
    while True:
        both = edges.unionByName(edges.select(F.col("m").alias("v"), F.col("v").alias("m")))
        least = both.groupBy("v").agg(F.min("m").alias("x")).select(F.col("v").alias("u"), F.least("v", "x").alias("x"))
        large = both.where("m > v").join(least, F.col("v") == F.col("u")).select(F.col("m").alias("v"), F.col("x").alias("m"))
        large = large.unionByName(least.where("x < u").select(F.col("u").alias("v"), F.col("x").alias("m"))).distinct()
        least = large.groupBy("v").agg(F.min("m").alias("x")).withColumnRenamed("v", "u")
        small = large.join(least, F.col("v") == F.col("u"))
        edges = small.select(F.col("m").alias("v"), F.col("x").alias("m")).unionByName(least.select(F.col("u").alias("v"), F.col("x").alias("m")))
        edges = kept(edges.where("v <> m").distinct())
        now = edges.agg(*seen).first()
        if now == state:
            break
        state = now
    nodes = edges.select("v", F.col("m").alias("component"))
    return nodes.unionByName(edges.select(F.col("m").alias("v"), F.col("m").alias("component")).distinct())
