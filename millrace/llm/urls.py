"""URL filters: host-suffix and path-prefix expressions against rules, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ready

#: Rules up to so many, of so many bytes together, are broadcast; more are dealt by their hash, each
#: to SALTS places.
FEW, FEW_BYTES = 100_000, 16 << 20
SALTS = 32
ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """host and path of a URL as the contract has them; both empty for null or without `://`."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), ASCII_UPPER, ASCII_LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (host, path, verdict) as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def short(digest: Column) -> Column:
    """The first 32 bits of a hex digest: the key of the join."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row a page: key, host, path, rule, verdict.

    A rule fits its host and the host's subdomains where the path starts with the rule's path. Of
    the rules that fit, the one whose host and path are longest together wins, then the longer
    host; `block` goes before `allow` where the same rule is given twice. Without a rule, rule is
    null and the verdict is the default. Each URL becomes expressions of the shapes that rules
    have (so many host labels, so long a path); they meet the rules on 32 bits of a digest, and
    the whole digest confirms. Rows with equal or null keys stay rows of their own.
    """
    ready(pages.sparkSession)
    made = rules.where("host is not null and path is not null").withColumn("digest", F.sha2(F.concat_ws("\n", "host", "path"), 256))
    shapes = made.agg(F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 200), F.lit(0)).alias("bytes")), F.array_sort(F.collect_set(F.size(F.split("host", r"\.")))), F.array_sort(F.collect_set(F.length("path")))).first()
    count, labels, lengths = shapes[0], shapes[1] or [1], shapes[2] or [0]
    best = F.struct(F.length(F.concat("host", "path")).alias("a"), F.length("host").alias("b"), F.col("verdict").isin("block").alias("c"), F.concat("host", "path").alias("rule"), "verdict")
    made = made.groupBy("digest").agg(F.max(best).alias("best")).select(F.col("digest").alias("rule_digest"), short(F.col("digest")).alias("rule_key"), "best")
    host, path = url_parts(F.col(url))
    p = pages.select(F.col(key).alias("key"), host.alias("host"), path.alias("path")).withColumn("row", F.monotonically_increasing_id())
    n = F.size(F.split("host", r"\."))
    hosts = F.transform(F.filter(F.lit(labels), lambda x: x <= n), lambda x: F.array_join(F.slice(F.split("host", r"\."), -x, x), "."))
    paths = F.transform(F.filter(F.lit(lengths), lambda x: x <= F.length("path")), lambda x: F.left(F.col("path"), x))
    expressions = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda q: F.sha2(F.concat_ws("\n", h, q), 256))))
    e = p.withColumn("digest", F.explode_outer(expressions)).withColumn("url_key", short(F.col("digest")))
    on = (F.col("url_key") == F.col("rule_key")) & (F.col("digest") == F.col("rule_digest"))
    if count["n"] <= FEW and count["bytes"] <= FEW_BYTES:
        e = e.join(F.broadcast(made), on, "left")
    else:
        made = made.withColumn("rule_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        e = e.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(made, on & (F.col("salt") == F.col("rule_salt")), "left")
    found = e.groupBy("row", "key", "host", "path").agg(F.max("best").alias("best"))
    return found.select(F.col("key").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
