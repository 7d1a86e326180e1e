"""Writers: whole or not at all, content-addressed, with manifests, and guarded replacement."""

from __future__ import annotations

import json
import os
import re
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def filesystem(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def replace_whole(df: DataFrame, path: str, format: str = "parquet", **options: str) -> None:
    """Written beside the target, then put in its place by two renames. Between them no table is
    there: where readers must never miss it, use `versions.Table`."""
    spark, beside = df.sparkSession, f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.format(format).options(**options).save(beside)
    fs, target = filesystem(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.old")
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"could not put {path} aside; it is as it was, the new rows are in {beside}")
    if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(beside), target):
        fs.rename(aside, target)
        raise OSError(f"could not put {path} in place")
    fs.delete(aside, True)


def append(df: DataFrame, path: str, compression: str = "zstd") -> None:
    df.write.mode("append").option("compression", compression).parquet(path)


def put_blobs(blobs: DataFrame, path: str) -> DataFrame:
    """(bytes) -> stored by digest once; a second put of the same bytes writes nothing. Of what is
    stored only the shards that new digests fall into are read, and of these the digests."""
    spark = blobs.sparkSession
    new = blobs.select(F.sha2("bytes", 256).alias("digest"), "bytes").withColumn("shard", F.left("digest", F.lit(2))).dropDuplicates(["digest"])
    fs, p = filesystem(spark, path)
    if fs.exists(p):
        shards = [r["shard"] for r in new.select("shard").distinct().collect()]  # 256 at most
        there = spark.read.schema("digest string, bytes binary, shard string").parquet(path).where(F.col("shard").isin(shards))
        new = new.join(there.select("shard", "digest"), ["shard", "digest"], "left_anti")
    new.write.mode("append").partitionBy("shard").parquet(path)
    return spark.read.schema("digest string, bytes binary, shard string").parquet(path)


def digest_sums(df: DataFrame) -> list[Column]:
    """rows, a, b: a count and two seeded sums of row hashes, whatever the order of the rows."""
    row = F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})
    return [F.count(F.lit(1)).alias("rows"), *[F.sum(F.xxhash64(F.lit(i), row).cast("decimal(38,0)")).alias(n) for i, n in ((1, "a"), (2, "b"))]]


def table_digest(df: DataFrame) -> DataFrame:
    """rows and an order-free digest of a table: the sums of row hashes, twice seeded."""
    return df.agg(*digest_sums(df)).select("rows", F.sha2(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("a", "b")]), 256).alias("digest"))


def export(tables: dict[str, DataFrame], path: str, formats: tuple[str, ...] = ("json", "parquet"), **facts) -> dict:
    """Each table in each format under path, and export.json with rows and digests."""
    report: dict = {"files": {}, **facts}
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        r = table_digest(df).first()
        for f in formats:
            replace_whole(df, f"{path}/{name}.{f}", f)
            report["files"][f"{name}.{f}"] = {"rows": r["rows"], "digest": r["digest"]}
    fs, p = filesystem(spark, f"{path}/export.json")
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(report, sort_keys=True, ensure_ascii=False).encode()))
    out.close()
    return report


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as multisets of rows."""
    return a.exceptAll(b.select(*a.columns)).isEmpty() and b.select(*a.columns).exceptAll(a).isEmpty()


def clean_and_replace(spark: SparkSession, path: str, keep, apply: bool = False) -> dict:
    """keep(df) -> df: a dry run by default. Applied, the old table is kept as backup, the new one
    is written aside, read again and compared (rows and digest, observed while it was written),
    and only then put in place."""
    before = spark.read.parquet(path)
    after = keep(before)
    if not apply:
        return {"before": before.count(), "after": after.count(), "applied": False}
    mark = uuid.uuid4().hex
    staged, backup = f"{path}.{mark}.staged", f"{path}.{mark}.backup"
    told = Observation(f"written-{mark}")
    after.observe(told, *digest_sums(after)).write.parquet(staged)
    back = spark.read.parquet(staged)
    if back.agg(*digest_sums(back)).first().asDict() != told.get:
        raise ValueError("the staged copy differs from what was to be written")
    fs, target = filesystem(spark, path)
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.rename(target, path_of(backup)):
        raise OSError(f"could not put {path} aside; it is as it was, the new rows are in {staged}")
    if not fs.rename(path_of(staged), target):
        fs.rename(path_of(backup), target)
        raise OSError("replacement failed; the old table is back")
    return {"before": spark.read.parquet(backup).count(), "after": told.get["rows"], "applied": True, "backup": backup}


def place_of(path: str) -> str:
    """One name for a place, however it is written: with its scheme, absolute, without . and .."""
    scheme, rest = path.split(":", 1) if re.match(r"[a-zA-Z][\w+.-]*:/", path) else ("file", os.path.abspath(path))
    host, at = re.match(r"(//[^/]*)?(.*)", rest, re.S).groups()
    return f"{scheme.lower()}:{(host or '//').lower()}{os.path.normpath('/' + at.lstrip('/'))}".rstrip("/")


def guard(output: str, *sources: str) -> None:
    """Refuse to write over, into or around a source."""
    out = place_of(output)
    for s in map(place_of, sources):
        if f"{out}/".startswith(f"{s}/") or f"{s}/".startswith(f"{out}/"):
            raise ValueError(f"{output} would overwrite {s}")
