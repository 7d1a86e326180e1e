"""Readers: tables, line logs with error rows, journals, folders as tables, source registries."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    """One split of one source: where its files are, how they are written, which columns count.
    unused names path parts that are never read."""

    name: str
    split: str
    path: str
    format: str = "json"
    columns: tuple[str, ...] = ()
    multiline: bool = False
    unused: tuple[str, ...] = ()


def read(spark: SparkSession, s: Source) -> DataFrame:
    """The source's rows with source, split and path; a path without files is an error. gzip is
    seen by name; Parquet reads the named columns only."""
    r = spark.read.option("multiLine", str(s.multiline).lower()) if s.format == "json" else spark.read
    df = r.format(s.format).load(s.path)
    df = df.select("*", F.col("_metadata.file_path").alias("path"))
    for u in s.unused:
        df = df.where(~F.contains("path", F.lit(u)))
    if s.columns:
        df = df.select(*s.columns, "path")
    return df.select(F.lit(s.name).alias("source"), F.lit(s.split).alias("split"), "*")


@dataclass
class Registry:
    sources: list[Source] = field(default_factory=list)

    def rows(self, spark: SparkSession, name: str) -> DataFrame:
        """All splits of one source."""
        out = None
        for s in self.sources:
            if s.name == name:
                df = read(spark, s)
                out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        if out is None:
            raise KeyError(name)
        return out


def scanned(spark: SparkSession, path: str, line_end: str | None = None) -> DataFrame:
    """path, block, file_size, no, raw of the lines of text files: no rises through a block (the
    part of a file that one task reads), without a shuffle."""
    r = spark.read if line_end is None else spark.read.option("lineSep", line_end)
    t = r.text(path)
    facts = [F.col(f"_metadata.{a}").alias(b) for a, b in (("file_path", "path"), ("file_block_start", "block"), ("file_size", "file_size"))]
    return t.select(*facts, F.monotonically_increasing_id().alias("no"), F.col("value").alias("raw"))


def numbered(t: DataFrame) -> DataFrame:
    """`scanned` rows with line, from 0 in each file. Only counts of blocks, one row each, are
    summed and joined back."""
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("path", "block").agg(F.min("no").alias("first"), F.count("*").alias("n"))
    blocks = blocks.select("path", "block", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return t.join(blocks, ["path", "block"]).withColumn("line", F.col("no") + F.col("shift")).drop("shift")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line (from 0 in each file), raw and path of text files; blank lines are left out but keep
    their numbers."""
    return numbered(scanned(spark, path)).where(F.trim("raw") != "").select("line", "raw", "path")


def whole_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line, at, size, raw of the lines that \\n ends: at is a line's first byte in its file
    and size its bytes, so that it can be read alone. A last line without an end is torn and left
    out: with its missing end the lines are one byte more than the file."""
    t = numbered(scanned(spark, path, "\n")).withColumn("size", F.octet_length("raw").cast("long"))
    in_block = Window.partitionBy("path", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = t.withColumn("until", F.sum(F.col("size") + 1).over(in_block))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy("path", "block").agg(F.max("until").alias("bytes")).select("path", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("start"))
    t = t.join(blocks, ["path", "block"]).withColumn("until", F.col("start") + F.col("until"))
    return t.where(F.col("until") <= F.col("file_size")).select("path", "line", (F.col("until") - F.col("size") - 1).alias("at"), "size", "raw")


def read_at(index: DataFrame) -> DataFrame:
    """raw of (path, at, size) rows, read from their places in the files, without a scan. For
    files that Arrow's file systems can open."""

    def run(batches):
        from pyarrow import fs

        for b in batches:
            found = []
            for path, at, size in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                system, name = fs.FileSystem.from_uri(path)
                with system.open_input_file(name) as f:
                    found.append(f.read_at(size, at).decode())
            yield pa.record_batch([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "raw"])

    return index.select("path", "at", "size").mapInArrow(run, "path string, at long, size long, raw string")


def strict_records(raw: DataFrame, schema: str, key: str, required: tuple[str, ...] = (), start: int = 0) -> DataFrame:
    """(line, raw) -> line, error, record. The first row with a key wins and later ones are
    errors, also when reading resumes at `start`: earlier rows still count. Rows are errors too
    where they are no JSON object, lack a required field or have one the schema does not name."""
    known = F.array(*[F.lit(f.split(":")[0].strip().split(" ")[0]) for f in split_fields(schema)])
    parsed = raw.withColumn("record", F.from_json("raw", schema, {"mode": "PERMISSIVE"})).withColumn("names", F.json_object_keys("raw"))
    value = F.get_json_object("raw", f"$.{key}")
    sound = F.col("names").isNotNull() & value.isNotNull()
    seen = F.row_number().over(Window.partitionBy(F.when(sound, value), sound).orderBy("line"))
    missing = [F.get_json_object("raw", f"$.{r}").isNull() for r in (key, *required)]
    lacks = missing[0]
    for m in missing[1:]:
        lacks = lacks | m
    error = (
        F.when(F.try_parse_json("raw").isNull(), "invalid_json")
        .when(F.col("names").isNull(), "not_an_object")
        .when(lacks, "missing_field")
        .when(F.size(F.array_except("names", known)) > 0, "unknown_field")
        .when(sound & (seen > 1), "duplicate_id")
    )
    return parsed.withColumn("error", error).where(F.col("line") >= start).select("line", "error", F.when(F.col("error").isNull(), F.col("record")).alias("record"))


def split_fields(schema: str) -> list[str]:
    out, depth, part = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(part)
            part = ""
        else:
            part += c
    return [x.strip() for x in [*out, part] if x.strip()]


EVENT = "event_id string, seq bigint, ts double, type string, episode_id string, query_id string, payload string, schema_version string"


def journal(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Events and faults of an append-only log. A last line that was torn (it has no line end) is
    no event and no fault; a broken line elsewhere, a number that does not rise and a repeated
    event are faults, and the first event of an id stays."""
    each = whole_lines(spark, path).where("raw <> ''")
    e = each.withColumn("e", F.from_json("raw", EVENT)).withColumn("broken", F.try_parse_json("raw").isNull() | F.col("e.seq").isNull())
    order = Window.partitionBy("path").orderBy("line")
    e = e.withColumn("last_seq", F.max(F.when(~F.col("broken"), F.col("e.seq"))).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    e = e.withColumn("copy", F.row_number().over(Window.partitionBy("path", "e.event_id").orderBy("line")))
    fault = F.when(F.col("broken"), "corrupt_line").when(F.col("e.seq") <= F.col("last_seq"), "seq_not_rising").when(F.col("copy") > 1, "repeated_event")
    e = e.withColumn("fault", fault)
    return e.where("fault is null").select("path", "line", "e.*"), e.where("fault is not null").select("path", "line", "fault")


def committed(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Records of a log that counts only lines ended by \\n; the last record of a key stays."""
    r = whole_lines(spark, path).where("raw <> ''").select("path", "line", F.from_json("raw", schema).alias("r"))
    return r.groupBy(F.col(f"r.{key}").alias("key")).agg(F.max_by("r", F.struct("path", "line")).alias("r")).select("r.*")


def blob_references(events: DataFrame, payload: str = "payload") -> DataFrame:
    return events.select(F.explode(F.regexp_extract_all(F.col(payload), F.lit(r"sha256:([0-9a-f]{64})"), F.lit(1))).alias("digest")).distinct()


def missing_blobs(events: DataFrame, blobs: DataFrame, payload: str = "payload") -> DataFrame:
    """Digests that payloads name and no blob with these bytes has."""
    sound = blobs.where(F.col("digest") == F.sha2("bytes", 256))
    return blob_references(events, payload).join(sound, "digest", "left_anti")


def attempt_results(spark: SparkSession, run: str, schema: str) -> DataFrame:
    """calls/<rollout>/<attempt>/result.json as rows with rollout_id and attempt."""
    df = spark.read.schema(schema).option("multiLine", "true").json(f"{run}/calls/*/*/result.json")
    path = F.col("_metadata.file_path")
    return df.select("*", F.regexp_extract(path, r"/calls/([^/]+)/", 1).alias("rollout_id"), F.regexp_extract(path, r"/calls/[^/]+/([^/]+)/", 1).cast("int").alias("attempt"))


def runs(spark: SparkSession, pattern: str, kinds: tuple[str, ...] = ("rollout_run", "rollout_merge")) -> DataFrame:
    """Manifests of runs of these kinds, with where they stand."""
    df = spark.read.schema("kind string, run_id string, created_at string").option("multiLine", "true").json(pattern)
    return df.select("*", F.regexp_replace(F.col("_metadata.file_path"), "/manifest.json$", "").alias("run")).where(F.col("kind").isin(*kinds))


def by_difficulty_or_skills(df: DataFrame, difficulties: tuple[str, ...] = (), skills: tuple[str, ...] = (), skill_column: str = "skill_types") -> DataFrame:
    """Rows of some difficulties, or whose skills (a list written as a Python literal) meet the
    wanted ones; the text is parsed, never evaluated."""
    listed = F.regexp_extract_all(F.col(skill_column), F.lit(r"""['"]([^'"]*)['"]"""), F.lit(1))
    if difficulties:
        return df.where(F.col("difficulty").isin(*difficulties))
    return df.where(F.arrays_overlap(listed, F.array(*map(F.lit, skills)))) if skills else df


def resume_after(df: DataFrame, done: DataFrame, key: str = "line") -> DataFrame:
    """What a resumed reader still has to do."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def snapshot(df: DataFrame, path: str) -> DataFrame:
    """A read-only copy of a table at this moment."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
