"""Structured Streaming editions: idempotent commits, dedupe, keyed states, windows over events."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, schema, format: str = "parquet", files: int = 100) -> DataFrame:
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", files).load(path)


def commit_once(results: str, key: str, work: Callable[[DataFrame], DataFrame], parts: int = 256) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: rows whose key is committed already are left out, the others are
    worked and appended. A batch that is run again so changes nothing.

    Results are partitioned by `key_part`, a hash of the key, and a batch reads the keys of its own
    parts only: its cost grows with the batch, as long as that has fewer keys than there are parts.
    """
    part = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int")

    def run(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        p = spark._jvm.org.apache.hadoop.fs.Path(results)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            touched = [r["p"] for r in batch.select(part.alias("p")).distinct().collect()]  # `parts` numbers at most
            new = new.join(spark.read.parquet(results).where(F.col("key_part").isin(touched)).select(key), key, "left_anti")
        work(new).withColumn("key_part", part).write.mode("append").partitionBy("key_part").parquet(results)

    return run


def changed_positions(inputs: DataFrame, results: DataFrame, position: str, digest: str) -> DataFrame:
    """Committed positions whose input is another one now: such a run must not go on."""
    r = results.select(position, F.col(digest).alias("__old"))
    return inputs.join(r, position).where(~F.col(digest).eqNullSafe(F.col("__old"))).select(position)


def first_of_id(stream: DataFrame, key: str, time: str | None = None, keep: str = "1 day") -> DataFrame:
    """The first row of each key. State grows with the keys, as exactness needs; with a time
    column it is kept for `keep`, and a repeat that is later than that counts as new."""
    if time is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(time, keep).dropDuplicatesWithinWatermark([key])


#: What each state of an episode may become.
STEPS = {"new": ("planning", "failed"), "planning": ("testing", "failed"), "testing": ("planning", "done", "failed"), "done": (), "failed": ()}


def episode_states(stream: DataFrame, steps: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(episode_id, seq, to_state) -> each episode's state after a batch, the steps that were taken
    and those refused as not allowed."""
    allowed = {k: set(v) for k, v in (steps or STEPS).items()}

    def step(key: tuple, batches, state: GroupState):
        now, taken, refused = state.get if state.exists else ("new", 0, 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        for to in rows["to_state"]:
            if to in allowed.get(now, ()):
                now, taken = to, taken + 1
            else:
                refused += 1
        state.update((now, taken, refused))
        yield pd.DataFrame({"episode_id": [key[0]], "state": [now], "taken": [taken], "refused": [refused]})

    kind = stream.schema["episode_id"].dataType.simpleString()
    return stream.groupBy("episode_id").applyInPandasWithState(step, f"episode_id {kind}, state string, taken long, refused long", "state string, taken long, refused long", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, width: str, slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums in tumbling or sliding windows of event time, batch or stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    g = e.groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: tuple[str, ...] = ("user_id",), late: str = "1 hour") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    g = e.groupBy(F.session_window("ts", gap), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs over all that is there now and returns what came out (for tests and small jobs)."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def joined_chunks(stream_rows: DataFrame, key: str, order: str, chunk: str) -> DataFrame:
    """Chunks of one body in order, before events are cut out of it."""
    return stream_rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, chunk))), lambda x: x[chunk]), "").alias("body"))


def late_responses(responses: DataFrame, cursors: DataFrame) -> DataFrame:
    """Responses that came after their history moved on: kept, but never a target."""
    return responses.join(cursors, "episode_id", "left").withColumn("is_target", F.col("history_position") >= F.coalesce("cursor", F.lit(0)))
