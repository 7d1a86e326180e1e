"""Streams with a clock: episodes that end, and calls that wait for their responses.

State goes when its time is over by the watermark, so that it is bounded by what is under way and
not by all that ever came.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..session import PART_ROWS, scratch
from .streams import STEPS

#: State in RocksDB; a commit writes what has changed, and a join's state is one store a part, not four.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.join.stateFormatVersion": "3",
}


@dataclass
class Feed:
    """A stream that is fed in chunks and whose query is started anew for each, on one checkpoint:
    what a scheduled job does. `progress` has the state rows after each start."""

    spark: SparkSession
    schema: T.StructType
    folder: str = ""
    chunks: int = 0
    progress: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.folder = self.folder or scratch(self.spark)

    def put(self, df: DataFrame) -> None:
        """Adds a chunk; nothing is read before the next start."""
        df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema]).write.parquet(f"{self.folder}/in/chunk={self.chunks:06d}")
        self.chunks += 1

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/in").select(*self.schema.names)


def run_once(stream: DataFrame, checkpoint: str, into: str, mode: str = "append", progress: list[int] | None = None, parts: int | None = None) -> None:
    """One start over all that is new, after which watermarks move on and what they end comes out.
    Each micro-batch goes to a folder of its own, which a repeated batch writes again. A new
    checkpoint has its state in so many parts, each with files of its own for every micro-batch;
    an old one keeps its number."""

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{into}/batch={batch}")

    spark = stream.sparkSession
    asked = STATE | ({"spark.sql.shuffle.partitions": str(parts)} if parts else {})
    before = {k: spark.conf.get(k, None) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    if progress is not None and q.lastProgress:
        progress.append(sum(s["numRowsTotal"] for s in q.lastProgress["stateOperators"]))


#: Buckets of episodes in each part of the state.
BUCKETS = 64


def parts_for(df: DataFrame) -> int:
    """Parts of the state of a stream of so many rows: a few for each core."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cores * max(1, -(-df.count() // (PART_ROWS * cores)))


# Episodes


class EpisodeSteps(StatefulProcessor):
    """Takes the steps that are allowed, counts those that are not, and drops an episode `keep`
    milliseconds after a step that ends it, or `idle` ones after the last step of one that does not
    end. A sequence number that comes twice counts once.

    Episodes are dealt to buckets. A bucket's state has a row for each of its episodes, with the
    numbers that were heard and the time when it goes, and one timer, for the first that goes: so
    a bucket asks for its state once a batch, and not several times for each episode."""

    def __init__(self, key: str, kind: str, steps: dict[str, tuple[str, ...]], keep: int, idle: int | None):
        self.key, self.kind, self.keep, self.idle = key, kind, keep, idle
        self.allowed = {k: set(v) for k, v in steps.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        row = f"k: {self.kind}, state: string, taken: long, refused: long, until: long, heard: array<long>"
        self.now = handle.getValueState("now", f"episodes array<struct<{row}>>, timer long")

    def known(self) -> tuple[dict, int | None]:
        """Episodes with state, taken, refused, until and heard, and the time of the bucket's timer."""
        told = self.now.get() if self.now.exists() else None
        return ({k: r for k, *r in told[0]}, told[1]) if told else ({}, None)

    def put(self, episodes: dict, timer: int | None) -> None:
        """Writes the state, and moves the timer to the first time at which an episode goes."""
        first = min((r[3] for r in episodes.values() if r[3] is not None), default=None)
        if first != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if episodes:
            self.now.update(([(k, *r) for k, r in episodes.items()], first))
        else:
            self.now.clear()

    def rows(self, episodes: dict, expired: bool) -> pd.DataFrame:
        state, taken, refused = zip(*(r[:3] for r in episodes.values()), strict=True)
        return pd.DataFrame({self.key: pd.Series(list(episodes), dtype=object), "state": state, "taken": taken, "refused": refused, "expired": expired})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        episodes, timer = self.known()
        steps = pd.concat(list(rows)).sort_values("seq", kind="stable")
        touched, heard, last = {}, {}, {}
        for k, seq, to, ms in zip(*(steps[c].tolist() for c in (self.key, "seq", "to_state", "ms")), strict=True):
            if k not in touched:
                touched[k] = list(episodes.get(k, ("new", 0, 0, None, [])))
                heard[k] = dict.fromkeys(touched[k][4])
            last[k] = max(ms, last.get(k, ms))
            if seq in heard[k]:
                continue
            heard[k][seq] = None
            now = touched[k]
            if to in self.allowed.get(now[0], ()):
                now[0], now[1] = to, now[1] + 1
            else:
                now[2] += 1
        for k, now in touched.items():
            over = not self.allowed.get(now[0])
            now[3] = last[k] + (self.keep if over else self.idle) if over or self.idle is not None else None
            now[4] = list(heard[k])
        self.put(episodes | touched, timer)
        yield self.rows(touched, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        episodes, timer = self.known()
        at = timerValues.getCurrentWatermarkInMs()
        gone = {k: r for k, r in episodes.items() if r[3] is not None and r[3] <= at}
        self.put({k: r for k, r in episodes.items() if k not in gone}, None if timer == expiredTimerInfo.getExpiryTimeInMs() else timer)
        if gone:
            yield self.rows(gone, True)

    def close(self) -> None:
        pass


def episodes(stream: DataFrame, key: str = "episode_id", late: str = "0 seconds", keep: int = 3_600_000, idle: int | None = None, steps: dict[str, tuple[str, ...]] | None = None, buckets: int = 256) -> DataFrame:
    """(key, seq, to_state, ts) -> key, state, taken, refused, expired: a row for each episode that a
    batch touches, and a last one when its state goes. Steps older than the watermark are dropped;
    an episode that is heard of again after it went begins anew. A checkpoint keeps its number of buckets."""
    kind = stream.schema[key].dataType.simpleString()
    s = stream.select(F.col(key), F.col("seq").cast("long").alias("seq"), "to_state", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    s = s.withColumns({"ms": F.unix_millis("ts"), "__bucket": F.pmod(F.xxhash64(key), F.lit(buckets))})
    out = f"{key} {kind}, state string, taken long, refused long, expired boolean"
    return s.groupBy("__bucket").transformWithStateInPandas(EpisodeSteps(key, kind, steps or STEPS, keep, idle), out, "update", "EventTime")


def latest(out: DataFrame, key: str = "episode_id") -> DataFrame:
    """Of what `run_once` wrote, the last row of each key."""
    rest = [c for c in out.columns if c not in (key, "batch")]
    last = F.max_by(F.struct(*rest), F.struct("batch", *(["expired"] if "expired" in rest else [])))
    return out.groupBy(key).agg(last.alias("r")).select(key, "r.*")


# Calls and responses


def answered(calls: DataFrame, responses: DataFrame, within: str, late: str = "0 seconds") -> DataFrame:
    """call_id, response_id, call_ts, response_ts, status, is_target of two streams (call_id, ts) and
    (response_id, call_id, ts), each with a watermark.

    A response meets its call if it comes within that time of it: answered, and a target. A call
    without one is unanswered, a response whose time was over (or whose call is unknown) is late;
    both come out once the watermark says that nothing can meet them, and neither is a target.
    State on either side goes with the watermark. Null call ids meet nothing.
    """
    c = calls.select(F.col("call_id").alias("call_id"), F.col("ts").cast("timestamp").alias("call_ts")).withWatermark("call_ts", late)
    r = responses.select("response_id", F.col("call_id").alias("of"), F.col("ts").cast("timestamp").alias("response_ts")).withWatermark("response_ts", late)
    on = (F.col("call_id") == F.col("of")) & (F.col("response_ts") >= F.col("call_ts")) & (F.col("response_ts") <= F.col("call_ts") + F.expr(f"INTERVAL {within}"))
    status = F.when(F.col("response_ts").isNull(), "unanswered").when(F.col("call_ts").isNull(), "late").otherwise("answered")
    j = c.join(r, on, "full_outer")
    return j.select(F.coalesce("call_id", "of").alias("call_id"), "response_id", "call_ts", "response_ts", status.alias("status"), (status == "answered").alias("is_target"))


def in_chunks(df: DataFrame, ts: str, n: int, whole: str | None = None) -> list[DataFrame]:
    """The rows in n spans of time, one after another. With `whole`, a unit of date_trunc, no such
    unit of time (a day, say) is cut in two; some spans may then be empty."""
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    if low is None:
        return [df]
    width = (high - low) / n
    edges = [low + width * i for i in range(1, n)]
    edges = [F.date_trunc(whole, F.lit(x)) if whole else F.lit(x) for x in edges]
    bounds = [None, *edges, None]
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        d = df if a is None else df.where(F.col(ts) >= a)
        out.append(d if b is None else d.where(F.col(ts) < b))
    return out
