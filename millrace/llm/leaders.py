"""Leaderboard change feed: who enters, leaves or moves on each nation's board of best-selling items.

Lines arrive in batches. A streaming query keeps a running revenue for each nation and item and puts
out, after each batch, the sums that the batch touched (update mode). From these the batch's own
deltas are taken away, which gives the revenues that the batch opened with; the state store's reader
supplies the best of the items that the batch left untouched; windows then rebuild the board after
each arrival day of the batch. The query is started anew for each batch on one checkpoint, as a job
that is scheduled by the day would be, and a batch that is run again writes the same files again.

Nothing is ranked in one task: boards are cut with row_number() <= top, which Spark applies in each
task before rows are dealt by nation and day, and an item takes part in the days of a batch only if
its best revenue reaches what the tenth item of its nation never falls below in that batch.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ready

FEED = "nation_id int, item_id long, day int, s int, cents double"
CHANGES = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"

#: Stands for the time before a batch's first day.
BEFORE = -(1 << 31)
#: Nations are a table of the shop's own; the small frame with a row for each is broadcast up to so many.
MOST_NATIONS = 10_000


@dataclass(frozen=True)
class Feed:
    """How lines are cut into batches: `first_day` counts from 1970, `span` days make `batches`
    batches, lines without a day are spread over `days`, lines more than `late` days older than the
    newest line of earlier batches are dropped, and a board has `top` places."""

    batches: int = 12
    first_day: int = 19723
    span: int = 180
    days: int = 150
    late: int = 8
    top: int = 10


def cents(money: Column) -> Column:
    """Whole cents as a double; null for null and for what is no finite number."""
    finite = ~F.isnan(money) & (F.abs(money) < F.lit(float("inf")))
    return F.when(finite, F.floor(100 * money + 0.5).cast("double"))


def arrivals(lines: DataFrame, items: DataFrame, vendors: DataFrame, feed: Feed) -> DataFrame:
    """The lines as they arrive: batch, nation_id and item_id (both null where a line is to be
    ignored), day of arrival, day s, cents. An item or vendor given twice counts once, with its
    least price or nation."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")]
    h = F.crc32(F.concat_ws(",", *text))
    s = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")), (feed.first_day + h % feed.days).cast("int"))
    day = (F.col("s") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).cast("int")
    batch = F.least(F.lit(feed.batches), 1 + F.floor((F.col("day") - feed.first_day) * feed.batches / feed.span)).cast("int")
    sign = F.when(F.col("flag") == "returned", -1.0).otherwise(1.0)
    lines = lines.select(h.alias("h"), s.alias("s"), "item_id", "vendor_id", "quantity", cents(F.col("amount")).alias("paid"), sign.alias("sign"))
    lines = lines.select("s", day.alias("day"), "item_id", "vendor_id", F.when(F.col("paid").isNull(), F.col("quantity")).alias("quantity"), (F.col("paid") * F.col("sign")).alias("paid"), "sign")
    nations = vendors.where("vendor_id IS NOT NULL").groupBy("vendor_id").agg(F.min("nation_id").alias("nation_id"))
    prices = items.where("item_id IS NOT NULL").groupBy("item_id").agg(F.min(cents(F.col("price"))).alias("price"), F.lit(True).alias("known"))
    lines = lines.join(prices, "item_id", "left").join(nations, "vendor_id", "left")
    owed = F.coalesce("paid", F.col("sign") * F.col("quantity") * F.col("price"), F.lit(0.0))
    counts = F.col("known") & F.col("nation_id").isNotNull()
    return lines.select(batch.alias("batch"), *(F.when(counts, F.col(c)).alias(c) for c in ("nation_id", "item_id")), "day", "s", owed.alias("cents"))


@contextlib.contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Settings of the session for as long as the block runs."""
    wanted = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def best(rows: DataFrame, by: list[str], money: str, n: int, name: str = "rank") -> DataFrame:
    """The n highest rows of each key, ties to smaller items: at most n a key leave each task."""
    w = Window.partitionBy(*by).orderBy(F.desc(money), "item_id")
    return rows.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def held_revenues(closing: DataFrame, deltas: DataFrame) -> DataFrame:
    """How each item that a batch touched stood in it: a row for each day that changes it, with the
    revenue after, until which day that holds, whether it is the first, what it opened with, and the
    lowest and highest of all of these.

    closing: nation_id, item_id, revenue after the batch. deltas: what each day of it adds.
    """
    key = ["nation_id", "item_id"]
    by = Window.partitionBy(*key)
    w = by.orderBy("day")
    moved = deltas.join(closing, key).withColumn("opening", F.col("revenue") - F.sum("delta").over(by)).withColumn("after", F.col("opening") + F.sum("delta").over(w))
    low, high = F.least("opening", F.min("after").over(by)), F.greatest("opening", F.max("after").over(by))
    return moved.select(*key, "day", F.lead("day").over(w).alias("until"), "opening", "after", (F.row_number().over(w) == 1).alias("first"), low.alias("low"), high.alias("high"))


#: Changed ranks of a batch are broadcast up to so many; there are twenty at most for a nation and day.
MOST_CHANGES = 200_000


def board_changes(moved: DataFrame, untouched: DataFrame | None, batch: int, top: int, small: bool, put: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The changes of rank within a batch.

    moved: `held_revenues`. untouched: nation_id, item_id, revenue of the best other items. A revenue
    holds from a day (the opening one from BEFORE) to the next that changes it. `put` stores a
    frame that is used twice, and reads it again.
    """
    key = ["nation_id", "item_id"]
    sides = moved.where("first").select(*key, "low")
    if untouched is not None:
        sides = sides.unionByName(untouched.select(*key, F.col("revenue").alias("low")))
    floor = best(sides.where("low > 0"), ["nation_id"], "low", top).where(F.col("rank") == top).select("nation_id", F.col("low").alias("floor"))
    days = moved.groupBy("nation_id").agg(F.array_sort(F.collect_set("day")).alias("days")).withColumn("days", F.concat(F.array(F.lit(BEFORE)), "days"))
    nation = days.join(floor, "nation_id", "left").withColumn("next", F.concat(F.slice("days", 2, F.size("days")), F.array(F.lit(None).cast("int"))))
    nation = put(nation.select("nation_id", F.arrays_zip("days", "next").alias("days"), F.coalesce("floor", F.lit(0.0)).alias("floor")), "nations")
    nation = F.broadcast(nation) if small else nation
    hold = F.array(F.struct(F.col("day"), F.col("until"), F.col("after").alias("revenue")), F.when(F.col("first"), F.struct(F.lit(BEFORE).alias("day"), F.col("day").alias("until"), F.col("opening").alias("revenue"))))
    held = moved.join(nation, "nation_id").where("high > 0 AND high >= floor").select(*key, F.explode(hold).alias("h"), "days").where("h IS NOT NULL").select(*key, "h.*", "days")
    if untouched is not None:
        rest = untouched.select(*key, F.lit(BEFORE).alias("day"), F.lit(None).cast("int").alias("until"), "revenue")
        held = held.unionByName(rest.join(nation.select("nation_id", "days"), "nation_id"))
    covered = F.filter("days", lambda d: (d["days"] >= F.col("day")) & (F.col("until").isNull() | (d["days"] < F.col("until"))))
    daily = held.where("revenue > 0").select(*key, "revenue", F.explode(covered).alias("d")).select(*key, "revenue", F.col("d.days").alias("day"), F.col("d.next").alias("next"))
    board = best(daily, ["nation_id", "day"], "revenue", top)
    none = F.lit(None).cast("int")
    ranks = F.array(F.struct(F.col("day"), none.alias("old"), F.col("rank").alias("new")), F.when(F.col("next").isNotNull(), F.struct(F.col("next").alias("day"), F.col("rank").alias("old"), none.alias("new"))))
    both = board.select(*key, F.explode(ranks).alias("r")).where("r IS NOT NULL").select(*key, "r.*")
    both = put(both.groupBy(*key, "day").agg(F.max("old").alias("old"), F.max("new").alias("new")).where(f"day > {BEFORE} AND NOT old <=> new"), "ranks")
    both = F.broadcast(both) if both.count() <= MOST_CHANGES else both
    now = held.select(*key, F.col("day").alias("since"), "until", "revenue")
    out = both.join(now, key).where("since <= day AND (until IS NULL OR day < until)")
    change = F.when(F.col("old").isNull(), "enter").when(F.col("new").isNull(), "exit").otherwise("move")
    return out.select("nation_id", F.col("day").cast("long").alias("arrival_day"), "item_id", F.lit(batch).alias("batch"), change.alias("change"), F.col("old").alias("old_rank"), F.col("new").alias("new_rank"), F.col("revenue").cast("long").alias("revenue"))


def leader_changes(lines: DataFrame, items: DataFrame, vendors: DataFrame, feed: Feed | None = None) -> DataFrame:
    """The change feed of the lines, a row for each item whose rank on its nation's board differs
    from the board before, in the columns of CHANGES.

    The state store is the session's (RocksDB where the pairs of nation and item outgrow the
    executors' memory: spark.sql.streaming.stateStore.providerClass).

    Null keys: a line without a vendor's nation or an item's row counts for the age of its batch
    only. Null or non-finite money falls back to quantity times price, then to 0. Lines given twice
    add twice. Days before the first batch's make batches of their own, numbered from 0 down. Empty
    tables give no rows; other columns take no part.
    """
    feed, spark = feed or Feed(), ready(lines.sparkSession)
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = f"{spark.sparkContext.getCheckpointDir()}/leaders-{uuid.uuid4().hex}"
    files = path(top).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(f"{top}/feed"))
    files.deleteOnExit(path(top))
    with settings(spark, spark__sql__streaming__stateStore__unloadOnCommit="true", spark__sql__streaming__noDataMicroBatches__enabled="false", spark__sql__classic__shuffleDependency__fileCleanup__enabled="true"):
        arrivals(lines, items, vendors, feed).write.partitionBy("batch").parquet(f"{top}/staged")
        staged = spark.read.schema(f"{FEED}, batch int").parquet(f"{top}/staged")
        newest = {r["batch"]: r["s"] for r in staged.groupBy("batch").agg(F.max("s").alias("s")).collect()}  # a row for each batch
        small = vendors.select("nation_id").distinct().limit(MOST_NATIONS + 1).count() <= MOST_NATIONS
        limit = None
        for batch in sorted(newest):
            files.rename(path(f"{top}/staged/batch={batch}"), path(f"{top}/feed/batch={batch}"))
            in_time = F.lit(True) if limit is None else F.col("s") + feed.late >= limit
            feed_batch(spark, top, batch, F.col("nation_id").isNotNull() & in_time, feed.top, small)
            limit = max(newest[batch], newest[batch] if limit is None else limit)
    return spark.read.schema(CHANGES).parquet(f"{top}/changes/*") if newest else spark.createDataFrame([], CHANGES)


def feed_batch(spark: SparkSession, top: str, batch: int, taken: Column, places: int, small: bool) -> None:
    """Starts the streaming query on what is new in the feed, and ends it after that batch."""

    def work(updated: DataFrame, version: int) -> None:
        s = updated.sparkSession

        def put(df: DataFrame, name: str) -> DataFrame:
            df.write.mode("overwrite").parquet(f"{top}/{name}")
            return s.read.schema(df.schema).parquet(f"{top}/{name}")

        closing = put(updated, "closing")
        deltas = s.read.schema(FEED).parquet(f"{top}/feed/batch={batch}").where(taken).groupBy("nation_id", "item_id", "day").agg(F.sum("cents").alias("delta"))
        leaders = None
        if version:  # the state as the version before this batch left it
            state = s.read.format("statestore").option("batchId", version - 1).load(f"{top}/state")
            state = state.select("key.nation_id", "key.item_id", F.col("value.sum").alias("revenue")).where("revenue > 0")
            state = state.join(closing.select("nation_id", "item_id"), ["nation_id", "item_id"], "left_anti")
            leaders = put(best(state, ["nation_id"], "revenue", places), "leaders")
        moved = put(held_revenues(closing, deltas), "moved")
        board_changes(moved, leaders, batch, places, small, put).write.mode("overwrite").parquet(f"{top}/changes/{batch}")

    stream = spark.readStream.schema(f"{FEED}, batch int").parquet(f"{top}/feed")
    sums = stream.where(taken).groupBy("nation_id", "item_id").agg(F.sum("cents").alias("revenue"))
    query = sums.writeStream.outputMode("update").option("checkpointLocation", f"{top}/state").trigger(availableNow=True).foreachBatch(work).start()
    query.awaitTermination()
