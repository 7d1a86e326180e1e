"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept, ready, spread


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float, total: Column | None = None) -> DataFrame:
    """source, size -> also weight and target, one row a source.

    Sources by code point (null last) weigh `weights`, repeating. They share the total by weight,
    but none gets more than `most` times its size; the excess goes to the others by weight until
    none is above. The sources that are full are those with the least size per weight, so running
    sums over that order find them in one pass.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    choices = F.array(*[F.lit(float(w)) for w in weights])
    w = sizes.withColumn("weight", F.element_at(choices, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    full = F.col("size") * F.lit(float(most))
    everything = Window.partitionBy()
    order = Window.orderBy(full / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    w = (
        w.withColumn("total", F.sum("size").over(everything) if total is None else total)
        .withColumn("left", F.col("total") - F.coalesce(F.sum(full).over(before), F.lit(0.0)))
        .withColumn("others", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("others"))
        .withColumn("is_full", full <= F.col("weight") * F.col("level"))
        .withColumn("level", F.max(F.when(~F.col("is_full"), F.col("level"))).over(everything))
    )
    target = F.when(F.col("is_full"), full).otherwise(F.least(full, F.col("weight") * F.col("level")))
    return w.select("source", "size", "weight", target.alias("target"))


def apportioned(parties: DataFrame, within: list[str], votes: str, seats: str, tie: list[Column]) -> DataFrame:
    """Adds `quota`: the seats that each party gets by highest quotients votes / (2 s + 1).

    Seats near a party's exact share are the only ones in doubt: rounding the shares differs from
    the right allocation by at most half as many seats as there are parties, and a party's part of
    that is at most its share of the votes. So each party offers a few quotients around its
    share, and the group takes the highest that are still to be given.
    """
    group = Window.partitionBy(*within)
    total, n = F.sum(votes).over(group), F.count("*").over(group)
    p = parties.withColumn("__share", F.when(total > 0, F.col(votes) * F.col(seats) / total).otherwise(F.lit(0.0)))
    p = p.withColumn("__part", F.when(total > 0, F.ceil(n * F.col(votes) / total / 2)).otherwise(F.lit(0)).cast("long") + 2)
    p = p.withColumn("__sure", F.greatest(F.lit(0), F.floor("__share").cast("long") - F.col("__part")))
    p = p.withColumn("__open", F.col(seats) - F.sum("__sure").over(group))
    offers = p.where(F.col(votes) > 0).withColumn("__seat", F.explode(F.sequence(F.col("__sure"), F.col("__sure") + 2 * F.col("__part") + 1)))
    best = Window.partitionBy(*within).orderBy(F.desc(F.col(votes) / (2 * F.col("__seat") + 1)), *tie)
    won = offers.withColumn("__rank", F.row_number().over(best)).where(F.col("__rank") <= F.col("__open"))
    names = [*parties.columns, "__sure"]
    all_sure = p.select(*names, F.lit(0).alias("__won")).unionByName(won.select(*names, F.lit(1).alias("__won")))
    keys = [c for c in names if c != "__sure"]
    return all_sure.groupBy(*keys).agg((F.max("__sure") + F.sum("__won")).alias("quota"))


def mixed(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    most: float = 3.0,
    block: int = 8,
    shard_words: int = 20_000,
    seed: int = 0,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """As mix_sources, with `draw` (a hash of the row) besides, and key and source so named.

    The mix has as many words as the documents. Blocks of `block` words are apportioned to the
    sources by their targets, then each source's blocks to its shards by their sizes: first to
    groups of shards, then within a group, so that no window holds more than about the root of a
    source's shards. A source has as many shards as shard_words go into its size, as a power of
    two; its documents are dealt to them by their draw, so that a large source is spread over many
    tasks. A shard takes its words in whole rounds over its documents, then the blocks that remain
    from its documents in an order drawn from the seed. No document is taken more than `most`
    times. A null text has size 0; a null source is a source; repeated rows are documents of their
    own. One row a source is in one task where sources are ranked and share.
    """
    ready(docs.sparkSession)
    slim = spread(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(text).alias("text")))
    slim = kept(slim.select("key", "source", size_of(F.col("text")).alias("size"), F.xxhash64(F.lit(seed), "key", "text").alias("draw")))
    per_source = kept(targets(slim.groupBy("source").agg(F.sum("size").alias("size")), weights, most))
    blocks = F.floor(F.sum("size").over(Window.partitionBy()) / block + 0.5).cast("long")
    quotas = apportioned(per_source.withColumn("blocks", blocks).withColumn("all", F.lit(0)), ["all"], "target", "blocks", [F.col("source").asc_nulls_last()])
    bits = F.floor(F.log2(F.greatest(F.lit(1), F.col("size") / shard_words)))
    parts, a_group = F.pow(F.lit(2), bits).cast("long"), F.pow(F.lit(2), F.floor(bits / 2)).cast("long")
    quotas = kept(quotas.select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target", F.col("quota").alias("source_blocks"), parts.alias("parts"), a_group.alias("a_group")))
    dealt = slim.join(quotas, F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("part", F.pmod("draw", "parts")).withColumn("upper", F.floor(F.col("part") / F.col("a_group")))
    fine = kept(dealt.groupBy("source", "source_blocks", "upper", "part").agg(F.sum("size").alias("part_size")))
    upper = fine.groupBy("source", "source_blocks", "upper").agg(F.sum("part_size").alias("upper_size"))
    upper = apportioned(upper, ["source"], "upper_size", "source_blocks", [F.col("upper")]).select(F.col("source").alias("s"), F.col("upper").alias("u"), F.col("quota").alias("upper_blocks"))
    fine = fine.select("source", "upper", "part", "part_size").join(upper, F.col("source").eqNullSafe(F.col("s")) & (F.col("upper") == F.col("u"))).drop("s", "u")
    fine = apportioned(fine, ["source", "upper"], "part_size", "upper_blocks", [F.col("part")])
    most_words = F.floor(F.lit(float(most)) * F.col("part_size")).cast("long")
    told = fine.select(F.col("source").alias("s"), F.col("part").alias("p"), "part_size", F.least(most_words, F.col("quota") * block).alias("words"))
    out = dealt.join(told, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    line = Window.partitionBy("source", "part").orderBy("draw", "key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumn("end", F.sum("size").over(line))
    rounds = F.when(F.col("part_size") > 0, F.floor(F.col("words") / F.col("part_size"))).otherwise(F.lit(0)).cast("long")
    out = out.withColumn("rounds", rounds).withColumn("rest", F.col("words") - F.col("rounds") * F.col("part_size"))
    partly = F.least(F.col("size"), F.greatest(F.lit(0), F.col("rest") - F.col("end") + F.col("size")))
    taken = (F.col("rounds") * F.col("size") + partly).cast("long")
    return out.select("draw", "key", "source", "size", "source_size", "target", taken.alias("taken"))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """One row a document: key, source, size, source_size, target, taken; see `mixed`."""
    return mixed(docs, key=key, source=source, **options).drop("draw").withColumnsRenamed({"key": key, "source": source})


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0, **options) -> DataFrame:
    """The mix as documents: each as often as it is taken, rounded to whole documents.

    Rows find what is taken of them by their draw, and rows of one draw (equal key and text) in
    the order of their sources. Rows that are equal in all three are the same to the mix.
    """
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    mix = mixed(docs, key=key, text=text, source=source, seed=seed, **options)
    each = F.struct(F.col("source").isNotNull().alias("named"), "source", F.col("key").isNotNull().alias("keyed"), "key", (-times).alias("less"))
    takes = mix.groupBy(F.col("draw").alias("__draw")).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: -x["less"]).alias("__times")).where(F.exists("__times", lambda n: n > 0))
    marked = docs.withColumn("__row", F.xxhash64(F.lit(seed), F.col(key), F.col(text)))
    whole = marked.join(takes, F.col("__row") == F.col("__draw"))
    order = Window.partitionBy("__row").orderBy(F.col(source).asc_nulls_first(), F.col(key).asc_nulls_first(), F.xxhash64(*docs.columns))
    whole = whole.withColumn("__no", F.when(F.size("__times") > 1, F.row_number().over(order)).otherwise(1))
    copies = F.array_repeat(F.lit(0), F.element_at("__times", F.col("__no")))
    return whole.withColumn("__copy", F.explode(copies)).select(*[F.col(f"`{c}`") for c in docs.columns])
