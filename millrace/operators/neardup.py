"""Near duplicates by bottom shingle keys, and the greedy choice that keeps the first of each."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from functools import reduce
from hashlib import md5
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import sizes_allow
from ..session import kept, spread


#: Longs of a sketch: for each of 64 times as many lots of shingle keys, whether the set has an odd number of them.
SKETCH = 16
#: The tokens of `text.TOKEN` as Python has them: only letters that its newer tables know differ.
WORDS = re.compile(r"\w+|[^\w\s]")
#: Pairs whose sets are compared in one cell.
CELL = 32_768


def shingle_set(words: list[str], n: int) -> np.ndarray:
    """The distinct runs of n words, each as the first 8 bytes of its md5, as a long that keeps their order; sorted."""
    words = [x.encode() for x in words]
    raw = b"".join([md5(b" ".join(g)).digest()[:8] for g in zip(*(words[i:] for i in range(n)))])
    return (np.unique(np.frombuffer(raw, ">u8")).astype("u8") ^ np.uint64(1 << 63)).view("i8")


def sketched(shingles: np.ndarray) -> np.ndarray:
    odd = np.bincount(shingles & (64 * SKETCH - 1), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype("u1")).view("i8")


def lists(xs: Sequence[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype("i4"), np.concatenate([np.empty(0, "i8"), *xs]))


def features(df: DataFrame, key: str, text: Column, sets: bool = False, bottom: int = 12, n: int = 3, least: int = 12) -> DataFrame:
    """key, n (shingle keys) and set (128 bits that equal sets share) of texts of `least` tokens or
    more; with `sets` the shingles, else the `bottom` smallest and a sketch."""
    folded = F.make_valid_utf8(F.replace(F.lower("__text"), F.lit("ß"), F.lit("ss")))
    t = spread(df.select(F.col(key), text.alias("__text"))).select(key, folded.alias("__t"))
    more = ["shingles"] if sets else ["bottom", "sketch"]

    def run(batches):
        for b in batches:
            rows, found = [], []
            for i, x in enumerate(b.column(1)):
                words = WORDS.findall(x.as_py() or "")
                if len(words) >= least:
                    shingles = shingle_set(words, n)
                    told = [shingles] if sets else [shingles[:bottom].copy(), sketched(shingles)]
                    rows.append(i)
                    found.append((len(shingles), md5(shingles.tobytes()).digest(), *told))
            size, digest, *told = zip(*found, strict=True) if found else [()] * (2 + len(more))
            yield pa.record_batch([b.column(0).take(pa.array(rows, pa.int64())), pa.array(size, pa.int32()), pa.array(digest, pa.binary()), *map(lists, told)], [key, "n", "set", *more])

    schema = t.select(key).schema.add("n", "integer").add("set", "binary")
    for c in more:
        schema = schema.add(c, T.ArrayType(T.LongType()))
    return t.mapInArrow(run, schema)


def candidate_pairs(one: DataFrame, threshold: float) -> DataFrame:
    """Pairs (x < y) of different sets that may reach the threshold, and g, the least of the smallest
    keys that they share.

    Where two sketches differ so do the sets, in one key at least; sets that reach the threshold
    differ in no more than (1 - threshold) / (1 + threshold) of their sizes' sum. Pairs are held
    against that as they meet, so that those that only share a common passage are never written.
    Only sizes of one class or of two adjacent ones meet.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / (1e-9 - 1.001 * math.log(threshold))).cast("long")
    flat = one.select("set", "n", size.alias("c"), F.explode("bottom").alias("g"), F.struct(*[F.get("sketch", i).alias(f"s{i}") for i in range(SKETCH)]).alias("s"))
    a, b = flat.alias("a"), flat.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("c", F.col("c") - F.col("up")).alias("b")
    differ = reduce(add, [F.bit_count(F.col(f"a.s.s{i}").bitwiseXOR(F.col(f"b.s.s{i}"))) for i in range(SKETCH)])
    near = sizes_allow(F.col("a.n"), F.col("b.n"), threshold) & (differ <= (F.col("a.n") + F.col("b.n")) * F.lit((1 - threshold) / (1 + threshold) * (1 + 1e-9)))
    on = (F.col("a.g") == F.col("b.g")) & (F.col("a.c") == F.col("b.c")) & ((F.col("b.up") == 1) | (F.col("a.set") < F.col("b.set"))) & near
    pairs = a.join(b, on).select(F.least("a.set", "b.set").alias("x"), F.greatest("a.set", "b.set").alias("y"), F.col("a.g").alias("g"))
    return pairs.groupBy("x", "y").agg(F.min("g").alias("g"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """x, y, shared, total of the candidates that reach the threshold; sets: set, shingles.

    Pairs are compared where the key lies that they share, in cells of bounded size: a set goes
    there once, not once for each of its pairs.
    """
    per = pairs.groupBy("g").agg(F.ceil(F.sqrt(F.count("*") / CELL)).cast("int").alias("k"))
    cell = [F.col("g"), F.pmod(F.xxhash64("x"), F.col("k")).alias("i"), F.pmod(F.xxhash64("y"), F.col("k")).alias("j")]
    pairs = kept(pairs.join(per, "g").select("x", "y", *cell))
    placed = pairs.select(*[F.col(c).alias(f"of_{c}") for c in "gij"], F.explode(F.array("x", "y")).alias("set")).distinct().join(sets.select("set", "shingles"), "set")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {k: np.asarray(v.values) for k, v in zip(right["set"].to_pylist(), right["shingles"].combine_chunks(), strict=True)} if len(left) else {}
        rows = []
        for x, y in zip(left["x"].to_pylist(), left["y"].to_pylist(), strict=True):
            a, b = known[x], known[y]
            shared = len(np.intersect1d(a, b, assume_unique=True))
            total = len(a) + len(b) - shared
            if shared >= threshold * total:
                rows.append((x, y, shared, total))
        x, y, shared, total = zip(*rows, strict=True) if rows else [[]] * 4
        return pa.table([pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.array(shared, pa.int64()), pa.array(total, pa.int64())], ["x", "y", "shared", "total"])

    return pairs.groupBy("g", "i", "j").cogroup(placed.groupBy("of_g", "of_i", "of_j")).applyInArrow(run, "x binary, y binary, shared long, total long")


def near_sets(df: DataFrame, key: str, text: Column, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, of, near): key, n and set of each row with shingles; set, class_id (the least key)
    and size; x, y, shared, total of different sets that are near.

    Sets stay behind: the few that are in candidates are made again of their texts.
    """
    f = kept(features(df, key, text))
    of = f.groupBy("set").agg(F.min(key).alias("class_id"), F.count("*").alias("size"))
    pairs = kept(candidate_pairs(f.select("set", "n", "bottom", "sketch").dropDuplicates(["set"]), threshold))
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("set")).distinct()
    wanted = kept(of.join(wanted, "set", "left_semi").select(F.col("class_id").alias(key), "set"))
    sets = features(df.join(wanted.select(key).distinct(), key, "left_semi"), key, text, sets=True)
    sets = kept(sets.join(wanted, [key, "set"], "left_semi").dropDuplicates([key, "set"]))
    return f.select(key, "n", "set"), of, kept(verified(pairs, sets, threshold))


def near_pairs(df: DataFrame, key: str, text: Column, threshold: float = 0.9) -> DataFrame:
    """a, b, shared, total: pairs whose shingle sets have Jaccard >= threshold (compared as
    shared >= threshold * total) and share one of their 12 smallest keys. All such pairs are rows,
    so n copies of a text make n squared / 2; `near_classes` has the same links without them."""
    rows, _, near = near_sets(df, key, text, threshold)
    x, y = [rows.select("set", F.col(key).alias(f"k{c}")).withColumnRenamed("set", c) for c in "xy"]
    across = near.join(x, "x").join(y, "y").where("kx <> ky").select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), "shared", "total")
    a, b = rows.alias("a"), rows.alias("b")
    n = F.col("a.n").cast("long")
    within = a.join(b, (F.col("a.set") == F.col("b.set")) & (F.col(f"a.{key}") < F.col(f"b.{key}"))).select(F.col(f"a.{key}").alias("a"), F.col(f"b.{key}").alias("b"), n.alias("shared"), n.alias("total"))
    return across.unionByName(within)


def near_classes(df: DataFrame, key: str, text: Column, threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): key, class_id, links of each row with shingles, and a, b, shared, total of
    near classes, named by their least keys.

    Rows of equal sets (compared by 128 bits of them) are one class, of which one set is compared,
    so that n copies cost a row each. links counts the other rows that a row is near to: those of
    its class and all of the classes near to it, as all pairs would tell.
    """
    rows, of, near = near_sets(df, key, text, threshold)
    both = near.select("x", "y").unionByName(near.select(F.col("y").alias("x"), F.col("x").alias("y")))
    more = both.join(of.select(F.col("set").alias("y"), "size"), "y").groupBy(F.col("x").alias("set")).agg(F.sum("size").alias("near"))
    links = of.join(more, "set", "left").select("set", "class_id", (F.col("size") - 1 + F.coalesce("near", F.lit(0))).alias("links"))
    x, y = [of.select(F.col("set").alias(c), F.col("class_id").alias(f"k{c}")) for c in "xy"]
    pairs = near.join(x, "x").join(y, "y").select(F.least("kx", "ky").alias("a"), F.greatest("kx", "ky").alias("b"), "shared", "total")
    return rows.select(key, "set").join(links, "set").select(key, "class_id", "links"), pairs


def first_of_each(order: DataFrame, pairs: DataFrame, key: str, rank: str) -> DataFrame:
    """key, accepted, matched: rows in order of rank; a row is turned down if an accepted earlier
    row is near it, and matched names the smallest such key.

    In rounds: what no undecided earlier neighbour holds up is accepted, and turns its later
    neighbours down. The rounds are as many as the longest chain of such decisions; each ends in a
    checkpoint.
    """
    o = order.select(F.col(key).alias("k"), F.col(rank).alias("r"))
    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    e = both.join(o.withColumnsRenamed({"k": "a", "r": "ar"}), "a").join(o.withColumnsRenamed({"k": "b", "r": "br"}), "b")
    e = e.where("ar < br").select("a", "b").distinct().checkpoint()  # a comes first
    state = o.select("k").join(e.select(F.col("b").alias("k")).distinct(), "k", "left_semi").withColumn("s", F.lit(None).cast("boolean"))
    firsts = e.select(F.col("a").alias("k")).distinct().join(state.select("k"), "k", "left_anti").withColumn("s", F.lit(True))
    state = state.unionByName(firsts).checkpoint()
    while not state.where("s is null").isEmpty():
        known = e.join(state.withColumnsRenamed({"k": "a", "s": "as"}), "a").groupBy("b").agg(F.bool_or(F.coalesce("as", F.lit(False))).alias("hit"), F.bool_or(F.col("as").isNull()).alias("open"))
        state = state.join(known, F.col("k") == F.col("b"), "left").select("k", F.when(F.col("s").isNotNull(), F.col("s")).when(F.col("hit"), False).when(~F.col("open"), True).alias("s")).checkpoint()
    match = e.join(state.where("s").select(F.col("k").alias("a")), "a").groupBy(F.col("b").alias("k")).agg(F.min("a").alias("matched"))
    out = o.join(state, "k", "left").join(match, "k", "left")
    accepted = F.coalesce("s", F.lit(True))
    return out.select(F.col("k").alias(key), accepted.alias("accepted"), F.when(~accepted, F.col("matched")).alias("matched"))
