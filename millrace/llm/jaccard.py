"""Exact n-gram Jaccard join by vertical partitioning of one global n-gram order.

N-grams are ordered by the number of documents that hold them, rarest first, and the order is cut
into fragments at fixed numbers of documents. A document's part of a fragment meets the same
fragment of the documents that it could link to, the overlaps are counted fragment by fragment, and
sums by pair decide. Which pairs could link is told by prefixes: documents that link share an
n-gram of their first ones in that order.

Copies with equal sets meet as one class, and what is wanted is which classes hang together, so
the pairs of a group of near copies are not all made: the documents of a prefix n-gram first meet
the one that can link to most of them, and only those left in other components meet the rest.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import TOLD, bucket_bits, by_bucket, group_of, groups_for, in_rounds, kept, packed, ready, spread, text_bytes, unpacked
from .components import components
from .wordgrid import Grid, grids, mix

#: Where the order of n-grams, rarest first, is cut into fragments: numbers of documents that hold them.
CUTS = (3, 6, 20, 200)
LARGEST = (1 << 16) - 1


def document_sets(grid: Grid, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash), sorted and distinct: each document's k-word shingles; with fewer words,
    all of them as one."""
    h, at = grid.grams(k)
    doc = grid.doc[at]
    short = np.flatnonzero((grid.counts > 0) & (grid.counts < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = grid.counts[short] > j
            word = grid.word[np.minimum(grid.starts[short] + j, len(grid.word) - 1)]
            whole = np.where(has, mix(whole * np.uint64(31) + word + np.uint64(j + 1)), whole)
        h, doc = np.concatenate([h, whole]), np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """key, n, s1, s2: the size of each document's set and 128 bits that equal sets share."""

    def run(batches):
        for b in batches:
            n, s1, s2 = [], [], []
            for grid in grids(b.column(1), lower=True):
                doc, h = document_sets(grid, k)
                edges = np.searchsorted(doc, np.arange(len(grid.counts) + 1))
                n.append(np.diff(edges))
                for s, salt in ((s1, 0x5851F42D4C957F2D), (s2, 0x14057B7EF767814F)):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(h ^ np.uint64(salt)))])
                    s.append((total[edges[1:]] - total[edges[:-1]]).view(np.int64))
            yield pa.record_batch([b.column(0), *(pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (n, s1, s2))], ["key", "n", "s1", "s2"])

    return spread(docs.select("key", "text")).mapInArrow(run, "key long, n long, s1 long, s2 long")


def prefix_postings(docs: DataFrame, representatives: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Documents whose prefix holds an n-gram that others hold too: key, n, u (n-grams of their
    own), prefix (the n-grams of the prefix after these), fragments (all that others hold) and row,
    which tells rows of one key apart."""
    docs = docs.where("key is not null")
    total = text_bytes(docs)
    groups, bits = groups_for(total), bucket_bits(total)
    dealt = docs.select("key", "text", group_of(groups, F.col("key")).alias("g"))

    def one_message(t: pa.Table) -> pa.Table:
        keys = np.sort(t["key"].to_numpy())
        return pa.table({"bucket": pa.array([TOLD], pa.int32()), "g": t["g"].slice(0, 1), "payload": pa.array([keys.tobytes()], pa.binary())})

    told = representatives.select("key", group_of(groups, F.col("key")).alias("g")).groupBy("g").applyInArrow(one_message, "bucket int, g int, payload binary")

    def sets(t: pa.Table, answers: dict[int, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the group's representatives; (document, n-gram) of all of their sets."""
        wanted = np.frombuffer(answers.get(TOLD, b""), np.int64)
        keys = t["key"].to_numpy()
        stay = np.isin(keys, wanted)
        t, keys = t.filter(pa.array(stay)), keys[stay]
        if len(np.unique(keys)) < len(keys):  # repeated rows count once
            seen = {}
            for i, row in enumerate(zip(keys.tolist(), t["text"].to_pylist(), strict=True)):
                seen.setdefault(row, i)
            once = np.array(list(seen.values()))
            t, keys = t.take(once), keys[once]
        docs, grams = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for grid in grids(t["text"], lower=True):
            doc, h = document_sets(grid, k)
            docs.append(doc + grid.row)
            grams.append(h)
        return keys, np.concatenate(docs), np.concatenate(grams)

    def emit(t: pa.Table, answers: dict[int, bytes]):
        grams, counts = np.unique(sets(t, answers)[2], return_counts=True)
        for b, at in by_bucket(grams, bits):
            many = np.flatnonzero(counts[at] > 1)
            yield b, packed(grams[at], bits, many.astype("<u4"), counts[at][many].astype("<u4"))

    def merge(payloads: list[bytes]) -> list[bytes]:
        all_keys, all_counts = [], []
        for p in payloads:
            keys, rest = unpacked(p)
            counts = np.ones(len(keys), np.int64)
            more = np.frombuffer(rest, "<u4").reshape(2, -1)
            counts[more[0]] = more[1]
            all_keys.append(keys)
            all_counts.append(counts)
        _, which = np.unique(np.concatenate(all_keys), return_inverse=True)
        df = np.minimum(np.bincount(which, np.concatenate(all_counts)), LARGEST).astype("<u2")[which]
        return [x.tobytes() for x in np.split(df, np.cumsum([len(x) for x in all_keys])[:-1])]

    def consume(t: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        keys, doc, gram = sets(t, answers)
        distinct, which = np.unique(gram, return_inverse=True)
        df = np.concatenate([np.frombuffer(answers[b], "<u2") for b, _ in by_bucket(distinct, bits)] or [np.empty(0, "<u2")])[which]
        order = np.lexsort((gram, df, doc))
        doc, gram, df = doc[order], gram[order].view(np.int64), df[order]
        level = np.searchsorted(np.array(CUTS), df, "right")
        edges = np.searchsorted(doc, np.arange(len(keys) + 1))
        alone = np.concatenate([[0], np.cumsum(df == 1)])
        rows = []
        for i in range(len(keys)):
            a, z = int(edges[i]), int(edges[i + 1])
            n, u = z - a, int(alone[z] - alone[a])
            p = n - -(-n * num // den) + 1
            if n and u < p:
                cut = np.split(gram[a + u : z], np.searchsorted(level[a + u : z], np.arange(1, len(CUTS) + 1)))
                rows.append((int(keys[i]), n, u, gram[a + u : a + p], cut, i))
        k_, n_, u_, p_, f_, r_ = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.table([pa.array(k_, pa.int64()), pa.array(n_, pa.int64()), pa.array(u_, pa.int32()), pa.array(list(p_), pa.list_(pa.int64())), pa.array([[list(x) for x in y] for y in f_], pa.list_(pa.list_(pa.int64()))), pa.array(r_, pa.int32())], ["key", "n", "u", "prefix", "fragments", "row"])

    return in_rounds(dealt, [(emit, merge)], consume, "key long, n long, u int, prefix array<bigint>, fragments array<array<bigint>>, row int", told)


def can_link(num: int, den: int) -> Column:
    """Whether a.n, a.pos, b.n, b.pos allow a link whose first common n-gram is this one."""
    most = 1 + F.least(F.col("a.n") - F.col("a.pos"), F.col("b.n") - F.col("b.pos"))
    return (den * most >= num * (F.col("a.n") + F.col("b.n") - most)) & (den * F.least("a.n", "b.n") >= num * F.greatest("a.n", "b.n"))


def linked(pairs: DataFrame, shared: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link: overlaps counted by fragment, summed by pair."""
    parts_of = shared.select("key", "n", "row", F.posexplode("fragments").alias("fragment", "grams"))
    left = pairs.join(parts_of.withColumnsRenamed({"key": "a", "n": "a_n", "row": "a_row", "grams": "a_grams"}), "a")
    both = left.join(parts_of.withColumnsRenamed({"key": "b", "n": "b_n", "row": "b_row", "grams": "b_grams"}), ["b", "fragment"])
    overlap = F.size(F.array_intersect("a_grams", "b_grams"))
    sums = both.groupBy("a", "b", "a_n", "b_n", "a_row", "b_row").agg(F.sum(overlap).alias("o"))
    return sums.where(den * F.col("o") >= num * (F.col("a_n") + F.col("b_n") - F.col("o"))).select("a", "b")


def class_links(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) that make the same components as all links between the documents of `shared`."""
    size_class = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)).cast("int")
    flat = shared.select("key", "n", "u", F.posexplode("prefix").alias("i", "gram"))
    flat = flat.select("key", "n", (F.col("u") + F.col("i") + 1).alias("pos"), "gram", size_class.alias("c"))
    pivots = flat.groupBy("gram", "c").agg(F.min(F.struct("pos", "key", "n")).alias("p"), F.count("*").alias("m"))
    pivots = pivots.select("gram", "c", "m", F.col("p.pos").alias("pos"), F.col("p.key").alias("key"), F.col("p.n").alias("n"))
    ok = can_link(num, den)
    star = flat.alias("a").join(pivots.where("m > 1").alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.key") != F.col("b.key")) & ok)
    next_class = pivots.withColumn("c", F.col("c") + 1)
    across = pivots.alias("a").join(next_class.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.c") == F.col("b.c")) & (F.col("a.key") != F.col("b.key")) & ok)
    pair = [F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")]
    tried = kept(star.select(*pair).unionByName(across.select(*pair)).distinct())
    found = kept(linked(tried, shared, num, den))
    # what is still apart in a list of documents meets all of it but its own component
    of = components(found)
    flat = kept(flat.join(of, F.col("key") == F.col("v"), "left").select("key", "n", "pos", "gram", F.coalesce("component", "key").alias("component")))
    sizes = flat.groupBy("gram", "component").agg(F.count("*").alias("m"))
    main = sizes.groupBy("gram").agg(F.max_by("component", F.struct("m", "component")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
    split = flat.join(main, "gram")
    rest = split.where("component <> main").alias("a").join(
        split.alias("b"),
        (F.col("a.gram") == F.col("b.gram")) & (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.key") < F.col("b.key"))) & ok,
    )
    rest = rest.select(*pair).distinct().join(tried, ["a", "b"], "left_anti")
    return found.unionByName(linked(kept(rest), shared, num, den))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_shingles, component_id.

    Texts are lower-cased (A-Z); a document's set are its distinct k-word shingles, or with fewer
    words all of them as one. Documents link where den * intersection >= num * union, and
    component_id is the smallest key that links reach. Documents without words, or with a null
    text, link with nothing; a null key is never a component's name, and documents with null keys
    only meet equal sets. Repeated rows are documents with equal sets. Keys are whole numbers.

    Shingles are 64-bit hashes: sets are compared by 128 bits, n-grams of two documents by all 64.
    """
    ready(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))
    sets = kept(signatures(docs, k))
    classes = kept(sets.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("key").alias("class")))
    least = -(-num // (den - num))  # a smaller set only links with its equal
    shared = kept(prefix_postings(docs, classes.where(f"n >= {least} and class is not null").select(F.col("class").alias("key")), k, num, den))
    of = components(class_links(shared, num, den))
    named = classes.join(of, F.col("class") == F.col("v"), "left").select("s1", "s2", "n", F.coalesce("component", "class").alias("component"))
    out = sets.join(named, ["s1", "s2", "n"], "left")
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with the smallest key of each component. Rows of one key stay together, but
    for those whose texts differ by case (A-Z) at most, of which one stays; documents with null
    keys stay, as no name tells them apart."""
    found = jaccard_components(docs, k, num, den, key, text)
    stay = found.where(F.col(key) == F.col("component_id")).select(key).distinct()
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    once = docs.join(stay, key, "left_semi").withColumn("__text", F.sha2(lower, 256)).dropDuplicates([key, "__text"]).drop("__text")
    return once.unionByName(docs.where(F.col(key).isNull()))
