"""Substring dedup by shared seeds and hashes of whole windows, on word sequences.

Each run of `window` words has a seed: of its shorter runs the one with the least hash
(winnowing), which equal runs share. Seeds only sift: where one stands in two or more documents,
the runs that have it are compared by their hashes, which tell the smallest document with each.
No match is extended word by word and no two texts are compared; window hashes take the place of
that. Runs that overlap join up, so what is removed are the repeats of at least `window` words.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_bits, by_bucket, group_of, groups_for, in_rounds, packed, ready, shortened, text_bytes, unpacked
from .wordgrid import Grid, grids

def seeds(grid: Grid, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each run of `window` words of one text: its first word's place, and its seed's hash."""
    k = (window + 1) // 2
    short, at = grid.grams(k)
    every = np.full(len(grid.word), np.uint64(2**64 - 1))
    every[at] = short
    _, at = grid.grams(window)
    least = every[at].copy()
    for j in range(1, window - k + 1):
        np.minimum(least, every[at + j], out=least)
    return at, least


def numbered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The group's distinct keys in order, and each row's place among them (-1: null)."""
    known = t["key"].is_valid().to_numpy()
    keys = t["key"].fill_null(0).to_numpy()
    distinct = np.unique(keys[known])
    return distinct, np.where(known, np.searchsorted(distinct, keys), -1)


def firsts(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the least owner of each, and whether it has more than one."""
    order = np.lexsort((owner, keys))
    keys, owner = keys[order], owner[order]
    edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, np.int64)
    return keys[edges[:-1]], owner[edges[:-1]], owner[edges[:-1]] != owner[edges[1:] - 1]


def removed_words(docs: DataFrame, window: int, consume_rows, schema: str) -> DataFrame:
    """Runs consume_rows(group's table, grid, mask of its words to remove) over all documents.

    docs: key, text and what is carried. A word goes where a run of `window` words that covers it
    also starts in a document with a smaller key. Documents with null keys neither lose words nor
    take any from others.
    """
    ready(docs.sparkSession)
    total = text_bytes(docs)
    groups, bits = groups_for(total), bucket_bits(total)
    dealt = docs.withColumn("g", group_of(groups, F.col("key"), F.col("text")))

    def send_seeds(t: pa.Table, _: dict[int, bytes]):
        _, row = numbered(t)
        keys, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for grid in grids(t["text"]):
            at, seed = seeds(grid, window)
            own = row[grid.row + grid.doc[at]]
            new = (own >= 0) & np.concatenate([[True], (seed[1:] != seed[:-1]) | (own[1:] != own[:-1])])[: len(at)]
            keys.append(shortened(seed[new], bits))
            owner.append(own[new])
        keys, _, several = firsts(np.concatenate(keys), np.concatenate(owner))
        for b, at in by_bucket(keys, bits):
            yield b, packed(keys[at], bits, np.packbits(several[at]), low=40)

    def merge_seeds(payloads: list[bytes]) -> list[bytes]:
        """Which of each group's seeds stand in two documents or more."""
        keys, several = [], []
        for p in payloads:
            k, rest = unpacked(p)
            keys.append(k)
            several.append(np.unpackbits(np.frombuffer(rest, np.uint8), count=len(k)))
        _, which, counts = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        found = counts > 1
        found[which[np.concatenate(several) > 0]] = True
        told = found[which]
        return [np.packbits(x).tobytes() for x in np.split(told, np.cumsum([len(x) for x in keys])[:-1])]

    def send_runs(t: pa.Table, answers: dict[int, bytes]):
        """Of the runs that hold a shared seed: the distinct ones, and the least document of each."""
        distinct, row = numbered(t)
        held, owner, seed_keys, pieces = [], [], [np.empty(0, np.uint64)], []
        for grid in grids(t["text"]):
            at, seed = seeds(grid, window)
            pieces.append((shortened(seed, bits), grid.grams(window)[0], row[grid.row + grid.doc[at]]))
            seed_keys.append(np.unique(pieces[-1][0][pieces[-1][2] >= 0]))
        known = np.unique(np.concatenate(seed_keys))
        shared = [np.unpackbits(np.frombuffer(answers[b], np.uint8), count=at.stop - at.start) for b, at in by_bucket(known, bits)]
        known = known[np.concatenate(shared) > 0] if shared else known
        for seed, run, own in pieces:
            stay = (own >= 0) & np.isin(seed, known)
            held.append(run[stay])
            owner.append(own[stay])
        keys, least, _ = firsts(np.concatenate(held), np.concatenate(owner)) if held else (np.empty(0, np.uint64),) * 3
        for b, at in by_bucket(keys, bits):
            runs = keys[at].astype("<u8").tobytes()
            if len(distinct) > (at.stop - at.start) // 2:  # the documents themselves, or their places in a list
                yield b, b"".join([np.array([len(keys[at]), 0], "<u4").tobytes(), runs, distinct[least[at]].astype("<i8").tobytes()])
            else:
                yield b, b"".join([np.array([len(keys[at]), len(distinct)], "<u4").tobytes(), runs, distinct.astype("<i8").tobytes(), least[at].astype("<u4").tobytes()])

    def merge_runs(payloads: list[bytes]) -> list[bytes]:
        """Each group's runs that stand in a document before the group's first one with it."""
        keys, least = [], []
        for p in payloads:
            n, listed = np.frombuffer(p, "<u4", 2).tolist()
            keys.append(np.frombuffer(p, "<u8", n, 8))
            ids = np.frombuffer(p, "<i8", listed or n, 8 + 8 * n)
            least.append(ids[np.frombuffer(p, "<u4", n, 8 + 8 * n + 8 * listed)] if listed else ids)
        all_keys, all_least = np.concatenate(keys), np.concatenate(least)
        order = np.lexsort((all_least, all_keys))
        k, m = all_keys[order], all_least[order]
        new = np.concatenate([[True], k[1:] != k[:-1]])
        first = np.empty(len(k), np.int64)
        first[order] = m[new][np.cumsum(new) - 1]
        earlier = first < all_least
        return [x[e].tobytes() for x, e in zip(keys, np.split(earlier, np.cumsum([len(x) for x in keys])[:-1]), strict=True)]

    def consume(t: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        _, row = numbered(t)
        gone = [np.frombuffer(p, "<u8") for p in answers.values()]
        gone = np.sort(np.concatenate(gone)) if gone else np.empty(0, np.uint64)
        runs, owner = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for grid in grids(t["text"]):
            h, at = grid.grams(window)
            runs.append(h)
            owner.append(row[grid.row + grid.doc[at]])
        runs, owner = np.concatenate(runs), np.concatenate(owner)
        keys, least, several = firsts(runs[owner >= 0], owner[owner >= 0])
        keys, least = keys[several], least[several]  # also within the group: all but the first document's
        bad = np.isin(runs, gone)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
            bad |= (keys[at] == runs) & (owner > least[at])
        bad &= owner >= 0
        done, out = 0, []
        for grid in grids(t["text"]):
            _, at = grid.grams(window)
            cover = np.zeros(len(grid.word) + 1, np.int64)
            hit = at[bad[done : done + len(at)]]
            done += len(at)
            cover[hit] += 1
            cover[hit + window] -= 1
            out.append(consume_rows(t.slice(grid.row, len(grid.counts)), grid, np.cumsum(cover)[:-1] > 0))
        return pa.concat_tables(out)

    return in_rounds(dealt, [(send_seeds, merge_seeds), (send_runs, merge_runs)], consume, schema)


def substring_dedup(docs: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_words, n_removed, kept_sha256 (of the kept words, joined by one
    space). Words are compared as they are; a null text has none. Documents of equal keys do not
    take words from each other. Keys are whole numbers. Runs are compared by 64-bit hashes."""
    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"))

    def rows(t: pa.Table, grid: Grid, gone: np.ndarray) -> pa.Table:
        lost = np.concatenate([[0], np.cumsum(gone)])[grid.starts]
        body, digests = grid.data.tobytes(), []
        for i, (a, z) in enumerate(zip(grid.edges[:-1].tolist(), grid.edges[1:].tolist(), strict=True)):
            words = body[a:z].split()
            if lost[i + 1] > lost[i]:
                words = compress(words, (~gone[grid.starts[i] : grid.starts[i + 1]]).tolist())
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pa.table([t["key"], pa.array(grid.counts, pa.int64()), pa.array(np.diff(lost), pa.int64()), pa.array(digests, pa.string())], ["key", "n_words", "n_removed", "kept_sha256"])

    return removed_words(named, window, rows, "key long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("key", key)


def cut_repeats(docs: DataFrame, window: int = 25, key: str = "doc_id", text: str = "text", count: str | None = "n_chars") -> DataFrame:
    """The documents without repeated passages, with their own columns; a document that a passage
    fills goes. What is kept keeps its white space; `count`, where there is such a column, is the
    new text's number of code points."""
    columns = docs.columns
    rest = F.struct(*[F.col(f"`{c}`") for c in columns if c != text]).alias("rest")
    named = docs.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string").alias("text"), rest)

    def rows(t: pa.Table, grid: Grid, gone: np.ndarray) -> pa.Table:
        body, texts = grid.data.tobytes(), t["text"].to_pylist()
        lost = np.concatenate([[0], np.cumsum(gone)])[grid.starts]
        for i in np.flatnonzero(np.diff(lost)).tolist():
            a, z = int(grid.starts[i]), int(grid.starts[i + 1])
            kept, at = [], int(grid.edges[i])
            change = np.flatnonzero(np.diff(gone[a:z].astype(np.int8), prepend=0, append=0))
            for x, y in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                kept.append(body[at : grid.first[a + x]])
                at = int(grid.first[a + y]) if a + y < z else int(grid.edges[i + 1])
            kept.append(body[at : grid.edges[i + 1]])
            texts[i] = b"".join(kept).decode()
        some = pa.array((np.diff(lost) < grid.counts) | (grid.counts == 0))
        return pa.table([pa.array(texts, pa.string()), t["rest"]], ["text", "rest"]).filter(some)

    out = removed_words(named, window, rows, named.select("text", "rest").schema)
    made = [F.col("text").alias(c) if c == text else F.col(f"rest.`{c}`").alias(c) for c in columns]
    out = out.select(*made)
    return out.withColumn(count, F.length(text).cast(out.schema[count].dataType)) if count in columns else out
