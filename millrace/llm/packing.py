"""Best-fit packing of documents' tokens into sequences, improved by swaps between bins."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import group_of, kept, ready, spread
from .tokens import default_vocabulary, reader, small_runs

#: Pieces that are packed together. Each such share ends with one underfull bin at most, or a few.
SHARE = 40_000


def pieces_of(docs: DataFrame, capacity: int, vocabulary: str, key: str, text: str, end_id: int) -> DataFrame:
    """key, piece, start, length, ids_crc32 of each document's pieces. Documents beyond the
    capacity are cut into full pieces; the first one is the shorter."""
    named = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))
    end = np.array([end_id], "<u4")

    def run(batches):
        r = reader(vocabulary)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            rows: list[tuple] = []
            for a, z in small_runs(texts):
                for i, ids in enumerate(r.read(texts[a:z]), a):
                    ids = np.concatenate([ids, end]).tobytes()
                    n, at, p = len(ids) // 4, 0, 0
                    size = (n - 1) % capacity + 1
                    while at < n:
                        rows.append((i, p, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)])))
                        at, p, size = at + size, p + 1, capacity
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.record_batch([b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])], ["key", "piece", "start", "length", "ids_crc32"])

    schema = named.select("key").schema.add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long")
    return named.mapInArrow(run, schema)


class Rooms:
    """Bins by the room that is left in them; full and empty ones are not held."""

    def __init__(self, capacity: int) -> None:
        self.bins: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
        self.values: list[int] = []

    def put(self, b: int, room: int) -> None:
        if 0 < room < len(self.bins) - 1:
            if not self.bins[room]:
                insort(self.values, room)
            self.bins[room][b] = None

    def take(self, b: int, room: int) -> None:
        if self.bins[room].pop(b, 0) is None and not self.bins[room]:
            self.values.pop(bisect_left(self.values, room))

    def tightest(self, n: int, but: int = -1) -> int:
        """A bin with the least room that holds n, other than `but`; -1 where there is none."""
        for room in islice(self.values, bisect_left(self.values, n), None):
            for b in reversed(self.bins[room]):
                if b != but:
                    return b
        return -1


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of places in `lengths`: longest first, each into the fullest bin that holds it."""
    bins: list[list[int]] = []
    room: list[int] = []
    rooms = Rooms(capacity)
    for i in np.argsort(-lengths, kind="stable").tolist():
        b = rooms.tightest(int(lengths[i]))
        if b < 0:
            b = len(bins)
            bins.append([])
            room.append(capacity)
        rooms.take(b, room[b])
        bins[b].append(i)
        room[b] -= int(lengths[i])
        rooms.put(b, room[b])
    return bins


def swapped(bins: list[list[int]], lengths: np.ndarray, capacity: int, rounds: int = 32) -> list[list[int]]:
    """Local search over the underfull bins, the emptiest first: a document moves to the fullest
    bin that holds it, is exchanged for a shorter one of another bin, or goes with a second one
    for one that is shorter than both. Every step raises the sum of squared fills, so that the
    emptiest bins empty; bins left empty are dropped.

    It ends where no step is left, or where no packing has fewer bins. rounds bounds how often the
    underfull bins are gone through, not which documents take part; an exchange shifts an eighth of
    the capacity at most.
    """
    size_of = lengths.tolist()
    fill = np.array([lengths[b].sum() for b in bins], np.int64)
    fewest = -(-int(fill.sum()) // capacity)
    reach = max(1, capacity // 8)
    rooms = Rooms(capacity)
    for b, f in enumerate(fill.tolist()):
        rooms.put(b, capacity - f)

    def shift(weak: int, to: int, give: list[int], take: list[int]) -> None:
        n = sum(size_of[i] for i in give) - sum(size_of[i] for i in take)
        for b, less, more, gain in ((weak, give, take, -n), (to, take, give, n)):
            rooms.take(b, capacity - int(fill[b]))
            bins[b] = [i for i in bins[b] if i not in less] + more
            fill[b] += gain
            rooms.put(b, capacity - int(fill[b]))

    def underfull() -> list[int]:
        return [b for b in np.argsort(fill, kind="stable").tolist() if 0 < fill[b] < capacity]

    def longest_first(b: int) -> list[int]:
        return sorted(bins[b], key=lambda i: -size_of[i])

    for _ in range(rounds):
        if int((fill > 0).sum()) <= fewest:
            break
        steps = 0
        for weak in underfull():
            for i in longest_first(weak):
                n = size_of[i]
                to = rooms.tightest(n, weak)
                if to >= 0 and fill[to] > fill[weak] - n:
                    shift(weak, to, [i], [])
                    steps += 1
        # every document of an underfull bin, by its length
        loose = underfull()
        place = np.array([i for b in loose for i in bins[b]], np.int64)
        owner = np.repeat(loose, [len(bins[b]) for b in loose])
        order = np.argsort(lengths[place], kind="stable")
        place, owner = place[order], owner[order]
        size, row_of = lengths[place], {i: k for k, i in enumerate(place.tolist())}

        def exchanged(weak: int, give: list[int], size=size, owner=owner, place=place, row_of=row_of) -> bool:
            """Whether the documents went for one that is shorter than they are, with the fullest outcome."""
            n = sum(size_of[i] for i in give)
            some = slice(int(np.searchsorted(size, n - reach)), int(np.searchsorted(size, n)))
            of, shorter = owner[some], size[some]
            after = fill[of] - shorter + n
            ok = (after <= capacity) & (fill[of] > fill[weak] - n + shorter) & (of != weak)
            if not ok.any():
                return False
            k = some.start + int(np.argmax(np.where(ok, after, -1)))
            to = int(owner[k])
            shift(weak, to, give, [int(place[k])])
            owner[k] = weak
            owner[[row_of[i] for i in give]] = to
            return True

        for weak in loose:
            for i in longest_first(weak):
                if i in bins[weak]:
                    steps += exchanged(weak, [i]) or any(exchanged(weak, [i, j]) for j in bins[weak] if j != i)
        if not steps:
            break
    return [b for b in bins if b]


def pack(docs: DataFrame, capacity: int = 2048, vocabulary: str | None = None, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces (a few numbers each, no texts) are dealt evenly to shares of about 40,000, packed
    apart; sequence numbers hold the share in their upper bits. Null texts are empty: one end id.
    """
    ready(docs.sparkSession)
    pieces = kept(pieces_of(docs, capacity, vocabulary or default_vocabulary(), key, text, end_id))
    shares = max(1, -(-pieces.count() // SHARE))
    dealt = pieces.withColumn("share", group_of(shares, F.monotonically_increasing_id()))

    def run(t: pd.DataFrame) -> pd.DataFrame:
        t = t.reset_index(drop=True)
        lengths = t["length"].to_numpy()
        sequence, offset = np.empty(len(t), np.int64), np.empty(len(t), np.int64)
        for s, members in enumerate(swapped(best_fit(lengths, capacity), lengths, capacity)):
            sequence[members] = (int(t["share"][0]) << 32) + s
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        return t.assign(sequence_id=sequence, offset=offset).drop(columns="share")

    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")
    return dealt.groupBy("share").applyInPandas(run, schema).withColumnRenamed("key", key)
