"""Words of many texts at once, as arrays: hashes, places and runs, without a Python loop over words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are worked on in pieces of about so many bytes; a longer text is a piece of its own.
CHUNK = 2 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


SEED = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)

#: Bytes of a part that are hashed at once, how many such blocks all parts take together, and what is left of a block's bytes.
BLOCK, TOGETHER = 8, 32
HEAD = np.array([(1 << 8 * n) - 1 for n in range(BLOCK + 1)], np.uint64)


def span_hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the parts data[first:end], none empty. Eight bytes at a time go into a
    chain of finalisers, so that no pattern of bytes makes two parts meet, as it can in sums of
    powers. The few parts beyond 256 bytes go through BLAKE2 each."""
    size = end - first
    out = mix(size.astype(np.uint64) + SEED)
    padded = np.concatenate([data, np.zeros(BLOCK, np.uint8)])
    blocks = np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))
    at = np.flatnonzero(size <= BLOCK * TOGETHER)
    for j in range(TOGETHER):
        at = at[size[at] > BLOCK * j] if j else at
        if not len(at):
            break
        left = np.minimum(size[at] - BLOCK * j, BLOCK)
        out[at] = mix(out[at] ^ (blocks[first[at] + BLOCK * j] & HEAD[left]))
    body = memoryview(data)
    for i in np.flatnonzero(size > BLOCK * TOGETHER).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(body[int(first[i]) : int(end[i])], digest_size=8).digest(), "little")
    return out


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs."""
    return mix(left * STEP + right)


class Grid:
    """The words of a run of texts. first/last+1: byte places in `data`; doc: which text; word: hash."""

    __slots__ = ("data", "edges", "first", "end", "doc", "counts", "starts", "word", "row")

    def __init__(self, data: np.ndarray, edges: np.ndarray, row: int) -> None:
        """edges: where texts start in data, and its end; row: the first text's number in its table."""
        self.data, self.edges, self.row = data, edges, row
        inside = ~SPACE[data]
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        starts = edges[:-1]
        before[starts[starts < len(data)]] = False
        self.first = np.flatnonzero(inside & ~before)
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        ends = edges[1:] - 1
        after[ends[ends >= 0]] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.counts = np.diff(np.searchsorted(self.first, edges))
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.word = span_hashes(data, self.first, self.end)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of k words of one text, and each run's first word's place in the grid.
        Runs are joined of halves, as k's binary digits tell."""
        n = len(self.word)
        if n < k:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        h, length, part, size = None, 0, self.word, 1
        while True:
            if k & size:
                h = part if h is None else joined(part[: len(part) - length], h[size:])
                length += size
            if 2 * size > k:
                break
            part, size = joined(part[:-size], part[size:]), 2 * size
        h = h[: n - k + 1]
        at = np.flatnonzero(self.doc[: n - k + 1] == self.doc[k - 1 :])
        return mix(h[at] ^ np.uint64(k)), at


def grids(texts: pa.ChunkedArray | pa.Array, lower: bool = False) -> Iterator[Grid]:
    """The texts, a piece at a time; null is empty."""
    row = 0
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        part = part.cast(pa.large_binary()).fill_null(b"")
        if not len(part):
            continue
        offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
        body = part.buffers()[2]
        body = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
        a = 0
        while a < len(part):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
            data = body[offsets[a] : offsets[b]]
            yield Grid(LOWER[data] if lower else data, offsets[a : b + 1] - offsets[a], row + a)
            a = b
        row += len(part)


def varied(keys: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """How many of each of n groups' keys there are, each key once a group."""
    order = np.lexsort((keys, groups))
    k, g = keys[order], groups[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (g[1:] != g[:-1])
    return np.bincount(g[new], minlength=n)
