"""Token counts and ids of whole texts by public vocabulary files.

`count_tokens` merges byte pairs with a heap over a linked list and counts symbols less merges;
no identifier is made. `token_ids` asks the tokenizers library. Both work a text's chunks between
single spaces, which are tokenised alike wherever they stand, and remember recent chunks.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready, spread
from .wordgrid import span_hashes

#: Chunks that a worker remembers at most.
REMEMBERED = 1_500_000

#: A text with a longer stretch without a space is worked whole.
LONG = 1 << 16

#: White space that is neither a space nor \n: such texts are not cut into chunks.
RARE_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def plain(text: str) -> bool:
    """Whether the text may be cut before each space: no run of white space crosses a cut."""
    if "  " in text or " \n" in text or "\n " in text or RARE_SPACE.search(text):
        return False
    return len(text) < LONG or max(map(len, text.split(" "))) < LONG


def byte_letters() -> list[str]:
    """The letters that stand for the 256 bytes in byte-level vocabularies: printable Latin-1
    stands for itself, the others for letters from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    letters = {b: chr(b) for b in shown}
    for b in range(256):
        letters.setdefault(b, chr(256 + len(letters) - len(shown)))
    return [letters[b] for b in range(256)]


class Chunks:
    """The chunks of a run of plain texts: each from a space, or its text's start, to the next space."""

    def __init__(self, texts: list[bytes]) -> None:
        edges = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        self.body = b"".join(texts)
        data = np.frombuffer(self.body, np.uint8)
        cut = data == 0x20
        cut[edges[:-1][np.diff(edges) > 0]] = True
        self.first = np.flatnonzero(cut)
        self.end = np.append(self.first[1:], len(data))
        self.starts = np.searchsorted(self.first, edges)
        keys = span_hashes(data, self.first, self.end) if len(data) else np.empty(0, np.uint64)
        self.keys, self.sample, self.which = np.unique(keys, return_index=True, return_inverse=True)

    def text(self, i: int) -> str:
        """The chunk that unique key i stands for."""
        j = self.sample[i]
        return self.body[self.first[j] : self.end[j]].decode()


class Memory:
    """What recent chunks gave, as sorted arrays of bounded size: key, value, times seen."""

    def __init__(self) -> None:
        self.keys, self.values, self.seen = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int32)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: their values, and the places of those not known."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        known = self.keys[at] == keys
        self.seen[at[known]] += 1
        return np.where(known, self.values[at], 0), np.flatnonzero(~known)

    def learn(self, keys: np.ndarray, values: np.ndarray) -> None:
        if len(self.keys) + len(keys) > REMEMBERED:  # what came in one batch only goes first
            stay = np.flatnonzero(self.seen > 0)
            stay = stay[np.argsort(-self.seen[stay], kind="stable")[: REMEMBERED // 2]]
            stay.sort()
            self.keys, self.values, self.seen = self.keys[stay], self.values[stay], np.zeros(len(stay), np.int32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.values, self.seen = np.insert(self.keys, at, keys), np.insert(self.values, at, values), np.insert(self.seen, at, 0)


class PairMerger:
    """A byte-level BPE vocabulary as ranked pairs. A .json file has ordered merges, a .tiktoken
    file ranked byte strings; other kinds are refused."""

    def __init__(self, path: str) -> None:
        import public_tokenizers

        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.special: list[str] = []
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as f:
                d = json.load(f)
            pre = d.get("pre_tokenizer") or {}
            if d["model"]["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or d.get("normalizer"):
                raise ValueError(f"{path}: only plain byte-level BPE can be counted")
            ids = d["model"]["vocab"]
            self.first = [ids[c] for c in byte_letters()]
            pairs = (m.split(" ") if isinstance(m, str) else m for m in d["model"]["merges"])
            self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
            self.special = [t["content"] for t in d.get("added_tokens", ())]
        elif path.endswith(".tiktoken"):
            with open(path, "rb") as f:
                ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.first = [ids[bytes([b])] for b in range(256)]
            self.merges = {(ids[w[:i]], ids[w[i:]]): (n, n) for w, n in ids.items() for i in range(1, len(w)) if w[:i] in ids and w[i:] in ids}
        else:
            raise ValueError(f"{path}: only .json and .tiktoken vocabularies can be counted")
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.pieces: dict[str, int] = {}
        self.memory = Memory()

    def merged(self, piece: bytes) -> int:
        """Symbols of one piece less the merges that its pairs allow, lowest rank first, then leftmost."""
        symbol = [self.first[b] for b in piece]
        n = left_over = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        find, heap = self.merges.get, []
        for i in range(n - 1):
            if m := find((symbol[i], symbol[i + 1])):
                heap.append((m[0], i, m[1], symbol[i], symbol[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, new, a, b = heapq.heappop(heap)
            j = after[i]
            if symbol[i] != a or j >= n or symbol[j] != b:
                continue
            symbol[i], symbol[j] = new, -1
            k = after[i] = after[j]
            left_over -= 1
            if k < n:
                before[k] = i
                if m := find((new, symbol[k])):
                    heapq.heappush(heap, (m[0], i, m[1], new, symbol[k]))
            if (h := before[i]) >= 0 and (m := find((symbol[h], new))):
                heapq.heappush(heap, (m[0], h, m[1], symbol[h], new))
        return left_over

    def of_text(self, text: str) -> int:
        total, known = 0, self.pieces
        for piece in self.pattern.findall(text):
            n = known.get(piece)
            if n is None:
                if len(known) >= REMEMBERED // 4:
                    known.clear()
                n = self.merged(piece.encode())
                if len(piece) < 64:
                    known[piece] = n
            total += n
        return total

    def whole(self, text: str) -> int:
        """As the library counts a text that may hold special strings."""
        if self.cut and self.cut.search(text):
            return sum(map(self.of_text, self.cut.split(text))) + len(self.cut.findall(text))
        return self.of_text(text)

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; the texts of one call should be some megabytes at most."""
        easy = [plain(x) and not any(s in x for s in self.special) for x in texts]
        out = [0 if e else self.whole(x) for x, e in zip(texts, easy, strict=True)]
        c = Chunks([x.encode() for x, e in zip(texts, easy, strict=True) if e])
        values, new = self.memory.find(c.keys)
        values[new] = [self.of_text(c.text(i)) for i in new]
        self.memory.learn(c.keys[new], values[new])
        total = np.concatenate([[0], np.cumsum(values[c.which])])
        counts = iter((total[c.starts[1:]] - total[c.starts[:-1]]).tolist())
        return [next(counts) if e else n for n, e in zip(out, easy, strict=True)]


@lru_cache(maxsize=4)
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, vocabulary: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, n_bytes (UTF-8) and n_tokens of the whole text; null is empty."""
    ready(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    named = spread(docs.select(F.col(key).alias("key"), F.col(text).alias("text")))

    def run(batches):
        m = merger(vocabulary)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            counts = [n for a, z in small_runs(texts) for n in m.count(texts[a:z])]
            yield pa.record_batch([b.column(0), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(counts, pa.int64())], ["key", "n_bytes", "n_tokens"])

    schema = named.select("key").schema.add("n_bytes", "long").add("n_tokens", "long")
    return named.mapInArrow(run, schema).withColumnRenamed("key", key)


class IdReader:
    """Ids as the tokenizers library gives them, as little-endian unsigned 32-bit numbers.

    Where a byte-level vocabulary numbers its merges in order, as is checked, ranked merging by
    tiktoken gives the same ids; it reads the chunks. All else goes to the library itself.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            d = json.load(f)
        pre, model = d.get("pre_tokenizer") or {}, d["model"]
        self.special = [t["content"] for t in d.get("added_tokens", ())]
        self.chunked = model["type"] == "BPE" and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not d.get("normalizer")
        if self.chunked:
            ids = {k: v for k, v in model["vocab"].items() if k not in self.special}
            pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            self.chunked = all(ids[a + b] == 256 + n for n, (a, b) in enumerate(pairs)) and len(ids) == 256 + len(pairs)
        if self.chunked:
            byte = {c: b for b, c in enumerate(byte_letters())}
            ranks = {bytes(byte[c] for c in k): v for k, v in ids.items()}
            self.ranked = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.size = np.zeros(max(ranks.values()) + 1, np.int64)
            self.size[list(ranks.values())] = [len(k) for k in ranks]
        self.memory, self.pool, self.used = Memory(), np.empty(1 << 20, "<u4"), 0

    def encoded(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, c: Chunks, new: np.ndarray) -> np.ndarray:
        """Where each new chunk's ids are in the pool from now on: place * 2**20 + length."""
        body, at = c.body, c.sample[new]
        spaced = np.frombuffer(body, np.uint8)[c.first[at]] == 0x20
        new = np.concatenate([new[spaced], new[~spaced]])
        at = c.sample[new]
        pieces = [body[a:b] for a, b in zip(c.first[at].tolist(), c.end[at].tolist(), strict=True)]
        n = int(spaced.sum())
        ids = self.ranked.encode_to_numpy(b"".join(pieces[:n]).decode(), disallowed_special=())
        ends = np.searchsorted(np.cumsum(self.size[ids]), np.cumsum([len(x) for x in pieces[:n]])) + 1 if n else np.empty(0, np.int64)
        heads = [self.ranked.encode_to_numpy(x.decode(), disallowed_special=()) for x in pieces[n:]]
        lengths = np.concatenate([np.diff(ends, prepend=0), np.array([len(x) for x in heads], np.int64)]).astype(np.int64)
        fresh = np.concatenate([ids, *heads]).astype("<u4")
        if self.used + len(fresh) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + 2 * len(fresh), "<u4")])
        self.pool[self.used : self.used + len(fresh)] = fresh
        places = np.empty(len(c.keys), np.int64)
        places[new] = (self.used + np.cumsum(lengths) - lengths << 20) + lengths
        self.used += len(fresh)
        return places

    def read(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; the texts of one call should be some megabytes at most."""
        easy = [self.chunked and plain(x) and not any(s in x for s in self.special) for x in texts]
        hard = iter(self.encoded([x for x, e in zip(texts, easy, strict=True) if not e]))
        c = Chunks([x.encode() for x, e in zip(texts, easy, strict=True) if e])
        if self.used > 4 * REMEMBERED:  # the pool is bounded too
            self.memory, self.used = Memory(), 0
        places, new = self.memory.find(c.keys)
        if len(new):
            places[new] = self.learn(c, new)[new]
            self.memory.learn(c.keys[new], places[new])
        places = places[c.which]
        lengths = places & ((1 << 20) - 1)
        ends = np.cumsum(lengths)
        ids = self.pool[np.repeat((places >> 20) - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]
        cuts = np.concatenate([[0], ends])[c.starts]
        soft = (ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return [next(soft) if e else next(hard) for e in easy]


@lru_cache(maxsize=4)
def reader(path: str) -> IdReader:
    return IdReader(path)


def small_runs(texts: list[str], chars: int = 2_000_000) -> list[tuple[int, int]]:
    """Consecutive runs of texts of about so many characters."""
    runs, a, size = [], 0, 0
    for i, x in enumerate(texts):
        size += len(x)
        if size >= chars:
            runs.append((a, i + 1))
            a, size = i + 1, 0
    return [*runs, (a, len(texts))] if a < len(texts) else runs
