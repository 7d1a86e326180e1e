"""A log-bilinear language model, trained in numpy with noise-contrastive estimation.

Word counts over all training documents give the units: the most frequent words each for itself,
about twice the square root of the number of training tokens, and classes (by the last letters)
for all others. The model predicts the next unit from the one before: the score of unit w after
unit h is r_h . q_w + b_w. Training goes through the unit pairs of all training documents, each
occurrence once a round at least; noise units are drawn from the unit counts. Matrix products over all
units then give each unit's normaliser. A class's probability is spread over its words by their
counts, with one place kept for words never seen.

As units grow with the root of the tokens, so do the trainers: what trainers send (their number
times the units) and the normalisers (units squared) grow with the input, and no faster.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain, islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_bits, by_bucket, group_of, groups_for, in_rounds, kept, packed, ready, spread, text_bytes, unpacked
from .wordgrid import Grid, grids, mix

#: Pairs that are put in random order at once; different pairs that are counted before they are
#: gone through, and how many a single one may stand for.
SHUFFLED, DISTINCT, HEAVY = 1 << 20, 5 << 20, 32

#: Steps of training that are made ready at once.
TOGETHER = 64

#: Units of a message or of a normaliser's task.
BLOCK = 1024
FIRST = np.zeros(1, np.int64)

#: Words with counts that a task holds before it sends them.
HELD = 2 << 20


@dataclass(frozen=True)
class Settings:
    """words: units of their own, at least (more where the corpus is large); classes: units of all
    other words; batch: pairs a step; steps: batches of training, at least; rounds: how often all pairs take part, however
    many, and the trainers' models are put together. The end of a text is a unit too, and the
    context of its first word."""

    words: int = 1023
    classes: int = 1024
    width: int = 32
    batch: int = 1024
    noise: int = 256
    steps: int = 3200
    rate: float = 0.1
    seed: int = 0
    rounds: int = 3

    def words_for(self, tokens: int) -> int:
        return max(self.words, 2 * isqrt(tokens))

    def trainers_for(self, tokens: int) -> int:
        return max(1, isqrt(tokens) // 1000)

    def passes_for(self, tokens: int) -> int:
        """How often a round goes through all pairs."""
        return max(1, -(-self.steps * self.batch // max(self.rounds * tokens, 1)))


def word_classes(grid: Grid, classes: int) -> np.ndarray:
    """The class of each word, by its last two letters or signs (bytes) and whether it is short."""
    last = grid.data[grid.end - 1].astype(np.uint64)
    second = np.where(grid.end - grid.first > 1, grid.data[np.maximum(grid.end - 2, 0)], 0).astype(np.uint64)
    short = (grid.end - grid.first < 4).astype(np.uint64)
    return (mix(last * np.uint64(512) + second * np.uint64(2) + short + np.uint64(1)) % np.uint64(classes)).astype(np.int64)


def held_out(key: Column) -> Column:
    """The fold that training leaves out: crc32 of the key as text, mod 7, is 2."""
    return F.coalesce(F.crc32(key.cast("string")) % 7 == 2, F.lit(False))


def word_counts(docs: DataFrame, s: Settings) -> DataFrame:
    """Exact word counts of the training documents, one row a bucket of words: tokens and kinds,
    the same by class, how many words have each count, and the words with their counts and classes."""
    buckets = groups_for(text_bytes(docs))

    def messages(words: np.ndarray, n: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
        b_of = ((words >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b_of, kind="stable")
        cuts = np.flatnonzero(np.diff(b_of[order], prepend=-1, append=-1))
        rows = [order[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
        columns = [pa.array([x[r].astype(t).tobytes() for r in rows], pa.binary()) for x, t in ((words, "<u8"), (n, "<i8"), (kind, "<u2"))]
        return pa.record_batch([pa.array([int(b_of[r[0]]) for r in rows], pa.int32()), *columns], ["bucket", "words", "n", "kind"])

    def summed(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        words, n, kind = (np.concatenate(x) for x in zip(*held, strict=True))
        words, first, which = np.unique(words, return_index=True, return_inverse=True)
        return words, np.bincount(which, n).astype(np.int64), kind[first]

    def send(batches):
        held, size = [], 0
        for b in batches:
            for grid in grids(b.column(0), lower=True):
                words, first, n = np.unique(grid.word, return_index=True, return_counts=True)
                held.append((words, n, word_classes(grid, s.classes)[first]))
                size += len(words)
                if size > HELD:
                    held = [summed(held)]
                    size = len(held[0][0])
                    if 2 * size > HELD:
                        yield messages(*held[0])
                        held, size = [], 0
        if held:
            yield messages(*summed(held))

    def count(t: pa.Table) -> pa.Table:
        words, n, kind = (np.concatenate([np.frombuffer(x, d) for x in t[c].to_pylist()]) for c, d in (("words", "<u8"), ("n", "<i8"), ("kind", "<u2")))
        words, first, which = np.unique(words, return_index=True, return_inverse=True)
        n, kind = np.bincount(which, n).astype(np.int64), kind[first]
        row = (np.bincount(kind, n, s.classes).astype(np.int64), np.bincount(kind, minlength=s.classes), *np.unique(n, return_counts=True))
        sums = [pa.array([int(n.sum())]), pa.array([len(words)]), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in row)]
        own = [pa.array([x.astype(d).tobytes()], pa.binary()) for x, d in ((words, "<u8"), (n, "<i8"), (kind, "<u2"))]
        return pa.table([*sums, *own], ["n", "kinds", "class_n", "class_kinds", "level", "many", "words", "word_n", "word_kind"])

    sent = spread(docs.select("text")).mapInArrow(send, "bucket int, words binary, n binary, kind binary")
    return sent.groupBy("bucket").applyInArrow(count, "n long, kinds long, class_n array<bigint>, class_kinds array<bigint>, level array<bigint>, many array<bigint>, words binary, word_n binary, word_kind binary")


def most_frequent(counts: DataFrame, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """About `wanted` of the most frequent words, in order of their hashes: hash, count, class.
    Of the words with the least count among them, those with small hashes are taken."""
    levels = counts.select(F.explode(F.arrays_zip("level", "many")).alias("l")).groupBy("l.level").agg(F.sum("l.many").alias("many")).orderBy(F.desc("level")).collect()
    level, most, above = 1, 2**64 - 1, 0
    for r in levels:
        if above + r["many"] > wanted:
            level, most = r["level"], 2**64 * (wanted - above) // r["many"]
            break
        above += r["many"]

    def choose(batches):
        for b in batches:
            for row in b.to_pylist():
                words, n, kind = (np.frombuffer(row[c], d) for c, d in (("words", "<u8"), ("word_n", "<i8"), ("word_kind", "<u2")))
                stay = (n > level) | ((n == level) & (words <= np.uint64(most)))
                yield pa.record_batch([pa.array([x[stay].tobytes()], pa.binary()) for x in (words, n, kind)], ["words", "word_n", "word_kind"])

    rows = counts.select("words", "word_n", "word_kind").mapInArrow(choose, "words binary, word_n binary, word_kind binary").collect()
    words, n, kind = (np.concatenate([np.empty(0, d), *(np.frombuffer(r[c], d) for r in rows)]) for c, d in (("words", "<u8"), ("word_n", "<i8"), ("word_kind", "<u2")))
    order = np.argsort(words)
    return words[order], n[order], kind[order].astype(np.int64)


@dataclass
class Vocabulary:
    """Sorted hashes of the words that are units, and counts of all training words."""

    words: np.ndarray
    n: np.ndarray
    total: int
    kinds: int
    texts: int
    class_n: np.ndarray
    class_kinds: np.ndarray

    def units(self, grid: Grid, s: Settings) -> np.ndarray:
        """Each word's unit: 0 is the end, then words, then classes."""
        kind = 1 + len(self.words) + word_classes(grid, s.classes)
        if not len(self.words):
            return kind
        begins, low, words = self.begins
        at = begins[(grid.word >> low).astype(np.int64)]
        behind = np.flatnonzero(words[at] < grid.word)
        while len(behind):
            at[behind] += 1
            behind = behind[words[at[behind]] < grid.word[behind]]
        return np.where((words[at] == grid.word) & (at < len(self.words)), 1 + at, kind)

    @cached_property
    def begins(self) -> tuple[np.ndarray, np.uint64, np.ndarray]:
        """Where the words of each value of a hash's upper bits begin (a word or none have most), the
        number of bits below these, and the words with an end that no hash is beyond."""
        upper = (4 * len(self.words)).bit_length()
        low = np.uint64(64 - upper)
        return np.searchsorted(self.words, np.arange(1 << upper, dtype=np.uint64) << low).astype(np.int32), low, np.append(self.words, np.uint64(2**64 - 1))

    def unit_counts(self) -> np.ndarray:
        return np.concatenate([[self.texts], self.n, self.class_n])


def vocabulary(docs: DataFrame, s: Settings) -> Vocabulary:
    """From all training documents; sums, one row a class and the units' words reach the driver."""
    counts = kept(word_counts(docs, s))
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    classes = counts.select(F.posexplode(F.arrays_zip("class_n", "class_kinds")).alias("k", "c")).groupBy("k").agg(F.sum("c.class_n"), F.sum("c.class_kinds")).collect()
    texts = docs.count()
    words, word_n, kind = most_frequent(counts, s.words_for(total + texts))
    class_n, class_kinds = np.zeros(s.classes, np.int64), np.zeros(s.classes, np.int64)
    for k, n, v in classes:
        class_n[k], class_kinds[k] = n, v
    np.subtract.at(class_n, kind, word_n)
    np.subtract.at(class_kinds, kind, 1)
    return Vocabulary(words, word_n, total + texts, kinds + (texts > 0), texts, class_n, class_kinds)


def sequence(units: np.ndarray, grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units with each text's end: (unit before, unit, text) of each token."""
    texts = len(grid.counts)
    out = np.zeros(len(units) + texts, np.int64)
    text = np.repeat(np.arange(texts), grid.counts + 1)
    last = np.cumsum(grid.counts + 1) - 1
    inner = np.ones(len(out), bool)
    inner[last] = False
    out[inner] = units
    before = np.concatenate([[0], out[:-1]])
    return before, out, text


def fresh(unit_counts: np.ndarray, s: Settings) -> np.ndarray:
    """An untrained model, one row a unit: r, q, b, and Adagrad's sums of squares of each."""
    u, rng = len(unit_counts), np.random.default_rng(s.seed)
    r, q = rng.normal(0, 0.1, (u, s.width)), rng.normal(0, 0.1, (u, s.width))
    b = np.log((unit_counts + 1.0) / (unit_counts + 1.0).sum())
    return np.concatenate([r, q, b[:, None], np.full((u, 2 * s.width + 1), 1e-2)], axis=1).astype(np.float32)


def parameters(model: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return model[:, : s.width], model[:, s.width : 2 * s.width], model[:, 2 * s.width]


@dataclass
class Sums:
    """How a step's gradients, a row each, become one row a unit: the units, a row of each, and of those
    with several rows their numbers, all their rows, and where each one's begin there."""

    units: np.ndarray
    first: np.ndarray
    several: np.ndarray
    rest: np.ndarray
    begins: np.ndarray

    def of(self, gradient: np.ndarray) -> np.ndarray:
        total = gradient.take(self.first, 0)
        if len(self.several):
            total[self.several] = np.add.reduceat(gradient.take(self.rest, 0), self.begins)
        return total


def firsts(code: np.ndarray) -> np.ndarray:
    """code: sorted. Where each of its values begins, and its length."""
    return np.concatenate([FIRST, np.flatnonzero(code[1:] != code[:-1]) + 1, [len(code)]])


def sums(step: np.ndarray, unit: np.ndarray, place: np.ndarray, units: int, steps: int) -> Iterator[Sums]:
    """For each of some steps, from each row's step, its unit and its place among the step's rows."""
    code = step * np.int64(units) + unit
    order = np.argsort(code)
    code, place = code[order], place[order]
    edges = firsts(code)
    new, size = edges[:-1], np.diff(edges)
    several = np.flatnonzero(size > 1)
    rest, begins = place[np.repeat(size > 1, size)], np.concatenate([FIRST, np.cumsum(size[several])])
    rows, first = code[new] % units, place[new]
    a = np.searchsorted(code[new], np.arange(steps + 1) * np.int64(units))
    b = np.searchsorted(several, a)
    c = begins[b]
    for i in range(steps):
        yield Sums(rows[a[i] : a[i + 1]], first[a[i] : a[i + 1]], several[b[i] : b[i + 1]] - a[i], rest[c[i] : c[i + 1]], begins[b[i] : b[i + 1]] - c[i])


def learn(model: np.ndarray, unit_counts: np.ndarray, pairs: Iterable[tuple[np.ndarray, ...]], s: Settings, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Noise-contrastive estimation with Adagrad, in place: a step for each batch (units before,
    units and, where pairs stand for several, their weights). Each step draws s.noise noise units; one that it
    draws several times is scored once, and counts as often. What does not depend on the model is worked out for
    TOGETHER steps at once. Returns how often each unit took part as context, and as unit or noise."""
    u, wide = len(model), s.width
    unigram = unit_counts + 1.0
    unigram = unigram / unigram.sum()
    noise_sum = np.cumsum(unigram)
    log_noise = (np.log(unigram) + np.log(s.noise)).astype(np.float32)
    # a unit's q and b stand side by side, r and a one beside them; each part's rows lie in one piece, as whole rows are copied much faster
    one, ends = np.ones((u, 1), np.float32), (0, wide, 2 * wide + 1, 3 * wide + 1, 4 * wide + 2)
    r, qb, r_squares, qb_squares = parts = [model[:, a:b].copy() if k % 2 else np.concatenate([model[:, a:b], one], axis=1) for k, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
    as_context, as_unit = np.zeros(u), np.zeros(u)

    def move(x: np.ndarray, square: np.ndarray, rows: np.ndarray, total: np.ndarray) -> None:
        now = square.take(rows, 0)
        now += total * total
        square[rows] = now
        np.divide(total, np.sqrt(now, out=now), out=total)
        total *= s.rate
        x[rows] = np.subtract(x.take(rows, 0), total, out=total)

    np.seterr(over="ignore")  # what is beyond exp's range gives 0, as it should
    pairs = iter(pairs)
    while some := list(islice(pairs, TOGETHER)):
        steps = len(some)
        h, w = (np.concatenate([x[i] for x in some]) for i in (0, 1))
        weight = np.concatenate([x[2] if len(x) > 2 else np.ones(len(x[0])) for x in some]).astype(np.float64)
        at = np.concatenate([FIRST, np.cumsum([len(x[0]) for x in some])])
        of = np.repeat(np.arange(steps), np.diff(at))
        c = (weight / np.bincount(of, weight, steps)[of]).astype(np.float32)[:, None]
        n = np.minimum(np.searchsorted(noise_sum, np.sort(rng.random((steps, s.noise)), axis=1)), u - 1)
        edges = firsts((n + np.arange(steps)[:, None] * np.int64(u)).ravel())
        n, noise_of, times = n.ravel()[edges[:-1]], edges[:-1] // s.noise, np.diff(edges)
        noise_at = np.searchsorted(noise_of, np.arange(steps + 1))
        as_context += np.bincount(h, weight, u)
        as_unit += np.bincount(w, weight, u) + np.bincount(n, times, u)
        times, log_w, log_n = times.astype(np.float32)[:, None], log_noise[w], log_noise[n]
        place = np.arange(len(h)) - at[of]
        to_units = sums(np.concatenate([of, noise_of]), np.concatenate([w, n]), np.concatenate([place, np.arange(len(n)) - (noise_at - np.diff(at, append=at[-1]))[noise_of]]), u, steps)
        for i, (by_context, by_unit) in enumerate(zip(sums(of, h, place, u, steps), to_units, strict=True)):
            own, its = slice(at[i], at[i + 1]), slice(noise_at[i], noise_at[i + 1])
            rh, qw, qn = r.take(h[own], 0), qb.take(w[own], 0), qb.take(n[its], 0)
            g = (1 / (1 + np.exp(log_w[own] - np.einsum("ij,ij->i", rh, qw))) - 1)[:, None]
            qn[:, wide] -= log_n[its]
            gn = rh @ np.negative(qn).T
            np.exp(gn, out=gn)
            gn += 1
            np.divide(1, gn, out=gn)
            qn *= times[its]
            grow = gn @ qn
            grow += g * qw
            grow *= c[own]
            grow[:, wide] = 0
            rh *= c[own]
            to_both = np.empty((len(rh) + len(qn), wide + 1), np.float32)
            np.multiply(g, rh, out=to_both[: len(rh)])
            np.multiply(gn.T @ rh, times[its], out=to_both[len(rh) :])
            move(qb, qb_squares, by_unit.units, by_unit.of(to_both))
            move(r, r_squares, by_context.units, by_context.of(grow))
    for a, b, part in zip(ends[:-1], ends[1:], parts, strict=True):
        model[:, a:b] = part[:, : b - a]
    return np.rint(as_context).astype(np.int64), np.rint(as_unit).astype(np.int64)


def train(counts: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, q, b from a table of pair counts at hand; pairs are drawn by their counts."""
    rng, unit_counts = np.random.default_rng(s.seed), counts.sum(axis=0, dtype=np.float64)
    model = fresh(unit_counts, s)
    flat = np.flatnonzero(counts)
    weight = np.cumsum(counts.reshape(-1)[flat], dtype=np.float64)

    def drawn():
        for _ in range(s.steps if len(flat) else 0):
            pair = flat[np.searchsorted(weight, rng.random(s.batch) * weight[-1], "right").clip(max=len(flat) - 1)]
            yield pair // len(counts), pair % len(counts)

    learn(model, unit_counts, drawn(), s, rng)
    return parameters(model, s)


def in_batches(pairs: Iterable[tuple[np.ndarray, np.ndarray]], passes: int, s: Settings, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs, each as often as there are passes, some at a time in random order."""

    def mixed(held):
        h, w = (np.concatenate(x) for x in zip(*held, strict=True))
        for _ in range(passes):
            order = rng.permutation(len(h))
            for a in range(0, len(h), s.batch):
                yield h[order[a : a + s.batch]], w[order[a : a + s.batch]]

    held, n = [], 0
    for h, w in pairs:
        held.append((h, w))
        n += len(h)
        if n >= SHUFFLED:
            yield from mixed(held)
            held, n = [], 0
    if held:
        yield from mixed(held)


def counted(pairs: Iterable[tuple[np.ndarray, np.ndarray]], units: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs, DISTINCT or so at a time: each once as a number, in order, with how often it
    stands there."""
    codes, counts, held, n = np.empty(0, np.int64), np.empty(0, np.float32), [], 0
    for h, w in chain(pairs, [(None, None)]):
        if h is not None:
            held.append(h * np.int64(units) + w)
            n += len(h)
            if n < SHUFFLED:
                continue
        if n:
            new, times = np.unique(np.concatenate(held), return_counts=True)
            held, n = [], 0
            at = np.searchsorted(codes, new)
            old = np.zeros(len(new), bool)
            old[at < len(codes)] = codes[at[at < len(codes)]] == new[at < len(codes)]
            counts[at[old]] += times[old]
            codes, counts = np.insert(codes, at[~old], new[~old]), np.insert(counts, at[~old], times[~old])
        if len(codes) > DISTINCT or (h is None and len(codes)):
            yield codes, counts
            codes, counts = codes[:0].copy(), counts[:0].copy()


def weighted_batches(pairs: Iterable[tuple[np.ndarray, np.ndarray]], units: int, passes: int, s: Settings, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Batches for `learn` that stand for about s.batch pairs each; every pair counts once a pass.
    What is very frequent comes several times, for HEAVY pairs at most each."""
    for codes, counts in counted(pairs, units):
        total = counts.sum(dtype=np.float64)
        times = np.ceil(counts / HEAVY).astype(np.int32)
        codes, weights = np.repeat(codes, times), np.repeat(counts / times.astype(np.float32), times)
        order = rng.permutation(len(codes)).astype(np.int32)
        codes, weights = codes[order], weights[order]
        some = replace(s, batch=max(1, int(s.batch * len(codes) / total)))
        for code, weight in in_batches(((codes[a : a + SHUFFLED], weights[a : a + SHUFFLED]) for a in range(0, len(codes), SHUFFLED)), passes, some, rng):
            yield code // units, code % units, weight


def trained(docs: DataFrame, v: Vocabulary, s: Settings) -> np.ndarray:
    """The model after all pairs of the training documents. In each round the trainers start from
    one model and each goes through its own documents; a unit's new row is the mean of theirs,
    weighted by how often it took part. Which documents a trainer has depends on how the input is
    split, and the model with it."""
    sc, unit_counts = docs.sparkSession.sparkContext, v.unit_counts()
    model, passes = fresh(unit_counts, s), s.passes_for(v.total)
    for i in range(s.rounds if v.texts else 0):
        shared = sc.broadcast((v, model))

        def run(batches, i=i, shared=shared):
            v, start = shared.value
            rng, mine = np.random.default_rng([s.seed, i, TaskContext.get().partitionId()]), start.copy()

            def pairs():
                for b in batches:
                    for grid in grids(b.column(0), lower=True):
                        yield sequence(v.units(grid, s), grid)[:2]

            taken = np.stack(learn(mine, unit_counts, weighted_batches(pairs(), len(mine), passes, s, rng), s, rng), axis=1)
            for a in range(0, len(mine), BLOCK):
                at = a + np.flatnonzero(taken[a : a + BLOCK].any(axis=1))
                if len(at):
                    yield pa.record_batch([pa.array([a // BLOCK], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (at.astype("<i8"), taken[at].astype("<i8"), mine[at].astype("<f4")))], ["block", "units", "taken", "rows"])

        def average(t: pa.Table) -> pa.Table:
            units = np.unique(np.concatenate([np.frombuffer(x, "<i8") for x in t["units"].to_pylist()]))
            weight, width = np.zeros((len(units), 2)), s.width
            total = np.zeros((len(units), 4 * width + 2))
            role = np.concatenate([np.zeros(width, int), np.ones(width + 1, int)] * 2)
            for at, taken, rows in zip(*(t[c].to_pylist() for c in ("units", "taken", "rows")), strict=True):
                at = np.searchsorted(units, np.frombuffer(at, "<i8"))
                taken = np.frombuffer(taken, "<i8").reshape(-1, 2) + 1e-9
                weight[at] += taken
                total[at] += taken[:, role] * np.frombuffer(rows, "<f4").reshape(-1, 4 * width + 2)
            return pa.table([pa.array([x.tobytes()], pa.binary()) for x in (units.astype("<i8"), (total / weight[:, role]).astype("<f4"))], ["units", "rows"])

        sent = docs.select("text").coalesce(s.trainers_for(v.total)).mapInArrow(run, "block int, units binary, taken binary, rows binary")
        for row in sent.groupBy("block").applyInArrow(average, "units binary, rows binary").toLocalIterator():
            at = np.frombuffer(row["units"], "<i8")
            model[at] = np.frombuffer(row["rows"], "<f4").reshape(len(at), -1)
        shared.unpersist()
    return model


def normalisers(spark: SparkSession, model: np.ndarray, s: Settings) -> np.ndarray:
    """For each unit the log of the sum over all units that makes its scores probabilities."""
    blocks = -(-len(model) // BLOCK)
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(model[:, : 2 * s.width + 1]))

    def run(batches):
        r, q, b = parameters(shared.value, s)
        for batch in batches:
            for i in batch.column(0).to_pylist():
                rows, out = r[i * BLOCK : (i + 1) * BLOCK], None
                for a in range(0, len(q), 8 * BLOCK):
                    x = rows @ q[a : a + 8 * BLOCK].T + b[a : a + 8 * BLOCK]
                    top = x.max(axis=1, keepdims=True)
                    part = top[:, 0].astype(np.float64) + np.log(np.exp(x - top).sum(axis=1, dtype=np.float64))
                    out = part if out is None else np.logaddexp(out, part)
                yield pa.record_batch([pa.array([i]), pa.array([out.astype("<f8").tobytes()], pa.binary())], ["i", "z"])

    rows = spark.range(blocks, numPartitions=min(blocks, 1024)).mapInArrow(run, "i long, z binary").collect()
    return np.concatenate([np.frombuffer(r["z"], "<f8") for r in sorted(rows)])


def log_probabilities(r: np.ndarray, q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """log10 P(unit | unit before) for all pairs of units, by matrix products of some rows at once."""
    out = np.empty((len(r), len(q)), np.float32)
    for a in range(0, len(r), 256):
        x = (r[a : a + 256] @ q.T + b).astype(np.float64)
        x -= x.max(axis=1, keepdims=True)
        out[a : a + 256] = (x - np.log(np.exp(x).sum(axis=1, keepdims=True))) / np.log(10)
    return out


def score_texts(docs: DataFrame, settings: Settings | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z); tokens are their words and one end. A null text is empty; a null
    key trains. base_score has add-one unigram probabilities from the exact counts of all training
    documents, score the model's; both are log10 sums over the whole text.
    """
    ready(docs.sparkSession)
    s = settings or Settings()
    docs = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), held_out(F.col(key)).alias("held_out"))
    training = docs.where("not held_out")
    v = vocabulary(training, s)
    model = trained(training, v, s)
    shared = docs.sparkSession.sparkContext.broadcast((v, np.ascontiguousarray(model[:, : 2 * s.width + 1]), normalisers(docs.sparkSession, model, s)))
    total = text_bytes(docs)
    groups, bits = groups_for(total), bucket_bits(total)
    dealt = docs.withColumn("g", group_of(groups, F.col("key"), F.col("text")))

    def words_of(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word of the group, and whether it trains."""
        trains = ~t["held_out"].to_numpy()
        words, of = [np.empty(0, np.uint64)], [np.empty(0, bool)]
        for grid in grids(t["text"], lower=True):
            words.append(grid.word)
            of.append(trains[grid.row + grid.doc])
        return np.concatenate(words), np.concatenate(of)

    def emit(t: pa.Table, _: dict[int, bytes]):
        words, trains = words_of(t)
        words, which = np.unique(words, return_inverse=True)
        n = np.bincount(which, trains, len(words)).astype("<u4")
        for b, at in by_bucket(words, bits):
            yield b, packed(words[at], bits, n[at])

    def merge(payloads: list[bytes]) -> list[bytes]:
        both = [unpacked(p) for p in payloads]
        keys = np.concatenate([k for k, _ in both])
        _, which = np.unique(keys, return_inverse=True)
        total = np.zeros(which.max(initial=-1) + 1, np.int64)
        np.add.at(total, which, np.concatenate([np.frombuffer(n, "<u4") for _, n in both]).astype(np.int64))
        return [x.astype("<i8").tobytes() for x in np.split(total[which], np.cumsum([len(k) for k, _ in both])[:-1])]

    def consume(t: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        v, model, z = shared.value
        r, q, b = parameters(model, s)
        words, _ = words_of(t)
        distinct, which = np.unique(words, return_inverse=True)
        c = np.concatenate([np.frombuffer(answers[b], "<i8") for b, _ in by_bucket(distinct, bits)] or [np.empty(0, np.int64)])[which]
        spread = np.log10(v.class_n + v.class_kinds + 1.0)
        done, found = 0, []
        for grid in grids(t["text"], lower=True):
            own = c[done : done + len(grid.word)]
            done += len(grid.word)
            units = v.units(grid, s)
            kind = units - 1 - len(v.words)
            inside = np.where(kind >= 0, np.log10(own + 1.0) - spread[np.maximum(kind, 0)], 0.0)
            before, unit, of = sequence(units, grid)
            n = len(grid.counts)
            natural = np.einsum("ij,ij->i", r[before], q[unit]).astype(np.float64) + b[unit] - z[before]
            score = np.bincount(of, natural / np.log(10), n) + np.bincount(grid.doc, inside, n)
            scale = np.log10(float(v.total) + 1.0 * (v.kinds + 1))
            base = np.bincount(grid.doc, np.log10(own + 1.0), n) + np.log10(v.texts + 1.0) - (grid.counts + 1) * scale
            known = np.bincount(grid.doc, own > 0, n).astype(np.int64) + (v.texts > 0)
            found.append((grid.counts + 1, known, base, score))
        n, known, base, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table([t["key"], t["held_out"], pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(n), v.total), pa.int64()), pa.array(base), pa.array(score)], ["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = docs.select("key", "held_out").schema
    for name, kind in (("n_tokens", "long"), ("n_known", "long"), ("train_tokens", "long"), ("base_score", "double"), ("score", "double")):
        schema = schema.add(name, kind)
    return in_rounds(dealt, [(emit, merge)], consume, schema).withColumnRenamed("key", key)
