"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguises: case, accents, invisible characters, letters of other scripts that look
like Latin ones, digits and signs in the place of letters, letters spaced apart or drawn out. The
lexicon is learnt from labelled rows: beginnings of words that stand in many more toxic documents
than in clean ones, weighted by that log ratio. A hit inside an exception phrase (given, or found
around hits in clean documents) counts nothing. The sum of a text's weights divided by its number
of words is turned into a probability by a rising curve fitted on the labelled rows.

What leaves Spark is bounded by parameters: the lexicon, the exceptions, the counts of the bins, and
the labels that the model is fitted on, which are drawn by a hash where there are more, and go to
the documents, whose texts so stay where they are.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, ready, spread

# What looks like what. Latin i and l, which digits and signs stand for alike, fold to one.
LOOKS_LIKE = {
    "a": "4@αа", "b": "8βь", "c": "ϲс¢", "d": "ԁ", "e": "3€εеє", "g": "9ɡ", "h": "һн", "i": "1!|lıιіӏ", "j": "ϳј", "k": "κк", "m": "м", "n": "ոп", "o": "0οоօ", "p": "ρр",
    "q": "ԛ", "r": "г", "s": "5$ѕ", "t": "7+τт", "u": "υս", "v": "νѵ", "w": "ωԝш", "x": "χх", "y": "γу", "z": "2ζ",
}
UNSEEN = "­​‌‍‎‏⁠﻿"
SIGNS = "@!|€$¢+"

LETTERS = {ord(c): to for to, froms in LOOKS_LIKE.items() for c in froms if not c.isdigit() and c not in SIGNS}
LETTERS |= {ord(c): None for c in UNSEEN}
INSIDE = {ord(c): to for to, froms in LOOKS_LIKE.items() for c in froms if c.isdigit() or c in SIGNS}

MARKS = re.compile("[̀-ͯ]+")
DRAWN_OUT = re.compile(r"([^\W\d_])\1{2,}")
SPACED = re.compile(r"(?<!\w)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\w)")
MIXED = re.compile(rf"(?<![\w{re.escape(SIGNS)}])(?=[\d{re.escape(SIGNS)}]*[^\W\d_])[\w{re.escape(SIGNS)}]*[\d{re.escape(SIGNS)}]+(?=[\w{re.escape(SIGNS)}]*[^\W_])[\w{re.escape(SIGNS)}]*")
TAIL = re.compile(rf"[{re.escape(SIGNS)}]+$")
WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Settings:
    """support: toxic documents that a term stands in at least; ratio: by how much likelier it is
    there than in clean ones; shortest, longest: letters of a term; terms, exceptions: at most so
    many, the best supported first; limit: score from which a text is predicted toxic."""

    support: int = 6
    ratio: float = 8.0
    shortest: int = 3
    longest: int = 12
    terms: int = 20_000
    exceptions: int = 20_000
    labels: int = 50_000
    limit: float = 0.7


def folded(text: str) -> str:
    """The words of a text, folded, between single spaces, with one at each end."""
    t = text.lower()
    if not t.isascii():
        t = MARKS.sub("", unicodedata.normalize("NFKD", t).lower())
    t = DRAWN_OUT.sub(r"\1", t)
    t = SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), t)
    t = t.translate(LETTERS)
    if any(c in t for c in SIGNS) or re.search(r"\d", t):
        t = MIXED.sub(lambda m: TAIL.sub("", m[0]).translate(INSIDE), t)
    return f" {' '.join(WORDS.findall(t))} "


def fold_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [folded(t or "") for t in b.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), b.column("toxic")], names=["words", "toxic"])


def told(counts: Counter, schema: pa.Schema) -> pa.RecordBatch:
    keys = list({k for k, _ in counts})
    return pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), *(pa.array([counts.get((k, y), 0) for k in keys], pa.int64()) for y in (1, 0))], schema=schema)


def counted(rows: DataFrame, items: Callable[[str], Iterable], kind: str) -> DataFrame:
    """item, toxic and clean: in how many documents of either label it stands. `items` gives those
    of a folded text; each task adds up before it sends."""
    schema = pa.schema([("item", pa.string() if kind == "string" else pa.int32()), ("toxic", pa.int64()), ("clean", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for words, y in zip(b.column("words").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                counts.update((i, y) for i in items(words))
            if len(counts) > 400_000:
                yield told(counts, schema)
                counts.clear()
        if counts:
            yield told(counts, schema)

    return rows.mapInArrow(run, f"item {kind}, toxic long, clean long").groupBy("item").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def beginnings(shortest: int, longest: int) -> Callable[[str], set[str]]:
    def of(words: str) -> set[str]:
        return {w[:n] for w in set(words.split()) for n in range(shortest, min(len(w), longest) + 1)}

    return of


def log_ratio(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    return F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))


def lexicon(rows: DataFrame, n_toxic: int, n_clean: int, s: Settings) -> dict[str, float]:
    """Terms and weights. Of a chain of beginnings with the same documents the longest stands for
    all, so that a term says as much as it can; a word counts with its heaviest term only."""
    c = counted(rows, beginnings(s.shortest, s.longest), "string")
    c = c.withColumn("weight", log_ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean)).where((F.col("toxic") >= s.support) & (F.col("weight") >= math.log(s.ratio)))
    found = {r["item"]: (r["toxic"], r["weight"]) for r in c.orderBy(F.desc("toxic"), "item").limit(s.terms).collect()}
    carried: dict[str, int] = {}
    for t, (n, _) in found.items():
        carried[t[:-1]] = max(carried.get(t[:-1], 0), n)
    return {t: w for t, (n, w) in sorted(found.items()) if 10 * carried.get(t, 0) < 9 * n}


class Matcher:
    """The automaton over terms (at the beginnings of words) and exceptions (whole words)."""

    def __init__(self, terms: dict[str, float], exceptions: Iterable[str] = ()):
        self.automaton = ahocorasick.Automaton()
        for t, w in terms.items():
            self.automaton.add_word(f" {t}", (w, len(t) + 1))
        for e in exceptions:
            self.automaton.add_word(f" {e} ", (None, len(e) + 2))
        if len(self.automaton):
            self.automaton.make_automaton()

    def hits(self, words: str) -> list[tuple[int, float]]:
        """Where the hit words begin (their space), and their weights, without excepted ones."""
        if not len(self.automaton):
            return []
        best: dict[int, float] = {}
        spans = []
        for end, (w, n) in self.automaton.iter(words):
            at = end - n + 1
            if w is None:
                spans.append((at, end))
            else:
                best[at] = max(best.get(at, w), w)
        if spans:
            best = {at: w for at, w in best.items() if not any(a <= at < b for a, b in spans)}
        return sorted(best.items())

    def density(self, words: str) -> float:
        return sum(w for _, w in self.hits(words)) / max(1, words.count(" ") - 1)


class Around:
    """The phrases of two words around the hits of a text. The automaton is made where it is used."""

    def __init__(self, terms: dict[str, float]):
        self.terms, self.matcher = terms, None

    def __call__(self, words: str) -> set[str]:
        self.matcher = self.matcher or Matcher(self.terms)
        out = set()
        for at, _ in self.matcher.hits(words):
            end = words.index(" ", at + 1)
            before, after = words.rfind(" ", 0, at), words.find(" ", end + 1)
            if before >= 0:
                out.add(words[before + 1 : end])
            if after > 0:
                out.add(words[at + 1 : after])
        return out


def exceptions(rows: DataFrame, terms: dict[str, float], n_toxic: int, n_clean: int, s: Settings) -> list[str]:
    """Phrases around hits that are likelier in clean documents than in toxic ones."""
    c = counted(rows, Around(terms), "string").where(F.col("clean") >= s.support)
    c = c.where(log_ratio(F.col("toxic"), F.col("clean"), n_toxic, n_clean) < 0)
    return [r["item"] for r in c.orderBy(F.desc("clean"), "item").limit(s.exceptions).collect()]


#: Bins of a density: 0 for none, then half powers of two.
LOWEST, BINS = -14.0, 40


def bin_of(density: float) -> int:
    return 0 if density <= 0 else min(BINS - 1, max(1, 1 + int(2 * (math.log2(density) - LOWEST))))


class Binned:
    """The bin of a text's density."""

    def __init__(self, terms: dict[str, float], excepted: list[str]):
        self.given, self.matcher = (terms, excepted), None

    def __call__(self, words: str) -> list[int]:
        self.matcher = self.matcher or Matcher(*self.given)
        return [bin_of(self.matcher.density(words))]


def curve(bins: list[tuple[int, int, int]]) -> tuple[list[float], list[float]]:
    """Densities (as log2, LOWEST - 1 for none) and rising probabilities, by pooling neighbours
    that fall; each bin is drawn towards the base rate by the weight of one row."""
    base = sum(t for _, t, _ in bins) / max(1, sum(t + c for _, t, c in bins))
    pools: list[list[float]] = []
    for b, t, c in sorted(bins):
        pools.append([b, b, t + base, t + c + 1.0])
        while len(pools) > 1 and pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3]:
            _, last, t2, n2 = pools.pop()
            pools[-1] = [pools[-1][0], last, pools[-1][2] + t2, pools[-1][3] + n2]
    at = lambda b: LOWEST - 1 if b == 0 else LOWEST + (b - 0.5) / 2
    points = [(at(x), t / n) for a, b, t, n in pools for x in ([a] if a == b else [a, b])]
    return [p[0] for p in points], [p[1] for p in points]


def score_toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, excepted: Iterable[str] = ()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels count only where crc32 of doc_id as text, mod 3, is not 1. Null text: empty, which has
    no hit; null doc_id: never a labelled row, held_out null counts as false. A document labelled
    twice is toxic if either label says so; a document that stands there twice is scored twice.
    Very long texts are matched whole. Without labels of both kinds every score is the share of
    toxic ones (0 without any). Other columns take no part.
    """
    s, spark = settings or Settings(), ready(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").where(~held).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.labels)
    rows = docs.where(~held).select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("text", "toxic")
    rows = kept(rows.mapInArrow(fold_batches, "words string, toxic int"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    terms: dict[str, float] = {}
    found: list[str] = []
    points = ([0.0], [n.get(1, 0) / max(1, sum(n.values()))])
    if len(n) == 2:
        terms = lexicon(rows, n[1], n[0], s)
        given = [folded(e).strip() for e in excepted]
        found = given + exceptions(rows, terms, n[1], n[0], s)
        points = curve([tuple(r) for r in counted(rows, Binned(terms, found), "int").collect()])

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Matcher(terms, found)
        for b in batches:
            density = np.array([m.density(folded(t or "")) for t in b.column("text").to_pylist()])
            log = np.log2(density, out=np.full(len(density), LOWEST - 1), where=density > 0)
            p = np.interp(np.maximum(log, LOWEST - 1), *points)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array((p >= s.limit).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return spread(docs.select("doc_id", held.alias("held_out"), "text")).mapInArrow(score, f"doc_id {kind}, held_out boolean, score double, predicted int")
