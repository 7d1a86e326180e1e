"""Quality rules: a document's own rules, and its host's record of failing them.

Rule failures are summed by host, each host's rate is shrunk towards all hosts' with an
empirical beta prior, and the hosts' verdicts come back to the documents: in a host that is
suspect a document must also pass the strict rules. Clean documents stay in any host.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, ready, spread
from .wordgrid import grids

FEATURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """The first two are the base rules; `suspect_rate` is the shrunken failure rate from which
    a host is suspect, and the strict ones hold in suspect hosts only. With `above`, failures of
    all rules count for a host, strict ones too, and it is suspect from a shrunken rate so many
    standard deviations of the prior above the prior's mean."""

    min_words: int = 10
    max_repeat_percent: int = 20
    suspect_rate: float = 0.5
    strict_repeat_percent: int = 10
    strict_symbol_percent: int = 10
    strict_dup_line_percent: int = 30
    above: float | None = None


def measure(texts: pa.ChunkedArray) -> dict[str, np.ndarray]:
    """The features of each text; null is empty."""
    found: dict[str, list] = {k: [] for k in FEATURES}
    for grid in grids(texts):
        data, edges, n = grid.data, grid.edges, len(grid.counts)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        chars = np.concatenate([[0], np.cumsum(points[grid.end] - points[grid.first])])
        symbols = np.concatenate([[0], np.cumsum(SYMBOL[data])])
        keys, at = grid.grams(5)
        keys = keys ^ (grid.doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        twice = np.zeros(len(keys), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(len(grid.word), bool)
        for j in range(5):
            covered[at[twice] + j] = True
        repeat = np.concatenate([[0], np.cumsum(covered)])
        body = data.tobytes()
        lines, dups = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for i in range(n):
            own = [x for x in body[edges[i] : edges[i + 1]].split(b"\n") if x.strip()]
            lines[i], dups[i] = len(own), len(own) - len(set(own))
        of = grid.starts
        for k, v in zip(FEATURES, (grid.counts, chars[of[1:]] - chars[of[:-1]], symbols[edges[1:]] - symbols[edges[:-1]], lines, dups, repeat[of[1:]] - repeat[of[:-1]]), strict=True):
            found[k].append(v)
    return {k: np.concatenate(v) if v else np.empty(0, np.int64) for k, v in found.items()}


def with_features(docs: DataFrame, text: str, carry: list[str], inside: str | None = None) -> DataFrame:
    """The carried columns and the features of `text`, which is read once and not passed on;
    `inside` names a carried struct that has it, so that it travels once."""
    ready(docs.sparkSession)
    docs = spread(docs.select(*carry, *([] if inside else [F.col(text).cast("string").alias("__text")])))

    def run(batches):
        for b in batches:
            t = pa.Table.from_batches([b])
            f = measure(pc.struct_field(t[inside], text) if inside else t["__text"])
            yield from pa.table([*(t[c] for c in carry), *(pa.array(f[k], pa.int64()) for k in FEATURES)], [*carry, *FEATURES]).to_batches()

    schema = docs.select(*carry).schema
    for k in FEATURES:
        schema = schema.add(k, "long")
    return docs.mapInArrow(run, schema)


def base_failed(rules: Rules):
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def strictly_failed(rules: Rules):
    return (
        (100 * F.col("n_repeat_words") > rules.strict_repeat_percent * F.col("n_words"))
        | (100 * F.col("n_symbols") > rules.strict_symbol_percent * F.col("word_chars"))
        | (100 * F.col("n_dup_lines") > rules.strict_dup_line_percent * F.col("n_lines"))
    )


def host_rates(features: DataFrame, host: str, rules: Rules) -> DataFrame:
    """One row a host: n, failed, its shrunken rate and whether it is suspect.

    The prior is a beta distribution with the mean and variance of the hosts' rates (one row
    reaches the driver). Where the hosts do not differ, it weighs as one document.
    """
    counted = base_failed(rules) if rules.above is None else base_failed(rules) | F.coalesce(strictly_failed(rules), F.lit(False))
    hosts = features.groupBy(host).agg(F.count("*").alias("n"), F.count_if(counted).alias("failed"))
    rate = F.col("failed") / F.col("n")
    m, v = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    m = min(max(m or 0.0, 1e-6), 1 - 1e-6)
    weight = max(1.0, m * (1 - m) / v - 1) if v else 1.0
    shrunk = (F.col("failed") + F.lit(m * weight)) / (F.col("n") + F.lit(weight))
    level = rules.suspect_rate if rules.above is None else m + rules.above * (v or 0.0) ** 0.5
    suspect = F.col("rate") >= level if rules.above is None else F.col("rate") > level
    return hosts.withColumn("rate", shrunk).withColumn("suspect", suspect)


def judged(features: DataFrame, rates: DataFrame, host: str, rules: Rules) -> DataFrame:
    """features with base_failed, host_suspect and kept. Only suspect hosts take part in the
    join; the optimiser sees their true number before it picks how to join them."""
    bad = rates.where("suspect").select(F.col(host).alias("__host"), F.lit(True).alias("__bad"))
    out = features.join(bad, F.col(host).eqNullSafe(F.col("__host")), "left")
    out = out.withColumn("base_failed", base_failed(rules)).withColumn("host_suspect", F.coalesce("__bad", F.lit(False)))
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_suspect") & strictly_failed(rules))).drop("__host", "__bad")


def quality_rules(docs: DataFrame, rules: Rules | None = None, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """One row a document: key, host, the features, base_failed, host_suspect, kept.

    A null text has no words and fails; null hosts are one host; repeated rows are judged each.
    """
    rules = rules or Rules()
    named = docs.select(F.col(key).alias("key"), F.col(host).alias("host"), F.col(text).alias("text"))
    features = kept(with_features(named, "text", ["key", "host"]))
    out = judged(features, host_rates(features, "host", rules), "host", rules)
    return out.withColumnsRenamed({"key": key, "host": host})


def keep_good(docs: DataFrame, rules: Rules | None = None, text: str = "text", host: str = "source") -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    rules = rules or Rules()
    named = docs.select(F.col(host).alias("host"), F.col(text).alias("text"))
    features = kept(with_features(named, "text", ["host"]))
    rates = host_rates(features, "host", rules)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(host).alias("host"))
    whole = with_features(whole, text, ["row", "host"], inside="row")
    return judged(whole, rates, "host", rules).where("kept").select("row.*")
