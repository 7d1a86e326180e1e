"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors are whole numbers, kept dimension by dimension. A block of queries meets blocks of
candidates: scores grow a few dimensions at a time, and after each step only candidates stay
whose score so far plus the mass that remains (the product of the remaining norms) can still
reach the k-th best sure score. Dimensions with most mass come first. One cell of candidates goes
ahead of the others; what it finds is each query's bound in all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import group_of, kept, ready

#: Dimensions that are added before candidates are looked at again.
STEP = 16

#: Queries whose first scores are held at once.
TOGETHER = 256
LONG = 2**63 - 1
FOUND = "query_id long, query_no long, vec_id long, vec_no long, score long"


def matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors as columns (dimension, row); shorter ones are padded with zeros. int64, or
    Python's whole numbers where a component is so large that sums could overflow."""
    rows = len(vectors)
    flat = vectors.combine_chunks()
    lengths = np.diff(flat.offsets.to_numpy(zero_copy_only=False))
    values = flat.flatten().to_numpy(zero_copy_only=False)
    large = bool(len(values)) and float(np.abs(values).max()) * width**0.5 >= 2.0**26
    out = np.zeros((width, rows), object if large else np.int64)
    at = np.repeat(np.arange(rows), lengths), np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[at[1], at[0]] = [int(x) for x in values] if large else values.astype(np.int64)
    return out


def tails(m: np.ndarray) -> np.ndarray:
    """Norms of what remains of each column from each step on, a little too large."""
    squares = np.cumsum((m.astype(np.float64) ** 2)[::-1], axis=0)[::-1]
    return np.sqrt(np.concatenate([squares[::STEP], np.zeros((1, m.shape[1]))])) * (1 + 1e-9)


def search(queries: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, row_numbers: np.ndarray, k: int, ids: np.ndarray | None = None, floors: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(query's column, row number, score) of each query's k best rows of the block, but for the
    query's own row; ties to smaller ids (row numbers, where no ids are given), then numbers.
    floors: scores below which a query needs no row."""
    out: list[tuple[int, int, int]] = []
    np.seterr(over="ignore", invalid="ignore")
    ids = row_numbers if ids is None else ids
    exact = queries.dtype != object and rows.dtype != object
    heavy = np.argsort(-(rows.astype(np.float64) ** 2).sum(axis=1), kind="stable")
    queries, rows = queries[heavy], rows[heavy]
    q_tail, r_tail = tails(queries), tails(rows)
    q = queries.astype(np.float64)
    r = rows.astype(np.float64)
    steps = -(-rows.shape[0] // STEP)
    for a in range(0, queries.shape[1], TOGETHER):
        first = q[:STEP, a : a + TOGETHER].T @ r[:STEP]  # the first block of dimensions for some queries at once
        for j in range(a, min(a + TOGETHER, queries.shape[1])):
            alive = np.flatnonzero(row_numbers != query_rows[j])
            score = first[j - a, alive]
            for s in range(1, steps + 1):
                slack = q_tail[s, j] * r_tail[s, alive]
                if not exact:  # rounding may be off by so much
                    slack = slack + 1e-9 * q_tail[0, j] * r_tail[0, alive]
                sure = -np.inf if floors is None else floors[j]
                if len(alive) > k:
                    sure = max(sure, np.partition(score - slack, len(alive) - k)[len(alive) - k])
                sure = min(sure, 9e18) if sure > -9e18 else -np.inf  # scores beyond a long are ties
                stay = ~(score + slack < sure)  # what overflowed stays too
                alive, score = alive[stay], score[stay]
                if s < steps:
                    part = slice(s * STEP, (s + 1) * STEP)
                    score = score + q[part, j] @ r[part][:, alive]
            sums = [int(x) for x in score] if exact else [sum(int(x) * int(y) for x, y in zip(queries[:, j], rows[:, i], strict=True)) for i in alive]
            best = sorted(zip((-max(-LONG, min(LONG, x)) for x in sums), ids[alive].tolist(), row_numbers[alive].tolist(), strict=True))[:k]
            out += [(j, i, -x) for x, _, i in best]
    return out


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    key: str = "vec_id",
    vector: str = "embedding",
    scale: int = 256,
    block: int = 2048,
) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k best rows by inner product of floor(scale * x).

    Rows whose id or vector is null, or whose vector holds a null, NaN or infinity, take no part.
    A query meets every row but its own; a repeated row is a row, and a query, of its own. Vectors
    of different lengths meet as if the shorter ended in zeros. Scores beyond a long are cut to its
    range. Candidates stay whole: queries are dealt to blocks, candidates to cells, and each
    (block, cell) is one bounded task; a cell sends each query's k best only.
    """
    ready(vectors.sparkSession)
    x = F.col(vector)
    sound = F.col(key).isNotNull() & x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))

    def floored(e: Column) -> Column:
        v = e.cast("double") * scale  # beyond 2**53 a double is whole; floor() would make it a long
        return F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)

    whole = F.transform(x, floored)
    rows = kept(vectors.where(sound).select(F.col(key).cast("long").alias("id"), whole.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"), F.monotonically_increasing_id().alias("no")))
    width, n, nq = rows.agg(F.max(F.size("v")), F.count("*"), F.count_if("q")).first()
    q_blocks = max(1, -(-(nq or 0) // block))
    cells = max(1, -(-(n or 0) // (4 * block)))
    width = max(width or 0, 1)
    queries = rows.where("q").select("id", "v", "no", group_of(q_blocks, F.col("no")).alias("b"))
    spread = rows.select(*[F.col(c).alias(c) for c in ("id", "v", "no")], group_of(cells, F.col("no")).alias("c")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if len(a) and len(b):
            floors = a["least"].fill_null(-np.inf).to_numpy() if "least" in a.column_names else None
            found = search(matrix(a["v"], width), a["no"].to_numpy(), matrix(b["v"], width), b["no"].to_numpy(), k, b["id"].to_numpy(), floors)
        take = pa.array([j for j, _, _ in found], pa.int64())
        of = dict(zip(b["no"].to_pylist(), b["id"].to_pylist(), strict=True)) if found else {}
        return pa.table([a["id"].take(take), a["no"].take(take), *(pa.array(x, pa.int64()) for x in ([of[i] for _, i, _ in found], [i for _, i, _ in found], [s for _, _, s in found]))], ["query_id", "query_no", "vec_id", "vec_no", "score"])

    def met(some: DataFrame, at: int, until: int) -> DataFrame:
        left = some.withColumn("c", F.explode(F.sequence(F.lit(at), F.lit(until))))
        right = spread.where(F.col("c").between(at, until))
        return left.groupBy("b", "c").cogroup(right.groupBy("b", "c")).applyInArrow(cell, FOUND)

    found = met(queries, 0, 0)
    if cells > 1:
        found = kept(found)
        least = found.groupBy(F.col("query_no").alias("no")).agg(F.count("*").alias("m"), F.min("score").cast("double").alias("least")).where(F.col("m") == k)
        found = found.unionByName(met(queries.join(least.drop("m"), "no", "left").select("id", "v", "no", "b", "least"), 1, cells - 1))
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), "vec_id", "vec_no")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
