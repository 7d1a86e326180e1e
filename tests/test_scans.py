import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.operators import drift, profile, sampling, scans, trace

N = 4000


@pytest.fixture(scope="module")
def rows(spark):
    """One key has nine tenths of the rows; another is null; values repeat and are null."""
    r = random.Random(5)
    data = [(None if i % 97 == 0 else "hot" if i % 10 else f"k{i % 3}", i, r.choice([None, *range(6)]), r.choice(["a", "b", None])) for i in range(N)]
    r.shuffle(data)
    return spark.createDataFrame(data, "k string, t long, v long, s string").repartition(5)


def as_set(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=repr)


def test_scan_is_a_window_over_any_number_of_rows(rows):
    b = scans.Blocks(rows, ["k"], ["t"], parts=9).scan(sums={"s1": F.col("v"), "n": F.lit(1)}, maxima={"m": F.col("v")}, lags={"p": F.col("s")})
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    o = Window.partitionBy("k").orderBy("t")
    want = rows.select("*", F.sum("v").over(w).alias("s1"), F.row_number().over(o).alias("n"), F.max("v").over(w).alias("m"), F.lag("s").over(o).alias("p"))
    cols = ["k", "t", "v", "s", "s1", "n", "m", "p"]
    assert as_set(b.frame(), *cols) == as_set(want, *cols)


def test_no_task_has_more_than_a_block(rows):
    """One key for all rows: blocks are even, and every window deals by block."""
    one = rows.select(F.lit(1).alias("k"), "t")
    b = scans.Blocks(one, ["k"], ["t"], parts=16)
    sizes = [r["count"] for r in b.rows.groupBy(scans.BLOCK).count().collect()]
    assert len(sizes) >= 12 and max(sizes) <= 3 * N / 16
    done = b.scan(sums={"n": F.lit(1)})
    assert sorted(r["n"] for r in done.frame().collect()) == list(range(1, N + 1))
    plan = done.rows._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "Window" in x and "windowspecdefinition" in x]
    assert windows and all(scans.BLOCK in x for x in windows)


def test_descending_order_and_ties(spark):
    df = spark.createDataFrame([("a", i // 3, i) for i in range(60)], "k string, t int, i int")
    got = scans.numbered(df, ["k"], [F.desc("t")], "n", parts=7).collect()
    assert sorted(r["n"] for r in got) == list(range(1, 61))
    assert all(a["t"] >= b["t"] for a, b in zip(*[sorted(got, key=lambda r: r["n"])[x:] for x in (0, 1)], strict=False))
    assert scans.numbered(df.limit(0), ["k"], ["t"], "n").count() == 0


def test_rate_islands_and_breaker_equal_windows(rows):
    w = Window.partitionBy("k").orderBy("t")
    want = rows.withColumn("in_window", F.count("*").over(w.rangeBetween(-25, 0)))
    assert as_set(trace.rate(rows, ["k"], "t", 25), "k", "t", "in_window") == as_set(want, "k", "t", "in_window")
    failed = rows.withColumn("failed", F.col("s") == "a")
    before = w.rowsBetween(-3, -1)
    want = failed.withColumn("open", (F.count("failed").over(before) == 3) & F.coalesce(F.min(F.col("failed").cast("int")).over(before) == 1, F.lit(False)))
    assert as_set(trace.breaker(failed, ["k"], ["t"], "failed", 3), "k", "t", "open") == as_set(want, "k", "t", "open")
    d = rows.withColumn("new", (~F.col("s").eqNullSafe(F.lag("s").over(w)) | (F.row_number().over(w) == 1)).cast("int")).withColumn("island", F.sum("new").over(w))
    want = d.groupBy("k", "island", "s").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("length")).where("length >= 2")
    assert as_set(trace.islands(rows, ["k"], ["t"], "s", 2), *want.columns) == as_set(want, *want.columns)


def test_cumulative_shares_and_ks(rows):
    want = rows.withColumn("ecdf", F.cume_dist().over(Window.partitionBy("k").orderBy("v")))
    assert as_set(profile.cumulative(rows, ["k"], "v"), "k", "t", "ecdf") == as_set(want, "k", "t", "ecdf")
    got = {r["k"]: r for r in drift.ks(rows.where("v is not null"), ["k"], "v", F.col("t") % 2 == 0).collect()}
    for k in (None, "hot"):
        mine = [r for r in rows.where("v is not null").collect() if r["k"] == k]
        a, b = (np.array([r["v"] for r in mine if r["t"] % 2 == x]) for x in (0, 1))
        far = max(abs((a <= v).mean() - (b <= v).mean()) for v in range(6))
        assert got[k]["ks"] == pytest.approx(far) and (got[k]["n_a"], got[k]["n_b"]) == (len(a), len(b))


def test_round_robin_is_cut_before_rows_meet(rows):
    got = sampling.round_robin(rows.where("k is not null"), ["k"], "s", 7, "t")
    assert "WindowGroupLimit" in got._jdf.queryExecution().executedPlan().toString()
    w = Window.partitionBy("k").orderBy("turn", "s")
    want = sampling.turns(rows.where("k is not null"), ["k"], "s", "t").withColumn("position", F.row_number().over(w) - 1).where("position < 7")
    assert as_set(got, "k", "t", "turn", "position") == as_set(want, "k", "t", "turn", "position")


@pytest.mark.parametrize("small", [True, False])
def test_quantiles_are_exact(spark, monkeypatch, small):
    """Also where spans are narrowed over several passes, with outliers that a first pass cannot part."""
    if not small:
        monkeypatch.setattr(scans, "SORTED", 20)
        monkeypatch.setattr(scans, "BINS", 256)
    r = random.Random(3)
    data = [("a", r.gauss(0, 1)) for _ in range(500)] + [("a", 1e300), ("a", -1e300), ("a", None), ("b", 7.0), ("c", None), (None, 1.0), (None, 2.0)] + [("d", float(i % 3)) for i in range(300)] + [("e", 10.0 ** (i % 12)) for i in range(120)] + [("b", float("nan"))]
    df = spark.createDataFrame(data, "g string, x double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {x["g"]: x for x in scans.quantiles(df, ["g"], "x", shares).collect()}
    for g in ("a", "b", None, "d", "e"):
        mine = [x for k, x in data if k == g and x is not None and x == x]
        assert got[g]["n"] == len(mine)
        assert got[g]["q"] == pytest.approx(list(np.quantile(mine, shares)), rel=1e-9)
    assert (got["c"]["n"], got["c"]["q"]) == (0, None)
    assert scans.quantiles(df.limit(0), ["g"], "x", shares).count() == 0


def test_quantiles_of_large_whole_numbers(spark, monkeypatch):
    monkeypatch.setattr(scans, "SORTED", 10)
    monkeypatch.setattr(scans, "BINS", 16)
    data = [(2**60 + i,) for i in range(101)]
    assert scans.quantiles(spark.createDataFrame(data, "x long"), [], "x", [0.0, 0.5, 1.0]).first()["q"] == [float(2**60), float(2**60 + 50), float(2**60 + 100)]


def test_shares_over_all_rows(rows):
    s = {r["s"]: r for r in drift.shares(rows, "s", F.col("t") < 100).collect()}
    assert s["a"]["na"] == 100 and sum(r["b"] for r in s.values()) == N - 100
