"""Two-sample tests between distributions: total variation, Jensen-Shannon, chi-square, KS."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import Blocks, beside, joined


def shares(df: DataFrame, item: str, side: Column) -> DataFrame:
    """item, a, b (counts on either side), p, q (shares) and the sides' sizes."""
    c = df.groupBy(item).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    c = beside(c, F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return c.withColumn("p", F.col("a") / F.col("na")).withColumn("q", F.col("b") / F.col("nb"))


def distances(df: DataFrame, item: str, side: Column) -> DataFrame:
    """total_variation, js_bits (divergence), chi_square, dof and the p-value of that, of two categorical samples."""
    s = shares(df, item, side)
    m = (F.col("p") + F.col("q")) / 2
    half = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0) / 2
    row, every = F.col("a") + F.col("b"), F.col("na") + F.col("nb")
    ea, eb = row * F.col("na") / every, row * F.col("nb") / every
    chi = (F.col("a") - ea) ** 2 / ea + (F.col("b") - eb) ** 2 / eb
    g = s.agg((F.sum(F.abs(F.col("p") - F.col("q"))) / 2).alias("total_variation"), F.sum(half(F.col("p")) + half(F.col("q"))).alias("js_bits"), F.sum(chi).alias("chi_square"), (F.count("*") - 1).alias("dof"))
    return g.withColumn("p", chi_square_tail(F.col("chi_square"), F.col("dof")))


def ks(df: DataFrame, by: list[str], value: str, side: Column) -> DataFrame:
    """Per group the largest distance of the two empirical distributions, and both sizes."""
    c = df.groupBy(*by, value).agg(F.count_if(side).alias("a"), F.count_if(~side).alias("b"))
    upto = Blocks(c, by, [value]).scan(sums={"__a": F.col("a"), "__b": F.col("b")}).frame()
    whole = c.groupBy(*by).agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    d = F.abs(F.try_divide("__a", "n_a") - F.try_divide("__b", "n_b"))
    g = joined(upto, whole, by).groupBy(*by).agg(F.max(d).alias("ks"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))
    return g.withColumn("p", ks_tail(F.col("ks"), F.col("n_a"), F.col("n_b")))


def log_gamma(a: Column) -> Column:
    """Of positive numbers: Stirling's series eight steps up, and back."""
    z = a + 8
    series = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    return series - sum((F.log(a + i) for i in range(1, 8)), F.log(a))


def upper_gamma(a: Column, x: Column) -> Column:
    """The regularised upper incomplete gamma function, by its series up to a + 1 and its continued
    fraction beyond, with terms in proportion to the root of a."""
    terms = F.sequence(F.lit(1), (100 + 12 * F.sqrt(a)).cast("int"))
    scale = F.exp(-x + a * F.log(x) - log_gamma(a))
    pair = lambda t, s: F.struct(t.alias("t"), s.alias("s"))
    series = F.aggregate(terms, pair(1 / a, 1 / a), lambda v, n: pair(v["t"] * x / (a + n), v["s"] + v["t"] * x / (a + n)), lambda v: 1 - v["s"] * scale)
    state = lambda b, c, d, h: F.struct(b.alias("b"), c.alias("c"), d.alias("d"), h.alias("h"))

    def step(v: Column, n: Column) -> Column:
        an, b = -n * (n - a), v["b"] + 2
        d, c = 1 / (an * v["d"] + b), b + an / v["c"]
        return state(b, c, d, v["h"] * d * c)

    low = x + 1 - a
    fraction = F.aggregate(terms, state(low, F.lit(1e300), 1 / low, 1 / low), step, lambda v: v["h"] * scale)
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, series).otherwise(fraction)


def chi_square_tail(statistic: Column, dof: Column) -> Column:
    """The p-value of a chi-square statistic, per row; null for no degree of freedom."""
    return F.when(dof > 0, upper_gamma(dof.cast("double") / 2, statistic.cast("double") / 2))


def ks_tail(d: Column, n: Column, m: Column) -> Column:
    """The asymptotic two-sided p-value of a Kolmogorov-Smirnov distance, per row."""
    x = d * F.sqrt(F.try_divide(n.cast("double") * m, n + m))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x * x))
    return F.when(x > 0.2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).when(x.isNotNull(), F.lit(1.0))


def chi_square_p(statistic: float, dof: int) -> float:
    """The upper tail: a regularised incomplete gamma by series or continued fraction."""
    a, x = dof / 2, statistic / 2
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return 1 - total * scale
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h, i = d, 0
    while True:
        i += 1
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            return scale * h


def ks_p(d: float, n: int, m: int) -> float:
    """The asymptotic two-sided tail."""
    x = d * math.sqrt(n * m / (n + m))
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101)))) if x > 0.2 else 1.0
