"""Rules on small preference graphs: admission, implied orders, strict cycles, evidence binding.

A suite is written by hand or by one model call and has tens of examples; orders within a suite are
all its pairs, which is what is asked for. Suites are many and spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def implied_by_capability(labels: DataFrame) -> DataFrame:
    """suite, cap, left, right: within a capability each pass stands above each fail."""
    c = labels.where("scope = 'capability'")
    p = c.where("label = 'pass'").select("suite", "cap", F.col("example").alias("left"))
    f = c.where("label = 'fail'").select("suite", "cap", F.col("example").alias("right"))
    return p.join(f, ["suite", "cap"])


def implied_overall(labels: DataFrame, caps: DataFrame) -> DataFrame:
    """suite, left, right: overall passes above overall fails, and Pareto dominance of complete
    capability profiles (no worse anywhere, better somewhere). caps: suite, cap."""
    o = labels.where("scope = 'overall'")
    first = o.where("label = 'pass'").select("suite", F.col("example").alias("left")).join(o.where("label = 'fail'").select("suite", F.col("example").alias("right")), "suite")
    want = caps.groupBy("suite").agg(F.countDistinct("cap").alias("want"))
    profile = labels.where("scope = 'capability'").groupBy("suite", "example").agg(F.array_sort(F.collect_set(F.struct("cap", (F.col("label") == "pass").cast("int").alias("v")))).alias("p"))
    full = profile.join(want, "suite").where(F.size("p") == F.col("want")).select("suite", "example", F.transform("p", lambda x: x["v"]).alias("v"))
    a, b = full.select("suite", F.col("example").alias("left"), F.col("v").alias("a")), full.select("suite", F.col("example").alias("right"), F.col("v").alias("b"))
    d = F.zip_with("a", "b", lambda x, y: x - y)
    better = a.join(b, "suite").where(F.forall(d, lambda x: x >= 0) & F.exists(d, lambda x: x > 0)).select("suite", "left", "right")
    return first.unionByName(better).distinct()


def strict_cycles(edges: DataFrame) -> DataFrame:
    """suite, node of strict cycles, after nodes declared equal are one. edges: suite, left, op
    (> or =), right. Reachability doubles its reach each round; a suite is a small graph."""
    nodes = edges.select("suite", F.col("left").alias("n")).unionByName(edges.select("suite", F.col("right").alias("n"))).distinct()
    equal = edges.where("op = '='").select("suite", F.col("left").alias("x"), F.col("right").alias("y"))
    equal = equal.unionByName(equal.select("suite", F.col("y").alias("x"), F.col("x").alias("y")))
    of = nodes.select("suite", "n", F.col("n").alias("root")).checkpoint()
    while True:
        low = equal.join(of.select("suite", F.col("n").alias("y"), "root"), ["suite", "y"]).groupBy("suite", F.col("x").alias("n")).agg(F.min("root").alias("r"))
        new = of.join(low, ["suite", "n"], "left").select("suite", "n", F.least("root", "r").alias("root")).checkpoint()
        if new.exceptAll(of).isEmpty():
            break
        of = new
    s = edges.where("op = '>'").join(of.withColumnsRenamed({"n": "left", "root": "a"}), ["suite", "left"]).join(of.withColumnsRenamed({"n": "right", "root": "b"}), ["suite", "right"])
    reach = s.select("suite", "a", "b").distinct().checkpoint()
    while True:
        longer = reach.join(reach.select("suite", F.col("a").alias("b"), F.col("b").alias("c")), ["suite", "b"]).select("suite", "a", F.col("c").alias("b"))
        new = reach.unionByName(longer).distinct().checkpoint()
        if new.count() == reach.count():
            break
        reach = new
    bad = reach.where("a = b").select("suite", F.col("a").alias("root")).distinct()
    return of.join(bad, ["suite", "root"]).select("suite", F.col("n").alias("node"))


def admission_problems(cases: DataFrame, caps: DataFrame, examples: DataFrame, categories: tuple[str, ...], allowed_evidence: tuple[str, ...]) -> DataFrame:
    """suite, problem, subject: capabilities without a case of a category, repeated intents,
    contradictory labels, unused examples, evidence that is not allowed.

    cases: suite, case_id, intent, scope, cap, category, evidence_source, example_ids, expected.
    """
    wanted = caps.select("suite", "cap").distinct().withColumn("category", F.explode(F.array(*map(F.lit, categories))))
    gaps = wanted.join(cases.select("suite", "cap", "category").distinct(), ["suite", "cap", "category"], "left_anti").select("suite", F.lit("coverage_gap").alias("problem"), F.concat_ws("/", "cap", "category").alias("subject"))
    twice = cases.groupBy("suite", "intent").agg(F.count("*").alias("n")).where("n > 1").select("suite", F.lit("duplicate_intent").alias("problem"), F.col("intent").alias("subject"))
    each = cases.where("expected is not null").select("suite", "scope", "cap", F.explode("example_ids").alias("example"), "expected")
    torn = each.groupBy("suite", "scope", "cap", "example").agg(F.countDistinct("expected").alias("n")).where("n > 1").select("suite", F.lit("contradictory_label").alias("problem"), F.col("example").alias("subject"))
    used = cases.select("suite", F.explode("example_ids").alias("example")).distinct()
    idle = examples.select("suite", "example").join(used, ["suite", "example"], "left_anti").select("suite", F.lit("unused_example").alias("problem"), F.col("example").alias("subject"))
    alien = cases.where(~F.col("evidence_source").isin(*allowed_evidence)).select("suite", F.lit("evidence_not_allowed").alias("problem"), F.col("case_id").alias("subject"))
    return gaps.unionByName(twice).unionByName(torn).unionByName(idle).unionByName(alien)


def unbound_evidence(verdicts: DataFrame, available: DataFrame) -> DataFrame:
    """Evidence that a verdict names and its case does not have. verdicts: case_id, refs."""
    return verdicts.select("case_id", F.explode("refs").alias("ref")).join(available, ["case_id", "ref"], "left_anti")


def permitted(inputs: Column, allowed: tuple[str, ...]) -> Column:
    """A map with the permitted keys only."""
    return F.map_filter(inputs, lambda k, _: k.isin(*allowed))
