"""Scores: component results to totals, usage, verdicts, relations and group advantages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import raw_error


def component_scores(results: DataFrame, low: Column, high: Column) -> DataFrame:
    """(.., raw, kind) -> also score, error and status: failed components have no score."""
    error = raw_error(F.col("raw"), F.col("kind"))
    scaled = F.when(low.isNull(), F.when(F.col("raw").between(0.0, 1.0), F.col("raw"))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(F.col("raw") - low, high - low))))
    r = results.withColumn("error", error).withColumn("score", F.when(error.isNull(), scaled))
    r = r.withColumn("error", F.when(F.col("error").isNull() & F.col("score").isNull(), "COMPONENT_OUT_OF_RANGE").otherwise(F.col("error")))
    return r.withColumn("status", F.when(F.col("score").isNull(), "error").otherwise("ok"))


def totals(scored: DataFrame, by: list[str], component: str = "component_id") -> DataFrame:
    """total (mean of the components that are ok; null without any), status ok, partial or failed,
    coverage, and the valid components in order."""
    ok = F.col("status") == "ok"
    g = scored.groupBy(*by).agg(F.avg(F.when(ok, F.col("score"))).alias("total"), F.count_if(ok).alias("n_ok"), F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(ok, F.col(component)))), ",").alias("valid_components"))
    state = F.when(F.col("n_ok") == 0, "failed").when(F.col("n_ok") < F.col("n"), "partial").otherwise("ok")
    return g.select(*by, "total", state.alias("status"), (F.col("n_ok") / F.col("n")).alias("coverage"), "valid_components")


def validation_metrics(cases: DataFrame, by: list[str]) -> DataFrame:
    """completed, failed, ranking accuracy (of ranking cases that were decided), mean coverage,
    partial and all-failed cases."""
    ranked = F.col("kind") == "ranking"
    return cases.groupBy(*by).agg(
        F.count_if(F.col("passed").isNotNull()).alias("completed"),
        F.count_if(F.col("passed").isNull()).alias("undecided"),
        F.avg(F.when(ranked, F.col("passed").cast("double"))).alias("ranking_accuracy"),
        F.avg("coverage").alias("coverage"),
        F.count_if(F.col("status") == "partial").alias("partial_cases"),
        F.count_if(F.col("status") == "failed").alias("all_failed_cases"),
    )


def mask_distribution(total_rows: DataFrame, by: list[str]) -> DataFrame:
    return total_rows.groupBy(*by, "valid_components").agg(F.count("*").alias("count"))


def merged_usage(df: DataFrame, by: list[str], counters: list[str], cost_status: str) -> DataFrame:
    """Sums in which unknown stays unknown only where all are; a cost is unknown if one is,
    partial where known and unavailable meet."""
    s = F.collect_set(cost_status)
    state = F.when(F.array_contains(s, "unknown"), "unknown").when(F.size(s) > 1, "partial").otherwise(F.element_at(s, 1))
    return df.groupBy(*by).agg(*[F.sum(c).alias(c) for c in counters], state.alias("cost_status"))


def compact_errors(results: DataFrame, order: str) -> DataFrame:
    """Per component and error: how often, and the first message."""
    return results.where("error is not null").groupBy("component_id", "error").agg(F.count("*").alias("count"), F.min_by("message", order).alias("first_message"))


def advantages(df: DataFrame, prompt: str, score: str, eps: float = 1e-6) -> DataFrame:
    """(score - mean) / (std + eps) within each prompt's group; 0 where all are equal."""
    w = Window.partitionBy(prompt)
    std = F.stddev_pop(score).over(w)
    return df.withColumn("advantage", F.when(std == 0, 0.0).otherwise((F.col(score) - F.avg(score).over(w)) / (std + eps)))


def relation_scores(relations: DataFrame, totals_: DataFrame, example: str = "example_id", value: str = "total") -> DataFrame:
    """Both sides of each relation with their difference; null where a side has none."""
    t = totals_.select(F.col(example).alias("__e"), F.col(value).alias("__v"))
    r = relations.join(t.withColumnsRenamed({"__e": "left", "__v": "left_score"}), "left", "left")
    r = r.join(t.withColumnsRenamed({"__e": "right", "__v": "right_score"}), "right", "left")
    return r.withColumn("difference", F.col("left_score") - F.col("right_score"))


def rule_verdicts(cases: DataFrame, related: DataFrame, points: DataFrame, threshold: float = 0.5, tolerance: float = 1e-9) -> DataFrame:
    """case_id, verdict (pass, fail or insufficient_evidence).

    points: case_id, example_id, score, ok of the components that the case needs (their mean);
    a case with one that did not run, or without independent labels, has insufficient evidence.
    related: case_id, left, right, op of ranking cases.
    """
    p = points.groupBy("case_id", "example_id").agg(F.avg("score").alias("v"), F.bool_and("ok").alias("ok"))
    sound = p.groupBy("case_id").agg(F.bool_and("ok").alias("ok"), F.min_by("v", "example_id").alias("v"))
    t = p.select("case_id", "example_id", "v")
    r = related.join(t.withColumnsRenamed({"example_id": "left", "v": "lv"}), ["case_id", "left"], "left").join(t.withColumnsRenamed({"example_id": "right", "v": "rv"}), ["case_id", "right"], "left")
    holds = F.when(F.col("op") == ">", F.col("lv") > F.col("rv") + tolerance).otherwise(F.abs(F.col("lv") - F.col("rv")) <= tolerance)
    r = r.groupBy("case_id").agg(F.bool_and(F.coalesce(holds, F.lit(False))).alias("holds"))
    j = cases.join(sound, "case_id", "left").join(r, "case_id", "left")
    point = (F.col("v") >= threshold) == (F.col("expected") == "pass")
    passed = F.when(F.col("kind") == "pointwise", point).otherwise(F.coalesce("holds", F.lit(True)))
    lacking = (F.col("evidence_source") != "human_annotated") | ~F.coalesce("ok", F.lit(False))
    return j.select("case_id", F.when(lacking, "insufficient_evidence").when(passed, "pass").otherwise("fail").alias("verdict"))


def best_candidate(df: DataFrame, by: list[str], rank: str, key: str) -> DataFrame:
    """Per group the row with the least rank, null ranks last, ties to the smaller key."""
    w = Window.partitionBy(*by).orderBy(F.col(rank).asc_nulls_last(), key)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def training_rows(df: DataFrame, columns: dict[str, Column], reserved: tuple[str, ...] = ("data_source", "prompt", "reward_model", "extra_info")) -> DataFrame:
    """Rows for a trainer: given columns beside the reserved ones, which must not clash."""
    clash = set(columns) & set(reserved)
    if clash:
        raise ValueError(f"reserved names: {sorted(clash)}")
    return df.select(*[c for c in reserved if c in df.columns], *[c.alias(n) for n, c in columns.items()])


def whole_scores(df: DataFrame, score: str = "total", status: str = "status") -> DataFrame:
    """Scores for a trainer: partial or failed totals raise instead of passing as numbers."""
    return df.withColumn("score", F.when(F.col(status) == "ok", F.col(score)).otherwise(F.raise_error(F.concat(F.lit("incomplete score: "), status)).cast("double")))
