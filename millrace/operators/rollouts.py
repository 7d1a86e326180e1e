"""Rollouts: tasks, streamed responses, status, latest attempts, rows, merging and nesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_blank, redacted
from .duplicates import consistent_union

USAGE = "struct<prompt_tokens:bigint,completion_tokens:bigint,total_tokens:bigint>"
RETRYABLE_HTTP = (408, 429, 500, 502, 503, 504)


def tasks(prompts: DataFrame, run_id: str, samples: int) -> DataFrame:
    """Each prompt so many times, with an id that tells run, prompt and number."""
    t = prompts.withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    return t.withColumn("rollout_id", F.sha2(F.concat_ws("\x1f", F.lit(run_id), "sample_id", F.col("sample_index").cast("string")), 256))


def events_of(raw: DataFrame, key: str, body: str) -> DataFrame:
    """key, pos, data: the events of server-sent streams; chunks are joined before. Data lines of
    one event are joined; an event without data is none."""
    text = F.regexp_replace(F.col(body), "\r\n|\r", "\n")
    blocks = raw.select(F.col(key), F.posexplode(F.split(text, "\n\n")).alias("pos", "block"))
    data = F.filter(F.split("block", "\n"), lambda x: x.startswith("data:"))
    joined = F.array_join(F.transform(data, lambda x: F.regexp_replace(x, "^data: ?", "")), "\n")
    return blocks.select(key, "pos", joined.alias("data")).where("data <> ''")


def folded(raw: DataFrame, key: str, body: str, secrets: tuple[str, ...] = ()) -> DataFrame:
    """One row a response: content, reasoning_content, refusal, finish_reason, usage, done,
    events, errors, returned_models (in order).

    Usage is the last one told (it is cumulative); an event after [DONE], a server's error and an
    event that is malformed are errors, and a malformed event adds nothing but its model and
    usage, which come before the choices. A body may be bytes: those that are no UTF-8 count as
    U+FFFD and as the first error.
    """
    binary = raw.schema[body].dataType == T.BinaryType()
    said = F.col(body).cast("string")
    raw = raw.select(key, (F.make_valid_utf8(said) if binary else said).alias(body), F.coalesce(~F.is_valid_utf8(said) if binary else F.lit(False), F.lit(False)).alias("__broken"))
    e = events_of(raw, key, body)
    w = Window.partitionBy(key).orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("is_done", F.col("data") == "[DONE]")
    e = e.withColumn("late", ~F.col("is_done") & F.coalesce(F.max("is_done").over(before), F.lit(False)))
    get = lambda path: F.get_json_object("data", path)
    obj = F.try_parse_json("data").isNotNull() & F.trim("data").startswith("{")
    tokens = [F.get_json_object("data", f"$.usage.{k}") for k in ("prompt_tokens", "completion_tokens", "total_tokens")]
    bad_usage = get("$.usage").isNotNull() & (~get("$.usage").startswith("{"))
    for t in tokens:
        bad_usage = bad_usage | F.coalesce(~t.rlike(r"^\d+$"), F.lit(False))
    choice = "struct<index:int,delta:struct<content:string,reasoning_content:string,reasoning:string,refusal:string,tool_calls:string,function_call:string>,finish_reason:string>"
    parsed = F.from_json(get("$.choices"), f"array<{choice}>")
    e = e.withColumn("object", obj & ~F.col("is_done")).withColumn("choices", F.coalesce(parsed, F.array().cast(f"array<{choice}>")))
    tools = F.exists("choices", lambda c: (F.coalesce(c["index"], F.lit(0)) != 0) | c["delta"]["tool_calls"].isNotNull() | c["delta"]["function_call"].isNotNull())
    e = e.withColumn("finish", F.get(F.filter(F.transform("choices", lambda c: c["finish_reason"]), lambda x: x.isNotNull() & (x != "")), 0))
    finished = F.count("finish").over(before) > 0
    nontext = get("$.choices[0].delta.content").isNotNull() & F.coalesce(F.get_json_object("data", "$.choices[0].delta.content").rlike(r"^[\[{]"), F.lit(False)) & ~F.col("data").rlike(r'"content"\s*:\s*"')
    e = e.withColumn("malformed", ~F.col("is_done") & (~F.col("object") | F.coalesce(bad_usage, F.lit(False)) | tools | nontext | (F.col("finish").isNotNull() & finished)))
    server = F.col("object") & get("$.error").isNotNull() & ~get("$.error").isin("", "null", "false", "{}")
    errors = F.filter(F.array(F.when(F.col("late"), "event_after_done"), F.when(server, "server_stream_error"), F.when(F.col("malformed"), "malformed_or_unsupported_event")), lambda x: x.isNotNull())
    e = e.withColumn("errors", errors).withColumn("model", F.when(F.col("object"), get("$.model")))
    e = e.withColumn("usage", F.when(F.col("object") & ~F.coalesce(bad_usage, F.lit(False)) & get("$.usage").isNotNull(), F.from_json(get("$.usage"), USAGE)))
    text = lambda f: F.when(~F.col("malformed"), F.array_join(F.transform("choices", f), ""))
    parts = {"content": lambda c: c["delta"]["content"], "reasoning_content": lambda c: F.coalesce(c["delta"]["reasoning_content"], c["delta"]["reasoning"]), "refusal": lambda c: c["delta"]["refusal"]}
    for name, f in parts.items():
        e = e.withColumn(f"_{name}", F.coalesce(text(f), F.lit("")))
    row = F.struct("pos", *[f"_{n}" for n in parts], "model", "errors")
    g = e.groupBy(key).agg(
        F.array_sort(F.collect_list(row)).alias("rows"),
        F.max_by("usage", F.when(F.col("usage").isNotNull(), F.col("pos"))).alias("usage"),
        F.min_by("finish", F.when(F.col("finish").isNotNull() & ~F.col("malformed"), F.col("pos"))).alias("finish_reason"),
        F.max("is_done").alias("done"),
        F.count_if("object").alias("events"),
    )
    out = raw.groupBy(key).agg(F.bool_or("__broken").alias("broken")).join(g, key, "left")
    every = lambda name: F.transform("rows", lambda r: r[name])
    joined = {n: redacted(F.coalesce(F.array_join(every(f"_{n}"), ""), F.lit("")), *secrets).alias(n) for n in parts}
    none = F.array().cast("array<string>")
    models = F.coalesce(F.array_distinct(F.filter(every("model"), lambda m: m.isNotNull())), none)
    errors = F.concat(F.when(F.col("broken"), F.array(F.lit("invalid_utf8"))).otherwise(none), F.coalesce(F.flatten(every("errors")), none))
    return out.select(key, *joined.values(), "finish_reason", "usage", F.coalesce("done", F.lit(False)).alias("done"), F.coalesce("events", F.lit(0)).alias("events"), errors.alias("errors"), models.alias("returned_models"))


def shows_reasoning(content: Column, reasoning: Column) -> Column:
    """Reasoning was told apart, or stands in the content; an empty think pair is none."""
    return ~is_blank(reasoning) | F.regexp_replace(content, r"(?i)<think>\s*</think>", "").rlike(r"(?i)</?think>")


def status(http: Column, transport_error: Column, model: Column, thinking: Column) -> Column:
    """The response's status by strict precedence, over the columns that `folded` makes."""
    c = F.col
    return (
        F.when(transport_error.isNotNull() | http.isNull(), "uncertain")
        .when((http != 200) & http.isin(*RETRYABLE_HTTP), "retryable")
        .when(http != 200, "failed")
        .when(F.size("errors") > 0, "protocol_error")
        .when(F.exists("returned_models", lambda m: m != model), "model_mismatch")
        .when((thinking == "disabled") & shows_reasoning(c("content"), c("reasoning_content")), "thinking_violation")
        .when(~c("done") | (F.coalesce("finish_reason", F.lit("")) == ""), "uncertain")
        .when(c("finish_reason") == "length", "truncated")
        .when((c("refusal") != "") | (c("finish_reason") == "content_filter"), "rejected")
        .when(c("finish_reason") != "stop", "unsupported_finish")
        .when(~is_blank(c("content")), "success")
        .otherwise("empty")
    )


def latest(task_rows: DataFrame, attempts: DataFrame, key: str = "rollout_id") -> DataFrame:
    """Each task with its last attempt: pending without one, uncertain where it has no result."""
    columns = [c for c in attempts.columns if c != key]
    last = attempts.groupBy(key).agg(F.max_by(F.struct(*columns), "attempt").alias("last"), F.count("*").alias("attempt_count"))
    j = task_rows.join(last, key, "left")
    state = F.when(F.col("last").isNull(), "pending").otherwise(F.coalesce("last.status", F.lit("uncertain")))
    return j.withColumn("attempt_count", F.coalesce("attempt_count", F.lit(0))).withColumn("status", state)


def rows(latest_rows: DataFrame) -> DataFrame:
    """Rollout rows with defaults where a result is missing."""
    fields = {f.name for f in latest_rows.schema["last"].dataType.fields}

    def told(name: str, default=None, kind: str = "string") -> Column:
        c = F.col(f"last.{name}") if name in fields else F.lit(None).cast(kind)
        return (c if default is None else F.coalesce(c, F.lit(default))).alias(name)

    evidence = F.when(F.col("attempt_count") > 0, "uncommitted").otherwise("not_executed")
    if "evidence_kind" in fields:
        evidence = F.coalesce("last.evidence_kind", evidence)
    kept = [c for c in latest_rows.columns if c not in ("last", "status", "attempt_count")]
    return latest_rows.select(
        *kept, "status", "attempt_count", evidence.alias("evidence_kind"),
        (F.coalesce("last.content", F.lit("")) if "content" in fields else F.lit("")).alias("response"),
        told("reasoning_content", ""), told("refusal", ""), told("finish_reason"),
        (F.col("last.usage") if "usage" in fields else F.lit(None).cast(USAGE)).alias("usage"),
        told("usage_complete", False, "boolean"), told("http_status", kind="int"), told("elapsed_seconds", kind="double"), told("request_sha256"), told("response_sha256"),
    )


def merged(runs: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All runs' rows, equal copies once, and the ids whose copies differ. Rows of one dataset only."""
    out, conflicts = runs[0], None
    for other in runs[1:]:
        out, bad = consistent_union(out, other, "rollout_id", ("source_run",))
        conflicts = bad if conflicts is None else conflicts.unionByName(bad)
    if conflicts is None:
        out, conflicts = consistent_union(out, out.limit(0), "rollout_id", ("source_run",))
    return out, conflicts


def candidates(df: DataFrame, truncated: bool = False) -> DataFrame:
    return df.where(F.col("status").isin("success", *(["truncated"] if truncated else [])) & ~is_blank(F.col("response")))


def by_prompt(df: DataFrame, chosen: DataFrame, prompt: tuple[str, ...], order: tuple[str, ...]) -> DataFrame:
    """Each prompt with its candidates; prompts without any stay, with an empty list."""
    told = [*order, *[c for c in chosen.columns if c not in (*prompt, *order)]]
    nested = chosen.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct(*told))).alias("rollouts"))
    return df.select(*prompt).distinct().join(nested, "sample_id", "left").withColumn("rollouts", F.coalesce("rollouts", F.array()))


def summary(task_rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per source and status: tasks, attempts, tokens of all attempts and attempts of unknown usage."""
    a = attempts.groupBy("rollout_id").agg(F.count("*").alias("attempts"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.count_if(F.col("completion_tokens").isNull()).alias("unknown_usage"))
    j = task_rows.join(a, "rollout_id", "left")
    return j.groupBy("data_source", "status").agg(F.count("*").alias("tasks"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.coalesce(F.sum("unknown_usage"), F.lit(0)).alias("unknown_usage"))


def integrity(df: DataFrame, checks: dict[str, tuple[str, Column]]) -> DataFrame:
    """Rows whose stored columns are not what is computed again: name -> (stored, computed)."""
    wrong = F.filter(F.array(*[F.when(~F.col(stored).eqNullSafe(again), F.lit(n)) for n, (stored, again) in checks.items()]), lambda x: x.isNotNull())
    return df.withColumn("failures", wrong).where(F.size("failures") > 0)
