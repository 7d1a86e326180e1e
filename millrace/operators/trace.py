"""Event logs: calls folded from events, reports, windows over sequences, ledgers and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread
from .scans import Blocks, joined


def field(name: str, payload: str = "payload") -> Column:
    return F.get_json_object(payload, f"$.{name}")


def calls(events: DataFrame) -> DataFrame:
    """One row a physical attempt, folded from its events: what was prepared, whether it was
    dispatched, its response, usage, error, and whether its reply was committed and acted on.

    events: seq, type, episode_id, payload (JSON). Only attempts that were prepared count.
    """
    e = events.withColumn("pid", field("physical_attempt_id")).withColumn("logical", field("logical_call_id"))
    of = lambda t: F.col("type") == t
    at = lambda t, c: F.max_by(F.when(of(t), c), F.when(of(t), F.col("seq")))
    number = lambda n: field(f"usage.{n}").cast("bigint")
    g = e.where("pid is not null").groupBy("pid").agg(
        F.min(F.when(of("llm_attempt_prepared"), F.col("seq"))).alias("seq"),
        at("llm_attempt_prepared", F.col("logical")).alias("logical_call_id"),
        at("llm_attempt_prepared", F.col("episode_id")).alias("episode_id"),
        at("llm_attempt_prepared", field("actor_role")).alias("actor_role"),
        F.max_by(F.when(of("llm_attempt_prepared"), "prepared").when(of("llm_dispatched"), "unknown").when(of("llm_response"), "returned").when(of("llm_attempt_error"), field("status")), F.when(F.col("type").isin("llm_attempt_prepared", "llm_dispatched", "llm_response", "llm_attempt_error"), F.col("seq"))).alias("dispatch_status"),
        at("llm_response", field("response_complete").cast("boolean")).alias("response_complete"),
        at("llm_response", number("prompt_tokens")).alias("prompt_tokens"),
        at("llm_response", number("completion_tokens")).alias("completion_tokens"),
        at("llm_response", number("cached_tokens")).alias("cached_tokens"),
        F.coalesce(at("llm_response", field("usage.usage_known").cast("boolean")), F.lit(False)).alias("usage_known"),
        F.coalesce(at("llm_attempt_error", field("latency").cast("double")), at("llm_response", field("latency").cast("double"))).alias("latency"),
        F.bool_or(of("llm_history_committed")).alias("committed"),
        at("llm_history_committed", field("schema_valid").cast("boolean")).alias("schema_valid"),
    ).where("seq is not null")
    acted = e.where(of("llm_actions_dispatched")).select(F.col("logical").alias("logical_call_id"), F.lit(True).alias("acted")).distinct()
    g = g.withColumn("committed_to_history", F.col("committed") & F.coalesce("response_complete", F.lit(False))).drop("committed").join(acted, "logical_call_id", "left")
    return g.withColumn("actions_dispatched", F.coalesce(F.col("schema_valid") & F.col("committed_to_history") & F.col("acted"), F.lit(False))).drop("acted")


def double_commits(events: DataFrame) -> DataFrame:
    """Logical calls to which two different responses were committed: none is well."""
    c = events.where("type = 'llm_history_committed'").groupBy(field("logical_call_id").alias("logical_call_id"))
    return c.agg(F.countDistinct(field("physical_attempt_id")).alias("responses")).where("responses > 1")


def usage_by_role(c: DataFrame) -> DataFrame:
    return c.groupBy(F.coalesce("actor_role", F.lit("legacy_controller")).alias("actor_role")).agg(
        F.countDistinct("logical_call_id").alias("logical_calls"),
        F.count_if(F.col("dispatch_status") != "prepared").alias("physical_attempts"),
        F.sum("prompt_tokens").alias("input_tokens"), F.sum("completion_tokens").alias("output_tokens"),
        F.count_if(~F.col("usage_known")).alias("unknown_usage_events"), F.coalesce(F.sum("latency"), F.lit(0.0)).alias("latency_seconds"),
    )


def run_report(results: DataFrame, c: DataFrame, events: DataFrame) -> DataFrame:
    """One row: committed results by status, reuse, calls, retries, tokens (null when all are
    unknown) and wall time."""
    r = results.agg(F.count("*").alias("committed"), *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "unvalidated", "skipped")], F.count_if("reused").alias("reuse_count"), F.avg(F.col("reused").cast("double")).alias("reuse_rate"))
    sent = F.col("dispatch_status") != "prepared"
    per = c.groupBy("logical_call_id").agg(F.greatest(F.lit(0), F.count("*") - 1).alias("retries")).agg(F.coalesce(F.sum("retries"), F.lit(0)).alias("transport_retries"))
    u = c.agg(F.countDistinct(F.when(F.col("actor_role").isNull(), F.col("logical_call_id"))).alias("controller_logical_calls"), F.count_if(sent).alias("physical_requests"), F.sum(F.when(sent, F.col("prompt_tokens"))).alias("input_tokens"), F.sum(F.when(sent, F.col("completion_tokens"))).alias("output_tokens"), F.count_if(sent & ~F.col("usage_known")).alias("unknown_usage_events"))
    t = events.agg((F.coalesce(F.max_by("ts", "seq") - F.min_by("ts", "seq"), F.lit(0.0))).alias("elapsed_wall_seconds"))
    one = F.lit(True)
    return r.join(per, one).join(u, one).join(t, one)


def latest_state(df: DataFrame, by: list[str], seq: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.max_by(F.struct(*rest), seq).alias("s")).select(*by, "s.*")


def not_rising(df: DataFrame, by: list[str], seq: str, order: str) -> DataFrame:
    """Rows whose number does not rise over the one before."""
    return Blocks(df, by, [order]).scan(lags={"last": F.col(seq)}).frame().where(F.col(seq) <= F.col("last"))


def rewritten(df: DataFrame, by: list[str], seq: str, history: str) -> DataFrame:
    """Rows whose history does not start with the history before. Of that one only its length and a
    digest go on to the next row, which takes the digest of as much of its own."""
    digest = lambda h: F.sha2(F.to_json(F.struct(h.alias("h"))), 256)
    d = Blocks(df, by, [seq]).scan(lags={"__size": F.size(history), "__digest": digest(F.col(history))}).frame()
    begins = digest(F.slice(history, 1, F.greatest("__size", F.lit(1))))
    return d.where((F.col("__size") > 0) & ~begins.eqNullSafe(F.col("__digest"))).drop("__size", "__digest")


def rate(df: DataFrame, by: list[str], seconds: str, span: int) -> DataFrame:
    """How many rows fall in the span up to each: the rows up to it less those before the span,
    both read off one running count over the times and the spans' beginnings."""
    c = df.groupBy(*by, seconds).agg(F.count("*").alias("__n"))
    told = c.select(*by, F.col(seconds).alias("__at"), F.lit(1).alias("__kind"), "__n", F.col(seconds).alias("__of"))
    asked = c.select(*by, (F.col(seconds) - span).alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__n"), F.col(seconds).alias("__of"))
    run = Blocks(told.unionByName(asked), by, ["__at", "__kind"]).scan(sums={"__sum": F.col("__n")}).frame()
    of = run.groupBy(*by, "__of").agg((F.max(F.when(F.col("__kind") == 1, F.col("__sum"))) - F.max(F.when(F.col("__kind") == 0, F.col("__sum")))).alias("in_window"))
    return joined(df, of.withColumnRenamed("__of", seconds), [*by, seconds])


def islands(df: DataFrame, by: list[str], order: list[str], value: str, least: int = 1) -> DataFrame:
    """Runs of equal values in a row: their first and last place and length."""
    d = Blocks(df, by, order).scan(lags={"__was": F.col(value), "__row_before": F.lit(1)})
    d = d.add(__new=(F.col("__row_before").isNull() | ~F.col(value).eqNullSafe(F.col("__was"))).cast("int")).scan(sums={"island": F.col("__new")}).frame()
    g = d.groupBy(*by, "island", value).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("length"))
    return g.where(F.col("length") >= least)


def breaker(df: DataFrame, by: list[str], order: list[str], failed: str, most: int) -> DataFrame:
    """Whether so many failures in a row precede each row: the circuit is open. They are the rows
    since the last one that did not fail."""
    d = Blocks(df, by, order).scan(sums={"__no": F.lit(1).cast("long")})
    d = d.scan(maxima={"__good": F.when(F.coalesce(~F.col(failed), F.lit(True)), F.col("__no"))}).scan(lags={"__last": F.col("__good")}).frame()
    return d.withColumn("open", F.col("__no") - 1 - F.coalesce("__last", F.lit(0)) >= most).drop("__no", "__good", "__last")


def ledger(operations: DataFrame, limits: DataFrame) -> DataFrame:
    """Running balances of a budget from its operations.

    operations: seq, op_id, level, dim, kind (reserve, settle, unknown), reserved, used. A repeated
    (op_id, kind) counts once. Settling frees the reservation and adds what was used; unknown use
    is charged as reserved. limits: level, dim, most (null: no limit).
    """
    w = Window.partitionBy("op_id", "kind", "level", "dim").orderBy("seq")
    o = operations.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
    held = F.when(F.col("kind") == "reserve", F.col("reserved")).otherwise(-F.col("reserved"))
    spent = F.when(F.col("kind") == "settle", F.col("used")).when(F.col("kind") == "unknown", F.col("reserved")).otherwise(0)
    o = Blocks(o, ["level", "dim"], ["seq"]).scan(sums={"held": held, "consumed": spent}).frame()
    return o.join(limits, ["level", "dim"], "left").withColumn("remaining", F.col("most") - F.col("held") - F.col("consumed"))


def remaining(balances: DataFrame, by: list[str]) -> DataFrame:
    """The least that any level leaves; levels without a limit do not bind."""
    return balances.groupBy(*by).agg(F.min("remaining").alias("remaining"))


def published(entries: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library entries that a success at their place confirms (by key, validation and job), and
    the others."""
    ok = results.where("status = 'success'").select(F.col("sequence").alias("sequence"), "reward_key", "validation_ref", "job_key")
    on = ["sequence", "reward_key", "validation_ref", "job_key"]
    return entries.join(ok, on, "left_semi"), entries.join(ok, on, "left_anti")


#: Entries of a class that go along in one list.
LISTED = 1000


def applicable(entries: DataFrame, tasks: DataFrame, same: list[str], subset: tuple[str, str]) -> DataFrame:
    """Entries that fit a task: equal digests, and all that the entry needs is there.

    What fits is told once for each two classes, of entries and of tasks with the same digests and
    list; only rows that fit meet then. The entries of a class go along in lists of about LISTED rows,
    so that a task meets a list and not each of its rows. A few large classes are dealt over all cores:
    a task goes to one of the lots of its class, a list to each. The result may be as large as the product."""
    need, have = subset
    lots, on = entries.sparkSession.sparkContext.defaultParallelism, [*same, have, "__lot"]
    own, rest = [c for c in entries.columns if c not in (*same, need)], [[c for c in df.columns if c not in same] for df in (entries, tasks)]
    fits = entries.select(*same, need).distinct().join(tasks.select(*same, have).distinct(), same).where(F.size(F.array_except(need, have)) == 0)
    sizes = entries.groupBy(*same, need).agg(F.ceil(F.count("*") / LISTED).alias("__lists"))
    lists = entries.join(sizes, [*same, need]).withColumn("__list", F.pmod(F.xxhash64(*entries.columns), F.col("__lists")))
    lists = lists.groupBy(*same, need, "__list").agg(F.collect_list(F.struct(F.lit(0).alias("__row"), *own)).alias("__rows"))
    e = lists.join(fits, [*same, need]).withColumn("__lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    t = spread(tasks).withColumn("__lot", F.pmod(F.xxhash64(*tasks.columns), F.lit(lots)).cast("int"))
    met = e.repartition(4 * lots, *on).join(t.repartition(4 * lots, *on), on)
    return met.withColumn("__e", F.explode("__rows")).select(*same, *[F.col(f"__e.{c}").alias(c) if c in own else F.col(c) for c in rest[0]], *rest[1])


def fine_tuning_rows(c: DataFrame, role: str, selected: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(samples, exclusions): calls that may train, and why the others may not, by the first
    reason that holds. c: calls with request and response texts; selected: episode_id."""
    ok = selected.select("episode_id", F.lit(True).alias("chosen")).distinct()
    j = c.join(ok, "episode_id", "left")
    sound = F.coalesce(F.col("response_complete") & F.col("committed_to_history") & F.col("schema_valid"), F.lit(False))
    reason = F.when(~F.col("actor_role").eqNullSafe(F.lit(role)), "non_selected_actor").when(F.col("chosen").isNull(), "role_not_training_success").when(~sound, "incomplete_invalid_or_uncommitted")
    j = j.withColumn("reason", reason)
    w = Window.partitionBy("logical_call_id", F.col("reason").isNull()).orderBy("seq")
    j = j.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), "duplicate_logical_response").otherwise(F.col("reason")))
    j = j.withColumn("reason", F.when(F.col("reason").isNull() & (F.octet_length("request") + F.octet_length("response") > most), "context_window").otherwise(F.col("reason")))
    good = j.where("reason is null").select(F.col("logical_call_id").alias("sample_id"), "episode_id", "request", F.col("response").alias("target"), F.lit("target_assistant_only").alias("loss_scope"), "seq")
    return good, j.where("reason is not null").groupBy("reason").agg(F.count("*").alias("count"))


def full_traces(samples: DataFrame, histories: DataFrame, role: str, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows, exclusions): one row an episode that has samples, its whole history with a mask of
    the replies that the samples are. histories: episode_id, messages (role, content, actor,
    logical_call_id). Histories beyond `most` bytes of JSON are excluded."""
    targets = samples.groupBy("episode_id").agg(F.collect_set("sample_id").alias("targets"))
    j = histories.join(targets, "episode_id")
    told = F.transform("messages", lambda m: F.struct(m["content"].alias("content"), m["role"].alias("role")))
    j = j.select(F.concat("episode_id", F.lit(f":{role}")).alias("sample_id"), "episode_id", told.alias("told"), loss_mask(F.col("messages"), F.col("targets")).alias("message_loss_mask"), F.lit("selected_assistants_once").alias("loss_scope"))
    fits = F.octet_length(F.to_json("told", {"ignoreNullFields": "false"})) <= most
    return j.where(fits).withColumnRenamed("told", "messages"), j.where(~fits).agg(F.lit("context_window").alias("reason"), F.count("*").alias("count")).where("count > 0")


def final_programs(samples: DataFrame, selected: DataFrame) -> DataFrame:
    """One row an episode that has samples: the request of its first one, and the program that was
    selected. selected: episode_id, target_program, reward_key; samples with their seq."""
    first = samples.groupBy("episode_id").agg(F.min_by("request", "seq").alias("request"))
    return first.join(selected, "episode_id").select(F.concat("episode_id", F.lit(":program")).alias("sample_id"), "episode_id", "request", "target_program", "reward_key", F.lit("verified_artifact").alias("target_origin"), F.lit("program_only").alias("loss_scope"))


def loss_mask(messages: Column, logical_ids: Column) -> Column:
    """Per message whether it trains: an assistant's whose call is one of the chosen."""
    return F.transform(messages, lambda m: (m["actor"] == "assistant") & F.array_contains(logical_ids, m["logical_call_id"]))


def feedback_rows(scores: DataFrame) -> DataFrame:
    """One row a component with feedback, of score rows with nested component results."""
    s = scores.select("episode_id", "evaluation_id", "reward_key", "example_id", F.explode("component_results").alias("c"))
    return s.where("c.feedback is not null").select("episode_id", "evaluation_id", "reward_key", "example_id", F.col("c.id").alias("component_id"), F.col("c.score").alias("score"), F.col("c.feedback").alias("feedback"))


def suite_statistics(states: DataFrame, suites: DataFrame) -> DataFrame:
    """Per episode with a suite, of its last state: sizes of the suite and attempts."""
    last = latest_state(states, ["episode_id"], "seq").where("suite_ref is not null")
    return last.join(suites, "suite_ref").select("episode_id", "suite_ref", F.size("examples").alias("examples"), F.size("cases").alias("cases"), F.aggregate("cases", F.lit(0), lambda a, c: a + F.size(c["relations"])).alias("relations"), F.size(F.filter("cases", lambda c: c["required"])).alias("required_cases"), "reward_attempts", F.greatest(F.lit(0), F.col("reward_attempts") - 1).alias("reward_revisions"))
