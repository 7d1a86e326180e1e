"""Training-set selection: normalise sources, reserve held-out families, build a pool, label, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.identity import draw_key, family_text, group_key, message_json
from ..functions.text import is_blank
from ..session import kept as written
from .neardup import first_of_each, near_pairs
from .sampling import held_out, keep_first, turns

MESSAGES = "array<struct<role:string,content:string>>"


def user(text: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).cast(MESSAGES)


def _without_answer(m: str = "messages") -> Column:
    n = F.size(m)
    return F.when((n > 0) & (F.get(F.col(m), n - 1)["role"] == "assistant"), F.slice(m, 1, n - 1)).cast(MESSAGES)


#: Per source: its messages, stratum, own id and further names of the task. Answers are never read.
SHAPES = {
    "helpsteer2": lambda: (user(F.col("prompt")), F.lit("general"), F.lit(None), []),
    "no_robots": lambda: (_without_answer(), F.col("category"), F.col("prompt_id"), []),
    "ultrafeedback": lambda: (user(F.col("instruction")), F.col("source"), F.lit(None), []),
    "kodcode": lambda: (user(F.col("question")), F.col("subset"), F.col("question_id"), []),
    "taco": lambda: (user(F.concat("question", F.when(F.coalesce("starter_code", F.lit("")) != "", F.concat(F.lit("\n\nStarter code:\n"), "starter_code")).otherwise(""))), F.col("difficulty"), F.col("name"), []),
    "mathqa": lambda: (user(F.concat("Problem", F.lit("\n\nOptions:\n"), "options")), F.col("category"), F.lit(None), []),
    "bigcodebench_hard": lambda: (user(F.col("instruct_prompt")), F.lit("benchmark"), F.col("task_id"), [F.col("complete_prompt")]),
    "classeval": lambda: (user(F.concat("class_description", F.lit("\n"), "skeleton")), F.lit("benchmark"), F.col("task_id"), [F.col("skeleton")]),
    "ds1000": lambda: (user(F.col("prompt")), F.coalesce(F.col("metadata.library"), F.lit("benchmark")), F.col("metadata.problem_id"), []),
}


def normalised(df: DataFrame, source: str, place: list[str]) -> DataFrame:
    """place columns, source, messages, stratum, original_id, aliases, gid, family, error. A row
    of a bad shape has an error and no gid."""
    messages, stratum, own, aliases = SHAPES[source]()
    d = df.select(*place, F.lit(source).alias("source"), messages.alias("messages"), F.coalesce(stratum.cast("string"), F.lit("unknown")).alias("stratum"), own.cast("string").alias("original_id"), F.array(*aliases).cast("array<string>").alias("aliases"))
    last = F.get("messages", F.size("messages") - 1)
    error = (
        F.when(F.col("messages").isNull(), "no_final_demonstration" if source == "no_robots" else "no_messages")
        .when(~last["role"].eqNullSafe(F.lit("user")), "not_ending_in_user")
        .when(F.exists("messages", lambda m: ~F.coalesce(m["role"].isin("system", "user", "assistant"), F.lit(False)) | m["content"].isNull()), "unsupported_message")
        .when(is_blank(last["content"]), "empty_final_user")
    )
    d = d.withColumn("error", error)
    ok = F.col("error").isNull()
    return d.withColumn("gid", F.when(ok, group_key(F.col("messages")))).withColumn("family", F.when(ok, family_text(F.col("messages"))))


def reserved(held: DataFrame) -> DataFrame:
    """gid, family of held-out tasks and of their other names, each once."""
    named = held.select("gid", "family")
    other = held.select(F.explode("aliases").alias("family")).select(group_key(user(F.col("family"))).alias("gid"), "family")
    return named.unionByName(other).dropDuplicates(["gid"])


def prepare(rows: DataFrame, seed: int, fraction: float, order: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, records, reserved) of normalised rows with a split. Rows of split `unsplit` are
    dealt to holdout or train by their family. Families that are held out are no records."""
    split = F.when(F.col("split") != "unsplit", F.col("split")).when(held_out(F.col("gid"), seed, fraction), "holdout").otherwise("train")
    rows = written(rows.where("error is null").withColumn("split", split))  # keys are made once, not for each use
    kept = reserved(rows.where("split <> 'train'"))
    members = rows.where("split = 'train'")
    records = keep_first(members, ["gid"], *order).withColumn("draw", draw_key(seed, "draw", F.col("gid")))
    held = kept.select("gid", F.lit(True).alias("held"))
    records = records.join(held, "gid", "left").withColumn("disposition", F.when(F.col("held"), "reserved_exact").otherwise("available")).drop("held")
    return members, records, kept


def build_pool(records: DataFrame, held: DataFrame, sources: list[str], targets: dict[str, int], most_chars: int, threshold: float = 0.9) -> DataFrame:
    """records with their disposition and pool_position.

    Sources come in their order; within one, strata take turns in draw order. Too long records are
    put off, near duplicates of held-out tasks or of accepted candidates are turned down, and
    others are accepted until the target is met. Turns are used up by skipped rows. Near pairs are
    found once; then the greedy choice runs over them. A target can cut a source short, and what
    it cuts must not turn others down, so sources are settled one after the other.
    """
    r = written(records.where("disposition = 'available'").withColumn("put_off", F.length(message_json(F.col("messages"))) > most_chars))
    visits = turns(r.select("gid", "source", "stratum", "draw"), ["source"], "stratum", "draw", "gid")  # ranked without their texts
    visits = written(visits.select("gid", "source", F.row_number().over(Window.partitionBy("source").orderBy("turn", "stratum")).alias("visit")))
    tasks = r.where(~F.col("put_off")).select(F.concat(F.lit("candidate:"), "gid").alias("k"), "gid", "family")
    marks = held.select(F.concat(F.lit("heldout:"), "gid").alias("k"), "family")
    pairs = near_pairs(tasks.select("k", "family").unionByName(marks), "k", F.col("family"), threshold).select("a", "b").checkpoint()
    tasks, taken, done = written(tasks.select("k", "gid").join(visits, "gid").select("k", "source", F.col("visit").alias("r"))), marks.select("k").checkpoint(), None
    position = 0
    for source in sources:
        own = tasks.where(F.col("source") == source)
        order = taken.withColumn("r", F.lit(0)).unionByName(own.select("k", "r"))
        among = pairs.join(taken.select(F.col("k").alias("a"), F.lit(1).alias("ta")), "a", "left").join(taken.select(F.col("k").alias("b"), F.lit(1).alias("tb")), "b", "left").where("ta is null or tb is null").select("a", "b")
        chosen = first_of_each(order, among, "k", "r").join(own.select("k", "r"), "k")
        top = chosen.where("accepted").orderBy("r").limit(targets.get(source, 0))
        top = top.select("k", "r", (F.row_number().over(Window.orderBy("r")) - 1 + position).alias("pool_position")).checkpoint()
        n, end = top.agg(F.count("*"), F.max("r")).first()
        seen = F.col("r") <= F.lit(2**31 - 1 if n < targets.get(source, 0) else end or 0)
        state = F.when(~seen, "available").when(F.col("accepted"), "pending").otherwise("near_duplicate")
        chosen = chosen.join(top.drop("r"), "k", "left").select("k", F.lit(source).alias("source"), "r", state.alias("state"), F.when(seen, F.col("matched")).alias("matched"), "pool_position").checkpoint()
        done = chosen if done is None else done.unionByName(chosen)
        position += n
        taken = taken.unionByName(top.select("k"))
    met = F.element_at(F.create_map(*[x for k in sources for x in (F.lit(k), F.lit(targets.get(k, 0)))]), F.col("source"))
    last = done.groupBy("source").agg(F.max(F.when(F.col("pool_position").isNotNull(), F.col("r"))).alias("r"), F.count("pool_position").alias("n"))
    last = last.select("source", F.when(F.col("n") >= met, F.coalesce("r", F.lit(0))).otherwise(2**31 - 1).alias("last_visit"))
    gids = done.select(F.substring("k", 11, 64).alias("gid"), "state", "matched", "pool_position")
    r = r.join(visits.select("gid", "visit"), "gid").join(gids, "gid", "left").join(last, "source", "left")
    state = F.when(F.col("put_off") & (F.col("visit") < F.coalesce("last_visit", F.lit(0))), "deferred_input_limit").otherwise(F.coalesce("state", F.lit("available")))
    out = r.select("gid", "source", "stratum", "draw", "messages", "family", state.alias("disposition"), "matched", "pool_position")
    rest = records.where("disposition <> 'available'").select("gid", "source", "stratum", "draw", "messages", "family", "disposition", F.lit(None).cast("string").alias("matched"), F.lit(None).cast("long").alias("pool_position"))
    return out.unionByName(rest)


def apply_labels(pool: DataFrame, labels: DataFrame, key: str = "gid") -> DataFrame:
    """Dispositions after labelling; unlabelled rows stay."""
    l = labels.select(F.col(key).alias("__k"), F.col("decision"))
    return pool.join(l, F.col(key) == F.col("__k"), "left").withColumn("disposition", F.coalesce("decision", "disposition")).drop("__k", "decision")


def export_rows(pool: DataFrame, members: DataFrame, seed: int, targets: dict[str, int]) -> DataFrame:
    """The selected rows of each source up to its target, with their source records, in export order.
    They are chosen without their messages; the largest target, a number, cuts each part's rows."""
    n = F.element_at(F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v))]), F.col("source"))
    place = F.row_number().over(Window.partitionBy("source").orderBy("pool_position"))
    chosen = pool.where("disposition = 'include'").select("gid", "source", "pool_position").withColumn("place", place).where(F.col("place") <= max(targets.values(), default=0)).where(F.col("place") <= n)
    chosen = written(chosen)
    members = members.join(chosen.select("gid"), "gid", "left_semi")
    whole = pool.where("disposition = 'include'").select("gid", F.col("pool_position").alias("__p"), "messages")
    chosen = chosen.join(whole, "gid").where(F.col("pool_position").eqNullSafe(F.col("__p")))
    told = members.groupBy("gid").agg(F.array_sort(F.collect_list(F.struct("source", "path", "row", "split", "original_id"))).alias("source_records"))
    return chosen.join(told, "gid", "left").select(F.col("gid").alias("sample_id"), F.col("source").alias("data_source"), F.col("messages").alias("prompt"), F.sha2(message_json(F.col("messages")), 256).alias("prompt_sha256"), "source_records").orderBy(draw_key(seed, "export", F.col("sample_id")))


def export_checks(rows: DataFrame, held: DataFrame) -> DataFrame:
    """One row of checks that must all be true."""
    hits = rows.join(held.select(F.col("gid").alias("sample_id")), "sample_id", "left_semi").agg((F.count("*") == 0).alias("no_exact_heldout_overlap"))
    own = rows.agg(
        (F.countDistinct("sample_id") == F.count("*")).alias("unique_sample_ids"),
        F.coalesce(F.bool_and(F.forall("source_records", lambda m: m["split"] == "train")), F.lit(True)).alias("only_train_members"),
        F.coalesce(F.bool_and(F.get("prompt", F.size("prompt") - 1)["role"] == "user"), F.lit(True)).alias("prompts_end_in_user"),
    )
    return own.join(hits, F.lit(True))


def report(pool: DataFrame, by: tuple[str, ...] = ("source", "disposition")) -> DataFrame:
    return pool.groupBy(*by).agg(F.count("*").alias("count"))


def label_usage(calls: DataFrame, response: str = "response") -> DataFrame:
    """Dispatched, unknown and known usage of label calls, from their JSON responses."""
    used = F.from_json(F.get_json_object(response, "$.usage"), "prompt_tokens bigint, completion_tokens bigint")
    u = calls.withColumn("u", used)
    return u.agg(F.count("*").alias("dispatched"), F.count_if(F.col("u").isNull()).alias("unknown_usage"), F.sum("u.prompt_tokens").alias("prompt_tokens"), F.sum("u.completion_tokens").alias("completion_tokens"))
