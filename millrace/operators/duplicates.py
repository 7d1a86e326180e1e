"""Exact duplicates, leakage between splits, prefix overlap and upstream comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import changed_each, composed_and_collapsed, is_blank, norm
from ..session import dealt


def group_audit(df: DataFrame, key: Column, split: str = "split") -> DataFrame:
    """Per split: duplicate groups, their rows and the redundant ones; and how many keys and rows
    are shared with other splits. Null keys are not grouped. The key is made once: a filter on it
    would be worked out before the grouping, and the key again after it."""
    per = df.select(key.alias("k"), split).groupBy("k", split).agg(F.count("*").alias("n"), F.count("k").alias("known")).where("known > 0")
    per = per.withColumn("splits", F.count("*").over(Window.partitionBy("k")))
    twice, shared = F.col("n") > 1, F.col("splits") > 1
    return per.groupBy(split).agg(
        F.count_if(twice).alias("duplicate_groups"),
        F.coalesce(F.sum(F.when(twice, F.col("n"))), F.lit(0)).alias("rows_in_duplicate_groups"),
        F.coalesce(F.sum(F.when(twice, F.col("n") - 1)), F.lit(0)).alias("redundant_rows"),
        F.count_if(shared).alias("shared_keys"),
        F.coalesce(F.sum(F.when(shared, F.col("n"))), F.lit(0)).alias("shared_rows"),
    )


def sample_keys(body: Column) -> dict[str, Column]:
    """The eight keys by which training rows are looked through for copies, of rows with
    data_source, ability, prompt, reward_model and extra_info; body: the text without its task's
    template. Null where a key does not apply."""
    source, ability = F.col("data_source"), F.col("ability")
    truth, question, first = F.col("reward_model.ground_truth"), F.col("extra_info.question"), F.get("prompt", 0)["content"]
    as_json = lambda x: F.to_json(x, {"ignoreNullFields": "false"})
    texts = changed_each(F.transform("prompt", lambda m: F.coalesce(m["content"], F.lit(""))), composed_and_collapsed)
    told = F.zip_with("prompt", texts, lambda m, t: F.array(m["role"], t))
    where = lambda c, x: norm(F.when(c, x))  # noqa: E731  other rows' texts do not go to Python
    first_line = lambda t: F.get(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]", 2), 0)
    translated = ability == "translation"
    one, other = where(translated, body), where(translated, truth)
    pair = F.when(source.endswith("en-fr"), F.array(one, other)).otherwise(F.array(other, one))
    return {
        "prompt_exact": as_json("prompt"),
        "prompt_normalized": F.to_json(told),
        "question_normalized_nonempty": where(~is_blank(question), question),
        "answer_normalized": norm(truth),
        "sample_without_split_or_function": as_json(F.struct("data_source", "prompt", "reward_model")),
        "wildchat_first_user_message": where((ability == "multi-turn") & (first != ""), first),
        "translation_pair_direction_invariant": F.when(translated, F.to_json(pair)),
        "essay_title_candidate": norm(F.when(source == "essay_abs2text", first_line(truth)).when(source == "essay_infilling", first_line(body))),
    }


def duplicate_groups(df: DataFrame, key: Column, row: str) -> DataFrame:
    g = df.select(key.alias("key"), row).groupBy("key").agg(F.count("*").alias("copies"), F.min(row).alias("first"), F.count("key").alias("known"))
    return g.where("copies > 1 and known > 0").drop("known")


def differing_values(df: DataFrame, key: Column, value: Column) -> DataFrame:
    """Keys that stand with more than one value."""
    return df.groupBy(key.alias("key")).agg(F.count("*").alias("rows"), F.countDistinct(value).alias("values")).where("values > 1")


def known(df: DataFrame, key: str, existing: DataFrame, flag: str = "known") -> DataFrame:
    """Whether the other table has the row's key."""
    marks = existing.select(F.col(key).alias("__k")).where("__k is not null").distinct().withColumn(flag, F.lit(True))
    return df.join(marks, F.col(key) == F.col("__k"), "left").drop("__k").withColumn(flag, F.coalesce(flag, F.lit(False)))


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of both tables with their rows in each."""
    left = a.groupBy(key).agg(F.count("*").alias("left_rows"))
    return left.join(b.groupBy(key).agg(F.count("*").alias("right_rows")), key)


def overlap(df: DataFrame, held_out: DataFrame, key: str) -> DataFrame:
    """Rows that must not be: the key is held out. Empty is well."""
    return df.join(held_out.select(key).distinct(), key, "left_semi")


def prefix_overlap(valid: DataFrame, train: DataFrame, key: str, turns: str) -> DataFrame:
    """Per pair of dialogues the longest even prefix of the first that the second also starts
    with. turns: an array of strings. Prefix hashes are chained turn by turn."""

    def prefixes(df: DataFrame, name: str, even: bool) -> DataFrame:
        chained = F.aggregate(turns, F.array(F.lit("")), lambda a, t: F.array_append(a, F.sha2(F.concat(F.element_at(a, -1), F.lit("\x1f"), t), 256)))
        p = df.select(F.col(key).alias(name), F.posexplode(chained).alias("length", "hash")).where("length > 0")
        return p.where("length % 2 = 0") if even else p

    a, b = prefixes(valid, "valid", True), prefixes(train, "train", True)
    return a.join(b, ["length", "hash"]).groupBy("valid", "train").agg(F.max("length").alias("prefix"))


def upstream_match(local: DataFrame, upstream: DataFrame) -> DataFrame:
    """local: row, q, a; upstream: row, q, and its two answers a0, a1 (normed texts). Whether the
    question is upstream and whether the answer is one of those given there, and for unique
    matches the distance of the rows."""
    by_q = upstream.groupBy("q").agg(F.collect_set("row").alias("q_rows"))
    sides = upstream.select("row", F.explode(F.array("a0", "a1")).alias("a"))
    by_a = sides.groupBy("a").agg(F.collect_set("row").alias("a_rows"))
    j = local.join(by_q, "q", "left").join(by_a, "a", "left")
    both = F.array_intersect("q_rows", "a_rows")
    state = F.when(F.col("q_rows").isNull(), "question_not_found").when(F.coalesce(F.size(both), F.lit(0)) > 0, "match").when(F.col("a_rows").isNotNull(), "answer_elsewhere").otherwise("different_answer")
    unique = F.when(F.size(both) == 1, F.element_at(both, 1) - F.col("row"))
    return j.select("row", state.alias("state"), unique.alias("offset"))


def cached(tasks: DataFrame, cache: DataFrame, key: str, same: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of tasks in a cache of results: a hit has the key and equal columns `same`
    (null equals null), and the entry's other columns. A key has one entry."""
    rest = [c for c in cache.columns if c not in (key, *same)]
    entry = cache.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in same], *rest)
    on = F.col(key) == F.col("__k")
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"__{c}"))
    drop = ["__k", *[f"__{c}" for c in same]]
    return tasks.join(entry, on).drop(*drop), tasks.join(entry.select(*drop), on, "left_anti")


def starts_with_prompt(messages: Column, prompt: Column) -> Column:
    return F.coalesce(F.get(messages, 0)["content"] == prompt, F.lit(False))


def consistent_union(a: DataFrame, b: DataFrame, key: str, apart: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The union with each key once, and the keys whose rows differ (but for columns `apart`)."""
    every = a.unionByName(b)
    content = F.sha2(F.to_json(F.struct(*[c for c in every.columns if c not in apart]), {"ignoreNullFields": "false"}), 256)
    every, order = dealt(every, key).withColumn("__h", F.unhex(content)), Window.partitionBy(key)
    every = every.withColumn("__n", F.row_number().over(order.orderBy("__h", *apart))).withColumn("__v", F.dense_rank().over(order.orderBy("__h")))
    conflicts = every.where("__v > 1").groupBy(key).agg(F.max("__v").cast("long").alias("versions"))
    return every.where("__n = 1").drop("__n", "__v", "__h"), conflicts


def one_identity(df: DataFrame, *columns: str) -> DataFrame:
    """How many different identities rows have: 1 is well."""
    return df.agg(F.countDistinct(F.struct(*columns)).alias("identities"))
