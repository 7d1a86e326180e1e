import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import duplicates, flags, graph, lexical, neardup, rollouts, sampling, scoring, selection, trace
from millrace.sources import readers, writers

CHAT = "id int, m array<struct<role:string,content:string>>"


def test_cleaning_rules(spark):
    rows = [(0, "tulu3-sft-reused-on-policy-8b", "x", [("user", "q")]), (1, "pubmed-summarization", " ", [("user", "q")]), (2, "pubmed-summarization", flags.PUBLISHER_BOILERPLATE.replace(" ", "  "), [("user", "q")]), (3, "allenai-WildChat-1M-multiturn", "x", [("user", "q"), ("assistant", "a"), ("user", " ")]), (4, "other", None, [])]
    df = spark.createDataFrame(rows, "id int, s string, t string, m array<struct<role:string,content:string>>")
    got = [r[0] for r in df.orderBy("id").select(flags.removal_reasons(F.col("s"), F.col("t"), F.col("m"))).collect()]
    assert got == [["remove_tulu_subset"], ["pubmed_empty_article"], ["pubmed_publisher_boilerplate_only"], ["wildchat_empty_last_user_message"], []]


def test_bodies(spark):
    q = "Start your translation task now. [English Input]\nHello\nthere\n[French Output]"
    rows = [("english-french-translation-x", q), ("english-french-translation-x", "plain"), ("essay_1", "rules\n\nthe essay"), ("chat", "q")]
    df = spark.createDataFrame([(i, s, q, [("user", None)]) for i, (s, q) in enumerate(rows)], "id int, s string, q string, m array<struct<role:string,content:string>>")
    assert [r[0] for r in df.orderBy("id").select(flags.body(F.col("s"), F.col("q"), F.col("m"))).collect()] == ["Hello\nthere", "plain", "the essay", "user: "]


def test_structure(spark):
    good = [("system", "s"), ("user", "what is it?"), ("assistant", "It is a long enough answer.")]
    rows = [(0, good), (1, good[:2]), (2, [("user", " "), ("assistant", "")]), (3, None), (4, [("user", "copy me please, twenty chars"), ("assistant", "copy me  please, twenty chars")])]
    f = flags.structure_flags(F.col("m"), F.lit(""), F.lit("u"), F.lit(False))
    got = [(set(r[0]), r[1]) for r in spark.createDataFrame(rows, CHAT).orderBy("id").select(f, flags.structurally_valid(f)).collect()]
    assert got[0] == (set(), True)
    assert "not_ending_assistant" in got[1][0] and not got[1][1]
    assert {"empty_last_user", "empty_or_invalid_final_answer"} <= got[2][0]
    assert "invalid_messages_structure" in got[3][0] and not got[3][1]
    assert got[4] == ({"answer_copies_last_user_review_only"}, True)


@pytest.mark.parametrize(("ask", "n", "bad"), [("Write at least 50 words.", 49, True), ("write at least 50 words", 50, False), ("exactly 100 words", 106, True), ("about 100 words", 119, False), ("no more than 1,000 words", 1001, True), ("20 words", 5, False)])
def test_word_counts(spark, ask, n, bad):
    df = spark.createDataFrame([(ask, "w " * n)], "q string, a string")
    assert df.select(flags.word_count_violated(F.col("q"), F.col("a"))).first()[0] is bad


def test_review_and_reject(spark):
    df = spark.createDataFrame([("Describe the picture in this image in exactly three sentences", "I'm sorry ``` ")], "q string, a string")
    assert set(df.select(flags.review_flags(F.col("q"), F.col("a"))).first()[0]) == {"refusal_or_inability_needs_review", "explicit_format_needs_review", "unbalanced_code_fence_needs_review", "external_context_needs_review"}
    df = spark.createDataFrame([(0, [("user", "q"), ("user", "r"), ("assistant", "a")])], CHAT)
    assert df.select(flags.reject_reasons(F.col("m"), F.lit("on"), F.lit(1), F.lit(True))).first()[0] == ["wrong_reasoning_mode", "invalid_role_sequence"]


def test_labels(spark):
    df = spark.createDataFrame([("include", "trivial", "complete", [], "x", []), ("exclude", "nontrivial", "complete", ["d"], "x", []), ("include", "nontrivial", "complete", ["d"], "x", [])], "d string, s string, c string, dims array<string>, r string, codes array<string>")
    got = [r[0] for r in df.select(flags.label_errors(*map(F.col, ("d", "s", "c", "dims", "r", "codes")))).collect()]
    assert [len(x) for x in got] == [2, 1, 0]


def test_group_audit_and_upstream(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "train"), ("a", "valid"), ("b", "train"), (None, "train")], "k string, split string")
    got = {r["split"]: r for r in duplicates.group_audit(df, F.col("k")).collect()}
    assert (got["train"]["duplicate_groups"], got["train"]["redundant_rows"], got["train"]["shared_rows"]) == (1, 1, 2)
    local = spark.createDataFrame([(0, "q", "a"), (1, "q", "z"), (2, "n", "a")], "row int, q string, a string")
    up = spark.createDataFrame([(5, "q", "a", "b")], "row int, q string, a0 string, a1 string")
    assert {r["row"]: (r["state"], r["offset"]) for r in duplicates.upstream_match(local, up).collect()} == {0: ("match", 5), 1: ("different_answer", None), 2: ("question_not_found", None)}


def test_prefix_overlap_keeps_the_longest(spark):
    v = spark.createDataFrame([(1, ["a", "b", "c", "d"])], "id int, turns array<string>")
    t = spark.createDataFrame([(2, ["a", "b", "c", "x"]), (3, ["a", "b", "c", "d", "e"]), (4, ["z"])], "id int, turns array<string>")
    assert {tuple(r) for r in duplicates.prefix_overlap(v, t, "id", "turns").collect()} == {(1, 2, 2), (1, 3, 4)}


def test_greedy_choice_equals_one_pass(spark):
    rng = random.Random(3)
    n = 60
    pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.06}
    accepted, want = set(), {}
    for i in range(n):
        near = [a for a in accepted if (a, i) in pairs]
        want[i] = (not near, min(near) if near else None)
        if not near:
            accepted.add(i)
    order = spark.createDataFrame([(i, i) for i in range(n)], "k int, r int")
    got = neardup.first_of_each(order, spark.createDataFrame(list(pairs), "a int, b int"), "k", "r").collect()
    assert {r["k"]: (r["accepted"], r["matched"]) for r in got} == want


def test_round_robin_uses_up_turns(spark):
    df = spark.createDataFrame([("s", x, i) for x in "ab" for i in range(4)], "source string, stratum string, i int")
    got = sampling.round_robin(df, ["source"], "stratum", 5, "i").orderBy("position").select("stratum", "i").collect()
    assert [tuple(r) for r in got] == [("a", 0), ("b", 0), ("a", 1), ("b", 1), ("a", 2)]


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(rng.randrange(99)) for _ in range(n))


def test_pool_turns_down_near_copies_of_held_out_and_accepted(spark):
    rng = random.Random(5)
    base, other = words(rng, 60), words(rng, 60)
    texts = {"r0": (base, "test"), "r1": (base + " end", "train"), "r2": (other, "train"), "r3": (other + " tail", "train"), "r4": (words(rng, 40), "train"), "r5": ("x" * 3000, "train")}
    rows = spark.createDataFrame([("helpsteer2", s, k, t) for k, (t, s) in texts.items()], "source string, split string, row string, prompt string")
    n = selection.normalised(rows.drop("source").withColumn("path", F.lit("p")), "helpsteer2", ["path", "row", "split"])
    members, records, held = selection.prepare(n, 1, 0.1, ["row"])
    pool = selection.build_pool(records, held, ["helpsteer2"], {"helpsteer2": 10}, 2000).join(members.select("gid", "row"), "gid")
    got = {r["row"]: r["disposition"] for r in pool.collect()}
    assert got["r1"] == "near_duplicate" and got["r4"] == "pending" and got["r5"] == "deferred_input_limit"
    assert sorted([got["r2"], got["r3"]]) == ["near_duplicate", "pending"]
    labelled = selection.apply_labels(pool, pool.where("disposition = 'pending'").select("gid", F.lit("include").alias("decision")))
    rows = selection.export_rows(labelled, members, 1, {"helpsteer2": 1})
    assert rows.count() == 1 and all(selection.export_checks(rows, held).first())


def test_normaliser_errors(spark):
    df = spark.createDataFrame([(0, [("user", "q"), ("assistant", "a")], "c", "1"), (1, [("user", "q")], "c", "2"), (2, [("assistant", "a")], "c", "3")], "row int, messages array<struct<role:string,content:string>>, category string, prompt_id string")
    got = {r["row"]: (r["error"], r["gid"] is None) for r in selection.normalised(df, "no_robots", ["row"]).collect()}
    assert got == {0: (None, False), 1: ("no_final_demonstration", True), 2: ("not_ending_in_user", True)}


def sse(*events, done=True):
    return "".join(f"data: {e if isinstance(e, str) else json.dumps(e)}\r\n\r\n" for e in events) + ("data: [DONE]\n\n" if done else "")


def chunk(text=None, finish=None, **more):
    return {"model": "m", "choices": [{"index": 0, "delta": {} if text is None else {"content": text}, "finish_reason": finish}], **more}


@pytest.mark.parametrize(
    ("body", "http", "want"),
    [
        (sse(chunk("a"), chunk("b", "stop", usage={"completion_tokens": 2})), 200, "success"),
        (sse(chunk("a", "length")), 200, "truncated"),
        (sse(chunk("a", "stop"), done=False), 200, "uncertain"),
        (sse(chunk("<think>x</think>", "stop")), 200, "thinking_violation"),
        (sse(chunk("<think> </think>ok", "stop")), 200, "success"),
        (sse(chunk("a", "content_filter")), 200, "rejected"),
        (sse(chunk("a", "tool")), 200, "unsupported_finish"),
        (sse(chunk(" ", "stop")), 200, "empty"),
        (sse("{broken"), 200, "protocol_error"),
        (sse(chunk("a", "stop"), chunk("b", "stop")), 200, "protocol_error"),
        (sse({**chunk("a", "stop"), "model": "n"}), 200, "model_mismatch"),
        (sse(chunk("a", "stop")) + sse(chunk("late")), 200, "protocol_error"),
        ("", 429, "retryable"),
        ("", 400, "failed"),
        ("", None, "uncertain"),
    ],
)
def test_response_status(spark, body, http, want):
    f = rollouts.folded(spark.createDataFrame([(1, body)], "k int, body string"), "k", "body")
    assert f.select(rollouts.status(F.lit(http), F.lit(None).cast("string"), F.lit("m"), F.lit("disabled"))).first()[0] == want


def test_fold_takes_the_last_usage_and_hides_secrets(spark):
    body = sse(chunk("my se", usage={"completion_tokens": 1}), chunk("cret", "stop", usage={"completion_tokens": 9}))
    r = rollouts.folded(spark.createDataFrame([(1, body)], "k int, body string"), "k", "body", ("secret",)).first()
    assert (r["content"], r["usage"]["completion_tokens"], r["done"], r["events"], r["returned_models"]) == ("my [REDACTED]", 9, True, 2, ["m"])


def test_merge_once_and_nest(spark):
    schema = "rollout_id string, sample_id string, status string, response string, source_run string"
    a = spark.createDataFrame([("r1", "s1", "success", "x", "A"), ("r2", "s2", "empty", "", "A")], schema)
    b = spark.createDataFrame([("r3", "s1", "truncated", "y", "B"), ("r1", "s1", "success", "x", "B")], schema)
    rows, conflicts = rollouts.merged([a, b, a])
    assert rows.count() == 3 and conflicts.isEmpty()
    n = rollouts.by_prompt(rows, rollouts.candidates(rows, truncated=True), ("sample_id",), ("rollout_id",))
    assert {r["sample_id"]: len(r["rollouts"]) for r in n.collect()} == {"s1": 2, "s2": 0}
    clash = b.withColumn("response", F.lit("other"))
    assert rollouts.merged([a, clash])[1].count() == 1


@pytest.mark.parametrize(("scores", "total", "status"), [([1, 0, 0.5], 0.5, "ok"), ([1, None, 0], 0.5, "partial"), ([None, None], None, "failed"), ([0, 0], 0.0, "ok")])
def test_totals(spark, scores, total, status):
    rows = [(1, i, None if s is None else float(s), "number" if s is not None else "null") for i, s in enumerate(scores)]
    r = scoring.totals(scoring.component_scores(spark.createDataFrame(rows, "e int, component_id int, raw double, kind string"), F.lit(0.0), F.lit(1.0)), ["e"]).first()
    assert (r["total"], r["status"]) == (total, status)


def test_whole_scores_refuse_partial(spark):
    df = spark.createDataFrame([(0.5, "partial")], "total double, status string")
    with pytest.raises(Exception, match="incomplete score"):
        scoring.whole_scores(df).collect()


def test_cycles_and_orders(spark):
    e = [("s", "a", ">", "b"), ("s", "b", "=", "c"), ("s", "c", ">", "a"), ("t", "a", ">", "b"), ("t", "b", ">", "c"), ("u", "x", "=", "y"), ("u", "x", ">", "y")]
    got = {tuple(r) for r in graph.strict_cycles(spark.createDataFrame(e, "suite string, left string, op string, right string")).collect()}
    assert got == {("s", "a"), ("s", "b"), ("s", "c"), ("u", "x"), ("u", "y")}
    labels = spark.createDataFrame([("s", "capability", c, x, v) for x, cs in {"p": "pp", "q": "pf", "r": "fp"}.items() for c, v in zip("ab", ["pass" if y == "p" else "fail" for y in cs], strict=True)], "suite string, scope string, cap string, example string, label string")
    o = graph.implied_overall(labels, labels.select("suite", "cap").distinct())
    assert {(r["left"], r["right"]) for r in o.collect()} == {("p", "q"), ("p", "r")}
    assert graph.implied_by_capability(labels).count() == 4


def test_admission(spark):
    cases = spark.createDataFrame([("s", "1", "i", "capability", "a", "pass", "human", ["x"], "pass"), ("s", "2", "i", "capability", "a", "fail", "guess", ["x"], "fail")], "suite string, case_id string, intent string, scope string, cap string, category string, evidence_source string, example_ids array<string>, expected string")
    caps = spark.createDataFrame([("s", "a"), ("s", "b")], "suite string, cap string")
    ex = spark.createDataFrame([("s", "x"), ("s", "y")], "suite string, example string")
    got = sorted((r["problem"], r["subject"]) for r in graph.admission_problems(cases, caps, ex, ("pass", "fail"), ("human",)).collect())
    assert got == [("contradictory_label", "x"), ("coverage_gap", "b/fail"), ("coverage_gap", "b/pass"), ("duplicate_intent", "i"), ("evidence_not_allowed", "2"), ("unused_example", "y")]


def test_ledger_is_idempotent(spark):
    ops = [(1, "a", "reserve", 5, 0), (2, "a", "reserve", 5, 0), (3, "a", "settle", 5, 3), (4, "b", "unknown", 0, 0)]
    df = spark.createDataFrame([(s, o, "run", "usd", k, r, u) for s, o, k, r, u in ops], "seq int, op_id string, level string, dim string, kind string, reserved long, used long")
    got = trace.ledger(df, spark.createDataFrame([("run", "usd", 10)], "level string, dim string, most long")).orderBy("seq").select("held", "consumed", "remaining").collect()
    assert [tuple(r) for r in got] == [(5, 0, 5), (0, 3, 7), (0, 3, 7)]


def test_published_and_applicable(spark):
    e = spark.createDataFrame([(1, "k", "v", "j"), (2, "k", "v", "x")], "sequence int, reward_key string, validation_ref string, job_key string")
    r = spark.createDataFrame([(1, "k", "v", "j", "success"), (2, "k", "v", "j", "success")], "sequence int, reward_key string, validation_ref string, job_key string, status string")
    a, b = trace.published(e, r)
    assert [x["sequence"] for x in a.collect()] == [1] and [x["sequence"] for x in b.collect()] == [2]
    lib = spark.createDataFrame([("p", ["a"]), ("p", ["a", "z"])], "profile string, need array<string>")
    task = spark.createDataFrame([("p", ["a", "b"])], "profile string, have array<string>")
    assert trace.applicable(lib, task, ["profile"], ("need", "have")).count() == 1


def test_fine_tuning_reasons(spark):
    schema = "seq int, logical_call_id string, episode_id string, actor_role string, response_complete boolean, committed_to_history boolean, schema_valid boolean, request string, response string"
    rows = [(1, "a", "e", "w", True, True, True, "q", "r"), (2, "a", "e", "w", True, True, True, "q", "r"), (3, "b", "e", "x", True, True, True, "q", "r"), (4, "c", "f", "w", True, True, True, "q", "r"), (5, "d", "e", "w", False, True, True, "q", "r"), (6, "g", "e", "w", True, True, True, "q" * 99, "r")]
    good, bad = trace.fine_tuning_rows(spark.createDataFrame(rows, schema), "w", spark.createDataFrame([("e",)], "episode_id string"), 50)
    assert [r["sample_id"] for r in good.collect()] == ["a"]
    assert {r["reason"]: r["count"] for r in bad.collect()} == {"non_selected_actor": 1, "role_not_training_success": 1, "incomplete_invalid_or_uncommitted": 1, "duplicate_logical_response": 1, "context_window": 1}


def test_tfidf_finds_the_copy(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["red green blue", "one two three", "red green violet"])], "k int, t string")
    t = lexical.terms(df, "k", F.col("t"))
    w = lexical.weights(t, lexical.idf(t, 3), "k")
    q = lexical.weights(lexical.terms(spark.createDataFrame([(9, "one two three")], "k int, t string"), "k", F.col("t")), lexical.idf(t, 3), "k")
    r = lexical.nearest(q, w, "k").first()
    assert r["base"] == 1 and r["cosine"] == pytest.approx(1.0)


def test_strict_reading(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text('{"query_id":"a","query":"1"}\n{broken\n{"query":"2"}\n\n{"query_id":"a","query":"3"}\n{"query_id":"b","query":"4"}\n{"query_id":"c","query":"5","more":1}\n[1]\n')
    got = readers.strict_records(readers.lines(spark, str(p)), "query_id string, query string", "query_id", ("query",)).orderBy("line").collect()
    assert [(r["line"], r["error"]) for r in got] == [(0, None), (1, "invalid_json"), (2, "missing_field"), (4, "duplicate_id"), (5, None), (6, "unknown_field"), (7, "not_an_object")]
    later = readers.strict_records(readers.lines(spark, str(p)), "query_id string, query string", "query_id", ("query",), start=4)
    assert later.count() == 4 and later.where("line = 4").first()["error"] == "duplicate_id"


def test_journal(spark, tmp_path):
    e = lambda i, s: json.dumps({"event_id": i, "seq": s, "ts": 1.0, "type": "t", "episode_id": "e", "query_id": "q", "payload": "{}", "schema_version": "1"})
    p = tmp_path / "trace.jsonl"
    p.write_text("\n".join([e("a", 1), e("b", 2), "{oops", e("b", 3), e("c", 3), e("d", 5)]) + "\n" + e("e", 6)[:20])
    events, faults = readers.journal(spark, str(p))
    assert [r["event_id"] for r in events.orderBy("line").collect()] == ["a", "b", "d"]
    assert [(r["line"], r["fault"]) for r in faults.orderBy("line").collect()] == [(2, "corrupt_line"), (3, "repeated_event"), (4, "seq_not_rising")]


def test_committed_records_and_attempts(spark, tmp_path):
    p = tmp_path / "results.jsonl"
    p.write_text('{"job_key":"a","n":1}\n{"job_key":"a","n":2}\n{"job_key":"b","n":3}')
    assert [tuple(r) for r in readers.committed(spark, str(p), "job_key string, n int", "job_key").collect()] == [("a", 2)]
    for r, a in (("x", 1), ("x", 2)):
        d = tmp_path / "run" / "calls" / r / str(a)
        d.mkdir(parents=True)
        (d / "result.json").write_text(json.dumps({"status": f"s{a}"}))
    got = readers.attempt_results(spark, str(tmp_path / "run"), "status string").orderBy("attempt").collect()
    assert [(r["rollout_id"], r["attempt"], r["status"]) for r in got] == [("x", 1, "s1"), ("x", 2, "s2")]


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    spark.createDataFrame([(3, "y")], "x int, z string").write.parquet(str(tmp_path / "p"))
    reg = readers.Registry([readers.Source("s", "train", str(tmp_path / "a.json"), multiline=True), readers.Source("s", "test", str(tmp_path / "p"), "parquet", ("x",))])
    assert sorted((r["split"], r["x"]) for r in reg.rows(spark, "s").collect()) == [("test", 3), ("train", 1), ("train", 2)]
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read(spark, readers.Source("s", "x", str(tmp_path / "none*.json")))


def test_skill_lists_are_parsed(spark):
    df = spark.createDataFrame([("['Graphs', 'Sorting']", "EASY"), ("[]", "HARD")], "skill_types string, difficulty string")
    assert readers.by_difficulty_or_skills(df, skills=("Sorting",)).count() == 1
    assert readers.by_difficulty_or_skills(df, difficulties=("HARD",)).count() == 1


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, t string")
    path = str(tmp_path / "t")
    writers.replace_whole(df, path)
    writers.replace_whole(df.limit(1), path)
    assert spark.read.parquet(path).count() == 1
    dry = writers.clean_and_replace(spark, path, lambda d: d.where("x > 5"))
    assert dry["after"] == 0 and spark.read.parquet(path).count() == 1
    done = writers.clean_and_replace(spark, path, lambda d: d.where("x > 5"), apply=True)
    assert done["applied"] and spark.read.parquet(path).count() == 0 and spark.read.parquet(done["backup"]).count() == 1
    blobs = spark.createDataFrame([(bytearray(b"x"),), (bytearray(b"x"),)], "bytes binary")
    writers.put_blobs(blobs, str(tmp_path / "b"))
    stored = writers.put_blobs(blobs, str(tmp_path / "b"))
    assert stored.count() == 1
    events = spark.createDataFrame([("sha256:" + "0" * 64 + " sha256:" + stored.first()["digest"],)], "payload string")
    assert [r["digest"] for r in readers.missing_blobs(events, stored).collect()] == ["0" * 64]
    report = writers.export({"rows": df}, str(tmp_path / "out"), note="n")
    assert report["files"]["rows.json"]["rows"] == 2 and writers.same_rows(spark.read.parquet(str(tmp_path / "out" / "rows.parquet")), df)
    with pytest.raises(ValueError):
        writers.guard(str(tmp_path / "t" / "x"), path)


def test_rewritten_history_and_breaker(spark):
    df = spark.createDataFrame([("e", 1, ["a"]), ("e", 2, ["a", "b"]), ("e", 3, ["a", "c"])], "ep string, seq int, h array<string>")
    assert [r["seq"] for r in trace.rewritten(df, ["ep"], "seq", "h").collect()] == [3]
    f = spark.createDataFrame([("e", i, x) for i, x in enumerate([True, True, False, True])], "ep string, seq int, failed boolean")
    assert [r["open"] for r in trace.breaker(f, ["ep"], ["seq"], "failed", 2).orderBy("seq").collect()] == [False, False, True, False]


def test_hint_text_takes_the_first_message_where_the_last_is_short(spark):
    long = "x" * 5000
    chats = [
        (0, [("user", "first"), ("assistant", "a"), ("user", "last")]), (1, [("user", "first"), ("user", long)]), (2, [("user", long), ("user", "y" * 80)]),
        (3, [("system", "s")]), (4, []), (5, None), (6, [("user", None), ("user", "last")]), (7, [("user", "only")]), (8, [("user", long), ("user", None)]),
    ]
    df = spark.createDataFrame(chats, "k int, messages array<struct<role:string,content:string>>")
    got = {r["k"]: r["t"] for r in df.select("k", flags.hint_text(F.col("messages")).alias("t")).collect()}
    assert got == {0: "last\nfirst", 1: "x" * 4000, 2: "y" * 80, 3: "", 4: "", 5: "", 6: "last", 7: "only\nonly", 8: "\n" + "x" * 4000}


def test_entries_of_one_large_class_meet_its_tasks_in_all_parts(spark):
    entries = spark.range(40).selectExpr("id AS e", "IF(id % 10 = 9, NULL, 'p') AS profile", "IF(id % 10 = 8, NULL, IF(id % 2 = 0, array('a'), array('a', NULL))) AS need")
    tasks = spark.range(500).selectExpr("id AS t", "IF(id % 7 = 6, NULL, 'p') AS profile", "IF(id % 5 = 0, array('b', 'a'), IF(id % 5 = 1, NULL, array('a', NULL))) AS have")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = trace.applicable(entries, tasks, ["profile"], ("need", "have"))
        plain = entries.join(tasks, ["profile"]).where(F.size(F.array_except("need", "have")) == 0)
        assert got.columns == plain.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
        assert got.select(F.spark_partition_id()).distinct().count() > plain.select(F.spark_partition_id()).distinct().count() == 1
    finally:
        for k in settings:
            spark.conf.unset(k)
