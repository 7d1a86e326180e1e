"""Languages, versions of tables, timed streams, nearest rows by bounds, p-values and limits of user code."""

import math
import random
import threading
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions import envelope
from millrace.operators import drift, language, lexical, neardup, rollouts, scorer
from millrace.sources import versions
from millrace.streaming import timed

# Languages


def speech(n, seed):
    r = random.Random(seed)
    parts = {"en": ["the", "ing", "wh", "ou", "th", "ed"], "de": ["sch", "ung", "ein", "ß", "ch", "er"], "fr": ["eux", "qu", "é", "ai", "ou", "le"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(parts))
        rows.append((i, lang, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(4, 40)))))
    return rows


def test_grams_of_any_characters(spark):
    df = spark.createDataFrame([(0, "aé😀b"), (1, "x"), (2, ""), (3, None)], "k int, t string")
    got = {r["k"]: r["g"] for r in df.select("k", language.char_grams(F.col("t")).alias("g")).collect()}
    assert got == {0: ["a", "é", "😀", "b", "aé", "é😀", "😀b", "aé😀", "é😀b"], 1: ["x"], 2: [], 3: []}


def test_languages_of_texts_that_the_model_has_not_seen(spark):
    df = spark.createDataFrame(speech(240, 1), "id int, lang string, t string").repartition(3)
    model = language.fit(df.where("id % 4 <> 0").unionByName(spark.createDataFrame([(900, None, "zzz")], df.schema)), "lang", "t")
    asked = df.where("id % 4 = 0").unionByName(spark.createDataFrame([(1000, None, ""), (1001, None, None), (1002, None, "日本語")], df.schema))
    got = {r["id"]: r for r in language.identified(asked, ["id"], "t", model).collect()}
    right = [got[i]["hint"] == lang for i, lang, _ in speech(240, 1) if i % 4 == 0]
    assert sum(right) == len(right) and all(0 < r["score"] <= 1 for r in got.values())
    assert got[1000]["hint"] == got[1001]["hint"] and got[1000]["score"] == pytest.approx(math.exp(max(model.prior)))
    assert {r["told"] for r in language.confusion(df.join(language.identified(df, ["id"], "t", model), "id"), "lang", "hint").collect()} == {"en", "de", "fr"}
    none = language.fit(df.limit(0), "lang", "t")
    assert [r["hint"] for r in language.identified(asked.limit(1), ["id"], "t", none).collect()] == [None]


def test_grams_are_counted_where_they_are_read(spark, monkeypatch):
    """In pieces of any length, for texts and languages of any number, without a row for each gram."""
    monkeypatch.setattr(language, "PIECE", 7)
    r, sizes = random.Random(5), (1, 2, 3, 5)
    texts = ["", "é", "".join(r.choice("ab\0😀") for _ in range(60)), "", "abab", "ba", ""]
    got = [{} for _ in texts]
    for of, place, grams in language.gram_runs(texts, sizes):
        for i, p in zip(of.tolist(), place.tolist(), strict=True):
            got[i][grams[p]] = got[i].get(grams[p], 0) + 1
    assert got == [{g: sum(t.startswith(g, k) for k in range(len(t))) for g in {t[k : k + n] for n in sizes for k in range(len(t) - n + 1)}} for t in texts]
    monkeypatch.undo()
    df = spark.createDataFrame([(1, "a", "xyxy"), (2, "b", "yz"), (3, "a", None), (4, None, "zz"), (5, "a", "x")], "k int, lang string, t string")
    counts = language.gram_counts(df, "lang", "t", sizes=(1, 2))
    assert {(x["lang"], x["gram"]): x["n"] for x in counts.collect()} == {("a", "x"): 3, ("a", "y"): 2, ("a", "xy"): 2, ("a", "yx"): 1, ("b", "y"): 1, ("b", "z"): 1, ("b", "yz"): 1}
    model = language.fit(df, "lang", "t", sizes=(1, 2))
    twice = language.identified(df.unionByName(df), ["k"], "t", model)
    once = language.identified(df.withColumn("t", F.concat("t", "t")), ["k"], "t", language.fit(df, "lang", "t", sizes=(1,)))
    one = language.identified(df.unionByName(df), ["k"], "t", language.fit(df, "lang", "t", sizes=(1,)))
    assert twice.count() == 5 and {x["k"]: x["hint"] for x in one.collect()} == {x["k"]: x["hint"] for x in once.collect()}
    told = language.answers(df.withColumn("probe", F.upper("t")), ["k"], "probe", model)
    own = {x["k"]: x for x in language.identified(df, ["k"], "t", model).collect()}
    assert all((x["folded_hint"], x["folded_score"]) == (own[x["k"]]["hint"], pytest.approx(own[x["k"]]["score"])) for x in told.collect())
    for q in (counts, twice, told):
        plan = q._jdf.queryExecution().toString()
        assert "Generate" not in plan and "explode" not in plan
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()


def test_scores_by_hand(spark):
    df = spark.createDataFrame([("a", "xx"), ("b", "xy"), ("b", "y")], "lang string, t string")
    m = language.fit(df, "lang", "t", sizes=(1,))
    r = language.identified(spark.createDataFrame([(1, "yz")], "k int, t string"), ["k"], "t", m).first()
    a, b = 1 / 3 * 1 / 4 * 1 / 4, 2 / 3 * 3 / 5 * 1 / 5
    assert r["hint"] == "b" and r["score"] == pytest.approx(b / (a + b))


# Versions


def test_a_reader_never_misses_the_table(spark, tmp_path):
    t = versions.Table(spark, str(tmp_path / "t"))
    t.replace(spark.range(3).withColumn("v", F.lit(0)))
    seen, failures, done = [], [], threading.Event()

    def read():
        while not done.is_set():
            try:
                rows = t.read().collect()
                assert len(rows) == 3 and len({r["v"] for r in rows}) == 1
                seen.append(rows[0]["v"])
            except Exception as e:  # noqa: BLE001
                failures.append(e)

    reader = threading.Thread(target=read)
    reader.start()
    for i in range(1, 21):
        t.replace(spark.range(3).withColumn("v", F.lit(i)))
    done.set()
    reader.join()
    assert not failures and seen == sorted(seen) and t.numbers() == list(range(21))


def test_a_writer_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch):
    t = versions.Table(spark, str(tmp_path / "t"))
    with pytest.raises(FileNotFoundError):
        t.read()
    t.replace(spark.range(3))
    with monkeypatch.context() as m:
        m.setattr(versions.Table, "_claim", lambda self, a, b: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            t.append(spark.range(5))
    assert t.read().count() == 3 and len(t.orphans()) == 1
    assert t.forget(1, orphans=True) and not t.orphans() and t.read().count() == 3


def test_two_writers_of_one_version(spark, tmp_path):
    t = versions.Table(spark, str(tmp_path / "t"))
    t.replace(spark.range(1))
    v = t.version()
    t._publish(1, v.folders, spark.range(1).schema, {})
    with pytest.raises(versions.Conflict):
        t._publish(1, (), spark.range(1).schema, {})
    errors = []

    def add(i):
        try:
            t.append(spark.range(i, i + 1))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    writers = [threading.Thread(target=add, args=(i,)) for i in range(1, 5)]
    [w.start() for w in writers]
    [w.join() for w in writers]
    assert not errors and sorted(r["id"] for r in t.read().collect()) == [0, 1, 2, 3, 4] and t.numbers() == list(range(6))


def test_append_clean_compact_and_older_versions(spark, tmp_path):
    t = versions.Table(spark, str(tmp_path / "t"))
    t.append(spark.range(4))
    t.append(spark.range(4, 6))
    with pytest.raises(ValueError, match="other columns"):
        t.append(spark.createDataFrame([("x",)], "id string"))
    assert t.clean(lambda df: df.where("id > 3")) == {"before": 6, "after": 2, "applied": False} and t.numbers() == [0, 1]
    done = t.clean(lambda df: df.where("id > 3"), apply=True)
    assert (done["before"], done["after"], t.read(done["backup"]).count()) == (6, 2, 6)
    t.replace(t.read().unionByName(t.read()))
    t.compact(1)
    assert sorted(r["id"] for r in t.read().collect()) == [4, 4, 5, 5] and len(t.version().folders) == 1
    t.replace(spark.range(0))
    assert t.read().count() == 0
    t.forget(2)
    assert len(t.numbers()) == 2 and t.read(t.numbers()[0]).count() == 4


# Timed streams


NOON = datetime(2024, 1, 1, 12)


def test_episodes_end_and_their_state_goes(spark):
    at = lambda h: NOON + timedelta(hours=h)
    rows = [("a", 1, "planning", at(0)), ("a", 2, "testing", at(0)), ("b", 1, "planning", at(0)), ("a", 3, "done", at(1)), ("a", 3, "done", at(1)), ("b", 2, "done", at(2)), ("a", 4, "planning", at(2)), ("c", 1, "planning", at(30)), ("a", 5, "planning", at(31))]
    df = spark.createDataFrame(rows, "episode_id string, seq long, to_state string, ts timestamp")
    feed = timed.Feed(spark, df.schema)
    for low, high in ((0, 1), (1, 2), (2, 30), (30, 31), (31, 99)):
        feed.put(df.where((F.col("ts") >= F.lit(at(low))) & (F.col("ts") < F.lit(at(high)))))
        timed.run_once(timed.episodes(feed.stream(), keep=3_600_000), f"{feed.folder}/cp", f"{feed.folder}/out", "update", feed.progress)
    out = spark.read.parquet(f"{feed.folder}/out")
    got = {(r["episode_id"], r["state"], r["taken"], r["refused"]) for r in out.where("expired").collect()}
    assert ("a", "done", 3, 1) in got
    last = {r["episode_id"]: (r["state"], r["taken"], r["refused"], r["expired"]) for r in timed.latest(out).collect()}
    assert last == {"a": ("planning", 1, 0, False), "b": ("planning", 1, 1, False), "c": ("planning", 1, 0, False)}


def test_unfinished_episodes_are_given_up(spark):
    rows = [("a", 1, "planning", NOON), ("z", 1, "planning", NOON + timedelta(days=1))]
    df = spark.createDataFrame(rows, "episode_id string, seq long, to_state string, ts timestamp")
    feed = timed.Feed(spark, df.schema)
    for r in rows:
        feed.put(df.where(F.col("episode_id") == r[0]))
        timed.run_once(timed.episodes(feed.stream(), keep=1000, idle=60_000), f"{feed.folder}/cp", f"{feed.folder}/out", "update")
    last = {r["episode_id"]: (r["state"], r["expired"]) for r in timed.latest(spark.read.parquet(f"{feed.folder}/out")).collect()}
    assert last == {"a": ("planning", True), "z": ("planning", False)}


def test_late_responses_are_marked_and_never_targets(spark):
    minute = lambda n: NOON + timedelta(minutes=n)
    c = spark.createDataFrame([(1, minute(0)), (2, minute(1)), (3, minute(2)), (None, minute(2)), (9, minute(5000))], "call_id long, ts timestamp")
    r = spark.createDataFrame([(11, 1, minute(30)), (12, 2, minute(90)), (14, 7, minute(3)), (19, 9, minute(5001))], "response_id long, call_id long, ts timestamp")
    calls, responses = timed.Feed(spark, c.schema), timed.Feed(spark, r.schema)
    for low, high in ((0, 60), (60, 4000), (4000, 9000)):
        for feed, df in ((calls, c), (responses, r)):
            feed.put(df.where((F.col("ts") >= F.lit(minute(low))) & (F.col("ts") < F.lit(minute(high)))))
        timed.run_once(timed.answered(calls.stream(), responses.stream(), "60 MINUTES"), f"{calls.folder}/cp", f"{calls.folder}/out", "append", calls.progress)
    got = {(x["call_id"], x["response_id"], x["status"], x["is_target"]) for x in spark.read.parquet(f"{calls.folder}/out").collect()}
    assert got >= {(1, 11, "answered", True), (2, None, "unanswered", False), (2, 12, "late", False), (3, None, "unanswered", False), (7, 14, "late", False), (9, 19, "answered", True)}
    assert sum(x[3] for x in got) == 2
    assert calls.progress[-1] < max(calls.progress)


# Nearest rows


def vectors(spark, n, seed, words=60):
    r = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    rows = [(i, " ".join(r.choices([f"w{j:02d}" for j in range(words)], weights, k=r.randint(3, 25)))) for i in range(n)]
    return spark.createDataFrame(rows, "k int, t string")


@pytest.mark.parametrize("by", [None, "part"])
def test_nearest_equals_all_pairs(spark, monkeypatch, by):
    monkeypatch.setattr(lexical, "BLOCK", 7)
    base, query = vectors(spark, 120, 1), vectors(spark, 40, 2).unionByName(spark.createDataFrame([(99, "nothing shared")], "k int, t string"))
    t = lexical.terms(base, "k", F.col("t"), (1,))
    i = lexical.idf(t, 120)
    b, q = (lexical.weights(x, i, "k").withColumn("part", F.col("k") % 3) for x in (t, lexical.terms(query, "k", F.col("t"), (1,))))
    on = ["term"] + ([by] if by else [])
    every = q.withColumnsRenamed({"k": "query", "w": "qw"}).join(b.withColumnsRenamed({"k": "base", "w": "bw"}).select("base", "bw", *on), on).groupBy("query", "base").agg(F.sum(F.col("qw") * F.col("bw")).alias("cosine"))
    want = every.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 12)), "base"))).where("n = 1")
    got = {r["query"]: r["cosine"] for r in lexical.nearest(q, b, "k", by).collect()}
    assert got == pytest.approx({r["query"]: r["cosine"] for r in want.collect()}) and 99 not in got


def test_common_terms_find_no_candidates(spark):
    """Of near copies among rows that all share common words, few pairs are looked at."""
    base = vectors(spark, 300, 3).withColumn("t", F.concat("t", F.lit(" rare"), "k", F.lit(" odd"), "k"))
    query = base.where("k < 20").withColumn("t", F.concat("t", F.lit(" more")))
    t = lexical.terms(base, "k", F.col("t"), (1,))
    i = lexical.idf(t, 300)
    b, q = lexical.weights(t, i, "k"), lexical.weights(lexical.terms(query, "k", F.col("t"), (1,)), i, "k")
    qs, bs, best = lexical.bounded(q, b, "k")
    needed = qs.join(best, "query").where("bound * (1 + 1e-9) >= best")
    looked, every = (lexical.pairs_on(x, bs, ["term"]).count() for x in (needed, qs))
    print(f"pairs: {looked} of {every}")
    assert looked * 5 < every
    assert all(r["query"] == r["base"] for r in lexical.nearest(q, b, "k").collect())


def test_terms_are_worked_out_once(spark):
    """The plan of the last step has what that step does, and not the terms again for each use."""
    base, query = vectors(spark, 60, 4), vectors(spark, 20, 5)
    t = lexical.terms(base, "k", F.col("t"))
    i = lexical.idf(t, 60)
    n = lexical.nearest(lexical.weights(lexical.terms(query, "k", F.col("t")), i, "k"), lexical.weights(t, i, "k"), "k")
    plan = n._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("Exchange") < 20


def test_commonest_terms_without_a_sort_of_all(spark):
    t = spark.createDataFrame([(k, f"t{i}", 1 + i % 3) for k in range(2) for i in range(40)], "k int, term string, tf int")
    g = t.groupBy("term").agg(F.sum("tf").alias("total"))
    for most in (5, 13, 14, 30, 40, 50):
        want = {r["term"] for r in g.orderBy(F.desc("total"), "term").limit(most).collect()}
        cut = lexical.idf(t, 2, most)
        assert {r["term"] for r in cut.collect()} == want
        assert "TakeOrderedAndProject" not in cut._jdf.queryExecution().executedPlan().toString()


# p-values


def test_p_values_by_row(spark):
    cases = [(s, k) for k in (1, 2, 3, 7, 30, 200, 5000) for s in (0.0, 0.1, k * 0.5, k * 0.9, k * 1.0, k * 1.1, k * 2.0, k + 60.0)]
    df = spark.createDataFrame(cases, "s double, k long")
    for r in df.withColumn("p", drift.chi_square_tail(F.col("s"), F.col("k"))).collect():
        assert r["p"] == pytest.approx(drift.chi_square_p(r["s"], r["k"]), abs=1e-9)
    df = spark.createDataFrame([(d, n, m) for d in (0.0, 0.01, 0.1, 0.5, 1.0) for n, m in ((10, 20), (500, 700), (100_000, 3_000_000))] + [(None, 0, 0)], "d double, n long, m long")
    for r in df.withColumn("p", drift.ks_tail(F.col("d"), F.col("n"), F.col("m"))).collect():
        assert (r["p"] is None) if r["d"] is None else r["p"] == pytest.approx(drift.ks_p(r["d"], r["n"], r["m"]), abs=1e-9)


# User code


def test_what_a_component_prints_and_tells(spark):
    r = scorer.score_one("def score(e, c):\n    print('p' * 300000)\n    return {'raw_score': 2, 'feedback': {'long': 'f' * 70000}}\n", {}, 30.0)
    assert r["raw"] == 2.0 and len(r["feedback"]) == 65536 and r["feedback_truncated"] and r["error"] is None
    assert scorer.score_one("def score(e, c):\n    return 10 ** 400\n", {}, 30.0)["kind"] == "nonfinite"
    for source in ("def score(e, c): return hash('x')", "def score(e, c): return id(e)", "def score(e, c): return memoryview(b'x')", "class A: pass\ndef score(e, c): return 1"):
        assert scorer.score_one(source, {}, 30.0)["error"] == "COMPONENT_EXCEPTION"
    assert scorer.score_one("import math\nfrom re import match\ndef score(e, c):\n    return math.sqrt(16) if match('a', 'ab') else 0", {}, 30.0)["raw"] == 4.0
    assert scorer.score_one("def score(e, c):\n    while True: pass", {}, 1.0)["error"] == "COMPONENT_TIMEOUT"


def test_components_are_admitted_or_told_why(spark):
    df = spark.createDataFrame([(1, "def score(e, c): return 1"), (2, "import os"), (3, "def ("), (4, None)], "component_id int, source string")
    got = {r["component_id"]: (r["admitted"], r["refusal"]) for r in scorer.admitted(df).collect()}
    assert got == {1: (True, None), 2: (False, "import of os"), 3: (False, "no Python"), 4: (False, "no function score(example, context)")}


# Envelopes


def test_envelopes_of_many_braces_and_deep_nesting():
    assert envelope.envelope("{" * 200_000)[1] == "no JSON object"
    assert envelope.envelope('{"a":' * 3000)[1].endswith("is not closed")
    assert envelope.envelope('x {"a": {"b": [{"actions": 1}]}} {"c": "{\\"actions\\": 2}"}')[0] == '{"actions":1}'
    assert envelope.envelope('{"say": "{}", "actions": []} trailing }')[0] == '{"actions":[],"say":"{}"}'
    assert envelope.envelope('{"actions": "never')[1] == "string is not closed"


# Near duplicates by classes


def test_classes_tell_the_links_of_all_pairs(spark):
    r = random.Random(4)
    words = [f"t{i}" for i in range(400)]
    rows = []
    for i in range(12):
        text = [r.choice(words) for _ in range(120)]
        for j in range(6):
            other = list(text)
            if j % 3:
                other[r.randrange(120)] = r.choice(words)
            rows.append((i * 10 + j, " ".join(other)))
    df = spark.createDataFrame([*rows, (900, "too short"), (901, None)], "k long, t string")
    links, pairs = {}, 0
    for p in neardup.near_pairs(df, "k", F.col("t")).collect():
        pairs += 1
        for x in (p["a"], p["b"]):
            links[x] = links.get(x, 0) + 1
    members, classes = neardup.near_classes(df, "k", F.col("t"))
    got = {m["k"]: (m["class_id"], m["links"]) for m in members.collect()}
    assert {k: n for k, (_, n) in got.items() if n} == links and len(got) == len(rows)
    texts = dict(rows)
    assert all(texts[k] == texts[c] and c <= k for k, (c, _) in got.items()) and classes.count() < pairs


def test_bytes_that_are_no_text(spark):
    head, tail = b'data: {"model":"m","choices":[{"index":0,"delta":{"content":"', b'"}}]}\n\ndata: [DONE]\n\n'
    df = spark.createDataFrame([(1, bytearray(head + "é".encode() + tail)), (2, bytearray(head + b"\xff" + tail)), (3, None)], "k int, body binary")
    got = {r["k"]: (r["content"], r["errors"], r["done"]) for r in rollouts.folded(df, "k", "body").collect()}
    assert got == {1: ("é", [], True), 2: ("\ufffd", ["invalid_utf8"], True), 3: ("", [], False)}


def test_texts_that_share_a_passage_only_are_no_candidates(spark):
    r = random.Random(8)
    words = [f"t{i}" for i in range(5000)]
    passage = " ".join(r.choice(words) for _ in range(100))
    rows = [(i, passage + " " + " ".join(r.choice(words) for _ in range(100))) for i in range(40)]
    rows += [(100 + i, t + " end") for i, t in rows[:5]]
    f = neardup.features(spark.createDataFrame(rows, "k long, t string"), "k", F.col("t")).cache()
    keys = f.select(F.explode("bottom").alias("g")).groupBy("g").count()
    assert keys.where("count > 20").count() > 0  # all pairs of 40 texts met here
    near = {(i, 100 + i) for i in range(5)}
    name = {bytes(x["set"]): x["k"] for x in f.collect()}
    got = [tuple(sorted((name[bytes(p["x"])], name[bytes(p["y"])]))) for p in neardup.candidate_pairs(f, 0.9).collect()]
    assert near <= set(got) and len(got) < 20
    pairs = neardup.near_pairs(spark.createDataFrame(rows, "k long, t string"), "k", F.col("t")).collect()
    assert {(p["a"], p["b"]) for p in pairs} == near


def test_state_has_as_many_parts_as_are_asked_for_and_one_store_each(spark, tmp_path):
    at = datetime(2024, 1, 1)
    calls, responses = timed.Feed(spark, spark.createDataFrame([], "call_id long, ts timestamp").schema), timed.Feed(spark, spark.createDataFrame([], "response_id long, call_id long, ts timestamp").schema)
    for k in range(2):
        calls.put(spark.createDataFrame([(k, at + timedelta(days=9 * k))], calls.schema))
        responses.put(spark.createDataFrame([(10 + k, k, at + timedelta(days=9 * k, minutes=90 * k))], responses.schema))
        before = spark.conf.get("spark.sql.shuffle.partitions")
        timed.run_once(timed.answered(calls.stream(), responses.stream(), "60 MINUTES"), f"{tmp_path}/cp", f"{tmp_path}/out", "append", calls.progress, 3)
        assert spark.conf.get("spark.sql.shuffle.partitions") == before
    parts = [p for p in (tmp_path / "cp" / "state" / "0").iterdir() if p.name.isdigit()]
    assert len(parts) == 3 and all(not [x for x in p.iterdir() if x.is_dir() and "-" in x.name] for p in parts)
    assert {(r["call_id"], r["status"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(0, "answered")}
