"""Results that have to be whole: what a cut, a null or an empty text would change."""

import hashlib
import json
import random

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from millrace.functions import identity, text
from millrace.operators import duplicates, lexical, neardup, trace
from millrace.plans import audits, catalogue, signals
from millrace.streaming import timed


def of_sql(sql, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    return sorted(con.execute(sql).fetchall(), key=repr)


def test_grams_of_empty_texts_and_rows_without_a_language(spark, tmp_path):
    rows = [(1, "aba", "en"), (2, "", "en"), (3, "", "de"), (4, "zz", None), (5, None, "en"), (6, "", None), (7, "", "en"), (8, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = signals.language_counts(spark, str(tmp_path)).select("lang", "gram", "n").collect()
    assert sorted(map(tuple, got), key=repr) == of_sql(catalogue.SQL["language_counts"], tmp_path, ["documents"])


def test_near_rows_by_all_terms_of_all_texts(spark, tmp_path, monkeypatch):
    """No term is cut, turns of 100 and more share a key, and a row without a key is no answer."""
    r = random.Random(3)
    said = lambda n: " ".join(f"w{r.randrange(60)}" for _ in range(n))
    talks = [(1, 1, said(60)), (1, 100, said(60)), (2, 0, said(60)), (3, None, "same " * 30 + said(20)), *[(k, 1, said(50)) for k in range(4, 20)]]
    spark.createDataFrame(talks, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    asked = [(0, said(60)), (1, "same " * 30 + said(20)), (2, "short")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    cuts, idf = [], lexical.idf
    monkeypatch.setattr(lexical, "idf", lambda t, n, most=None: cuts.append(most) or idf(t, n, most))
    got = audits.near_existing(spark, str(tmp_path)).select("query", "cosine_millionths").collect()
    assert cuts == [None]
    assert sorted(map(tuple, got)) == of_sql(catalogue.SQL["near_existing"], tmp_path, ["conversations", "benchmark"])


def test_tasks_meet_lists_of_entries(spark, monkeypatch):
    monkeypatch.setattr(trace, "LISTED", 7)
    entries = spark.range(90).selectExpr("id % 60 AS e", "map('k', 1)['k'] AS one", "IF(id % 3 = 0, 'p', 'q') AS profile", "sequence(0, id % 3) AS need")
    tasks = spark.range(40).selectExpr("id % 30 AS t", "IF(id % 2 = 0, 'p', 'q') AS profile", "sequence(0, id % 3) AS have")
    got = trace.applicable(entries, tasks, ["profile"], ("need", "have"))
    plain = entries.join(tasks, ["profile"]).where("size(array_except(need, have)) = 0")
    assert got.columns == plain.columns and got.count() > 40
    assert sorted(map(repr, got.collect())) == sorted(map(repr, plain.collect()))
    plan = got._jdf.queryExecution().analyzed().toString()
    assert plan.index("Generate explode(__rows") < plan.index("Join Inner")  # rows come out after tasks and lists have met


def test_texts_go_through_python_once_and_not_through_expressions(spark, sf_dir):
    """White space of all kinds, nulls and empty lists; a plan of keys replaces nothing by expressions."""
    said = ["a  b \r\n c d\t ", " \x1f　\n", "", None, "é \x85x\x1c", "x\n\n y"]
    chats = [[("user", x), ("assistant", "z"), ("system", "s ")] for x in said] + [[], None]
    df = spark.createDataFrame([(i, m) for i, m in enumerate(chats)], "i int, m array<struct<role:string,content:string>>")
    plain = lambda x: None if x is None else "\n".join(line.rstrip() for line in x.splitlines()).strip()
    told = [m and [{"content": plain(x), "role": r} for r, x in m if r != "assistant"] for m in chats]
    want = [None if m is None else hashlib.sha256(json.dumps(m, ensure_ascii=False, separators=(",", ":")).replace("\\u001f", "\\u001F").encode()).hexdigest() for m in told]
    assert [r[0] for r in df.orderBy("i").select(identity.group_key(F.col("m"))).collect()] == want
    blank = df.orderBy("i").select(text.is_blank(F.get("m", 0)["content"])).limit(len(said)).collect()
    assert [r[0] for r in blank] == [not (x or "").split() for x in said]
    plan = signals.source_shapes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "ArrowEvalPython" in plan
    keys = duplicates.sample_keys(F.col("body"))
    assert not any("regexp_replace" in str(c) for c in keys.values())


def test_keys_of_a_selection_and_its_tokens_are_made_once(spark, sf_dir):
    members, records, _ = catalogue.pool_parts(spark, sf_dir)
    plan = members._jdf.queryExecution().optimizedPlan().toString()
    assert "EvalPython" not in plan and "sha2" not in plan
    f = neardup.features(records, "gid", F.col("family"))
    assert "regexp_extract_all" not in f._jdf.queryExecution().optimizedPlan().toString()
    all_signs = "".join(map(chr, range(32, 0x860))) + " 漢字 ½ Ⅷ _a9 𝒳 😀 ᚠ x"
    java = spark.createDataFrame([(all_signs,)], "t string").select(text.tokens(F.col("t"))).first()[0]
    assert neardup.WORDS.findall(all_signs) == java


class Held:
    """A bucket's state and timers, as Spark would hold them, and how often they were asked for."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        self.calls += 1
        return self.value is not None

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls, self.value = self.calls + 1, value

    def clear(self):
        self.calls, self.value = self.calls + 1, None

    def registerTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.calls += 1
        self.timers.remove(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.at

    getExpiryTimeInMs = getCurrentWatermarkInMs  # noqa: N815


def test_a_bucket_of_episodes_is_asked_for_once_a_batch():
    """Each episode goes on, hears a number once and goes at its own time, however many share a bucket."""
    r, held = random.Random(8), Held()
    p = timed.EpisodeSteps("k", "long", {"new": ("a",), "a": ("b",), "b": ()}, 100, None)
    p.init(held)
    want, out, clock = {}, {}, 0
    for batch in range(6):
        steps = [(r.randrange(300), r.randrange(4), r.choice("ab"), clock + r.randrange(50)) for _ in range(400)]
        held.calls = 0
        for df in p.handleInputRows((0,), iter([pd.DataFrame(steps[:150], columns=["k", "seq", "to_state", "ms"]), pd.DataFrame(steps[150:], columns=["k", "seq", "to_state", "ms"])]), None):
            out |= {x[0]: x[1:] for x in df.itertuples(index=False)}
        assert held.calls <= 5
        for k, seq, to, _ in sorted(steps, key=lambda x: x[1]):
            now = want.setdefault(k, ["new", 0, 0, set(), None])
            if seq in now[3]:
                continue
            now[3].add(seq)
            good = (now[0], to) in (("new", "a"), ("a", "b"))
            now[0], now[1], now[2] = (to, now[1] + 1, now[2]) if good else (now[0], now[1], now[2] + 1)
        for k in {x[0] for x in steps}:
            want[k][4] = max(x[3] for x in steps if x[0] == k) + 100 if want[k][0] == "b" else None
        assert {k: out[k][:3] for k in want} == {k: (*now[:3],) for k, now in want.items()}
        clock += 60
        while held.timers and min(held.timers) <= clock:
            held.at = at = clock
            held.timers.discard(first := min(held.timers))
            p.handle, held.getExpiryTimeInMs = held, lambda: first
            gone = [x for df in p.handleExpiredTimer((0,), held, held) for x in df["k"]]
            assert sorted(gone) == sorted(k for k, now in want.items() if now[4] is not None and now[4] <= at)
            for k in gone:
                del want[k], out[k]
    assert held.timers == {min(now[4] for now in want.values() if now[4] is not None)}
