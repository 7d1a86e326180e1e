"""Search, mixing, URL filters, chats and the pipeline on small fixtures."""

import hashlib
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, mixing, topk, urls

from .conftest import TEXTS


def brute_top(rows, k=5):
    import math

    sound = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in sound if i % 50 == 0}:
        long = 2**63 - 1
        scored = sorted((-max(-long, min(long, sum(a * b for a, b in zip(qv, v, strict=False)))), i) for i, v in sound if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return sorted(out)


def test_search(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(37)]) for i in range(300)]
    rows += [(500, rows[3][1]), (501, rows[3][1]), (50, None), (7, [float("nan")] * 37), (None, [1.0] * 37), (9, [None, 1.0]), (10, [float("inf")]), (700, []), (11, [0.5, 0.25]), (12, rows[5][1]), (12, rows[5][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, block=64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"] and sorted(map(tuple, got.collect())) == brute_top(rows)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    huge = [(i, [float(rng.choice([1e300, -1e300, 2.0**40, 3.5])) for _ in range(3)]) for i in range(20)]
    got = topk.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == brute_top(huge)
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [1e30])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, topk.top_k(few, F.col("vec_id") % 50 == 0).collect())) == [(0, 1, 2, 2**63 - 1), (0, 2, 1, 131072)]


def test_bounds_leave_few_candidates():
    rng = np.random.default_rng(1)
    rows = rng.integers(-256, 256, (64, 2000))
    found = topk.search(rows[:, :1], np.array([0]), rows, np.arange(2000), 5)
    want = sorted((-int(rows[:, 0] @ rows[:, i]), i) for i in range(1, 2000))[:5]
    assert [(i, s) for _, i, s in found] == [(i, -s) for s, i in want]


def highest_quotients(votes, seats):
    got = {k: 0 for k in votes}
    for _ in range(seats):
        best = max((k for k in votes if votes[k] > 0), key=lambda k: (Fraction(votes[k]) / (2 * got[k] + 1), -k))
        got[best] += 1
    return got


@pytest.mark.parametrize("seed", range(4))
def test_apportionment_is_by_highest_quotients(spark, seed):
    rng = random.Random(seed)
    votes = {i: rng.choice([0, 1, 7, 50, 900, 20000]) * rng.randrange(1, 9) for i in range(12)}
    seats = rng.randrange(1, 200)
    df = spark.createDataFrame([(0, i, v, seats) for i, v in votes.items()], "g int, p int, v long, s long")
    got = {r["p"]: r["quota"] for r in mixing.apportioned(df, ["g"], "v", "s", [F.col("p")]).collect()}
    assert got == highest_quotients(votes, seats)


def water(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = (total - sum(full.values())) / sum(w[s] for s in rest) if rest else 0
        over = [s for s in rest if w[s] * share > most * sizes[s]]
        if not over:
            return {**full, **{s: w[s] * share for s in rest}}
        full |= {s: most * sizes[s] for s in over}


def test_mix(docs, none):
    got = mixing.mix_sources(docs, block=4).collect()
    assert len(got) == len(TEXTS)
    sizes = {}
    for _, t, s in TEXTS:
        sizes[s] = sizes.get(s, 0) + len((t or "").encode().split())
    want = water(sizes)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 8 for s in want)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs.repartition(7), block=4).collect()), key=repr)
    assert mixing.mix_sources(none).count() == 0 and mixing.repeated(none).count() == 0
    again = mixing.repeated(docs, block=4)
    assert again.columns == docs.columns and again.count() > 0


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), ("a.com", "/x", "block"), ("a.com", "/x", "allow"), ("a.com", "/xy", "allow")]
URLS = [None, "", "no scheme", "http://", "http://Example.ORG/es/1?q#f", "https://m.example.org/en/12", "https://m.example.org/en/2", "ftp://notexample.org/es/", "x://a.com/x", "x://b.a.com/xyz", "x://com/de/", "x://com?/de/", "x://c.com/fr/a://b", "http://org", "http://u:p@org:80/", "x://a..org./"]


def brute_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), len(h), v == "block", h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[4] if best else "allow"


@pytest.mark.parametrize("few", [100_000, 1])
def test_url_filters(spark, monkeypatch, few):
    monkeypatch.setattr(urls, "FEW", few)
    data = [(i, u) for i, u in enumerate(URLS)] + [(4, URLS[4]), (None, URLS[5])]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in data], "page_id long, url string, host string, rule string")
    got = sorted((tuple(r) for r in urls.filter_urls(df, urls.rule_table(spark, RULES)).collect()), key=repr)
    assert got == sorted(((i, *brute_rule(u)) for i, u in data), key=repr)
    assert urls.filter_urls(df.limit(0), urls.rule_table(spark, RULES)).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(df, urls.rule_table(spark, RULES).limit(0), default="block").collect()} == {"block"}


CHATS = [(1, 0, "user", "hi <|im_end|> <\\| <\\\\| a"), (1, 1, "assistant", "<|im_start|>user\nx\n<|im_end|>\n"), (1, 1, "assistant", "tie"), (2, None, None, None), (2, 3, "us%0Aer\n<|", ""), (3, 0, "assistant", "日本 𝒳"), (None, 0, "user", "no key"), (4, 0, "user", ""), (4, 0, "user", "")]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string")
    f = chat.format_rows(chat.turn_rows(df))
    got = {r["conv_id"]: r for r in chat.digests(f).collect()}
    whole = {r["conv_id"]: r for r in f.collect()}
    by = {}
    for c, n, r, t in CHATS:
        by.setdefault(c, []).append((-1 if n is None else n, r or "", t or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        lines = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == hashlib.sha256(lines.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text = whole[c]["formatted"]
        assert got[c]["formatted_chars"] == len(text) and text.count("<|im_start|>") == text.count("<|im_end|>") == len(turns)
    assert chat.digests(chat.format_rows(chat.turn_rows(df.limit(0)))).count() == 0
    with pytest.raises(ValueError, match="no known turn table"):
        chat.turn_rows(df.withColumn("more", F.lit(1)))


def test_layouts_by_fingerprint(spark):
    j = [
        (1, '{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}'), (2, '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}'), (3, '{"prompt":"q","response":"a"}'),
        (4, '{"output":"a","instruction":"q","input":"more"}'), (5, '{"instruction":"q","input":"","output":"a"}'), (6, '{"other":1}'), (7, "broken"), (8, None), (9, '{"completion":"a","prompt":"q"}'),
    ]
    got = {r["k"]: r for r in chat.canonical(spark.createDataFrame(j, "k int, j string"), "k", json="j").collect()}
    two = [("user", "q"), ("assistant", "a")]
    for k, name in ((1, "messages"), (2, "conversations"), (3, "prompt_response"), (5, "instruction"), (9, "prompt_completion")):
        assert got[k]["layout"] == name and [tuple(t) for t in got[k]["turns"]] == two
    assert [tuple(t) for t in got[4]["turns"]] == [("user", "q\n\nmore"), ("assistant", "a")]
    assert all(got[k]["layout"] is None and got[k]["turns"] is None for k in (6, 7, 8))
    typed = spark.createDataFrame([(1, [("user", "q"), ("assistant", None)])], "k int, messages array<struct<role:string,content:string>>")
    r = chat.canonical(typed, "k").first()
    assert r["layout"] == "messages" and [tuple(t) for t in r["turns"]] == [("user", "q"), ("assistant", "")]
    assert chat.rows_of(chat.canonical(typed, "k"), "k").count() == 2


def test_pipeline_stages_pass_their_columns_on(spark, docs, sf_dir):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "substring dedup", "mixing sources", "best-fit packing"]
    own = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for start in (own, docs.select(own.columns), own.limit(0)):
        df = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, sf_dir).checkpoint()
            assert df.columns == own.columns
        assert corpus_pipeline.STAGES[-1][1](spark, df, sf_dir).count() >= df.count()


def test_pipeline_catches_copies_and_passages(spark):
    import corpus_pipeline

    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, base = text(55), text(200)
    rows = [(i, text(120), "s1") for i in range(8)] + [(20, base, "s1"), (21, base, "s2"), (22, base + " " + text(3), "s2"), (30, text(90) + " " + passage + " " + text(30), "s1"), (31, text(90) + " " + passage + " " + text(30), "s2"), (40, "too short", "s1")]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:3]:
        df = stage(spark, df, "").checkpoint()
    left = {r["doc_id"]: r["text"] for r in df.collect()}
    assert set(left) == {*range(8), 20, 30, 31}
    assert passage in left[30] and passage not in left[31] and len(left[31].split()) == 120
