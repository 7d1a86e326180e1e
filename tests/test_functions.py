import hashlib
import json
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from millrace.functions import answers, envelope, identity, text
from millrace.operators import scorer

EDGES = ["x²", "½ cup", "c‿d", "é decomposed", "a\xa0b", "a b", "a\x1cb", "a\x85b", "zero​width", "ß", "İ", "ΟΔΟΣ", "ﬁ", "", "  ", "one two", " ".join("abcdefghijk"), " ".join("abcdefghijkl"), "line \r\nnext\t\n\n end "]


def frame(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate([*EDGES, None])], "id int, t string")


def column(spark, c):
    return [r[0] for r in frame(spark).orderBy("id").select(c).collect()]


def test_norm_is_nfc_and_split_join(spark):
    want = [" ".join(unicodedata.normalize("NFC", x).split()) for x in EDGES]
    assert column(spark, text.norm(F.col("t"))) == [*want, None]


def test_canonical_strips_lines(spark):
    want = ["\n".join(x.rstrip() for x in unicodedata.normalize("NFC", t).replace("\r\n", "\n").splitlines()).strip() for t in EDGES]
    assert column(spark, text.canonical(F.col("t"))) == [*want, None]


def test_casefold_and_words(spark):
    assert column(spark, text.casefold(F.col("t"))) == [*[x.casefold() for x in EDGES], None]
    assert column(spark, text.words(F.col("t"))) == [*[x.split() for x in EDGES], None]


def test_grams_and_shingles_need_enough_tokens(spark):
    got = column(spark, F.size(text.shingle_keys(text.folded_tokens(F.coalesce("t", F.lit(""))))))
    assert got[EDGES.index(" ".join("abcdefghijk"))] == 0
    assert got[EDGES.index(" ".join("abcdefghijkl"))] == 10


def test_neutral_and_masks(spark):
    df = spark.createDataFrame([("12 + 3 = 15",), ("B",), ("hello",), ("#### 42",), ("…",)], "t string")
    assert [r[0] for r in df.select(text.is_neutral(F.col("t"))).collect()] == [True, True, False, True, True]
    masked = spark.createDataFrame([("a ```x\ny``` `c` https://u.v \\[ z \\] b",)], "t string").select(text.masked_for_language(F.col("t"))).first()[0]
    assert masked.split() == ["a", "b"]


def test_draw_key_is_the_digest_of_a_json_list(spark):
    got = spark.createDataFrame([("7",)], "k string").select(identity.draw_key(20261002, "draw", F.col("k")), identity.unit_interval(identity.draw_key(1, "holdout", F.col("k")))).first()
    assert got[0] == hashlib.sha256(json.dumps([20261002, "draw", "7"], separators=(",", ":")).encode()).hexdigest()
    assert float(got[1]) == pytest.approx(int(hashlib.sha256(b'[1,"holdout","7"]').hexdigest()[:16], 16) / 2**64)


MESSAGES = "id int, m array<struct<role:string,content:string>>"


def test_group_key_ignores_assistants(spark):
    rows = [(0, [("user", "a "), ("assistant", "x"), ("user", "b")]), (1, [("user", "a"), ("assistant", "y"), ("user", "b\r\n")]), (2, [("user", "a"), ("user", "c")])]
    keys = [r[0] for r in spark.createDataFrame(rows, MESSAGES).orderBy("id").select(identity.group_key(F.col("m"))).collect()]
    assert keys[0] == keys[1] != keys[2]
    want = hashlib.sha256(json.dumps([{"role": "user", "content": "a"}, {"role": "user", "content": "b"}], sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    assert keys[0] == want


def test_seed_and_prompt(spark):
    df = spark.createDataFrame([(0, [("system", " "), ("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "z")])], MESSAGES)
    r = df.select(F.size(identity.conversation_seed(F.col("m"))), F.size(identity.prompt_of(F.col("m")))).first()
    assert tuple(r) == (2, 4)


def test_tags(spark):
    df = spark.createDataFrame([("x",)], "t string").withColumn("g", identity.tag(b"k")(F.col("t")))
    assert df.select(identity.tag_holds(b"k")(F.col("t"), F.col("g")), identity.tag_holds(b"other")(F.col("t"), F.col("g"))).first() == (True, False)


@pytest.mark.parametrize(("response", "reference", "want"), [("so #### 1,234.50", "x #### 1234.5", 1.0), ("#### 5", "#### 6", 0.0), ("no mark 5", "5", 0.0), ("#### 12,34", "1234", 0.0), ("#### 3", "none", None), (None, "3", 0.0)])
def test_final_answers(spark, response, reference, want):
    df = spark.createDataFrame([(response, reference)], "a string, b string")
    assert df.select(answers.final_answer_matches(F.col("a"), F.col("b"))).first()[0] == want


@pytest.mark.parametrize(("response", "reference", "want"), [(r"\boxed{1/3}", "2/6", 1.0), (r"\boxed{0.5} then \boxed{1/2}", "0.50", 1.0), ("none", "1", 0.0), (r"\boxed{1/0}", "1", 0.0)])
def test_boxed_rationals(spark, response, reference, want):
    df = spark.createDataFrame([(response, reference)], "a string, b string")
    assert df.select(answers.boxed_matches(F.col("a"), F.col("b"))).first()[0] == want


def test_raw_kinds(spark):
    kinds = {"1": "number", "-2.5e3": "number", "true": "bool", "null": "null", '"x"': "string", "[1]": "array", "{}": "object", '{"__nonfinite__":"nan"}': "nonfinite", "NaN": "nonfinite", "x": "invalid"}
    df = spark.createDataFrame([(k,) for k in kinds], "j string")
    assert {r[0]: r[1] for r in df.select("j", answers.raw_kind(F.col("j"))).collect()} == kinds


def test_scaling(spark):
    df = spark.createDataFrame([(5.0, 0.0, 10.0), (20.0, 0.0, 10.0), (1.0, 2.0, 2.0)], "v double, a double, b double")
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    assert [tuple(r) for r in df.select(answers.scaled(v, a, b), answers.scaled(v, a, b, clamp=False)).collect()] == [(0.5, 0.5), (1.0, None), (None, None)]


@pytest.mark.parametrize(
    ("said", "found", "error"),
    [('go {"actions": [1]} now', '{"actions":[1]}', None), ("", None, "empty"), ("no json", None, "no JSON"), ('{"a": 1}', None, "no 'actions' key"), ('{"actions": []} {"actions": []}', None, "2 envelopes"), ('{"actions": [1}', None, "unexpected"), ('{"actions": [1', None, "not closed"), ("use {braces} freely", None, "no JSON")],
)
def test_envelopes(said, found, error):
    got, why = envelope.envelope(said)
    assert got == found
    assert (error is None) == (why is None) and (error is None or error in why)


@pytest.mark.parametrize("source", ["import os\ndef score(e, c): return 1", "def score(e, c): return eval('1')", "import re\ndef score(e, c): return re.template('')", "def score(e, c): return e.__class__", "from math import tau\ndef score(e, c): return tau", "x = 1", "def score(example, context): return context.run_code('x')"])
def test_policy_refuses(source):
    with pytest.raises(ValueError):
        scorer.check_source(source)


def test_scorer_starts_afresh_for_each_example(spark):
    source = "n = 0\ndef score(example, context):\n    global n\n    n += 1\n    return {'raw_score': n, 'feedback': 'f'}\n"
    df = spark.createDataFrame([(1, "{}"), (2, "{}")], "example_id int, example string").coalesce(1)
    bad = "def score(example, context):\n    return 1 / 0\n"
    odd = "def score(example, context):\n    return {'raw_score': True}\n"
    rows = scorer.score_examples(df, {"count": source, "bad": bad, "odd": odd}, allow_code=True).collect()
    assert [r["raw"] for r in rows if r["component_id"] == "count"] == [1.0, 1.0]
    assert {r["error"] for r in rows if r["component_id"] == "bad"} == {"COMPONENT_EXCEPTION"}
    assert {r["kind"] for r in rows if r["component_id"] == "odd"} == {"bool"}
    with pytest.raises(PermissionError):
        scorer.score_examples(df, {"count": source})


def test_programs_time_out(spark):
    df = spark.createDataFrame([(1, "print(input())", "hi"), (2, "while True: pass", ""), (3, "raise SystemExit(3)", "")], "id int, program string, stdin string").coalesce(1)
    rows = {r["id"]: r for r in scorer.run_programs(df, allow_code=True, seconds=1.5).collect()}
    assert (rows[1]["exit_code"], rows[1]["stdout"]) == (0, "hi\n")
    assert rows[2]["exit_code"] is None and rows[3]["exit_code"] == 3
    assert re.match("", rows[3]["stderr"]) is not None
