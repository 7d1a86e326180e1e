"""No conversation gets lost: texts longer than a JSON reader takes by itself, and unknown layouts."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.llm import chat, queries

LONG = 21_000_000


@pytest.mark.parametrize("conv", [4, 1, 2, 3], ids=["rows", "messages", "speakers", "pair"])
def test_texts_of_21_million_characters(spark, conv):
    """In each layout of the query."""
    turns = spark.createDataFrame([(conv, 0, "user", "q"), (conv, 1, "assistant", "x")], "conv_id long, turn long, role string, text string")
    turns = turns.withColumn("text", F.when(F.col("turn") == 1, F.repeat("text", F.lit(LONG))).otherwise(F.col("text")))
    plain, records = queries.in_layouts(turns)
    told = chat.rows_of(chat.canonical(records, "conv_id", json="record"), "conv_id")
    got = chat.digests(chat.format_rows(chat.turn_rows(plain, strict=False).unionByName(told))).collect()
    assert [(r["conv_id"], r["n_turns"], r["loss_chars"]) for r in got] == [(conv, 2, LONG)]
    assert got[0]["turns_sha256"] == hashlib.sha256(b"user\nq\nassistant\n" + b"x" * LONG + b"\n").hexdigest()
    assert got[0]["loss_sha256"] == hashlib.sha256(b"x" * LONG).hexdigest()


def test_unknown_layouts_stay_as_rows(spark):
    df = spark.createDataFrame([(1, '{"prompt":"q","response":"a"}'), (2, '{"what":"else"}'), (3, "no JSON"), (4, None), (5, '{"messages":[]}')], "k int, j string")
    got = sorted((r["k"], r["turn"], r["role"]) for r in chat.rows_of(chat.canonical(df, "k", json="j"), "k").na.fill(-1).na.fill("?").collect())
    assert got == [(1, 0, "user"), (1, 1, "assistant"), (2, -1, "?"), (3, -1, "?"), (4, -1, "?")]
