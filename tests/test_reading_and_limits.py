"""Line numbers and places in several files, limits on user code, rounding, nested redaction, times."""

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import text, times
from millrace.operators import duplicates, flags, lexical, neardup, scorer
from millrace.session import checkpoints, spread
from millrace.sources import readers, writers
from millrace.streaming import streams


def test_each_file_numbers_its_own_lines(spark, tmp_path):
    files = {f"f{i}.txt": [f"line {i} {n} é" * (1 + n % 3) if n % 4 else "" for n in range(3000 + i)] for i in range(3)}
    for name, rows in files.items():
        (tmp_path / name).write_text("\n".join(rows) + ("\n" if name != "f2.txt" else ""))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")  # several blocks a file
    try:
        got = {}
        for r in readers.lines(spark, str(tmp_path)).collect():
            got.setdefault(r["path"].rsplit("/", 1)[1], {})[r["line"]] = r["raw"]
        assert got == {n: {i: x for i, x in enumerate(rows) if x} for n, rows in files.items()}
        index = readers.whole_lines(spark, str(tmp_path))
        for r in index.collect():
            name = r["path"].rsplit("/", 1)[1]
            whole = (tmp_path / name).read_bytes()
            assert whole[r["at"] : r["at"] + r["size"]].decode() == r["raw"] == files[name][r["line"]]
        assert index.count() == 3000 + 3001 + 3001  # the last line of f2 has no end
        some = index.where("line % 500 = 7").select("path", "at", "size")
        assert {r["raw"] for r in readers.read_at(some).collect()} == {r["raw"] for r in index.where("line % 500 = 7").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "empty.txt").write_text("")
    assert readers.lines(spark, str(tmp_path / "none")).count() == readers.whole_lines(spark, str(tmp_path / "none")).count() == 0


def test_user_code_has_little_memory_and_little_output():
    r = scorer.run_isolated("print('begin' + 'x' * 10**6)", "", 30.0, most_output=1000)
    assert r.status == "ok" and len(r.stdout) == 1000 and r.stdout.startswith("begin") and r.stdout_truncated and not r.stderr_truncated
    r = scorer.run_isolated("x = bytearray(2 << 30)", "", 30.0)
    assert r.status == "error" and "MemoryError" in r.stderr
    r = scorer.run_isolated("import time; print(input(), flush=True); time.sleep(60)", "in", 2.0)
    assert r.status == "timeout" and r.code is None and r.stdout == "in\n"
    r = scorer.run_isolated("import sys; sys.stderr.write('e' * 9999); sys.exit(3)", "", 30.0, most_output=1000)
    assert r.status == "output_limit" and r.code == 3


def test_rounding_is_of_the_binary_value(spark):
    values = [2.675, 2.665, 0.125, 0.375, -2.675, 1e300, 1.005, float("inf"), None, 0.0]
    df = spark.createDataFrame([(v,) for v in values], "v double").select(text.rounded(F.col("v"), 2).alias("r"))
    assert [r["r"] for r in df.collect()] == [v if v is None or math.isinf(v) else round(v, 2) for v in values]


def test_nested_values_are_scrubbed_and_hidden(spark):
    df = spark.createDataFrame([({"a": ["key", None], "m": {"key": {"x": "a key", "y": 1}}},), (None,)], "v struct<a:array<string>,m:map<string,struct<x:string,y:int>>>")
    kind = df.schema["v"].dataType
    got = [r["v"] for r in df.select(text.scrubbed(F.col("v"), kind, "key", "").alias("v")).collect()]
    assert got[1] is None and got[0]["a"] == ["[REDACTED]", None] and got[0]["m"]["key"]["x"] == "a [REDACTED]"
    less = df.select(text.without_fields(F.col("v"), kind, ("a", "x")).alias("v")).first()["v"].asDict(recursive=True)
    assert less == {"m": {"key": {"y": 1}}}


def test_times(spark):
    df = spark.sql("select timestamp'2026-03-01 23:30:00.5' as a, timestamp'2026-03-02 00:00:00' as b")
    r = df.select(times.iso_in_zone(F.col("a"), "Asia/Shanghai").alias("x"), times.iso_in_zone(F.col("b"), "America/New_York").alias("y"), times.elapsed(F.col("a"), F.col("b")).alias("e"), times.elapsed(F.col("b"), F.col("a")).alias("z"), times.epoch_of(F.lit("1970-01-01T08:00:01.5+08:00")).alias("t"), times.epoch_of(F.lit("no")).alias("n")).first()
    assert tuple(r) == ("2026-03-02T07:30:00.500000+08:00", "2026-03-01T19:00:00-05:00", 1799.5, 0.0, 1.5, None)


def test_null_keys_are_no_duplicates(spark):
    df = spark.createDataFrame([("t", "a"), ("t", "a"), ("t", None), ("t", None), ("v", None)], "split string, k string")
    got = {r["split"]: r for r in duplicates.group_audit(df, F.col("k")).collect()}
    assert (got["t"]["duplicate_groups"], got["t"]["redundant_rows"]) == (1, 1) and "v" not in got
    assert [tuple(r) for r in duplicates.duplicate_groups(df.withColumn("n", F.lit(1)), F.col("k"), "n").collect()] == [("a", 2, 1)]
    hits, misses = duplicates.cached(spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string"), spark.createDataFrame([(1, "x", "r"), (2, None, "s"), (3, "y", "t")], "k int, v string, result string"), "k", ("v",))
    assert sorted((r["k"], r["result"]) for r in hits.collect()) == [(1, "r"), (2, "s")] and [r["k"] for r in misses.collect()] == [3]


def test_near_pairs_by_brute_force(spark):
    words = lambda *x: " ".join(f"w{i}" for i in x)
    rows = [(1, words(*range(40))), (2, words(*range(40)) + " more"), (3, words(*range(40)).upper()), (4, words(*range(100, 140))), (5, "few words"), (6, None), (7, words(*range(40)))]
    got = neardup.near_pairs(spark.createDataFrame(rows, "k int, t string"), "k", F.col("t")).collect()
    assert sorted((r["a"], r["b"], r["shared"], r["total"]) for r in got) == [(1, 2, 38, 39), (1, 3, 38, 38), (1, 7, 38, 38), (2, 3, 38, 39), (2, 7, 38, 39), (3, 7, 38, 38)]
    g = lexical.gram_sets(spark.createDataFrame([(1, "a b c d e f"), (2, "A b c D e"), (3, "a b"), (4, None)], "k int, t string"), "k", F.col("t"))
    assert g.groupBy("k").count().orderBy("k").collect()[0]["count"] == 2 and g.select("gram").distinct().count() == 2 and g.where("k > 2").count() == 0


def test_chemical_claims_and_long_messages(spark):
    m = [("c", [("user", "Write an article on a chemical company"), ("assistant", "Sure. " + "x" * 7000)]), ("d", [("user", "Tell me of a chemical company"), ("assistant", "12")])]
    df = spark.createDataFrame(m, "k string, messages array<struct<role:string,content:string>>")
    assert {r["k"]: r["x"] for r in df.select("k", flags.claims_on_chemistry(F.col("messages")).alias("x")).collect()} == {"c": True, "d": False}
    s = flags.message_segments(df, "k").collect()
    assert sorted((r["k"], r["message_index"], r["segment"], len(r["probe"])) for r in s) == [("c", 0, 0, 38), ("c", 1, 0, 4000), ("c", 1, 1, 4000), ("d", 0, 0, 29)]


def test_parts_of_small_tables_and_checkpoint_folders(spark, tmp_path):
    one, many = spark.range(100).coalesce(1), spark.range(100).repartition(3)
    assert spread(one).rdd.getNumPartitions() == 4 and sorted(r["id"] for r in spread(one).collect()) == list(range(100))
    assert spread(many).count() == 100

    class Elsewhere:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Elsewhere()
        conf = {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoints(Session())


def test_commits_read_their_own_parts_only(spark, tmp_path):
    results = str(tmp_path / "results")
    commit = streams.commit_once(results, "id", lambda df: df, parts=8)
    commit(spark.range(50), 0)
    commit(spark.range(40, 60), 1)
    assert sorted(r["id"] for r in spark.read.parquet(results).collect()) == list(range(60))


def test_prompt_tokens_are_the_library_s(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from millrace.functions import token_counts

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    chats = [[("system", "be kind"), ("user", "ä b  c\n")], [], [("user", None)], None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chats)], "k int, messages array<struct<role:string,content:string>>")
    got = df.select("k", token_counts.prompt_tokens(F.col("messages"), path).alias("a"), token_counts.prompt_tokens(F.col("messages"), path, thinking=False).alias("b")).orderBy("k").collect()
    for r, c in zip(got, chats, strict=True):
        if c is None:
            assert r["a"] is None
            continue
        said = "".join(f"<|im_start|>{role}\n{text or ''}<|im_end|>\n" for role, text in c) + "<|im_start|>assistant\n"
        assert (r["a"], r["b"]) == tuple(len(t.encode(said + more, add_special_tokens=False).ids) for more in ("", "<think>\n\n</think>\n\n"))


def test_one_place_by_many_names(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for a, b in (("t/x", "t"), ("t", "t/x"), (f"file:{tmp_path}/t", "./t/../t/"), (f"file://{tmp_path}/t/y", "t"), ("s3a://Bucket/a/./b", "s3a://bucket/a/b/c"), ("/", "t")):
        with pytest.raises(ValueError, match="overwrite"):
            writers.guard(a, b)
    for a, b in (("t", "tt"), ("hdfs://h/t", "file:///t"), ("s3a://one/t", "s3a://two/t"), (f"{tmp_path}/a", "b")):
        writers.guard(a, b)


def test_a_replacement_is_worked_out_once(spark, tmp_path):
    path, seen = str(tmp_path / "t"), spark.sparkContext.accumulator(0)
    spark.range(100).selectExpr("id", "cast(id as string) as t").repartition(3).write.parquet(path)

    @F.udf("boolean")
    def even(x):
        seen.add(1)
        return x % 2 == 0

    report = writers.clean_and_replace(spark, path, lambda df: df.where(even("id")), apply=True)
    assert (report["before"], report["after"], report["applied"], seen.value) == (100, 50, True, 100)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(0, 100, 2))


def test_messages_in_nfc(spark):
    import unicodedata

    from millrace.functions import identity

    chats = [[("user", "é ̸\"\\ \n"), ("assistant", None)], [(None, "가̸")], [], None, [("user", "plain")]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(chats)], "k int, m array<struct<role:string,content:string>>")
    got = [r["m"] for r in df.orderBy("k").select(identity.nfc_messages(F.col("m")).alias("m")).collect()]
    want = [None if c is None else [(r, None if t is None else unicodedata.normalize("NFC", t)) for r, t in c] for c in chats]
    assert [None if g is None else [tuple(m) for m in g] for g in got] == want


def test_signs_that_nfc_may_change_go_to_python(spark):
    """No sign that stays in the JVM is changed by NFC, has a combining class or ends a composition."""
    import re
    import unicodedata

    from millrace.functions import text

    stays = re.compile(f"[{text.COMPOSED}]")
    ends = {chr(int(d.split()[1], 16)) for c in range(0x110000) if len((d := unicodedata.decomposition(chr(c))).split()) == 2 and not d.startswith("<")}
    ends |= {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]):
        if stays.match(c):
            assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c) and c not in ends, hex(ord(c))
    rows = ["plain", "für", "für", None, "", "Å", "한", "が", "𝅗𝅥"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "k int, t string")
    assert {r["k"]: r["n"] for r in df.select("k", text.nfc(F.col("t")).alias("n")).collect()} == {i: x if x is None else unicodedata.normalize("NFC", x) for i, x in enumerate(rows)}


def test_parts_grow_with_the_rows(spark, monkeypatch):
    from millrace import session

    monkeypatch.setattr(session, "PART_ROWS", 10)
    a = spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    rows, conflicts = duplicates.consistent_union(a, a.withColumn("v", F.when(F.col("k") < 3, "y").otherwise("x")), "k")
    assert rows.rdd.getNumPartitions() == 40 and rows.count() == 200
    assert sorted((r["k"], r["versions"]) for r in conflicts.collect()) == [(0, 2), (1, 2), (2, 2)]
