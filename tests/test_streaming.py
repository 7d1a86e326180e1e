from pyspark.sql import functions as F

from millrace.streaming import streams, timed


def source(spark, df, path):
    df.write.parquet(path)
    return streams.read_stream(spark, path, df.schema)


def test_stream_counts_equal_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = streams.windowed(streams.first_of_id(source(spark, events, str(tmp_path / "e")), "event_id"), "1 day")
    out = streams.drained(stream, "tumbling", "complete").collect()
    assert {(r["start"], r["event_type"], r["n"]) for r in out} == {(r["start"], r["event_type"], r["n"]) for r in streams.windowed(events, "1 day").collect()}


def test_commits_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, t string")
    results = str(tmp_path / "results")
    commit = streams.commit_once(results, "id", lambda df: df.withColumn("n", F.length("t")))
    commit(rows, 0)
    commit(rows, 0)
    assert spark.read.parquet(results).count() == 2
    stream = source(spark, spark.createDataFrame([(2, "b"), (3, "c")], "id int, t string"), str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(commit).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(results).collect()) == [1, 2, 3]


def test_episode_states(spark, tmp_path):
    rows = spark.createDataFrame([("e", 1, "planning"), ("e", 2, "done"), ("e", 3, "testing"), ("e", 4, "done"), ("f", 1, "failed")], "episode_id string, seq int, to_state string")
    out = streams.drained(streams.episode_states(source(spark, rows, str(tmp_path / "s"))), "states", "update").collect()
    assert {(r["episode_id"], r["state"], r["taken"], r["refused"]) for r in out} == {("e", "done", 3, 1), ("f", "failed", 1, 0)}


def test_chunks_and_late(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a")], "k string, n int, c string")
    assert streams.joined_chunks(df, "k", "n", "c").first()["body"] == "ab"
    r = spark.createDataFrame([("e", 1), ("e", 5)], "episode_id string, history_position int")
    got = streams.late_responses(r, spark.createDataFrame([("e", 3)], "episode_id string, cursor int"))
    assert [x["is_target"] for x in got.orderBy("history_position").collect()] == [False, True]


def test_changed_positions(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "position int, digest string")
    b = spark.createDataFrame([(1, "x"), (2, "z")], "position int, digest string")
    assert [r["position"] for r in streams.changed_positions(a, b, "position", "digest").collect()] == [2]


def test_chunks_of_whole_days(spark):
    times = [f"2024-01-0{d} {h}:00:00" for d in (1, 2, 3) for h in ("00", "09", "23")]
    df = spark.createDataFrame([(t,) for t in times], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    days = [[r[0] for r in c.select(F.col("ts").cast("date").cast("string")).collect()] for c in timed.in_chunks(df, "ts", 4, "day")]
    assert sorted(sum(days, [])) == sorted(t[:10] for t in times)
    assert all(days[i].count(d) in (0, 3) for i in range(4) for d in set(days[i]))
