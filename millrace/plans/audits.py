"""Queries over what reads and writes files, labels, exports, streams and runs code: their inputs
are made of the test tables, written where they have to be, and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import duplicates, flags, graph, lexical, rollouts, scorer, scoring, selection, trace
from ..session import dealt, kept, put_text, scratch, spread, table
from ..sources import readers, writers
from ..streaming import streams
from .catalogue import CHAT_SQL, NORM, SEED, WS, chats, docs, draw, query

CANONICAL = f"""trim(regexp_replace(regexp_replace(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '(?m){WS.replace(chr(92) + 's', ' ' + chr(92) + 't')}+$', '', 'g'), chr(10) || ' ')"""


def nations(spark: SparkSession, d: str) -> list:
    """The 25 nations, for small files that the driver writes."""
    return table(spark, d, "nation").orderBy("n_nationkey").collect()


# Sources and sinks


@query("""WITH n AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS line, item_id % 7 AS k, text FROM benchmark)
  SELECT line, CASE k WHEN 1 THEN 'invalid_json' WHEN 2 THEN 'missing_field' WHEN 3 THEN 'duplicate_id' WHEN 4 THEN 'unknown_field' WHEN 5 THEN 'not_an_object' END AS error, CASE WHEN k IN (0, 6) THEN text END AS text FROM n""")
def strict_lines(spark, d):
    k = F.col("item_id") % 7
    record = F.to_json(F.struct(F.col("item_id").cast("string").alias("item_id"), "text"))
    more = F.to_json(F.struct(F.col("item_id").cast("string").alias("item_id"), "text", F.lit(1).alias("more")))
    raw = F.when(k == 1, "{oops").when(k == 2, '{"text":"x"}').when(k == 3, '{"item_id":"0","text":"x"}').when(k == 4, more).when(k == 5, "[1]").otherwise(record)
    path = f"{scratch(spark)}/lines"
    table(spark, d, "benchmark").repartition(1).sortWithinPartitions("item_id").select(raw.alias("value")).write.text(path)
    got = readers.strict_records(readers.lines(spark, path), "item_id string, text string", "item_id", ("text",))
    return got.select("line", "error", "record.text")


@query("""WITH n AS (SELECT n_nationkey AS k FROM nation) SELECT CAST(k AS BIGINT) AS line, CASE k % 10 WHEN 3 THEN 'corrupt_line' WHEN 4 THEN 'repeated_event' WHEN 5 THEN 'seq_not_rising' END AS fault,
  CASE WHEN k % 10 NOT IN (3, 4, 5) THEN 'e' || k END AS event_id FROM n""")
def journal_faults(spark, d):
    lines = []
    for k in (r["n_nationkey"] for r in nations(spark, d)):
        event = {"event_id": f"e{k - 3 if k % 10 == 4 else k}", "seq": 0 if k % 10 == 5 else k + 1, "type": "t", "episode_id": "x", "payload": "{}"}
        lines.append("{oops" if k % 10 == 3 else json.dumps(event))
    path = f"{scratch(spark)}/trace.jsonl"
    put_text(spark, path, "\n".join(lines) + '\n{"event_id": "torn')
    events, faults = readers.journal(spark, path)
    return events.select("line", F.lit(None).cast("string").alias("fault"), "event_id").unionByName(faults.select("line", "fault", F.lit(None).cast("string").alias("event_id")))


@query("SELECT n_regionkey::VARCHAR AS job_key, max(n_nationkey) AS n FROM nation WHERE n_nationkey < (SELECT max(n_nationkey) FROM nation) GROUP BY 1")
def committed_records(spark, d):
    path = f"{scratch(spark)}/results.jsonl"
    put_text(spark, path, "\n".join(json.dumps({"job_key": str(r["n_regionkey"]), "n": r["n_nationkey"]}) for r in nations(spark, d)))
    return readers.committed(spark, path, "job_key string, n int", "job_key")


@query("""WITH r AS (SELECT item_id, replace(text, chr(10), ' ') AS raw FROM benchmark), s AS (SELECT row_number() OVER w - 1 AS line, octet_length(encode(raw)) AS size, item_id FROM r WINDOW w AS (ORDER BY item_id))
  SELECT line, CAST(coalesce(sum(size + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at, CAST(size AS BIGINT) AS size, true AS same FROM s""")
def line_offsets(spark, d):
    path = f"{scratch(spark)}/lines"
    table(spark, d, "benchmark").repartition(1).sortWithinPartitions("item_id").select(F.replace("text", F.lit("\n"), F.lit(" ")).alias("value")).write.text(path)
    index = kept(readers.whole_lines(spark, path))
    back = readers.read_at(index).select("path", "at", F.col("raw").alias("read"))
    return index.join(back, ["path", "at"], "left").select("line", "at", "size", F.coalesce(F.col("read") == F.col("raw"), F.lit(False)).alias("same"))


@query("SELECT sha256(r_name) AS digest, 'stored' AS state FROM region UNION ALL SELECT DISTINCT sha256(n_name), 'missing' FROM nation")
def blob_store(spark, d):
    path = f"{scratch(spark)}/blobs"
    names = table(spark, d, "region").select(F.col("r_name").cast("binary").alias("bytes"))
    writers.put_blobs(names, path)
    stored = writers.put_blobs(names, path)
    told = F.concat(F.lit("sha256:"), F.sha2("n_name", 256), F.lit(" sha256:"), F.sha2("r_name", 256))
    events = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(told.alias("payload"))
    return stored.select("digest", F.lit("stored").alias("state")).unionByName(readers.missing_blobs(events, stored).select("digest", F.lit("missing").alias("state")))


@query("SELECT n_regionkey::VARCHAR AS rollout_id, n_nationkey AS attempt, n_name AS status, 'rollout_run' AS kind FROM nation")
def attempts_read(spark, d):
    top = scratch(spark)
    for name, kind in (("a", "rollout_run"), ("b", "other")):
        put_text(spark, f"{top}/{name}/manifest.json", json.dumps({"kind": kind, "run_id": name, "created_at": "2026-01-01"}))
    for r in nations(spark, d):
        put_text(spark, f"{top}/a/calls/{r['n_regionkey']}/{r['n_nationkey']}/result.json", json.dumps({"status": r["n_name"]}))
    run = readers.runs(spark, f"{top}/*/manifest.json").first()
    return readers.attempt_results(spark, run["run"], "status string").select("rollout_id", "attempt", "status", F.lit(run["kind"]).alias("kind"))


@query("SELECT CASE WHEN p_size > 25 THEN 'train' ELSE 'test' END AS split, 'part' AS source, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS keys FROM part GROUP BY ALL")
def registry_rows(spark, d):
    top, p = scratch(spark), table(spark, d, "part").select("p_partkey", "p_size", "p_name")
    p.where("p_size > 25").write.parquet(f"{top}/train")
    p.where("p_size <= 25").write.option("compression", "gzip").json(f"{top}/test")
    r = readers.Registry([readers.Source("part", "train", f"{top}/train", "parquet", ("p_partkey", "p_name")), readers.Source("part", "test", f"{top}/test", "json", ("p_partkey", "p_name"))])
    return r.rows(spark, "part").groupBy("split", "source").agg(F.count("*").alias("n"), F.sum("p_partkey").alias("keys"))


@query("SELECT p_partkey FROM part WHERE p_size > 25 AND p_type = 'ECONOMY'")
def parts_by_skill(spark, d):
    listed = F.when(F.col("p_size") > 25, F.concat(F.lit("['"), "p_type", F.lit("', \"Sorting\"]"))).otherwise("[]")
    return readers.by_difficulty_or_skills(table(spark, d, "part").withColumn("skill_types", listed), skills=("ECONOMY",)).select("p_partkey")


@query("SELECT o_orderstatus, 'new' AS place, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 UNION ALL SELECT o_orderstatus, 'backup', count(*) FROM orders GROUP BY 1")
def replaced_table(spark, d):
    path, o = f"{scratch(spark)}/orders", table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    writers.replace_whole(o.where("o_orderstatus = 'F'"), path)
    writers.replace_whole(o.where("o_orderstatus <> 'P'"), path)
    writers.append(o.where("o_orderstatus = 'P'"), path)
    report = writers.clean_and_replace(spark, path, lambda df: df.where("o_orderstatus <> 'F'"), apply=True)
    new, old = (spark.read.parquet(p).select("o_orderstatus", F.lit(n).alias("place")) for p, n in ((path, "new"), (report["backup"], "backup")))
    return new.unionByName(old).groupBy("o_orderstatus", "place").agg(F.count("*").alias("n"))


@query("SELECT 'customers' AS name, count(*) AS rows, true AS same, true AS kept FROM customer UNION ALL SELECT 'suppliers', count(*), true, true FROM supplier")
def exported_tables(spark, d):
    top = scratch(spark)
    tables = {"customers": table(spark, d, "customer").select("c_custkey", "c_name"), "suppliers": table(spark, d, "supplier").select("s_suppkey", "s_name")}
    report = writers.export(tables, top)
    found = []
    for name, df in tables.items():
        back = spark.read.schema(df.schema).json(f"{top}/{name}.json")
        found.append((name, report["files"][f"{name}.json"]["rows"], writers.table_digest(back).first()["digest"] == report["files"][f"{name}.parquet"]["digest"], writers.same_rows(back, spark.read.parquet(f"{top}/{name}.parquet"))))
    return spark.createDataFrame(found, "name string, rows long, same boolean, kept boolean")


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1")
def resumed_rows(spark, d):
    o = readers.snapshot(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), f"{scratch(spark)}/orders")
    return readers.resume_after(o, o.where("o_orderkey % 3 = 0"), "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


# Selection


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, role, {CANONICAL} AS canon, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n FROM conversations),
  t AS (SELECT conv_id, arg_min(role, back) AS last FROM c GROUP BY conv_id),
  m AS (SELECT conv_id, arg_min(role, back) AS last, arg_min(text, back) AS said, bool_or(text IS NULL OR role NOT IN ('system', 'user', 'assistant')) AS odd,
    string_agg('{{"content":' || to_json(canon)::VARCHAR || ',"role":"' || role || '"}}', ',' ORDER BY n) FILTER (role <> 'assistant') AS told FROM c WHERE back > 1 GROUP BY conv_id),
  e AS (SELECT t.conv_id, told, CASE WHEN t.last <> 'assistant' THEN 'no_final_demonstration' WHEN m.last IS DISTINCT FROM 'user' THEN 'not_ending_in_user' WHEN odd THEN 'unsupported_message' WHEN trim(regexp_replace(said, '{WS}+', ' ', 'g')) = '' THEN 'empty_final_user' END AS error FROM t LEFT JOIN m USING (conv_id))
  SELECT 'helpsteer2' AS source, doc_id AS id, 'general' AS stratum, CASE WHEN trim(regexp_replace(text, '{WS}+', ' ', 'g')) = '' THEN 'empty_final_user' END AS error,
    CASE WHEN trim(regexp_replace(text, '{WS}+', ' ', 'g')) <> '' THEN sha256('[{{"content":' || to_json({CANONICAL})::VARCHAR || ',"role":"user"}}]') END AS gid FROM documents
  UNION ALL SELECT 'no_robots', conv_id, 'c' || (conv_id % 3), error, CASE WHEN error IS NULL THEN sha256('[' || told || ']') END FROM e""")
def normalised_rows(spark, d):
    a = selection.normalised(docs(spark, d).withColumnRenamed("text", "prompt"), "helpsteer2", ["doc_id"]).withColumnRenamed("doc_id", "id")
    c = chats(spark, d).withColumn("category", F.concat(F.lit("c"), F.col("conv_id") % 3)).withColumn("prompt_id", F.col("conv_id").cast("string"))
    b = selection.normalised(c, "no_robots", ["conv_id"]).withColumnRenamed("conv_id", "id")
    return a.unionByName(b).select("source", "id", "stratum", "error", "gid")


@query(f"""WITH p AS (SELECT d.doc_id, source, row_number() OVER (ORDER BY d.doc_id) AS position, quality, toxic, text FROM documents d LEFT JOIN labels USING (doc_id)),
  k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY position) AS place FROM p WHERE quality = 1),
  c AS (SELECT *, row_number() OVER (ORDER BY {draw('export', 'doc_id')}) AS n FROM k WHERE place <= CASE source WHEN 'src0' THEN 3 WHEN 'src1' THEN 2 WHEN 'src2' THEN 5 END)
  SELECT doc_id::VARCHAR AS sample_id, source AS data_source, sha256('[{{"content":' || to_json(text)::VARCHAR || ',"role":"user"}}]') AS prompt_sha256, CAST(1 + doc_id % 2 AS INTEGER) AS records, CAST(n AS INTEGER) AS place, true AS well FROM c""")
def labelled_export(spark, d):
    t = docs(spark, d)
    pool = t.select(F.col("doc_id").cast("string").alias("gid"), "source", selection.user(F.col("text")).alias("messages"), F.lit("pending").alias("disposition"), F.col("doc_id").alias("pool_position"))
    labels = table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("gid"), F.when(F.col("quality") == 1, "include").otherwise("exclude").alias("decision"))
    pool = selection.apply_labels(pool, labels)
    copies = t.withColumn("row", F.explode(F.sequence(F.lit(0), (F.col("doc_id") % 2).cast("int"))))
    members = copies.select(F.col("doc_id").cast("string").alias("gid"), "source", F.lit("p").alias("path"), "row", F.lit("train").alias("split"), F.lit("o").alias("original_id"))
    rows = kept(selection.export_rows(pool, members, SEED, {"src0": 3, "src1": 2, "src2": 5}))
    checks = selection.export_checks(rows, t.where("doc_id < 0").select(F.col("doc_id").cast("string").alias("gid")))
    well = checks.select(F.forall(F.array(*checks.columns), lambda x: x).alias("well"))
    place = F.row_number().over(Window.orderBy(F.sha2(F.concat(F.lit(f'[{SEED},"export","'), "sample_id", F.lit('"]')), 256)))
    return rows.select("sample_id", "data_source", "prompt_sha256", F.size("source_records").alias("records"), place.alias("place")).join(well, F.lit(True))


@query("SELECT count(*) AS dispatched, count(*) FILTER (event_id % 4 = 0) AS unknown_usage, CAST(sum(user_id) FILTER (event_id % 4 <> 0) AS BIGINT) AS prompt_tokens, CAST(sum(event_id) FILTER (event_id % 4 <> 0) AS BIGINT) AS completion_tokens FROM events")
def label_call_usage(spark, d):
    usage = F.struct(F.when(F.col("event_id") % 4 != 0, F.struct(F.col("user_id").alias("prompt_tokens"), F.col("event_id").alias("completion_tokens"))).alias("usage"))
    return selection.label_usage(table(spark, d, "events").select(F.to_json(usage).alias("response")))


DECISION_SQL = """l AS (SELECT doc_id, quality = 1 AS inc, toxic = 1 AS toxic FROM labels)"""


@query(f"""WITH {DECISION_SQL} SELECT doc_id, concat_ws(',', CASE WHEN toxic THEN 'blank_dimension' END, CASE WHEN inc AND (doc_id % 3 = 0 OR doc_id % 7 = 0) THEN 'include_with_exclusion_or_without_dimensions' END,
  CASE WHEN inc AND (doc_id % 5 = 0 OR doc_id % 4 = 0) THEN 'include_of_incomplete_or_trivial_task' END, CASE WHEN inc AND doc_id % 6 = 0 THEN 'include_over_output_budget' END, CASE WHEN NOT inc AND doc_id % 3 <> 0 THEN 'exclude_without_code' END) AS errors FROM l""")
def label_contradictions(spark, d):
    k = F.col("doc_id")
    dims = F.when(F.col("toxic") == 1, F.array(F.lit(" "), F.lit("a"))).when(k % 7 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a")))
    dims = F.when((k % 7 == 0) & (F.col("toxic") == 1), F.array(F.lit(" "))).otherwise(dims)
    e = flags.label_errors(
        F.when(F.col("quality") == 1, "include").otherwise("exclude"), F.when(k % 4 == 0, "trivial").otherwise("nontrivial"), F.when(k % 5 == 0, "partial").otherwise("complete"),
        F.when((k % 7 == 0) & (F.col("toxic") != 1), F.array().cast("array<string>")).otherwise(dims), F.when(k % 6 == 0, "explicitly_over_8000").otherwise("fits"),
        F.when((k % 3 == 0) | ((k % 7 == 0) & (F.col("quality") == 1)), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")),
    )
    return table(spark, d, "labels").select("doc_id", F.array_join(e, ",").alias("errors"))


@query("SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE n_chars % 2 = 1 AND quality IS NULL")
def review_queue(spark, d):
    c = docs(spark, d).select("doc_id", F.when(F.col("n_chars") % 2 == 1, F.array(F.lit("look"))).otherwise(F.array().cast("array<string>")).alias("review_flags"))
    return flags.review_queue(c, table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("accepted")), "doc_id").select("doc_id")


@query("""WITH s AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'pending' WHEN 1 THEN 'retryable' WHEN 2 THEN 'uncertain' WHEN 3 THEN 'failed' WHEN 4 THEN 'success' ELSE 'empty' END AS status, o_orderkey % 4 AS attempts FROM orders)
  SELECT o_orderkey, status IN ('pending', 'retryable') AND attempts < 3 AS plain, status IN ('pending', 'retryable', 'uncertain') AND attempts < 3 AS unsure, status <> 'success' AND attempts < 2 AS every FROM s""")
def retryable_tasks(spark, d):
    names = ("pending", "retryable", "uncertain", "failed", "success", "empty")
    s, n = F.element_at(F.array(*map(F.lit, names)), (F.col("o_orderkey") % 6 + 1).cast("int")), F.col("o_orderkey") % 4
    return table(spark, d, "orders").select("o_orderkey", flags.may_retry(s, n, 3).alias("plain"), flags.may_retry(s, n, 3, uncertain=True).alias("unsure"), flags.may_retry(s, n, 2, uncertain=True, failed=True).alias("every"))


# Rules and candidates


def shaped(spark, d):
    """Documents as rows of the sources that the cleaning rules know."""
    k = F.col("doc_id")
    source = F.element_at(F.array(*map(F.lit, ("tulu3-sft-reused-on-policy-8b", "pubmed-summarization", "allenai-WildChat-1M-multiturn", "english-french-translation-en-fr"))), (k % 4 + 1).cast("int"))
    said = F.when(k % 8 == 1, "  ").when(k % 8 == 5, F.lit(flags.PUBLISHER_BOILERPLATE.replace(" , ", "  , \n"))).when(k % 8 == 2, " \t").otherwise(F.col("text"))
    return docs(spark, d).select("doc_id", source.alias("source"), said.alias("said"), "text")


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'remove_tulu_subset' WHEN doc_id % 8 = 1 THEN 'pubmed_empty_article' WHEN doc_id % 8 = 5 THEN 'pubmed_publisher_boilerplate_only' WHEN doc_id % 8 = 2 THEN 'wildchat_empty_last_user_message' ELSE '' END AS reasons FROM documents""")
def removal_rows(spark, d):
    t = shaped(spark, d)
    return t.select("doc_id", F.array_join(flags.removal_reasons(F.col("source"), F.col("said"), selection.user(F.col("said"))), ",").alias("reasons"))


@query("""SELECT doc_id, sha256(CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN text WHEN 3 THEN 'user: ' || text ELSE 'no template' END) AS body FROM documents""")
def task_bodies(spark, d):
    k = F.col("doc_id") % 5
    question = (
        F.when(k == 0, F.concat(F.lit("Start your translation task now. [English Input]\n"), "text", F.lit("\n[French Output]"))).when(k == 1, F.concat(F.lit("x Start your summarization task now. [Article Input]\n"), "text", F.lit("\n[Abstract Output]")))
        .when(k == 2, F.concat(F.lit("title\n\n"), "text")).when(k == 4, F.lit("no template")).otherwise(F.col("text"))
    )
    source = F.when((k == 0) | (k == 4), "english-french-translation-en-fr").when(k == 1, "pubmed-summarization").when(k == 2, "essay_x").otherwise("other")
    return docs(spark, d).select("doc_id", F.sha2(flags.body(source, question, selection.user(F.col("text"))), 256).alias("body"))


@query(f"""WITH {CHAT_SQL}, x AS (SELECT conv_id, roles, list_transform(list_zip(texts, range(1, len(texts) + 1)), lambda p: CASE WHEN (conv_id + p[2]) % 9 = 0 THEN NULL WHEN (conv_id + p[2]) % 9 = 1 THEN ' ' WHEN (conv_id + p[2]) % 9 = 2 THEN 'short' ELSE p[1] END) AS texts FROM t),
  s AS (SELECT *, roles[-1] = 'assistant' AS ends, list_zip(roles, texts) AS m FROM x), p AS (SELECT *, CASE WHEN ends THEN m[:len(m) - 1] ELSE m END AS prompt FROM s),
  u AS (SELECT *, list_filter(prompt, lambda y: y[1] = 'user') AS users, CASE WHEN ends THEN coalesce(texts[-1], '') ELSE '' END AS answer FROM p), l AS (SELECT *, coalesce(users[-1][2], '') AS last FROM u)
  SELECT conv_id, concat_ws(',', CASE WHEN NOT ends THEN 'not_ending_assistant' END, CASE WHEN len(users) = 0 THEN 'no_user_message' END, CASE WHEN trim(last) = '' THEN 'empty_last_user' END, CASE WHEN trim(answer) = '' THEN 'empty_or_invalid_final_answer' END,
    CASE WHEN len(list_filter(texts, lambda y: y IS NULL)) > 0 THEN 'non_string_message_content' END, CASE WHEN len(list_filter(m, lambda y: y[1] = 'system' AND trim(y[2]) = '')) > 0 THEN 'empty_system_placeholder' END,
    CASE WHEN len(list_filter(prompt, lambda y: y[1] IN ('user', 'assistant') AND trim(y[2]) = '')) > 0 THEN 'empty_history_or_current_message' END, CASE WHEN length(trim(answer)) < 20 THEN 'short_answer_under_20_chars_review_only' END,
    CASE WHEN trim(answer) <> '' AND trim(regexp_replace(answer, '{WS}+', ' ', 'g')) = trim(regexp_replace(last, '{WS}+', ' ', 'g')) THEN 'answer_copies_last_user_review_only' END,
    CASE WHEN conv_id % 3 = 0 THEN 'final_assistant_has_separate_reasoning' END, CASE WHEN conv_id % 4 = 0 THEN 'missing_uuid' END, CASE WHEN conv_id % 5 = 0 THEN 'exact_prompt_overlap_existing_cleaned_data' END) AS flags FROM l""")
def soft_chat_flags(spark, d):
    k = F.col("conv_id")
    said = lambda m, i: F.when((k + i + 1) % 9 == 0, F.lit(None)).when((k + i + 1) % 9 == 1, " ").when((k + i + 1) % 9 == 2, "short").otherwise(m["content"])
    m = F.transform("messages", lambda m, i: F.struct(m["role"].alias("role"), said(m, i).alias("content")))
    f = flags.structure_flags(F.col("m"), F.when(k % 3 == 0, "why").otherwise(""), F.when(k % 4 == 0, "").otherwise("u"), k % 5 == 0)
    return chats(spark, d).withColumn("m", m).select("conv_id", F.array_join(f, ",").alias("flags"))


MASKED = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '```.*?```', ' ', 'gs'), '`[^`\n]+`', ' ', 'g'), 'https?://\S+', ' ', 'g'), '\\\[.*?\\\]|\$\$.*?\$\$', ' ', 'gs'))"


@query(f"""SELECT doc_id, sha256({MASKED}) AS masked, length({MASKED}) AS chars FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text || ' `code` and ```' || chr(10) || text || '``` end' WHEN 1 THEN 'see https://a.b/c?d#e ' || text WHEN 2 THEN text || ' $$x' || chr(10) || 'y$$ \\[ z \\] ' ELSE text END AS text FROM documents)""")
def masked_texts(spark, d):
    k = F.col("doc_id") % 4
    t = F.when(k == 0, F.concat("text", F.lit(" `code` and ```\n"), "text", F.lit("``` end"))).when(k == 1, F.concat(F.lit("see https://a.b/c?d#e "), "text")).when(k == 2, F.concat("text", F.lit(" $$x\ny$$ \\[ z \\] "))).otherwise(F.col("text"))
    m = text.masked_for_language(F.col("t"))
    return spread(docs(spark, d)).withColumn("t", t).select("doc_id", F.sha2(m, 256).alias("masked"), F.length(m).cast("long").alias("chars"))


@query("""SELECT item_id, k, v IN ('12', ' - ', 'B', '#### 1,000.5 %') AS neutral FROM (SELECT item_id, unnest(range(6)) AS k FROM benchmark) JOIN (VALUES (0, '12'), (1, ' - '), (2, 'B'), (3, '#### 1,000.5 %'), (4, 'word'), (5, '')) v(j, v) ON j = k""")
def neutral_texts(spark, d):
    said = F.array(*map(F.lit, ("12", " - ", "B", "#### 1,000.5 %", "word", "")))
    b = table(spark, d, "benchmark").select("item_id", F.posexplode(said).alias("k", "t"))
    return b.select("item_id", F.col("k").cast("long").alias("k"), text.is_neutral(F.col("t")).alias("neutral"))


@query(f"""WITH c AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations),
  s AS (SELECT conv_id, i, {MASKED} AS t, regexp_matches(text, '```|\\b(?:translate|translation|code|json|sql)\\b|(?m:^\\s*(?:def |class |import |public |#include|function |\\{{|\\[))|;\\s*$', 'i') AS code FROM c WHERE trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g')) <> ''),
  p AS (SELECT conv_id, i, code, least(length(t), 4000) AS n FROM s WHERE t <> '' UNION ALL SELECT conv_id, i, code, 4000 FROM s WHERE length(t) > 6000),
  g AS (SELECT conv_id, conv_id % 3 = 0 AND n >= 100 AND NOT code AND i % 2 = 0 AS sure, conv_id % 3 = 0 OR i % 2 = 1 AS doubt FROM p WHERE NOT (conv_id % 3 = 0 AND i % 4 = 3)),
  w AS (SELECT conv_id, bool_or(sure) AS sure, bool_or(doubt AND NOT sure) AS doubt FROM g GROUP BY conv_id),
  m AS (SELECT conv_id, arg_min(text, back) AS answer, list(role ORDER BY i) FILTER (role <> 'system') AS roles, count(*) FILTER (role = 'user') AS users, bool_or(role <> 'system' AND trim(text) = '') AS blank, bool_or(text IS NULL) AS odd FROM c GROUP BY conv_id)
  SELECT m.conv_id, concat_ws(',', CASE WHEN sure THEN 'confident_non_english_message' END, CASE WHEN blank THEN 'empty_user_or_assistant' END, CASE WHEN roles <> flatten(list_transform(range(users), lambda x: ['user', 'assistant'])) THEN 'invalid_role_sequence' END,
    CASE WHEN conv_id % 7 = 0 THEN 'invalid_structure' END, CASE WHEN odd THEN 'non_string_content' END, CASE WHEN conv_id % 5 = 0 THEN 'wrong_reasoning_mode' END) AS reasons,
    concat_ws(',', CASE WHEN conv_id % 4 = 0 THEN 'answer_copies_last_user_review_only' END, CASE WHEN doubt THEN 'language_needs_review' END, CASE WHEN (length(answer) - length(replace(answer, '```', ''))) // 3 % 2 = 1 THEN 'unbalanced_code_fence_needs_review' END) AS flags
  FROM m LEFT JOIN w USING (conv_id)""")
def candidate_inspection(spark, d):
    k = F.col("conv_id")
    carried = F.when(k % 4 == 0, F.array(F.lit("answer_copies_last_user_review_only"), F.lit("missing_uuid"))).otherwise(F.array().cast("array<string>"))
    c = chats(spark, d).select("conv_id", "messages", carried.alias("flags"), F.when(k % 5 == 0, "on").otherwise("off").alias("reasoning"), (k % 7 != 0).alias("structurally_valid"))
    c = c.withColumn("user_turns", F.size(F.filter("messages", lambda m: m["role"] == "user")))
    i = F.col("message_index")
    told = flags.message_segments(c, "conv_id").withColumn("hint", F.when(k % 3 == 0, "de").otherwise("en")).withColumn("score", F.when(i % 2 == 0, 0.995).otherwise(0.85))
    told = told.withColumn("folded_hint", F.when(i % 4 == 3, "en").otherwise("de")).withColumn("folded_score", F.when(i % 4 == 3, 0.96).otherwise(0.5))
    r = flags.inspected(c, told, "conv_id")
    return r.select("conv_id", F.array_join("auto_reject_reasons", ",").alias("reasons"), F.array_join("review_flags", ",").alias("flags"))


# Copies, caches and neighbours


KEYS_SQL = f"""r AS (SELECT doc_id, lang AS split, CASE doc_id % 5 WHEN 0 THEN 'x-en-fr' WHEN 1 THEN 'x-fr-en' WHEN 2 THEN 'essay_abs2text' WHEN 3 THEN 'essay_infilling' ELSE 'wild' END AS source, {NORM} AS n, text,
    trim(regexp_replace(nfc_normalize(regexp_extract(text, '^[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]*')), '{WS}+', ' ', 'g')) AS title FROM documents),
  k AS (SELECT 'prompt_exact' AS name, split, text AS k FROM r UNION ALL SELECT 'prompt_normalized', split, n FROM r UNION ALL SELECT 'question_normalized_nonempty', split, CASE WHEN doc_id % 2 = 0 AND n <> '' THEN n END FROM r
    UNION ALL SELECT 'answer_normalized', split, CASE WHEN doc_id % 2 = 0 THEN n ELSE 'reply' END FROM r UNION ALL SELECT 'sample_without_split_or_function', split, source || '/' || (doc_id % 2) || text FROM r
    UNION ALL SELECT 'wildchat_first_user_message', split, CASE WHEN doc_id % 5 = 4 AND text <> '' THEN n END FROM r
    UNION ALL SELECT 'translation_pair_direction_invariant', split, CASE doc_id % 5 WHEN 0 THEN n || chr(0) || CASE WHEN doc_id % 2 = 0 THEN n ELSE 'reply' END WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN n ELSE 'reply' END || chr(0) || n END FROM r
    UNION ALL SELECT 'essay_title_candidate', split, CASE doc_id % 5 WHEN 2 THEN CASE WHEN doc_id % 2 = 0 THEN title ELSE 'reply' END WHEN 3 THEN title END FROM r),
  p AS (SELECT name, k, split, count(*) AS n FROM k WHERE k IS NOT NULL GROUP BY ALL), s AS (SELECT *, count(*) OVER (PARTITION BY name, k) AS splits FROM p)"""


@query(f"""WITH {KEYS_SQL} SELECT name, split, count(*) FILTER (n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_duplicate_groups, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS redundant_rows,
  count(*) FILTER (splits > 1) AS shared_keys, CAST(coalesce(sum(n) FILTER (splits > 1), 0) AS BIGINT) AS shared_rows FROM s GROUP BY name, split""")
def sample_key_audit(spark, d):
    k = F.col("doc_id")
    source = F.element_at(F.array(*map(F.lit, ("x-en-fr", "x-fr-en", "essay_abs2text", "essay_infilling", "wild"))), (k % 5 + 1).cast("int"))
    truth = F.when(k % 2 == 0, F.col("text")).otherwise("reply")
    ability = F.when(k % 5 < 2, "translation").when(k % 5 == 4, "multi-turn").otherwise("writing")
    rows = spread(docs(spark, d)).select(F.col("lang").alias("split"), source.alias("data_source"), ability.alias("ability"), selection.user(F.col("text")).alias("prompt"), F.struct(truth.alias("ground_truth")).alias("reward_model"), F.struct(F.when(k % 2 == 0, F.col("text")).alias("question")).alias("extra_info"), F.col("text").alias("body"))
    keys = duplicates.sample_keys(F.col("body"))
    made = kept(rows.select("split", *[F.sha2(c, 256).alias(n) for n, c in keys.items()]))
    out = None
    for n in keys:
        a = duplicates.group_audit(made, F.col(n)).select(F.lit(n).alias("name"), "*")
        out = a if out is None else out.unionByName(a)
    return out


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 AND (o_orderkey % 3 <> 0) THEN o_custkey END AS result FROM orders""")
def cache_hits(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("version"))
    c = table(spark, d, "orders").where("o_orderkey % 2 = 0").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "old").when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("version"), F.col("o_custkey").alias("result"))
    hits, misses = duplicates.cached(o, c, "o_orderkey", ("version",))
    return hits.select("o_orderkey", "result").unionByName(misses.select("o_orderkey", F.lit(None).cast("long").alias("result")))


@query("SELECT conv_id, turn, text = (SELECT min(text) FROM conversations) OR conv_id % 2 = 0 AS starts FROM conversations")
def prompt_starts(spark, d):
    t = table(spark, d, "conversations")
    least = t.agg(F.min("text").alias("least"))
    prompt = F.when(F.col("conv_id") % 2 == 0, F.col("text")).otherwise(F.col("least"))
    return t.join(F.broadcast(least), F.lit(True)).select("conv_id", "turn", duplicates.starts_with_prompt(selection.user(F.col("text")), prompt).alias("starts"))


TFIDF_SQL = r"""q AS (SELECT item_id AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM benchmark WHERE length(text) >= LEAST), e AS (SELECT conv_id * 100 + turn AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM conversations WHERE length(text) >= LEAST),
  tq AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM q) GROUP BY ALL),
  te AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM e) GROUP BY ALL),
  i AS (SELECT t, ln((1.0 + (SELECT count(*) FROM e)) / (1 + count(*))) + 1 AS idf FROM te GROUP BY t),
  wq AS (SELECT k, t, (1 + ln(tf)) * idf AS w FROM tq JOIN i USING (t)), we AS (SELECT k, t, (1 + ln(tf)) * idf AS w FROM te JOIN i USING (t)),
  nq AS (SELECT k, sqrt(sum(w * w)) AS n FROM wq GROUP BY k), ne AS (SELECT k, sqrt(sum(w * w)) AS n FROM we GROUP BY k),
  c AS (SELECT wq.k AS q, we.k AS e, sum(wq.w / nq.n * (we.w / ne.n)) AS c FROM wq JOIN we USING (t) JOIN nq ON nq.k = wq.k JOIN ne ON ne.k = we.k GROUP BY ALL)"""


@query(f"""WITH {TFIDF_SQL.replace('LEAST', '120')}, b AS (SELECT q, max(round(c * 1e6)) AS c FROM c GROUP BY q) SELECT q AS query, CAST(c AS BIGINT) AS cosine_millionths FROM b WHERE c >= 20000""")
def near_existing(spark, d):
    e = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text")
    n = lexical.near_existing(table(spark, d, "benchmark").withColumnRenamed("item_id", "k"), e, "k", "text", threshold=0.0199995, most=None)
    return n.select("query", F.round(F.col("cosine") * 1e6).cast("long").alias("cosine_millionths"))


@query(f"""WITH {TFIDF_SQL.replace('LEAST', '0')}, p AS (SELECT q, e, c, max(c) OVER (PARTITION BY q) AS top FROM c WHERE q % 2 = e % 2) SELECT q AS query, CAST(round(max(c) * 1e6) AS BIGINT) AS cosine_millionths, bool_and(e % 2 = q % 2) AS same_group FROM p WHERE c >= top - 1e-9 GROUP BY q""")
def neighbours_within(spark, d):
    e = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text")
    t = lexical.terms(e, "k", F.col("text"))
    i = lexical.idf(t, e.count())
    q = lexical.weights(lexical.terms(table(spark, d, "benchmark").withColumnRenamed("item_id", "k"), "k", F.col("text")), i, "k")
    n = lexical.nearest(q.withColumn("group", F.col("k") % 2), lexical.weights(t, i, "k").withColumn("group", F.col("k") % 2), "k", "group")
    return n.select("query", F.round(F.col("cosine") * 1e6).cast("long").alias("cosine_millionths"), (F.col("base") % 2 == F.col("query") % 2).alias("same_group"))


# Traces


@query("SELECT o_orderkey AS sequence, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 2 = 0 THEN 'published' ELSE 'hidden' END AS state FROM orders")
def published_entries(spark, d):
    o = table(spark, d, "orders")
    results = o.select(F.col("o_orderkey").alias("sequence"), F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), F.col("o_custkey").alias("reward_key"), F.lit("v").alias("validation_ref"), F.col("o_orderpriority").alias("job_key"))
    entries = o.select(F.col("o_orderkey").alias("sequence"), (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("reward_key"), F.lit("v").alias("validation_ref"), F.col("o_orderpriority").alias("job_key"))
    good, bad = trace.published(entries, results)
    return good.select("sequence", F.lit("published").alias("state")).unionByName(bad.select("sequence", F.lit("hidden").alias("state")))


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_suppkey % 3 <= c_custkey % 3")
def applicable_entries(spark, d):
    upto = lambda k: F.sequence(F.lit(0), (F.col(k) % 3).cast("int"))
    entries = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("profile"), upto("s_suppkey").alias("need"))
    tasks = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("profile"), upto("c_custkey").alias("have"))
    return trace.applicable(entries, tasks, ["profile"], ("need", "have")).select("c_custkey", "s_suppkey")


@query("""WITH c AS (SELECT l_shipdate::DATE AS day, l_returnflag, l_linestatus = 'F' AS ranked, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS passed, CASE WHEN l_quantity > 30 THEN 'ok' WHEN l_quantity > 10 THEN 'partial' ELSE 'failed' END AS status, CAST(l_linenumber AS DOUBLE) / 8 AS coverage FROM lineitem)
  SELECT l_returnflag, count(passed) AS completed, count(*) - count(passed) AS undecided, avg(CASE WHEN ranked THEN passed::INT::DOUBLE END) AS ranking_accuracy, avg(coverage) AS coverage, count(*) FILTER (status = 'partial') AS partial_cases, count(*) FILTER (status = 'failed') AS all_failed_cases FROM c GROUP BY 1""")
def validation_metrics(spark, d):
    n = F.col("l_linenumber")
    status = F.when(F.col("l_quantity") > 30, "ok").when(F.col("l_quantity") > 10, "partial").otherwise("failed")
    cases = table(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_linestatus") == "F", "ranking").otherwise("pointwise").alias("kind"), F.when(n % 3 == 1, True).when(n % 3 == 2, False).alias("passed"), status.alias("status"), (n / 8).alias("coverage"))
    return scoring.validation_metrics(cases, ["l_returnflag"])


@query("""WITH r AS (SELECT count(*) AS committed, count(*) FILTER (o_orderstatus = 'F') AS success, count(*) FILTER (o_orderstatus = 'O') AS failed, count(*) FILTER (o_orderstatus = 'P') AS unvalidated, 0::BIGINT AS skipped, count(*) FILTER (o_orderkey % 4 = 0) AS reuse_count FROM orders),
  c AS (SELECT event_id // 2 AS logical, event_id % 3 <> 0 AS sent, event_id % 5 <> 0 AS known, user_id % 2 = 0 AS anonymous, event_id FROM events), l AS (SELECT logical, count(*) - 1 AS retries FROM c GROUP BY logical)
  SELECT r.*, (SELECT CAST(sum(retries) AS BIGINT) FROM l) AS transport_retries, (SELECT count(DISTINCT logical) FROM c WHERE anonymous) AS controller_logical_calls, (SELECT count(*) FROM c WHERE sent) AS physical_requests,
    (SELECT CAST(sum(event_id) AS BIGINT) FROM c WHERE sent AND known) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens, (SELECT count(*) FROM c WHERE sent AND NOT known) AS unknown_usage_events FROM r""")
def run_report(spark, d):
    o, e, k = table(spark, d, "orders"), table(spark, d, "events"), F.col("event_id")
    results = o.select(F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("unvalidated").alias("status"), (F.col("o_orderkey") % 4 == 0).alias("reused"))
    known = k % 5 != 0
    calls = e.select(F.floor(k / 2).alias("logical_call_id"), F.when(k % 3 == 0, "prepared").otherwise("returned").alias("dispatch_status"), known.alias("usage_known"), F.when(F.col("user_id") % 2 == 1, "judge").alias("actor_role"), F.when(known, k).alias("prompt_tokens"), F.lit(None).cast("long").alias("completion_tokens"))
    r = trace.run_report(results, calls, e.select((F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"), k.alias("seq")))
    return r.drop("elapsed_wall_seconds", "reuse_rate")


SUITE_SQL = """c AS (SELECT l_orderkey AS suite, l_orderkey || '-' || e AS case_id, 'i' || (e % 3) AS intent, 'capability' AS scope, 'cap' || (e % 2) AS cap, CASE WHEN l_quantity > 25 THEN 'positive' ELSE 'negative' END AS category, CASE WHEN l_returnflag = 'R' THEN 'guess' ELSE 'human' END AS evidence,
    ['x' || (e % 4), 'x' || ((e + 1) % 4)] AS ids, CASE WHEN l_linestatus = 'F' THEN 'pass' ELSE 'fail' END AS expected FROM n)"""
LINES_SQL = "n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS e FROM lineitem)"


def order_cases(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    t, e = dealt(table(spark, d, "lineitem"), "l_orderkey").withColumn("e", F.row_number().over(w)), F.col("e")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    return t.select(
        F.col("l_orderkey").alias("suite"), F.concat_ws("-", "l_orderkey", "e").alias("case_id"), name("i", e % 3).alias("intent"), F.lit("capability").alias("scope"), name("cap", e % 2).alias("cap"),
        F.when(F.col("l_quantity") > 25, "positive").otherwise("negative").alias("category"), F.when(F.col("l_returnflag") == "R", "guess").otherwise("human").alias("evidence_source"),
        F.array(name("x", e % 4), name("x", (e + 1) % 4)).alias("example_ids"), F.when(F.col("l_linestatus") == "F", "pass").otherwise("fail").alias("expected"),
    )


@query(f"""WITH {LINES_SQL}, {SUITE_SQL}, caps AS (SELECT DISTINCT suite, unnest(['cap0', 'cap1']) AS cap FROM c), ex AS (SELECT DISTINCT suite, unnest(['x0', 'x1', 'x2', 'x3']) AS example FROM c), u AS (SELECT suite, scope, cap, expected, unnest(ids) AS example FROM c)
  SELECT suite, 'coverage_gap' AS problem, cap || '/' || category AS subject FROM caps, (VALUES ('positive'), ('negative')) g(category) WHERE (suite, cap, category) NOT IN (SELECT suite, cap, category FROM c)
  UNION ALL SELECT suite, 'duplicate_intent', intent FROM c GROUP BY suite, intent HAVING count(*) > 1
  UNION ALL SELECT suite, 'contradictory_label', example FROM u GROUP BY suite, scope, cap, example HAVING count(DISTINCT expected) > 1
  UNION ALL SELECT suite, 'unused_example', example FROM ex WHERE (suite, example) NOT IN (SELECT suite, example FROM u)
  UNION ALL SELECT suite, 'evidence_not_allowed', case_id FROM c WHERE evidence = 'guess'""")
def suite_admission(spark, d):
    cases = order_cases(spark, d)
    suites = cases.select("suite").distinct()
    caps = suites.withColumn("cap", F.explode(F.array(F.lit("cap0"), F.lit("cap1"))))
    examples = suites.withColumn("example", F.explode(F.array(*map(F.lit, ("x0", "x1", "x2", "x3")))))
    return graph.admission_problems(cases, caps, examples, ("positive", "negative"), ("human",))


@query(f"""WITH {LINES_SQL}, {SUITE_SQL}, r AS (SELECT suite, case_id, unnest(ids) AS ref FROM c) SELECT case_id, ref FROM r WHERE ref IN ('x1', 'x3')""")
def unbound_evidence(spark, d):
    cases = order_cases(spark, d)
    has = cases.select("case_id", F.explode(F.array(F.lit("x0"), F.lit("x2"))).alias("ref"))
    return graph.unbound_evidence(cases.select("case_id", F.col("example_ids").alias("refs")), has)


CALLS_SQL = """c AS (SELECT event_id AS seq, 'l' || (event_id // 2) AS logical, 'e' || (event_id // 6) AS episode, event_id % 7 <> 0 AS own, event_id % 5 <> 0 AS sound, event_id % 11 = 0 AS large, (event_id // 6) % 3 <> 0 AS chosen FROM events),
  a AS (SELECT *, CASE WHEN NOT own THEN 'non_selected_actor' WHEN NOT chosen THEN 'role_not_training_success' WHEN NOT sound THEN 'incomplete_invalid_or_uncommitted' END AS reason FROM c),
  b AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY logical, reason IS NULL ORDER BY seq) > 1 THEN 'duplicate_logical_response' ELSE reason END AS r2 FROM a),
  s AS (SELECT *, CASE WHEN r2 IS NULL AND large THEN 'context_window' ELSE r2 END AS r3 FROM b)"""


def fine_tuning(spark, d):
    e, k = table(spark, d, "events"), F.col("event_id")
    sound = k % 5 != 0
    calls = e.select(
        k.alias("seq"), F.concat(F.lit("l"), F.floor(k / 2)).alias("logical_call_id"), F.concat(F.lit("e"), F.floor(k / 6)).alias("episode_id"), F.when(k % 7 != 0, "writer").otherwise("judge").alias("actor_role"),
        sound.alias("response_complete"), sound.alias("committed_to_history"), sound.alias("schema_valid"), F.when(k % 11 == 0, F.repeat(F.lit("q"), 99)).otherwise(F.concat(F.lit("q"), k)).alias("request"), F.concat(F.lit("r"), k).alias("response"),
    )
    selected = e.where(F.floor(k / 6) % 3 != 0).select(F.concat(F.lit("e"), F.floor(k / 6)).alias("episode_id")).distinct()
    return calls, selected, *trace.fine_tuning_rows(calls, "writer", selected, 50)


@query(f"WITH {CALLS_SQL} SELECT r3 AS reason, count(*) AS count FROM s WHERE r3 IS NOT NULL GROUP BY 1")
def fine_tuning_exclusions(spark, d):
    return fine_tuning(spark, d)[3]


@query(f"WITH {CALLS_SQL} SELECT logical AS sample_id, episode AS episode_id, 'q' || seq AS request, 'r' || seq AS target, 'target_assistant_only' AS loss_scope, seq FROM s WHERE r3 IS NULL")
def fine_tuning_calls(spark, d):
    return fine_tuning(spark, d)[2]


@query(f"""WITH {CALLS_SQL}, h AS (SELECT episode, string_agg(CASE WHEN own AND logical IN (SELECT logical FROM s WHERE r3 IS NULL) THEN '1' ELSE '0' END, '' ORDER BY seq) AS mask, count(*) AS n FROM c GROUP BY episode)
  SELECT episode || ':writer' AS sample_id, mask, n AS messages FROM h WHERE episode IN (SELECT episode FROM s WHERE r3 IS NULL)""")
def full_traces(spark, d):
    calls, _, good, _ = fine_tuning(spark, d)
    one = F.struct("seq", F.lit("assistant").alias("role"), F.col("response").alias("content"), F.when(F.col("actor_role") == "writer", "assistant").otherwise("tool").alias("actor"), "logical_call_id")
    histories = calls.groupBy("episode_id").agg(F.array_sort(F.collect_list(one)).alias("messages"))
    rows, _ = trace.full_traces(good, histories, "writer", 10**6)
    return rows.select("sample_id", F.array_join(F.transform("message_loss_mask", lambda x: x.cast("int").cast("string")), "").alias("mask"), F.size("messages").cast("long").alias("messages"))


@query(f"""WITH {CALLS_SQL} SELECT episode || ':program' AS sample_id, 'q' || min(seq) AS request, 'p' || episode AS target_program, 'program_only' AS loss_scope FROM s WHERE r3 IS NULL GROUP BY episode""")
def final_programs(spark, d):
    _, selected, good, _ = fine_tuning(spark, d)
    chosen = selected.select("episode_id", F.concat(F.lit("p"), "episode_id").alias("target_program"), F.lit("k").alias("reward_key"))
    return trace.final_programs(good, chosen).select("sample_id", "request", "target_program", "loss_scope")


@query("""SELECT l_orderkey AS episode_id, l_linenumber AS example_id, 'a' AS component_id, l_discount AS score, l_returnflag AS feedback FROM lineitem WHERE l_returnflag <> 'N'
  UNION ALL SELECT l_orderkey, l_linenumber, 'b', l_tax, l_linestatus FROM lineitem WHERE l_linestatus = 'F'""")
def feedback_rows(spark, d):
    part = lambda n, s, f: F.struct(F.lit(n).alias("id"), F.col(s).alias("score"), f.alias("feedback"))
    c = F.array(part("a", "l_discount", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag"))), part("b", "l_tax", F.when(F.col("l_linestatus") == "F", F.col("l_linestatus"))))
    s = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("episode_id"), F.lit("v").alias("evaluation_id"), F.lit("k").alias("reward_key"), F.col("l_linenumber").alias("example_id"), c.alias("component_results"))
    return trace.feedback_rows(s).select("episode_id", "example_id", "component_id", "score", "feedback")


@query("""SELECT user_id AS episode_id, CAST(max(event_id) % 4 AS INTEGER) AS examples, CAST(max(event_id) % 3 AS INTEGER) AS cases, CAST(max(event_id) % 3 * 2 AS INTEGER) AS relations, CAST(CASE WHEN max(event_id) % 3 > 0 THEN 1 ELSE 0 END AS INTEGER) AS required_cases, max(event_id) AS reward_attempts, greatest(0, max(event_id) - 1) AS reward_revisions FROM events GROUP BY user_id""")
def suite_statistics(spark, d):
    k = F.col("event_id")
    states = table(spark, d, "events").select(F.col("user_id").alias("episode_id"), k.alias("seq"), k.alias("suite_ref"), k.alias("reward_attempts"))
    upto = lambda n: F.filter(F.sequence(F.lit(1), F.lit(4)), lambda i: i <= n)
    cases = F.transform(upto(k % 3), lambda i: F.struct(F.array(F.lit(1), F.lit(2)).alias("relations"), (i == 1).alias("required")))
    suites = table(spark, d, "events").select(k.alias("suite_ref"), upto(k % 4).alias("examples"), cases.alias("cases"))
    return trace.suite_statistics(states, suites).drop("suite_ref")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 AND doc_id % 3 = 0 THEN 'digest,length' WHEN doc_id % 5 = 0 THEN 'digest' ELSE 'length' END AS failures FROM documents WHERE doc_id % 5 = 0 OR doc_id % 3 = 0")
def integrity_failures(spark, d):
    k = F.col("doc_id")
    t = docs(spark, d).withColumn("digest", F.when(k % 5 != 0, F.sha2("text", 256))).withColumn("length", F.length("text") + F.when(k % 3 == 0, 1).otherwise(0))
    bad = rollouts.integrity(t, {"digest": ("digest", F.sha2("text", 256)), "length": ("length", F.length("text"))})
    return bad.select("doc_id", F.array_join("failures", ",").alias("failures"))


@query("SELECT event_id % 500 AS logical_call_id, count(DISTINCT event_id) AS responses FROM events WHERE event_type = 'view' GROUP BY 1 HAVING count(DISTINCT event_id) > 1")
def double_commits(spark, d):
    k = F.col("event_id")
    payload = F.to_json(F.struct((k % 500).alias("logical_call_id"), k.alias("physical_attempt_id")))
    e = table(spark, d, "events").select(F.when(F.col("event_type") == "view", "llm_history_committed").otherwise("other").alias("type"), payload.alias("payload"))
    return trace.double_commits(e).select(F.col("logical_call_id").cast("long").alias("logical_call_id"), "responses")


# Rollouts and rows


STATES = ("uncertain", "retryable", "failed", "protocol_error", "model_mismatch", "thinking_violation", "uncertain", "truncated", "rejected", "unsupported_finish", "success", "empty")


@query("SELECT event_id, CASE event_id % 12 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(STATES)) + " END AS status FROM events")
def response_statuses(spark, d):
    k = F.col("event_id") % 12
    t = table(spark, d, "events").select(
        "event_id", F.when(k == 0, "reset").alias("transport"), F.when(k == 1, 503).when(k == 2, 400).otherwise(200).alias("http"), F.when(k == 3, F.array(F.lit("server_stream_error"))).otherwise(F.array().cast("array<string>")).alias("errors"),
        F.when(k == 4, F.array(F.lit("other"))).otherwise(F.array(F.lit("m"))).alias("returned_models"), F.when(k == 5, "<think>so</think> hi").when(k == 11, " ").otherwise("<think> </think>hi").alias("content"), F.lit("").alias("reasoning_content"),
        (k != 6).alias("done"), F.when(k == 7, "length").when(k == 9, "tool_calls").otherwise("stop").alias("finish_reason"), F.when(k == 8, "no").otherwise("").alias("refusal"),
    )
    return t.select("event_id", rollouts.status(F.col("http"), F.col("transport"), F.lit("m"), F.lit("disabled")).alias("status"))


@query("""WITH l AS (SELECT user_id AS k, max(event_id) AS last, count(*) AS n FROM events GROUP BY 1)
  SELECT c_custkey AS rollout_id, CASE WHEN last IS NULL THEN 'pending' WHEN last % 3 = 0 THEN 'uncertain' ELSE 'success' END AS status, coalesce(n, 0) AS attempt_count, CASE WHEN last IS NULL THEN 'not_executed' ELSE 'uncommitted' END AS evidence_kind,
  CASE WHEN last % 3 <> 0 THEN 'said ' || last ELSE '' END AS response, CASE WHEN last % 3 <> 0 THEN 'stop' END AS finish_reason, coalesce(last % 2 = 0, false) AS usage_complete FROM customer LEFT JOIN l ON k = c_custkey""")
def rollout_rows(spark, d):
    k = F.col("event_id")
    ok = k % 3 != 0
    a = table(spark, d, "events").select(F.col("user_id").alias("rollout_id"), k.alias("attempt"), F.when(ok, "success").alias("status"), F.when(ok, F.concat(F.lit("said "), k)).alias("content"), F.when(ok, "stop").alias("finish_reason"), (k % 2 == 0).alias("usage_complete"))
    tasks = table(spark, d, "customer").select(F.col("c_custkey").alias("rollout_id"))
    return rollouts.rows(rollouts.latest(tasks, a)).select("rollout_id", "status", "attempt_count", "evidence_kind", "response", "finish_reason", "usage_complete")


@query("SELECT o_orderkey AS rollout_id, o_orderpriority, 'row' AS state FROM orders UNION ALL SELECT o_orderkey, NULL, 'conflict' FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 2 = 0")
def merged_runs(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("rollout_id"), "o_orderpriority")
    a = o.where("rollout_id % 2 = 0").withColumn("source_run", F.lit("a"))
    b = o.where("rollout_id % 3 <> 0 or rollout_id % 2 = 1").withColumn("source_run", F.lit("b"))
    c = o.where("rollout_id % 10 = 0").withColumn("source_run", F.lit("c")).withColumn("o_orderpriority", F.concat("o_orderpriority", F.lit("!")))
    rows, conflicts = rollouts.merged([a, b, c])
    rows = rows.select("rollout_id", F.replace("o_orderpriority", F.lit("!"), F.lit("")).alias("o_orderpriority"), F.lit("row").alias("state"))
    return rows.unionByName(conflicts.select("rollout_id", F.lit(None).cast("string").alias("o_orderpriority"), F.lit("conflict").alias("state")))


@query("SELECT count(DISTINCT (c_mktsegment, c_nationkey)) AS identities FROM customer")
def identities(spark, d):
    return duplicates.one_identity(table(spark, d, "customer"), "c_mktsegment", "c_nationkey")


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","name":"' || replace(p_name, 'cold', '[REDACTED]') || '","notes":["' || replace(p_type, 'cold', '[REDACTED]') || '","a [REDACTED] one"],"by":{"cold":"[REDACTED]"}}' AS told, '{"brand":"' || p_brand || '","by":{}}' AS shown FROM part""")
def scrubbed_rows(spark, d):
    v = F.struct(F.col("p_brand").alias("brand"), F.col("p_name").alias("name"), F.array("p_type", F.lit("a cold one")).alias("notes"), F.create_map(F.lit("cold"), F.lit("cold")).alias("by"))
    t = table(spark, d, "part").select("p_partkey", v.alias("v"))
    kind = t.schema["v"].dataType
    return t.select("p_partkey", F.to_json(text.scrubbed(F.col("v"), kind, "cold")).alias("told"), F.to_json(text.without_fields(F.col("v"), kind, ("name", "notes", "cold"))).alias("shown"))


@query("""SELECT p_partkey, '{"brand":"' || p_brand || '","size":"' || p_size || '"}' AS inputs FROM part""")
def permitted_inputs(spark, d):
    m = F.create_map(F.lit("brand"), "p_brand", F.lit("name"), "p_name", F.lit("size"), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.to_json(graph.permitted(m, ("brand", "size"))).alias("inputs"))


@query("SELECT p_brand AS data_source, p_name AS prompt, p_retailprice AS score, p_size * 2 AS double_size FROM part")
def training_rows(spark, d):
    t = table(spark, d, "part").select(F.col("p_brand").alias("data_source"), F.col("p_name").alias("prompt"), "p_retailprice", "p_size", F.lit("ok").alias("status"), F.col("p_retailprice").alias("total"))
    t = scoring.whole_scores(t)
    return scoring.training_rows(t, {"score": F.col("score"), "double_size": F.col("p_size") * 2})


@query("""SELECT o_orderkey, strftime(o_orderdate + to_seconds(o_orderkey % 86400) + INTERVAL 8 HOURS, '%Y-%m-%dT%H:%M:%S') || CASE WHEN o_orderkey % 2 = 1 THEN '.000250' ELSE '' END || '+08:00' AS iso, CAST(epoch(o_orderdate) AS BIGINT) + o_orderkey % 86400 AS seconds, CAST(o_orderkey % 86400 AS BIGINT) AS since FROM orders""")
def iso_times(spark, d):
    k = F.col("o_orderkey")
    at = F.timestamp_micros(F.unix_micros(F.col("o_orderdate").cast("timestamp")) + (k % 86400) * 1_000_000 + F.when(k % 2 == 1, 250).otherwise(0))
    t = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("first"), at.alias("at"))
    t = t.withColumn("iso", times.iso_in_zone(F.col("at"), "Asia/Shanghai"))
    return t.select("o_orderkey", "iso", F.floor(times.epoch_of(F.col("iso"))).alias("seconds"), F.floor(times.elapsed(F.col("first"), F.col("at"))).alias("since"))


# Streams and user code


def as_stream(df: DataFrame) -> DataFrame:
    spark, path = df.sparkSession, f"{scratch(df.sparkSession)}/in"
    df.write.parquet(path)
    return streams.read_stream(spark, path, df.schema, files=1)


def run_out(stream: DataFrame, into, mode: str = "append") -> None:
    spark = stream.sparkSession
    q = stream.writeStream.foreachBatch(into).outputMode(mode).option("checkpointLocation", f"{scratch(spark)}/cp").trigger(availableNow=True).start()
    q.awaitTermination()


@query("SELECT user_id, length(min(event_type)) AS n FROM (SELECT DISTINCT ON (user_id) user_id, 'same' AS event_type FROM events) GROUP BY 1")
def stream_commits(spark, d):
    e = table(spark, d, "events").select("user_id", F.lit("same").alias("t")).repartition(3)
    results = f"{scratch(spark)}/results"
    commit = streams.commit_once(results, "user_id", lambda df: df.withColumn("n", F.length("t").cast("long")))
    commit(e.where("user_id % 2 = 0"), 0)
    commit(e.where("user_id % 2 = 0"), 0)
    run_out(as_stream(e), commit)
    return spark.read.parquet(results).select("user_id", "n")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windows(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    twice = as_stream(e.unionByName(e).repartition(2, "event_id"))
    path = f"{scratch(spark)}/out"
    run_out(streams.windowed(streams.first_of_id(twice, "event_id"), "1 day"), lambda df, _: df.write.mode("overwrite").parquet(path), "complete")
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT user_id AS episode_id, CASE WHEN count(*) FILTER (event_type = 'error') > 0 THEN 'failed' ELSE 'planning' END AS state FROM events GROUP BY 1""")
def stream_episodes(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("episode_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", "failed").otherwise("planning").alias("to_state"))
    path = f"{scratch(spark)}/out"
    out = streams.episode_states(as_stream(e.repartition(1).sortWithinPartitions("seq")), {"new": ("planning", "failed"), "planning": ("failed",), "failed": ()})
    run_out(out, lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(path), "update")
    return trace.latest_state(spark.read.parquet(path), ["episode_id"], "batch").select("episode_id", "state")


@query("SELECT e.event_id, e.event_id >= coalesce(c.m, 0) AS is_target FROM events e LEFT JOIN (SELECT user_id, min(event_id) + 50 AS m FROM events WHERE user_id % 2 = 0 GROUP BY 1) c USING (user_id)")
def late_responses(spark, d):
    e = table(spark, d, "events")
    cursors = e.where("user_id % 2 = 0").groupBy(F.col("user_id").alias("episode_id")).agg((F.min("event_id") + 50).alias("cursor"))
    return streams.late_responses(e.select(F.col("user_id").alias("episode_id"), "event_id", F.col("event_id").alias("history_position")), cursors).select("event_id", "is_target")


@query("SELECT doc_id AS position FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0")
def changed_positions(spark, d):
    now = docs(spark, d).select(F.col("doc_id").alias("position"), F.sha2("text", 256).alias("digest"))
    old = now.where("position % 2 = 0").withColumn("digest", F.when(F.col("position") % 3 != 0, F.col("digest")))
    return streams.changed_positions(now, old, "position", "digest")


@query("SELECT conv_id, string_agg(text, '' ORDER BY turn, role, text) AS body FROM conversations GROUP BY 1")
def joined_chunks(spark, d):
    t = table(spark, d, "conversations").withColumn("n", F.struct("turn", "role"))
    return streams.joined_chunks(t, "conv_id", "n", "text")


@query("""SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 4 THEN 3 ELSE 0 END AS exit_code, CASE WHEN n_nationkey % 5 <> 4 THEN (n_nationkey * n_nationkey)::VARCHAR || chr(10) ELSE '' END AS stdout FROM nation""")
def program_runs(spark, d):
    n = F.col("n_nationkey")
    code = F.when(n % 5 == 4, "import sys; sys.exit(3)").otherwise("print(int(input()) ** 2)")
    p = spread(table(spark, d, "nation")).select(n.alias("id"), code.alias("program"), n.cast("string").alias("stdin"))
    return scorer.run_programs(p, allow_code=True, seconds=30.0).select("id", "exit_code", "stdout")


@query("""SELECT n_nationkey AS example_id, c AS component_id, CASE c WHEN 'half' THEN CASE WHEN n_nationkey % 2 = 0 THEN 0.5 END END AS score, CASE WHEN c = 'fails' THEN 'COMPONENT_EXCEPTION' END AS error FROM nation, (VALUES ('half'), ('fails')) v(c)""")
def component_failures(spark, d):
    e = table(spark, d, "nation").select(F.col("n_nationkey").alias("example_id"), F.to_json(F.struct(F.col("n_nationkey").alias("k"))).alias("example"))
    half = "def score(example, context):\n    return 0.5 if example['k'] % 2 == 0 else None\n"
    fails = "def score(example, context):\n    return 1 // 0\n"
    return scorer.as_score(scorer.score_examples(spread(e), {"half": half, "fails": fails}, allow_code=True, seconds=30.0)).select("example_id", "component_id", "score", "error")


# What the plain queries of the catalogue never meet: faults, ties, second kinds


@query(f"""WITH r AS (SELECT *, trim(regexp_replace(text, '{WS}+', ' ', 'g')) = '' AS blank, doc_id % 6 AS k FROM documents)
  SELECT doc_id, concat_ws(',', CASE WHEN k = 0 THEN 'null:title' END, CASE WHEN k = 1 THEN 'empty:title' END, CASE WHEN k = 2 THEN 'empty:prompt' END, CASE WHEN k = 3 OR (k NOT IN (2, 3, 4) AND blank) THEN 'empty:message_content' END,
    CASE WHEN source = 'src0' AND k = 3 THEN 'empty:article_payload' END, CASE WHEN source = 'src0' AND k = 5 THEN 'article_is_publisher_boilerplate' END, CASE WHEN k IN (2, 4) THEN 'prompt_not_ending_user' END, CASE WHEN k = 4 THEN 'non_alternating_roles' END, CASE WHEN k IN (3, 4) THEN 'question_not_last_message' END) AS flags FROM r""")
def quality_flag_families(spark, d):
    k = F.col("doc_id") % 6
    one = lambda role, said: F.array(F.struct(F.lit(role).alias("role"), said.alias("content"))).cast(selection.MESSAGES)
    said = F.when(k == 2, F.array().cast(selection.MESSAGES)).when(k == 3, one("user", F.lit(" "))).when(k == 4, one("assistant", F.lit("a reply"))).otherwise(one("user", F.col("text")))
    source = F.when(F.col("source") == "src0", "pubmed-summarization").otherwise("x")
    article = F.when(k == 3, "\n").when(k == 5, F.lit(flags.PUBLISHER_BOILERPLATE)).otherwise("article")
    f = flags.quality_flags({"title": F.when(k == 0, F.lit(None)).when(k == 1, " ").otherwise("t")}, source, article, F.when(k == 3, "other").otherwise(F.col("text")), said)
    return docs(spark, d).select("doc_id", F.array_join(f, ",").alias("flags"))


@query("""SELECT conv_id, turn, CASE conv_id % 5 WHEN 0 THEN '{"actions":[1]}' END AS envelope, CASE conv_id % 5 WHEN 1 THEN '2 envelopes' WHEN 2 THEN 'no ''actions'' key' WHEN 3 THEN 'empty message' WHEN 4 THEN '''['' at 12 is not closed' END AS error FROM conversations""")
def envelope_errors(spark, d):
    from ..functions.envelope import extract_envelope

    k = F.col("conv_id") % 5
    said = F.when(k == 0, 'so {"actions": [1]} it is').when(k == 1, '{"actions":1} or {"actions":2}').when(k == 2, '{"other":1}').when(k == 3, " \n").otherwise('{"actions": [1')
    return spread(table(spark, d, "conversations")).select("conv_id", "turn", extract_envelope(said).alias("x")).select("conv_id", "turn", "x.envelope", "x.error")


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 1 THEN 'COMPONENT_BOOL_REJECTED' WHEN 2 THEN 'COMPONENT_NON_FINITE' WHEN 3 THEN 'COMPONENT_RETURN_TYPE' WHEN 4 THEN 'COMPONENT_RETURN_TYPE' WHEN 5 THEN 'COMPONENT_OUT_OF_RANGE' END AS error,
  CASE WHEN l_linenumber % 7 IN (0, 6) THEN l_discount END AS score, CASE WHEN l_linenumber % 7 IN (0, 6) THEN 'ok' ELSE 'error' END AS status FROM lineitem""")
def raw_score_errors(spark, d):
    n = F.col("l_linenumber") % 7
    kind = F.when(n == 1, "bool").when(n == 2, "nonfinite").when(n == 3, "string").when(n == 4, "null").otherwise("number")
    r = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 4, F.lit(None)).when(n == 5, 1.5).otherwise(F.col("l_discount")).alias("raw"), kind.alias("kind"))
    none = F.lit(None).cast("double")
    return scoring.component_scores(r, none, none).select("l_orderkey", "l_linenumber", "error", "score", "status")


@query("""SELECT c AS component_id, 'COMPONENT_BOOL_REJECTED' AS error, count(*) AS count, arg_min(l_extendedprice::VARCHAR, o * 100 + l) AS first_message FROM (SELECT l_linenumber % 3 AS c, l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS l, l_extendedprice FROM lineitem) WHERE o % 2 = 0 GROUP BY c""")
def first_errors(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    t = table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 100 + F.row_number().over(w))
    r = t.select((F.col("l_linenumber") % 3).alias("component_id"), F.when(F.col("l_orderkey") % 2 == 0, "COMPONENT_BOOL_REJECTED").alias("error"), F.col("l_extendedprice").cast("string").alias("message"), "at")
    return scoring.compact_errors(r, "at")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'event_after_done' WHEN 1 THEN 'server_stream_error' WHEN 2 THEN 'malformed_or_unsupported_event' WHEN 3 THEN 'malformed_or_unsupported_event' ELSE '' END AS errors, event_id % 6 <> 4 AS done,
  CASE event_id % 6 WHEN 0 THEN 'ab' WHEN 2 THEN 'a' WHEN 5 THEN 'a' || event_id ELSE 'a' END AS content, CASE event_id % 6 WHEN 5 THEN 'm,n' ELSE 'm' END AS models FROM events""")
def stream_faults(spark, d):
    k = F.col("event_id") % 6
    said = lambda t, model="m", more="": F.concat(F.lit('data: {"model":"' + model + '","choices":[{"index":0,"delta":{"content":"'), t, F.lit('"}' + more + "}]}\n\n"))
    done, a = F.lit("data: [DONE]\n\n"), said(F.lit("a"))
    body = (
        F.when(k == 0, F.concat(a, done, said(F.lit("b")))).when(k == 1, F.concat(a, F.lit('data: {"error":{"message":"x"}}\n\n'), done)).when(k == 2, F.concat(a, F.lit("data: {oops\n\n"), done))
        .when(k == 3, F.concat(a, F.lit('data: {"choices":[{"index":0,"delta":{"tool_calls":[1]}}]}\r\n\r\n'), done)).when(k == 4, a).otherwise(F.concat(F.lit(": note\n\n"), a, said(F.col("event_id").cast("string"), "n"), done))
    )
    f = rollouts.folded(table(spark, d, "events").select("event_id", body.alias("body")), "event_id", "body")
    return f.select("event_id", F.array_join("errors", ",").alias("errors"), "done", "content", F.array_join("returned_models", ",").alias("models"))


@query("""WITH l AS (SELECT o_orderkey AS row, CASE o_orderkey % 4 WHEN 0 THEN 'none' ELSE 'q' || o_orderkey END AS q, CASE o_orderkey % 4 WHEN 1 THEN 'a' || o_orderkey WHEN 2 THEN 'a' || (o_orderkey - 1) ELSE 'other' END AS a FROM orders),
  u AS (SELECT o_orderkey + 10 AS row, 'q' || o_orderkey AS q, 'a' || o_orderkey AS a FROM orders)
  SELECT l.row, CASE WHEN u.q IS NULL THEN 'question_not_found' WHEN u.a = l.a THEN 'match' WHEN v.a IS NOT NULL THEN 'answer_elsewhere' ELSE 'different_answer' END AS state, CASE WHEN u.a = l.a THEN u.row - l.row END AS "offset"
  FROM l LEFT JOIN u ON u.q = l.q LEFT JOIN u v ON v.a = l.a""")
def upstream_states(spark, d):
    k = F.col("o_orderkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    o = table(spark, d, "orders")
    local = o.select(k.alias("row"), F.when(k % 4 == 0, "none").otherwise(name("q", k)).alias("q"), F.when(k % 4 == 1, name("a", k)).when(k % 4 == 2, name("a", k - 1)).otherwise("other").alias("a"))
    return duplicates.upstream_match(local, o.select((k + 10).alias("row"), name("q", k).alias("q"), name("a", k).alias("a0"), name("b", k).alias("a1")))


@query("""WITH e AS (SELECT o_custkey AS suite, o_orderkey % 3 AS k FROM orders), s AS (SELECT suite, bool_or(k = 0) AS up, bool_or(k = 1) AS back, bool_or(k = 2) AS same FROM e GROUP BY suite)
  SELECT suite, unnest(CASE WHEN up AND back AND same THEN ['a', 'b', 'c'] WHEN up AND back THEN ['a', 'b', 'c'][1:0] ELSE [] END) AS node FROM s""")
def equal_cycles(spark, d):
    """a > b, b > c and a = c: a cycle only where all three are said."""
    k = F.col("o_orderkey") % 3
    pick = lambda x, y, z: F.when(k == 0, x).when(k == 1, y).otherwise(z)
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("suite"), pick("a", "b", "a").alias("left"), pick(">", ">", "=").alias("op"), pick("b", "c", "c").alias("right")).distinct()
    return graph.strict_cycles(e)


@query("""SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || l_quantity AS case_id, any_value(CASE WHEN l_returnflag = 'R' THEN 'insufficient_evidence' WHEN (l_discount >= 0.05) = (l_linestatus = 'F') THEN 'pass' ELSE 'fail' END) AS verdict
  FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity HAVING count(*) = 1""")
def pointwise_verdicts(spark, d):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"]
    t = table(spark, d, "lineitem").withColumn("case_id", F.concat_ws("-", *keys)).withColumn("n", F.count("*").over(Window.partitionBy(*keys))).where("n = 1")
    cases = t.select("case_id", F.lit("pointwise").alias("kind"), F.when(F.col("l_linestatus") == "F", "pass").otherwise("fail").alias("expected"), F.lit("human_annotated").alias("evidence_source"))
    points = t.select("case_id", F.lit(1).alias("example_id"), F.col("l_discount").alias("score"), (F.col("l_returnflag") != "R").alias("ok"))
    none = t.select("case_id", F.lit(1).alias("left"), F.lit(1).alias("right"), F.lit("=").alias("op"))
    return scoring.rule_verdicts(cases, none.limit(0), points, threshold=0.05)


@query("""SELECT o_custkey AS case_id, CASE WHEN max(o_orderkey) % 2 = 0 THEN 'pass' ELSE 'fail' END AS verdict FROM orders GROUP BY o_custkey""")
def tied_verdicts(spark, d):
    """Two examples that are said to be equal, and are so up to rounding or not."""
    c = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("case_id")).agg(F.max("o_orderkey").alias("k"))
    points = c.select("case_id", F.explode(F.array(F.struct(F.lit(1).alias("e"), F.lit(0.3).alias("v")), F.struct(F.lit(2).alias("e"), F.when(F.col("k") % 2 == 0, F.lit(0.1) + F.lit(0.2)).otherwise(0.31).alias("v")))).alias("p"))
    points = points.select("case_id", F.col("p.e").alias("example_id"), F.col("p.v").alias("score"), F.lit(True).alias("ok"))
    cases = c.select("case_id", F.lit("ranking").alias("kind"), F.lit(None).cast("string").alias("expected"), F.lit("human_annotated").alias("evidence_source"))
    return scoring.rule_verdicts(cases, c.select("case_id", F.lit(1).alias("left"), F.lit(2).alias("right"), F.lit("=").alias("op")), points)


@query("SELECT c_custkey AS key, CASE WHEN c_custkey % 10 <> 0 THEN c_mktsegment END AS segment, c_custkey % 10 = 0 AS conflict FROM customer")
def united_rows(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.lit("a").alias("run"))
    b = a.where("key % 5 <> 1").withColumn("segment", F.when(F.col("key") % 10 == 0, "other").otherwise(F.col("segment"))).withColumn("run", F.lit("b"))
    union, conflicts = duplicates.consistent_union(a, b, "key", ("run",))
    j = union.join(conflicts, "key", "left")
    return j.select("key", F.when(F.col("versions").isNull(), F.col("segment")).alias("segment"), F.col("versions").isNotNull().alias("conflict"))


@query("""WITH l AS (SELECT DISTINCT o_custkey AS suite, o_orderkey::VARCHAR AS e, o_orderstatus FROM orders WHERE o_orderstatus <> 'P') SELECT a.suite, a.e AS "left", b.e AS "right" FROM l a JOIN l b ON a.suite = b.suite AND a.o_orderstatus = 'F' AND b.o_orderstatus = 'O'""")
def overall_orders(spark, d):
    o = table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("suite"), F.col("o_orderkey").cast("string").alias("example"), F.lit(None).cast("string").alias("cap"), F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("label"), F.lit("overall").alias("scope"))
    return graph.implied_overall(o, o.select("suite", F.lit("a").alias("cap")).distinct())


@query("""WITH l AS (SELECT o_custkey AS suite, o_orderkey::VARCHAR AS e, o_orderpriority AS cap, o_orderstatus FROM orders) SELECT a.suite, a.cap, a.e AS "left", b.e AS "right" FROM l a JOIN l b ON a.suite = b.suite AND a.cap = b.cap AND a.o_orderstatus = 'F' AND b.o_orderstatus <> 'F'""")
def capability_orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("suite"), F.col("o_orderkey").cast("string").alias("example"), F.col("o_orderpriority").alias("cap"), F.when(F.col("o_orderstatus") == "F", "pass").otherwise("fail").alias("label"), F.lit("capability").alias("scope"))
    return graph.implied_by_capability(o)


PADS = ["".join(f"\\x{b ^ p:02X}" for b in b"secret".ljust(64, b"\0")) for p in (0x36, 0x5C)]


@query(f"""SELECT item_id, sha256('{PADS[1]}'::BLOB || unhex(sha256('{PADS[0]}'::BLOB || encode(text)))) AS tag, item_id % 3 <> 0 AS holds FROM benchmark""")
def hmac_tags(spark, d):
    from ..functions import identity

    t = spread(table(spark, d, "benchmark")).select("item_id", identity.tag(b"secret")(F.col("text")).alias("tag"), "text")
    told = F.when(F.col("item_id") % 3 == 0, F.reverse("tag")).otherwise(F.col("tag"))
    return t.select("item_id", "tag", identity.tag_holds(b"secret")(F.col("text"), told).alias("holds"))


@query("SELECT item_id, sha256(lower(replace(text, 'ß', 'ss'))) AS folded FROM benchmark")
def folded_texts(spark, d):
    return spread(table(spark, d, "benchmark")).select("item_id", F.sha2(text.casefold(F.col("text")), 256).alias("folded"))


@query("""WITH o AS (SELECT user_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 10 ELSE -10 END AS held, CASE WHEN event_type = 'purchase' THEN 7 WHEN event_type NOT IN ('view', 'purchase') THEN 10 ELSE 0 END AS used FROM events),
  b AS (SELECT user_id, 1000 + user_id - sum(held + used) OVER (PARTITION BY user_id ORDER BY seq) AS remaining FROM o) SELECT user_id % 4 AS pool, CAST(min(remaining) AS BIGINT) AS remaining FROM b GROUP BY 1""")
def budget_remaining(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "reserve").when(F.col("event_type") == "purchase", "settle").otherwise("unknown")
    ops = e.select(F.col("event_id").alias("seq"), F.col("event_id").alias("op_id"), F.col("user_id").alias("level"), F.lit("calls").alias("dim"), kind.alias("kind"), F.lit(10).alias("reserved"), F.lit(7).alias("used"))
    limits = e.select(F.col("user_id").alias("level")).distinct().select("level", F.lit("calls").alias("dim"), (1000 + F.col("level")).alias("most"))
    return trace.remaining(trace.ledger(ops, limits).withColumn("pool", F.col("level") % 4), ["pool"])


@query("""SELECT conv_id, turn FROM (SELECT conv_id, turn, turn % 2 = 1 AS odd, lag(turn % 2 = 1) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations) WHERE conv_id % 3 = 0 AND odd <> was""")
def rewritten_histories(spark, d):
    """Each turn with all texts before it; every odd turn of some conversations forgets the first, so
    that it and the turn after it do not go on from what was before."""
    t = table(spark, d, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = F.collect_list(F.concat_ws(":", "turn", F.md5("text"))).over(w)
    t = t.select("conv_id", "turn", h.alias("h")).withColumn("h", F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") % 2 == 1), F.concat(F.array(F.lit("x")), F.slice("h", 2, F.size("h")))).otherwise(F.col("h")))
    return trace.rewritten(t, ["conv_id"], "turn", "h").select("conv_id", "turn")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity - 1) / 40 <= 1 THEN (l_quantity - 1) / 40 END AS strict, least(1.0, (l_quantity - 1) / 40) AS clamped, CASE WHEN l_quantity <= 1 THEN l_quantity END AS plain FROM lineitem""")
def scaled_scores(spark, d):
    from ..functions import answers

    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", answers.scaled(q, F.lit(1.0), F.lit(41.0), clamp=False).alias("strict"), answers.scaled(q, F.lit(1.0), F.lit(41.0)).alias("clamped"), answers.as_is(q).alias("plain"))


@query()
def prompt_token_counts(spark, d):
    """No SQL can tokenise: tests hold it against the library."""
    import public_tokenizers

    from ..functions import token_counts

    path, m = public_tokenizers.path("byte_bpe_50k.json"), F.col("messages")
    return chats(spark, d).select("conv_id", token_counts.prompt_tokens(m, path).alias("thinking"), token_counts.prompt_tokens(m, path, thinking=False).alias("plain"))
