"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, identity, text
from ..functions.envelope import extract_envelope
from ..operators import drift, duplicates, flags, graph, lexical, neardup, profile, rollouts, sampling, scorer, scoring, selection, trace
from ..session import checkpoints, dealt, spread, table
from ..streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SEED = 20261002

#: White space as Python's str.split has it, for RE2.
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NORM = f"trim(regexp_replace(nfc_normalize(text), '{WS}+', ' ', 'g'))"


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def chats(spark: SparkSession, d: str) -> DataFrame:
    """conv_id, messages."""
    t = table(spark, d, "conversations")
    g = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return g.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


# Profiles


@query("""SELECT source, count(*) AS n, avg(n_chars) AS mean, CAST(min(n_chars) AS DOUBLE) AS min, quantile_cont(n_chars, 0.5) AS p50, quantile_cont(n_chars, 0.9) AS p90, quantile_cont(n_chars, 0.95) AS p95,
  quantile_cont(n_chars, 0.99) AS p99, CAST(max(n_chars) AS DOUBLE) AS max, CAST(sum(n_chars) AS BIGINT) AS chars, min(doc_id) AS first_row, max(doc_id) AS last_row,
  sum(n_chars) / sum(sum(n_chars)) OVER () AS char_share, count(*) / sum(count(*)) OVER () AS fraction FROM documents GROUP BY source""")
def source_profile(spark, d):
    return profile.source_profile(docs(spark, d), "source", "n_chars", "doc_id")


@query("""SELECT event_type, count(value) AS n, avg(CAST(round(value * 100) AS BIGINT)) AS mean, CAST(min(round(value * 100)) AS DOUBLE) AS min, quantile_cont(CAST(round(value * 100) AS BIGINT), 0.5) AS p50,
  quantile_cont(CAST(round(value * 100) AS BIGINT), 0.9) AS p90, quantile_cont(CAST(round(value * 100) AS BIGINT), 0.95) AS p95, quantile_cont(CAST(round(value * 100) AS BIGINT), 0.99) AS p99, CAST(max(round(value * 100)) AS DOUBLE) AS max FROM events GROUP BY event_type""")
def value_summary(spark, d):
    return profile.summary(table(spark, d, "events").withColumn("cents", F.round(F.col("value") * 100).cast("long")), ["event_type"], "cents")


EDGES = [0, 250, 1000, 4000, 16000, 64000, 10**9]


@query(f"""SELECT bin, count(*) AS count FROM (SELECT CAST(CASE {' '.join(f'WHEN n_chars > {a} AND n_chars <= {b} THEN {i}' for i, (a, b) in enumerate(zip(EDGES, EDGES[1:])))} END AS INTEGER) AS bin FROM documents) WHERE bin IS NOT NULL GROUP BY bin""")
def length_histogram(spark, d):
    return profile.histogram(docs(spark, d), "n_chars", EDGES)


@query("SELECT lang, " + ", ".join(f"count(*) FILTER (n_chars > {n}) AS over_{n}" for n in (4000, 8000, 16000, 32000)) + " FROM documents GROUP BY lang")
def length_thresholds(spark, d):
    return profile.over_thresholds(docs(spark, d), ["lang"], "n_chars", [4000, 8000, 16000, 32000])


@query("SELECT lang, source, grouping(lang, source) AS level, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (lang, source)")
def lang_source_rollup(spark, d):
    return profile.rollup(docs(spark, d), ["lang", "source"], "n_chars")


@query("SELECT event_type, item, count(*) AS count FROM (SELECT event_type, unnest(json_keys(props)) AS item FROM events) GROUP BY ALL")
def props_keys(spark, d):
    return profile.map_keys(table(spark, d, "events"), ["event_type"], "props")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10")
def longest_documents(spark, d):
    return profile.longest(docs(spark, d), "n_chars", "doc_id").select("doc_id", "n_chars")


@query("SELECT source, count(*) AS count FROM documents GROUP BY source ORDER BY count(*) DESC, source LIMIT 10")
def most_common_sources(spark, d):
    return profile.most_common(docs(spark, d), "source")


@query("SELECT doc_id, cume_dist() OVER (PARTITION BY lang ORDER BY n_chars) AS ecdf FROM documents")
def length_ecdf(spark, d):
    return profile.cumulative(docs(spark, d), ["lang"], "n_chars").select("doc_id", "ecdf")


@query("SELECT item_id, substr(text, 11, 40) AS part FROM benchmark")
def text_pages(spark, d):
    return table(spark, d, "benchmark").select("item_id", profile.text_page(F.col("text"), 10, 40).alias("part"))


@query("SELECT coalesce(max(conv_id), -1) + 1 AS next_position FROM conversations")
def next_position(spark, d):
    return profile.next_position(table(spark, d, "conversations"), "conv_id")


@query("SELECT length(text) - n_chars AS difference, count(*) AS count FROM documents GROUP BY ALL")
def length_differences(spark, d):
    return profile.differences(docs(spark, d).withColumn("a", F.length("text").cast("long")), "a", "n_chars")


# Text and identity


@query(f"SELECT doc_id, sha256({NORM}) AS text_key FROM documents")
def text_keys(spark, d):
    return spread(docs(spark, d)).select("doc_id", identity.text_key(F.col("text")).alias("text_key"))


@query("SELECT doc_id, CAST(ceil(octet_length(encode(text)) / 4) AS BIGINT) + 16 AS estimate, octet_length(encode(text)) + 16 AS fallback FROM documents")
def token_estimate(spark, d):
    return docs(spark, d).select("doc_id", text.token_estimate(F.col("text")).alias("estimate"), text.token_estimate(F.col("text"), fallback=True).alias("fallback"))


@query(r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')) AS BIGINT) AS tokens FROM documents")
def token_counts(spark, d):
    return spread(docs(spark, d)).select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("tokens"))


@query(f"""SELECT doc_id, sha256(trim(regexp_replace(regexp_replace(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), '(?m){WS.replace(chr(92) + 's', ' ' + chr(92) + 't')}+$', '', 'g'), chr(10) || ' ')) AS canonical FROM documents""")
def canonical_texts(spark, d):
    return spread(docs(spark, d)).select("doc_id", identity.digest(text.canonical(F.col("text"))).alias("canonical"))


@query("SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE text[:186] || '...[truncated]' END AS short FROM documents")
def truncated_texts(spark, d):
    return docs(spark, d).select("doc_id", text.truncated(F.col("text"), 200).alias("short"))


# Flags, rules and hints


CHAT_SQL = """t AS (SELECT conv_id, list(role ORDER BY turn, role, text) AS roles, list(text ORDER BY turn, role, text) AS texts FROM conversations GROUP BY conv_id)"""


@query(f"""WITH {CHAT_SQL} SELECT conv_id, concat_ws(',', CASE WHEN len(list_filter(texts, lambda x: trim(coalesce(x, '')) = '')) > 0 THEN 'empty:message_content' END,
  CASE WHEN roles[-1] <> 'user' THEN 'prompt_not_ending_user' END,
  CASE WHEN len(list_filter(range(1, len(roles) + 1), lambda i: roles[i] <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 THEN 'non_alternating_roles' END) AS flags FROM t""")
def conversation_flags(spark, d):
    c = chats(spark, d)
    last = F.get("messages", F.size("messages") - 1)["content"]
    return c.select("conv_id", F.array_join(flags.quality_flags({}, F.lit("chat"), last, last, F.col("messages")), ",").alias("flags"))


@query(f"""WITH {CHAT_SQL}, f AS (SELECT unnest([CASE WHEN roles[-1] <> 'user' THEN 'prompt_not_ending_user' END, CASE WHEN len(list_filter(texts, lambda x: trim(coalesce(x, '')) = '')) > 0 THEN 'empty:message_content' END,
  CASE WHEN len(list_filter(range(1, len(roles) + 1), lambda i: roles[i] <> CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) > 0 THEN 'non_alternating_roles' END]) AS flag FROM t)
  SELECT flag, count(*) AS count FROM f WHERE flag IS NOT NULL GROUP BY flag""")
def flag_counts(spark, d):
    c = chats(spark, d)
    last = F.get("messages", F.size("messages") - 1)["content"]
    return flags.flag_counts(c.select(flags.quality_flags({}, F.lit("chat"), last, last, F.col("messages")).alias("flags")))


@query(f"""WITH {CHAT_SQL}, s AS (SELECT conv_id, roles, texts, roles[-1] = 'assistant' AS ends FROM t),
  u AS (SELECT *, list_filter(list_zip(roles, texts)[:CASE WHEN ends THEN len(roles) - 1 ELSE len(roles) END], lambda x: x[1] = 'user') AS users, CASE WHEN ends THEN coalesce(texts[-1], '') ELSE '' END AS answer FROM s)
  SELECT conv_id, ends AND len(users) > 0 AND trim(coalesce(users[-1][2], '')) <> '' AND trim(answer) <> '' AND len(list_filter(texts, lambda x: x IS NULL)) = 0 AS valid FROM u""")
def chat_structure(spark, d):
    m = F.col("messages")
    f = flags.structure_flags(m, F.lit(""), F.lit("x"), F.lit(False))
    return chats(spark, d).select("conv_id", flags.structurally_valid(f).alias("valid"))


HINT_SQL = " ".join(f"WHEN regexp_matches(text, '{p}', 'is') THEN '{n}'" for n, p in flags.TASK_RULES)


@query(f"""WITH {CHAT_SQL}, u AS (SELECT list_filter(list_zip(roles, texts), lambda x: x[1] = 'user') AS users FROM t), s AS (SELECT left(coalesce(users[-1][2], ''), 4000) AS last, left(users[1][2], 4000) AS first FROM u),
  h AS (SELECT CASE WHEN length(last) < 80 AND first IS NOT NULL THEN last || chr(10) || first ELSE last END AS text FROM s)
  SELECT hint, count(*) AS count FROM (SELECT CASE {HINT_SQL} ELSE 'other_uncertain' END AS hint FROM h) GROUP BY hint""")
def task_hints(spark, d):
    c = chats(spark, d)
    return c.select(flags.task_hint(flags.task_signals(flags.hint_text(F.col("messages")))).alias("hint")).groupBy("hint").agg(F.count("*").alias("count"))


@query("""SELECT d.doc_id, CASE WHEN d.n_chars > 8000 THEN 'deferred_input_limit' WHEN l.toxic = 1 THEN 'outside_general_scope' WHEN l.quality = 1 THEN 'include' WHEN l.quality = 0 THEN 'exclude' ELSE 'pending' END AS disposition
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def dispositions(spark, d):
    j = docs(spark, d).join(table(spark, d, "labels"), "doc_id", "left")
    decision = F.when(F.col("quality") == 1, "include").when(F.col("quality") == 0, "exclude")
    route = flags.routed(F.when(F.col("toxic") == 1, F.lit("include")).otherwise(decision), F.lit("general"), F.when(F.col("toxic") == 1, F.lit("coding")), ("general",))
    return j.select("doc_id", F.coalesce(flags.deferred(F.col("text"), 8000), route, F.lit("pending")).alias("disposition"))


# Duplicates and leakage


@query(f"""WITH k AS (SELECT doc_id, lang AS split, sha256({NORM}) AS k FROM documents), p AS (SELECT k, split, count(*) AS n FROM k GROUP BY ALL), s AS (SELECT *, count(*) OVER (PARTITION BY k) AS splits FROM p)
  SELECT split, count(*) FILTER (n > 1) AS duplicate_groups, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS rows_in_duplicate_groups, CAST(coalesce(sum(n - 1) FILTER (n > 1), 0) AS BIGINT) AS redundant_rows,
  count(*) FILTER (splits > 1) AS shared_keys, CAST(coalesce(sum(n) FILTER (splits > 1), 0) AS BIGINT) AS shared_rows FROM s GROUP BY split""")
def exact_duplicate_audit(spark, d):
    return duplicates.group_audit(spread(docs(spark, d)).withColumnRenamed("lang", "split"), identity.text_key(F.col("text")))


@query(f"SELECT sha256({NORM}) AS key, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_groups(spark, d):
    return duplicates.duplicate_groups(spread(docs(spark, d)), identity.text_key(F.col("text")), "doc_id")


@query("SELECT text AS key, count(*) AS rows, count(DISTINCT source) AS values FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT source) > 1")
def same_key_diff_value(spark, d):
    return duplicates.differing_values(docs(spark, d).where("text is not null"), F.col("text"), F.col("source"))


@query("SELECT doc_id, d.text IN (SELECT text FROM benchmark) AS known FROM documents d")
def known_texts(spark, d):
    return duplicates.known(docs(spark, d), "text", table(spark, d, "benchmark")).select("doc_id", "known")


@query("""WITH a AS (SELECT text, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY text), b AS (SELECT text, count(*) AS n FROM conversations WHERE role <> 'user' GROUP BY text)
  SELECT text, a.n AS left_rows, b.n AS right_rows FROM a JOIN b USING (text)""")
def shared_texts(spark, d):
    c = table(spark, d, "conversations")
    return duplicates.shared_keys(c.where("role = 'user'"), c.where("role <> 'user'"), "text")


@query("SELECT doc_id FROM documents WHERE text IN (SELECT text FROM benchmark)")
def held_out_overlap(spark, d):
    return duplicates.overlap(docs(spark, d), table(spark, d, "benchmark"), "text").select("doc_id")


FOLD = f"""('0x' || sha256('[{SEED},"fold","' || conv_id || '"]')[1:16])::UHUGEINT::DOUBLE / 18446744073709551616.0 < 0.2"""


@query(f"""WITH {CHAT_SQL}, h AS (SELECT *, {FOLD} AS held FROM t), p AS (SELECT conv_id, held, i, list_zip(roles, texts)[:i] AS x FROM h, range(1, len(roles) + 1) r(i))
  SELECT v.conv_id AS valid, n.conv_id AS train, CAST(max(v.i) AS INTEGER) AS prefix FROM p v JOIN p n ON v.held AND NOT n.held AND v.i % 2 = 0 AND v.i = n.i AND v.x = n.x GROUP BY ALL""")
def prefix_overlap(spark, d):
    c = chats(spark, d).withColumn("turns", F.transform("messages", lambda m: F.concat_ws("\x1e", m["role"], m["content"])))
    held = sampling.held_out(F.col("conv_id"), SEED, 0.2, "fold")
    return duplicates.prefix_overlap(c.where(held), c.where(~held), "conv_id", "turns")


@query("""WITH l AS (SELECT doc_id AS row, text AS q, source AS a FROM documents), u AS (SELECT item_id AS row, text AS q FROM benchmark), q AS (SELECT q, count(*) AS n FROM u GROUP BY q)
  SELECT row, CASE WHEN n IS NULL THEN 'question_not_found' ELSE 'different_answer' END AS state, CAST(NULL AS BIGINT) AS "offset" FROM l LEFT JOIN q USING (q)""")
def upstream_match(spark, d):
    local = docs(spark, d).select(F.col("doc_id").alias("row"), F.col("text").alias("q"), F.col("source").alias("a"))
    b = table(spark, d, "benchmark")
    return duplicates.upstream_match(local, b.select(F.col("item_id").alias("row"), F.col("text").alias("q"), F.lit("yes").alias("a0"), F.lit("no").alias("a1")))


@query("""WITH e AS (SELECT o_custkey, o_orderpriority FROM orders UNION ALL SELECT c_custkey, '1-URGENT' FROM customer)
  SELECT o_custkey AS key, count(DISTINCT o_orderpriority) AS versions FROM e GROUP BY 1 HAVING count(DISTINCT o_orderpriority) > 1""")
def union_conflicts(spark, d):
    a = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderpriority")
    b = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("1-URGENT").alias("o_orderpriority"))
    return duplicates.consistent_union(a, b, "key")[1]


@query("""SELECT (SELECT count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer)) AS both,
  (SELECT count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)) AS only_customers, (SELECT count(DISTINCT o_custkey) FROM orders) AS distinct_keys""")
def set_ops_audit(spark, d):
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    one = o.intersect(c).agg(F.count("*").alias("both")).join(c.exceptAll(o.distinct()).agg(F.count("*").alias("only_customers")), F.lit(True))
    return one.join(o.agg(F.countDistinct("k").alias("distinct_keys")), F.lit(True))


# Near duplicates and lexical similarity


@query(r"""WITH t AS (SELECT doc_id, regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]') AS t FROM documents),
  s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, len(t) - 1), lambda i: md5(array_to_string(t[i:i + 2], ' '))[1:16]))) AS s FROM t WHERE len(t) >= 12),
  g AS (SELECT doc_id, len(s) AS n, unnest(s[1:12]) AS g FROM s),
  p AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.9 * greatest(a.n, b.n)),
  j AS (SELECT a, b, len(x.s) + len(y.s) AS m, len(list_intersect(x.s, y.s)) AS shared FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b)
  SELECT a, b, CAST(shared AS BIGINT) AS shared, CAST(m - shared AS BIGINT) AS total FROM j WHERE shared >= 0.9 * (m - shared)""")
def near_dup_pairs(spark, d):
    return neardup.near_pairs(docs(spark, d), "doc_id", F.col("text"))


@query()
def near_dup_first(spark, d):
    t = docs(spark, d)
    return neardup.first_of_each(t.select("doc_id", F.col("doc_id").alias("rank")), neardup.near_pairs(t, "doc_id", F.col("text")), "doc_id", "rank")


@query(r"""WITH b AS (SELECT item_id AS k, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark), e AS (SELECT doc_id AS k, list_filter(string_split_regex(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
  gb AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS g FROM b, range(1, len(w) - 3) r(i)), ge AS (SELECT DISTINCT k, array_to_string(w[i:i + 4], ' ') AS g FROM e, range(1, len(w) - 3) r(i)),
  n AS (SELECT k, count(*) AS total FROM gb GROUP BY k) SELECT gb.k AS part, ge.k AS whole, count(*) AS shared, total FROM gb JOIN ge USING (g) JOIN n ON n.k = gb.k GROUP BY ALL""")
def containment_5gram(spark, d):
    b = lexical.gram_sets(table(spark, d, "benchmark").withColumnRenamed("item_id", "k"), "k", F.col("text"))
    return lexical.containment(b, lexical.gram_sets(docs(spark, d).withColumnRenamed("doc_id", "k"), "k", F.col("text")), "k")


@query(r"""WITH q AS (SELECT item_id AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM benchmark), e AS (SELECT conv_id * 100 + turn AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS w FROM conversations),
  tq AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM q) GROUP BY ALL),
  te AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM e) GROUP BY ALL),
  i AS (SELECT t, ln((1.0 + (SELECT count(*) FROM e)) / (1 + count(*))) + 1 AS idf FROM te GROUP BY t),
  wq AS (SELECT k, t, (1 + ln(tf)) * idf AS w FROM tq JOIN i USING (t)), we AS (SELECT k, t, (1 + ln(tf)) * idf AS w FROM te JOIN i USING (t)),
  nq AS (SELECT k, sqrt(sum(w * w)) AS n FROM wq GROUP BY k), ne AS (SELECT k, sqrt(sum(w * w)) AS n FROM we GROUP BY k),
  c AS (SELECT wq.k AS q, we.k AS e, sum(wq.w / nq.n * (we.w / ne.n)) AS c FROM wq JOIN we USING (t) JOIN nq ON nq.k = wq.k JOIN ne ON ne.k = we.k GROUP BY ALL)
  SELECT q AS query, CAST(round(max(c) * 1e6) AS BIGINT) AS cosine_millionths FROM c GROUP BY q""")
def tfidf_nearest(spark, d):
    e = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("k"), "text")
    t = lexical.terms(e, "k", F.col("text"))
    i = lexical.idf(t, e.count())
    q = lexical.weights(lexical.terms(table(spark, d, "benchmark").withColumnRenamed("item_id", "k"), "k", F.col("text")), i, "k")
    n = lexical.nearest(q, lexical.weights(t, i, "k"), "k")
    return n.select("query", F.round(F.col("cosine") * 1e6).cast("long").alias("cosine_millionths"))


# Sampling and selection


def draw(domain: str, key: str) -> str:
    return f"""sha256('[{SEED},"{domain}","' || {key} || '"]')"""


UNIT = f"('0x' || {draw('holdout', 'doc_id')}[1:16])::UHUGEINT::DOUBLE / 18446744073709551616.0"


@query(f"SELECT doc_id, {UNIT} < 0.1 AS held_out FROM documents")
def holdout_split(spark, d):
    return docs(spark, d).select("doc_id", sampling.held_out(F.col("doc_id"), SEED, 0.1).alias("held_out"))


@query(f"SELECT doc_id FROM documents ORDER BY {draw('sample', 'doc_id')} LIMIT 100")
def hash_order_sample(spark, d):
    return sampling.hash_sample(docs(spark, d).select("doc_id"), SEED, "sample", "doc_id", 100)


@query(f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {draw('reservoir', 'doc_id')}) AS n FROM documents) WHERE n <= 20")
def hash_reservoir(spark, d):
    return sampling.reservoir(docs(spark, d).select("lang", "doc_id"), ["lang"], SEED, "doc_id", 20)


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY text")
def keep_first_representative(spark, d):
    return sampling.keep_first(docs(spark, d).select("text", "doc_id"), ["text"], "doc_id")


@query(f"""WITH t AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source, lang ORDER BY {draw('draw', 'doc_id')}) - 1 AS turn FROM documents),
  p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY turn, lang) - 1 AS position FROM t) SELECT source, CAST(position AS INTEGER) AS position, lang, doc_id FROM p WHERE position < 12""")
def strata_round_robin(spark, d):
    r = sampling.round_robin(docs(spark, d), ["source"], "lang", 12, identity.draw_key(SEED, "draw", F.col("doc_id")))
    return r.select("source", "position", "lang", "doc_id")


@query("SELECT source, doc_id FROM (SELECT source, d.doc_id, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS n FROM documents d JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0) WHERE n <= 5")
def quota_select(spark, d):
    good = table(spark, d, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return sampling.quota(docs(spark, d).join(good, "doc_id", "left_semi"), "source", 5, "doc_id").select("source", "doc_id")


@query("""WITH t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn FROM documents WHERE source IN ('src1', 'src2', 'src3'))
  SELECT source, doc_id FROM t WHERE turn <= CASE source WHEN 'src1' THEN 4 WHEN 'src2' THEN 2 ELSE 6 END ORDER BY turn, source LIMIT 10""")
def next_batch(spark, d):
    return sampling.batches(docs(spark, d), "source", "doc_id", 10, {"src1": 4, "src2": 2, "src3": 6}).select("source", "doc_id")


def pool_parts(spark, d):
    checkpoints(spark)
    rows = docs(spark, d).select(F.lit("p").alias("path"), F.col("doc_id").alias("row"), "source", F.col("lang").alias("stratum"), selection.user(F.col("text")).alias("messages"), F.col("doc_id").cast("string").alias("original_id"), F.array().cast("array<string>").alias("aliases"), F.lit(None).cast("string").alias("error"), F.lit("unsplit").alias("split"))
    rows = rows.withColumn("gid", identity.group_key(F.col("messages"))).withColumn("family", identity.family_text(F.col("messages")))
    return selection.prepare(rows, SEED, 0.1, ["source", "row"])


GID = r"""sha256('[{"content":' || to_json(text)::VARCHAR || ',"role":"user"}]')"""


@query()
def selection_pool(spark, d):
    _, records, held = pool_parts(spark, d)
    pool = selection.build_pool(records, held, ["src0", "src1", "src2"], {"src0": 30, "src1": 10, "src2": 10}, 8000)
    return pool.select("gid", "source", "stratum", "disposition", "matched", "pool_position")


@query()
def selection_report(spark, d):
    members, records, held = pool_parts(spark, d)
    pool = selection.build_pool(records, held, ["src0", "src1"], {"src0": 20, "src1": 10}, 8000)
    labels = members.join(table(spark, d, "labels"), F.col("row") == F.col("doc_id")).groupBy("gid").agg(F.max("quality").alias("q"))
    labels = labels.select("gid", F.when(F.col("q") == 1, "include").otherwise("exclude").alias("decision"))
    pending = pool.where("disposition = 'pending'").select("gid")
    return selection.report(selection.apply_labels(pool, labels.join(pending, "gid", "left_semi")))


@query("SELECT source, quality, toxic, count(*) AS count FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def label_join_counts(spark, d):
    return selection.report(docs(spark, d).join(table(spark, d, "labels"), "doc_id"), ("source", "quality", "toxic"))


# Conversations


@query(f"""WITH {CHAT_SQL} SELECT conv_id, array_to_string(roles, ',') AS roles, sha256(array_to_string(list_transform(list_filter(list_zip(roles, texts), lambda x: x[1] <> 'assistant'), lambda x: x[2]), chr(10))) AS family,
  CAST(list_sum(list_transform(texts, lambda x: length(x))) AS BIGINT) AS chars FROM t""")
def conversation_fold(spark, d):
    m = F.col("messages")
    chars = F.aggregate(m, F.lit(0).cast("long"), lambda a, x: a + F.length(x["content"]))
    return chats(spark, d).select("conv_id", F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"), identity.digest(identity.family_text(m)).alias("family"), chars.alias("chars"))


@query(f"""WITH {CHAT_SQL}, s AS (SELECT conv_id, CASE WHEN list_contains(roles, 'assistant') THEN list_zip(roles, texts)[:list_position(roles, 'assistant') - 1] ELSE list_zip(roles, texts) END AS seed FROM t),
  g AS (SELECT seed, count(*) AS n, min(conv_id) AS first FROM s GROUP BY seed) SELECT n AS copies, first FROM g""")
def conversation_seeds(spark, d):
    g = chats(spark, d).groupBy(identity.fingerprint(identity.conversation_seed(F.col("messages"))).alias("seed")).agg(F.count("*").alias("copies"), F.min("conv_id").alias("first"))
    return g.select("copies", "first")


@query(f"""WITH u AS (SELECT conv_id, count(*) FILTER (role = 'user') AS turns FROM conversations GROUP BY conv_id), r AS (SELECT *, row_number() OVER (PARTITION BY turns ORDER BY {draw('turns', 'conv_id')}) AS n FROM u)
  SELECT conv_id, turns FROM r WHERE n <= 10""")
def turn_stratified_sample(spark, d):
    u = table(spark, d, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"))
    return sampling.quota(u, "turns", 10, identity.draw_key(SEED, "turns", F.col("conv_id"))).select("conv_id", "turns")


# Scores


RESULTS_SQL = """r AS (SELECT l_orderkey AS example_id, l_linenumber AS component_id, CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_quantity / 64 END AS score FROM lineitem)"""


def results(spark, d):
    t = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "R", "bool").otherwise("number")
    r = t.select(F.col("l_orderkey").alias("example_id"), F.col("l_linenumber").alias("component_id"), F.col("l_quantity").alias("raw"), kind.alias("kind"), "l_extendedprice", "l_linestatus")
    return scoring.component_scores(r, F.lit(0.0), F.lit(64.0))


@query(f"""WITH {RESULTS_SQL} SELECT example_id, avg(score) AS total, CASE WHEN count(score) = 0 THEN 'failed' WHEN count(score) < count(*) THEN 'partial' ELSE 'ok' END AS status,
  count(score) / count(*) AS coverage, coalesce(string_agg(CASE WHEN score IS NOT NULL THEN component_id::VARCHAR END, ',' ORDER BY component_id), '') AS valid_components FROM r GROUP BY example_id""")
def score_aggregate(spark, d):
    return scoring.totals(results(spark, d), ["example_id"])


@query(f"""WITH {RESULTS_SQL}, m AS (SELECT example_id, coalesce(string_agg(CASE WHEN score IS NOT NULL THEN component_id::VARCHAR END, ',' ORDER BY component_id), '') AS valid_components FROM r GROUP BY example_id)
  SELECT valid_components, count(*) AS count FROM m GROUP BY valid_components""")
def component_masks(spark, d):
    return scoring.mask_distribution(scoring.totals(results(spark, d), ["example_id"]), [])


@query(f"""WITH {RESULTS_SQL} SELECT component_id, 'COMPONENT_BOOL_REJECTED' AS error, count(*) AS count FROM r WHERE score IS NULL GROUP BY component_id""")
def component_errors(spark, d):
    r = results(spark, d).withColumn("message", F.lit("not a number"))
    return scoring.compact_errors(r, "example_id").select("component_id", "error", "count")


#: Lines of an order, numbered anew: their own numbers repeat.
LINES_SQL = "n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS e FROM lineitem)"


def order_lines(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dealt(table(spark, d, "lineitem"), "l_orderkey").withColumn("e", F.row_number().over(w).cast("long"))


@query(f"""WITH {LINES_SQL}, p AS (SELECT l_orderkey AS k, e, l_quantity / 64 AS v, l_returnflag <> 'R' AS ok, l_linestatus FROM n),
  s AS (SELECT k, bool_and(ok) AS ok, bool_and(l_linestatus = 'F') AS human FROM p GROUP BY k),
  r AS (SELECT a.k, bool_and(a.v > b.v + 1e-9) AS holds FROM p a JOIN p b ON a.k = b.k AND b.e = a.e + 1 GROUP BY a.k)
  SELECT k AS case_id, CASE WHEN NOT ok OR NOT human THEN 'insufficient_evidence' WHEN coalesce(holds, true) THEN 'pass' ELSE 'fail' END AS verdict FROM s LEFT JOIN r USING (k)""")
def rank_verdicts(spark, d):
    t = order_lines(spark, d).select(F.col("l_orderkey").alias("case_id"), F.col("e").alias("example_id"), (F.col("l_quantity") / 64).alias("score"), (F.col("l_returnflag") != "R").alias("ok"), "l_linestatus")
    cases = t.groupBy("case_id").agg(F.bool_and(F.col("l_linestatus") == "F").alias("human"))
    cases = cases.select("case_id", F.lit("ranking").alias("kind"), F.lit(None).cast("string").alias("expected"), F.when(F.col("human"), "human_annotated").otherwise("model_inferred").alias("evidence_source"))
    w = Window.partitionBy("case_id").orderBy("example_id")
    rel = t.withColumn("right", F.lead("example_id").over(w)).where(F.col("right") == F.col("example_id") + 1).select("case_id", F.col("example_id").alias("left"), "right", F.lit(">").alias("op"))
    return scoring.rule_verdicts(cases, rel, t)


@query(f"""WITH {LINES_SQL} SELECT a.l_orderkey AS k, a.e AS "left", b.e AS "right", a.l_quantity - b.l_quantity AS difference FROM n a JOIN n b ON a.l_orderkey = b.l_orderkey AND b.e = a.e + 1""")
def relation_scores(spark, d):
    t = order_lines(spark, d).select(F.col("l_orderkey").alias("k"), "e", F.col("l_quantity").alias("total")).withColumn("example_id", F.struct("k", "e"))
    have = t.select("k", "e").join(t.select("k", (F.col("e") - 1).alias("e")), ["k", "e"])
    rel = have.select("k", F.struct("k", "e").alias("left"), F.struct("k", (F.col("e") + 1).alias("e")).alias("right"))
    return scoring.relation_scores(rel, t).select("k", F.col("left.e").alias("left"), F.col("right.e").alias("right"), "difference")


@query("""SELECT l_orderkey, l_linenumber, CAST(round(CASE WHEN s = 0 THEN 0 ELSE (l_quantity - m) / (s + 1e-6) END * 1e6) AS BIGINT) AS advantage_millionths
  FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_orderkey) AS m, stddev_pop(l_quantity) OVER (PARTITION BY l_orderkey) AS s FROM lineitem)""")
def group_advantage(spark, d):
    a = scoring.advantages(table(spark, d, "lineitem"), "l_orderkey", "l_quantity")
    return a.select("l_orderkey", "l_linenumber", F.round(F.col("advantage") * 1e6).cast("long").alias("advantage_millionths"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice NULLS LAST, o_orderkey) AS n FROM orders) WHERE n = 1")
def best_candidate(spark, d):
    return scoring.best_candidate(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey")


@query("""SELECT event_type, sum(CASE WHEN user_id % 7 = 0 THEN NULL ELSE event_id END)::BIGINT AS tokens, CASE WHEN bool_or(user_id % 7 = 0) THEN 'unknown' ELSE 'known' END AS cost_status FROM events GROUP BY event_type""")
def merged_usage(spark, d):
    e = table(spark, d, "events").withColumn("tokens", F.when(F.col("user_id") % 7 != 0, F.col("event_id"))).withColumn("cost", F.when(F.col("user_id") % 7 == 0, "unknown").otherwise("known"))
    return scoring.merged_usage(e, ["event_type"], ["tokens"], "cost")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_discount * 100) THEN 1.0 ELSE 0.0 END AS score FROM lineitem""")
def answer_scores(spark, d):
    t = table(spark, d, "lineitem")
    response = F.concat(F.lit("so #### wrong #### "), F.format_number(F.col("l_quantity") * 1000, 0))
    reference = F.concat(F.lit("#### "), F.floor(F.col("l_discount") * 100).cast("string"), F.lit("000"))
    return t.select("l_orderkey", "l_linenumber", answers.final_answer_matches(response, reference).alias("score"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity * 4 = floor(l_quantity) * 4 AS INTEGER)::DOUBLE AS score FROM lineitem")
def boxed_scores(spark, d):
    said = F.concat(F.lit("\\boxed{"), F.col("l_quantity").cast("decimal(10,2)").cast("string"), F.lit("}"))
    right = F.concat((F.floor("l_quantity") * 3).cast("string"), F.lit("/3"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", answers.boxed_matches(said, right).alias("score"))


# Rollouts


@query("SELECT conv_id, turn, text AS content, 'stop' AS finish_reason, length(text)::BIGINT AS completion_tokens, 'success' AS status FROM conversations")
def sse_fold(spark, d):
    t = table(spark, d, "conversations").withColumn("k", F.concat_ws("-", "conv_id", "turn"))
    half = F.floor(F.length("text") / 2).cast("int")

    def event(content, finish, tokens):
        delta = F.struct(F.struct(content.alias("content")).alias("delta"), F.lit(0).alias("index"), finish.cast("string").alias("finish_reason"))
        return F.concat(F.lit("data: "), F.to_json(F.struct(F.lit("m").alias("model"), F.array(delta).alias("choices"), F.struct(tokens.cast("long").alias("completion_tokens")).alias("usage"))), F.lit("\r\n\r\n"))

    rest = F.substring(F.col("text"), half + 1, F.length("text"))
    body = F.concat(event(F.left("text", half), F.lit(None), half), event(rest, F.lit("stop"), F.length("text")), F.lit("data: [DONE]\n\n"))
    f = rollouts.folded(t.select("k", "conv_id", "turn", body.alias("body")), "k", "body")
    f = f.withColumn("status", rollouts.status(F.lit(200), F.lit(None).cast("string"), F.lit("m"), F.lit("disabled")))
    return t.select("k", "conv_id", "turn").join(f, "k").select("conv_id", "turn", "content", "finish_reason", F.col("usage.completion_tokens").alias("completion_tokens"), "status")


ATTEMPTS_SQL = """a AS (SELECT user_id AS k, event_id AS attempt, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'retryable' ELSE 'uncertain' END AS status FROM events)"""


def attempts(spark, d):
    s = F.when(F.col("event_type") == "purchase", "success").when(F.col("event_type") == "error", "retryable").otherwise("uncertain")
    return table(spark, d, "events").select(F.col("user_id").alias("rollout_id"), F.col("event_id").alias("attempt"), s.alias("status"), F.col("event_id").alias("prompt_tokens"), F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("completion_tokens"))


@query(f"""WITH {ATTEMPTS_SQL}, l AS (SELECT k, arg_max(status, attempt) AS status, count(*) AS n FROM a GROUP BY k)
  SELECT c_custkey AS rollout_id, coalesce(status, 'pending') AS status, coalesce(n, 0) AS attempt_count FROM customer LEFT JOIN l ON k = c_custkey""")
def latest_attempt(spark, d):
    tasks = table(spark, d, "customer").select(F.col("c_custkey").alias("rollout_id"))
    return rollouts.latest(tasks, attempts(spark, d)).select("rollout_id", "status", "attempt_count")


@query("""SELECT sample_id, i AS sample_index, sha256(concat_ws(chr(31), 'run', sample_id, i)) AS rollout_id FROM (SELECT item_id AS sample_id, unnest(range(3))::INTEGER AS i FROM benchmark)""")
def rollout_tasks(spark, d):
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"))
    return rollouts.tasks(b, "run", 3).select("sample_id", "sample_index", "rollout_id")


@query("""SELECT c_custkey AS sample_id, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS rollouts FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' GROUP BY c_custkey""")
def nest_by_prompt(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("sample_id"), "o_orderkey", F.when(F.col("o_orderstatus") == "F", "success").otherwise("failed").alias("status"), F.lit("x").alias("response"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("sample_id"))
    n = rollouts.by_prompt(c, rollouts.candidates(o), ("sample_id",), ("o_orderkey",))
    return n.select("sample_id", F.array_join(F.transform("rollouts", lambda r: r["o_orderkey"].cast("string")), ",").alias("rollouts"))


@query(f"""WITH {ATTEMPTS_SQL}, t AS (SELECT o_orderpriority AS data_source, o_orderstatus AS status, o_orderkey AS k FROM orders), u AS (SELECT k, count(*) AS n, sum(attempt) AS p, sum(CASE WHEN attempt % 3 = 0 THEN attempt END) AS c, count(*) FILTER (attempt % 3 <> 0) AS u FROM a GROUP BY k)
  SELECT data_source, status, count(*) AS tasks, CAST(coalesce(sum(n), 0) AS BIGINT) AS attempts, CAST(sum(p) AS BIGINT) AS prompt_tokens, CAST(sum(c) AS BIGINT) AS completion_tokens, CAST(coalesce(sum(u), 0) AS BIGINT) AS unknown_usage FROM t LEFT JOIN u USING (k) GROUP BY ALL""")
def rollout_summary(spark, d):
    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("data_source"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("rollout_id"))
    return rollouts.summary(t, attempts(spark, d))


# Event logs


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_event_per_key(spark, d):
    return trace.latest_state(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], "event_id")


@query("""WITH c AS (SELECT user_id, event_id, event_type, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM c)
  SELECT user_id, CAST(island AS BIGINT) AS island, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS length FROM i GROUP BY ALL HAVING count(*) >= 3""")
def event_islands(spark, d):
    return trace.islands(table(spark, d, "events"), ["user_id"], ["event_id"], "event_type", 3)


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(ts)::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window FROM events")
def rate_window(spark, d):
    e = table(spark, d, "events").withColumn("s", F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long"))
    return trace.rate(e, ["user_id"], "s", 3600).select("event_id", "in_window")


@query("SELECT event_id, ts FROM (SELECT event_id, ts, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events) WHERE event_id <= last")
def sequence_faults(spark, d):
    e = table(spark, d, "events").withColumn("at", F.struct("ts", "event_id"))
    return trace.not_rising(e, ["user_id"], "event_id", "at").select("event_id", "ts")


@query("""SELECT event_id, coalesce(min(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w = 1 AND count(*) OVER w = 2, false) AS open FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)""")
def circuit_breaker(spark, d):
    e = table(spark, d, "events").withColumn("failed", F.col("event_type") == "error")
    return trace.breaker(e, ["user_id"], ["event_id"], "failed", 2).select("event_id", "open")


@query("""WITH o AS (SELECT user_id, event_id AS seq, CASE WHEN event_type = 'view' THEN 10 ELSE -10 END AS held, CASE WHEN event_type = 'purchase' THEN 7 WHEN event_type NOT IN ('view', 'purchase') THEN 10 ELSE 0 END AS used FROM events)
  SELECT user_id AS level, seq, CAST(sum(held) OVER w AS BIGINT) AS held, CAST(sum(used) OVER w AS BIGINT) AS consumed, CAST(1000 - sum(held) OVER w - sum(used) OVER w AS BIGINT) AS remaining FROM o WINDOW w AS (PARTITION BY user_id ORDER BY seq)""")
def running_ledger(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "reserve").when(F.col("event_type") == "purchase", "settle").otherwise("unknown")
    ops = e.select(F.col("event_id").alias("seq"), F.col("event_id").alias("op_id"), F.col("user_id").alias("level"), F.lit("calls").alias("dim"), kind.alias("kind"), F.lit(10).alias("reserved"), F.lit(7).alias("used"))
    limits = e.select(F.col("user_id").alias("level")).distinct().select("level", F.lit("calls").alias("dim"), F.lit(1000).cast("long").alias("most"))
    return trace.ledger(ops, limits).select("level", "seq", "held", "consumed", "remaining")


CALLS_SQL = """WITH e AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN 'llm_attempt_prepared' WHEN 1 THEN 'llm_dispatched' ELSE 'llm_response' END AS type, event_id // 3 AS pid FROM events),
  p AS (SELECT pid, max(user_id) FILTER (type = 'llm_attempt_prepared') AS u, bool_or(type = 'llm_attempt_prepared') AS prepared, bool_or(type = 'llm_dispatched') AS sent, bool_or(type = 'llm_response') AS returned FROM e GROUP BY pid HAVING bool_or(type = 'llm_attempt_prepared'))"""


def call_events(spark, d):
    e = table(spark, d, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "llm_attempt_prepared").when(F.col("event_id") % 3 == 1, "llm_dispatched").otherwise("llm_response")
    pid = F.floor(F.col("event_id") / 3).cast("string")
    payload = F.to_json(F.struct(pid.alias("physical_attempt_id"), F.concat(F.lit("L"), pid).alias("logical_call_id"), F.when(F.col("user_id") % 2 == 0, "judge").alias("actor_role"), F.lit(True).alias("response_complete"), F.struct(F.lit(5).alias("prompt_tokens"), F.lit(True).alias("usage_known")).alias("usage")))
    return e.select(F.col("event_id").alias("seq"), kind.alias("type"), F.col("user_id").alias("episode_id"), payload.alias("payload"), F.col("ts"))


@query(f"""{CALLS_SQL} SELECT pid::VARCHAR AS pid, u AS episode_id, CASE WHEN returned THEN 'returned' WHEN sent THEN 'unknown' ELSE 'prepared' END AS dispatch_status, CASE WHEN returned THEN 5 END::BIGINT AS prompt_tokens FROM p""")
def llm_calls(spark, d):
    return trace.calls(call_events(spark, d)).select("pid", "episode_id", "dispatch_status", "prompt_tokens")


@query(f"""{CALLS_SQL} SELECT CASE WHEN u % 2 = 0 THEN 'judge' ELSE 'legacy_controller' END AS actor_role, count(*) AS logical_calls, count(*) FILTER (sent OR returned) AS physical_attempts,
  CAST(sum(CASE WHEN returned THEN 5 END) AS BIGINT) AS input_tokens, count(*) FILTER (NOT returned) AS unknown_usage_events FROM p GROUP BY 1""")
def usage_by_role(spark, d):
    return trace.usage_by_role(trace.calls(call_events(spark, d))).select("actor_role", "logical_calls", "physical_attempts", "input_tokens", "unknown_usage_events")


@query("""WITH v AS (SELECT user_id, event_type AS n, value, lag(event_type) OVER w AS p, lag(value) OVER w AS pv FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
  e AS (SELECT DISTINCT user_id AS suite, n AS l, p AS r FROM v WHERE p IS NOT NULL AND p <> n AND value > pv),
  reach AS (WITH RECURSIVE x(suite, l, r) AS (SELECT suite, l, r FROM e UNION SELECT x.suite, x.l, e.r FROM x JOIN e ON e.suite = x.suite AND e.l = x.r) SELECT * FROM x)
  SELECT DISTINCT suite, l AS node FROM reach WHERE l = r""")
def strict_cycles(spark, d):
    checkpoints(spark)
    w = Window.partitionBy("user_id").orderBy("event_id")
    v = table(spark, d, "events").withColumn("p", F.lag("event_type").over(w)).withColumn("pv", F.lag("value").over(w))
    e = v.where("p is not null and p <> event_type and value > pv").select(F.col("user_id").alias("suite"), F.col("event_type").alias("left"), F.lit(">").alias("op"), F.col("p").alias("right")).distinct()
    return graph.strict_cycles(e)


@query(f"""WITH {LINES_SQL}, l AS (SELECT l_orderkey AS suite, e::VARCHAR AS e, CASE WHEN l_returnflag = 'R' THEN 'fail' ELSE 'pass' END AS a, CASE WHEN l_linestatus = 'F' THEN 'pass' ELSE 'fail' END AS b FROM n)
  SELECT x.suite, x.e AS "left", y.e AS "right" FROM l x JOIN l y ON x.suite = y.suite AND (x.a >= y.a AND x.b >= y.b) AND (x.a > y.a OR x.b > y.b)""")
def implied_orders(spark, d):
    t = order_lines(spark, d).select(F.col("l_orderkey").alias("suite"), F.col("e").cast("string").alias("example"), F.when(F.col("l_returnflag") == "R", "fail").otherwise("pass").alias("a"), F.when(F.col("l_linestatus") == "F", "pass").otherwise("fail").alias("b"))
    labels = t.select("suite", "example", F.explode(F.create_map(F.lit("a"), "a", F.lit("b"), "b")).alias("cap", "label")).withColumn("scope", F.lit("capability"))
    return graph.implied_overall(labels, labels.select("suite", "cap").distinct())


# Drift


@query("""WITH c AS (SELECT lang, count(*) FILTER (n_chars > 1500) AS a, count(*) FILTER (n_chars <= 1500) AS b FROM documents GROUP BY lang), s AS (SELECT *, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q, sum(a) OVER () AS na, sum(b) OVER () AS nb FROM c), g AS (
  SELECT CAST(round(sum(abs(p - q)) / 2 * 1e9) AS BIGINT) AS tv, CAST(round(sum(CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END / 2 + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END / 2) * 1e9) AS BIGINT) AS js,
  CAST(round(sum((a - (a + b) * na / (na + nb)) ** 2 / ((a + b) * na / (na + nb)) + (b - (a + b) * nb / (na + nb)) ** 2 / ((a + b) * nb / (na + nb))) * 1e6) AS BIGINT) AS chi,
    sum((a - (a + b) * na / (na + nb)) ** 2 / ((a + b) * na / (na + nb)) + (b - (a + b) * nb / (na + nb)) ** 2 / ((a + b) * nb / (na + nb))) / 2 AS x, count(*) - 1 AS dof FROM s)
  SELECT tv, js, chi, dof, CAST(round(1e9 * (1 - list_sum(list_transform(range(0, 400), lambda i: exp(-x + (dof / 2 + i) * ln(x) - lgamma(dof / 2 + i + 1)))))) AS BIGINT) AS p FROM g""")
def tv_js_drift(spark, d):
    t = drift.distances(docs(spark, d), "lang", F.col("n_chars") > 1500)
    return t.select(*[F.round(F.col(c) * m).cast("long").alias(n) for c, n, m in (("total_variation", "tv", 1e9), ("js_bits", "js", 1e9), ("chi_square", "chi", 1e6), ("p", "p", 1e9))], "dof")


@query("""WITH c AS (SELECT lang, n_chars, count(*) FILTER (source < 'src3') AS a, count(*) FILTER (source >= 'src3') AS b FROM documents GROUP BY ALL),
  s AS (SELECT lang, a, b, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY lang) - sum(b) OVER w / sum(b) OVER (PARTITION BY lang)) AS d FROM c WINDOW w AS (PARTITION BY lang ORDER BY n_chars))
  , g AS (SELECT lang, max(d) AS ks, CAST(sum(a) AS BIGINT) AS n_a, CAST(sum(b) AS BIGINT) AS n_b FROM s GROUP BY lang)
  SELECT lang, ks, n_a, n_b, CAST(round(1e9 * least(1, greatest(0, 2 * list_sum(list_transform(range(1, 101), lambda k: (-1) ** (k - 1) * exp(-2 * k * k * ks * ks * n_a * n_b / (n_a + n_b))))))) AS BIGINT) AS p FROM g""")
def ks_by_group(spark, d):
    return drift.ks(docs(spark, d), ["lang"], "n_chars", F.col("source") < "src3").withColumn("p", F.round(F.col("p") * 1e9).cast("long"))


# User code and windows


@query("SELECT item_id AS example_id, 'length' AS component_id, length(text)::DOUBLE AS raw FROM benchmark")
def user_scorer(spark, d):
    e = table(spark, d, "benchmark").select(F.col("item_id").alias("example_id"), F.to_json(F.struct(F.col("text").alias("response"))).alias("example"))
    source = "def score(example, context):\n    return {'raw_score': len(example['response']), 'feedback': None}\n"
    return scorer.score_examples(e.repartition(8), {"length": source}, allow_code=True).select("example_id", "component_id", "raw")


@query("""SELECT conv_id, turn, '{"actions":[{"id":"' || conv_id || '"}]}' AS envelope, CAST(NULL AS VARCHAR) AS error FROM conversations""")
def envelopes(spark, d):
    t = table(spark, d, "conversations")
    said = F.concat("text", F.lit(' then {"actions": [{"id": "'), F.col("conv_id").cast("string"), F.lit('"}]} and no more'))
    return t.select("conv_id", "turn", extract_envelope(said).alias("x")).select("conv_id", "turn", "x.envelope", "x.error")


@query("""SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL""")
def tumbling_counts(spark, d):
    w = streams.windowed(table(spark, d, "events"), "1 day")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 6 HOURS, ts), time_bucket(INTERVAL 6 HOURS, ts) - INTERVAL 6 HOURS]) AS s FROM events) GROUP BY ALL""")
def sliding_counts(spark, d):
    w = streams.windowed(table(spark, d, "events"), "12 hours", "6 hours")
    return w.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH n AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOURS OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM n) SELECT min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, d):
    s = streams.sessions(table(spark, d, "events"), "6 hours")
    return s.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "user_id", "n")


# Star schema


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS sum_cents, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("timestamp_ntz '1998-09-02 00:00:00'"))
    return t.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("sum_cents"), F.count("*").alias("n"))


@query("""SELECT r_name, n_name, c_mktsegment, count(*) AS orders, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def revenue_by_nation(spark, d):
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("orders"), F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents"))


@query("""SELECT s_suppkey, p_brand, CAST(sum(l_quantity) AS BIGINT) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey WHERE p_size > 25 GROUP BY ALL""")
def quantity_by_supplier(spark, d):
    li, p, s = (table(spark, d, t) for t in ("lineitem", "part", "supplier"))
    return li.join(p.where("p_size > 25"), li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).groupBy("s_suppkey", "p_brand").agg(F.sum("l_quantity").cast("long").alias("qty"))
