"""The operators over their whole tables, with production parameters, and SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, leaders, lm, mixing, packing, quality, repair, substring, tokens, topk, toxicity, urls
from .common import table

#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
WORD_SQL = r"'[^\x20\x09-\x0D]+'"


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


OP1_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 50 = 0) q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op3_score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op4_filter_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rule_table(spark, URL_RULES))


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
h AS (SELECT page_id, row_number() OVER () AS n,
  translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path FROM p),
r(rh, rp, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m AS (SELECT n, page_id, host, path, rh || rp AS rule, verdict,
  row_number() OVER (PARTITION BY n ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC NULLS LAST) AS k
  FROM h LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""

CONTROL = "<|im_end|><|im_start|>assistant ok"


def in_layouts(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations in the layouts that real sources have, a quarter each: rows by turn, and
    JSON records (conv_id, record) of messages, of speakers, and of prompt and response (or, where
    a conversation is no such pair, of messages with texts)."""
    kind = F.coalesce(F.pmod("conv_id", F.lit(4)), F.lit(0))
    role, text = F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    whole = turns.where(kind > 0).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", role, text))).alias("t"))
    roles = F.transform("t", lambda m: m["role"])
    as_fields = lambda a, b, renamed=lambda r: r: F.transform("t", lambda m: F.struct(renamed(m["role"]).alias(a), m["text"].alias(b)))
    speaker = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    messages = F.to_json(F.struct(as_fields("role", "content").alias("messages")))
    speakers = F.to_json(F.struct(as_fields("from", "value", speaker).alias("conversations")))
    texts = F.to_json(F.struct(as_fields("role", "text").alias("messages")))
    pair = F.to_json(F.struct(F.get("t", 0)["text"].alias("prompt"), F.get("t", 1)["text"].alias("response")))
    renamed = F.arrays_overlap(roles, F.array(*map(F.lit, chat.SPEAKERS)))
    record = F.when((kind == 2) & ~renamed, speakers).when((kind == 3) & (roles == F.array(F.lit("user"), F.lit("assistant"))), pair).when(kind == 3, texts).otherwise(messages)
    return turns.where(kind == 0), whole.select("conv_id", record.alias("record"))


def op5_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    rows, records = in_layouts(turns.unionByName(extra, allowMissingColumns=True))
    told = chat.rows_of(chat.canonical(records, "conv_id", json="record"), "conv_id")
    return chat.digests(chat.format_rows(chat.turn_rows(rows, strict=False).unionByName(told)))


OP5_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(i)),
e AS (SELECT *, length('<|im_start|>') + length(replace(replace(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'), '%', '%25'), chr(10), '%0A')) + 1
  + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS n FROM t),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss, CAST(sum(n) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


OP7_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM w, range(1, greatest(len(w) - 1, 2)) r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
reach(v, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, reach.r FROM reach JOIN e ON e.x = reach.v),
c AS (SELECT v, min(r) AS component_id FROM reach GROUP BY v)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.v = d.doc_id
"""


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT n, i, array_to_string(w[i:i + 4], ' ') AS g FROM d, range(1, len(w) - 3) r(i)),
twice AS (SELECT n, i FROM (SELECT n, i, count(*) OVER (PARTITION BY n, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT n, count(DISTINCT i + j) AS c FROM twice, range(5) r(j) GROUP BY n),
lines AS (SELECT n, count(*) AS n_lines, count(*) - count(DISTINCT x) AS dups FROM (SELECT n, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY n),
f AS (SELECT d.n, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_lines, 0) AS n_lines, coalesce(dups, 0) AS n_dup_lines, coalesce(c, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (n) LEFT JOIN lines USING (n)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS failed FROM b GROUP BY source),
m AS (SELECT least(greatest(coalesce(avg(failed / n), 0), 1e-6), 1 - 1e-6) AS m, coalesce(var_samp(failed / n), 0) AS v FROM h),
p AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, m * (1 - m) / v - 1) ELSE 1.0 END AS s FROM m),
s AS (SELECT source, (failed + m * s) / (n + s) >= 0.5 AS suspect FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (suspect AND (100 * n_repeat_words > 10 * n_words OR 100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines)) AS kept
FROM b JOIN s ON b.source IS NOT DISTINCT FROM s.source
"""


def op9_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokens.count_tokens(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM w, range(1, len(w) - 11) r(i)),
m AS (SELECT g, min(doc_id) AS m FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
x AS (SELECT DISTINCT doc_id, i + j AS i FROM g JOIN m USING (g), range(13) r(j) WHERE m < doc_id),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w) ANTI JOIN x USING (doc_id, i) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""



def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_leader_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaders.leader_changes(*(table(spark, sf_dir, t) for t in ("sale_lines", "items", "vendors")))


#: DuckDB has no crc32: its table, and the sum of a string of ASCII characters.
CRC_TABLE = """WITH RECURSIVE crc(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc WHERE k = 8)"""


def crc_sql(text: str) -> str:
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[1 + (xor(c, b) & 255)], c >> 8)))"


OP12_SQL = f"""
{CRC_TABLE},
h AS (SELECT *, {crc_sql("concat(sale_id, ',', item_id, ',', vendor_id, ',', line_no)")} AS h FROM sale_lines, crc_table),
s AS (SELECT *, coalesce(datediff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)), 19723 + h % 150) AS s FROM h),
a AS (SELECT *, s + h % 7 + CASE WHEN h % 5 = 0 THEN 20 ELSE 0 END AS a FROM s),
l AS (SELECT nation_id, i.item_id, a, s, least(12, 1 + CAST(floor((a - 19723) * 12 / 180) AS BIGINT)) AS b,
  CASE WHEN flag = 'returned' THEN -1 ELSE 1 END * coalesce(floor(100 * amount + 0.5), quantity * floor(100 * price + 0.5), 0) AS cents
  FROM a LEFT JOIN items i USING (item_id) LEFT JOIN vendors v USING (vendor_id)),
newest AS (SELECT b, max(max(s)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM l GROUP BY b),
d AS (SELECT nation_id, item_id, a, any_value(l.b) AS b, sum(cents) AS delta FROM l JOIN newest n ON n.b = l.b
  WHERE nation_id IS NOT NULL AND item_id IS NOT NULL AND (n.s IS NULL OR l.s + 8 >= n.s) GROUP BY nation_id, item_id, a),
r AS (SELECT *, sum(delta) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS revenue, lead(a) OVER (PARTITION BY nation_id, item_id ORDER BY a) AS til FROM d),
days AS (SELECT nation_id, a AS day, any_value(b) AS b, row_number() OVER (PARTITION BY nation_id ORDER BY a) AS n FROM d GROUP BY nation_id, a),
x AS (SELECT r.nation_id, item_id, day, days.b, n, revenue FROM r JOIN days ON r.nation_id = days.nation_id AND a <= day AND (til IS NULL OR day < til)),
k AS (SELECT *, row_number() OVER (PARTITION BY nation_id, n ORDER BY revenue DESC, item_id) AS k FROM x WHERE revenue > 0 QUALIFY k <= 10),
c AS (SELECT coalesce(o.nation_id, k.nation_id) AS nation_id, coalesce(o.n + 1, k.n) AS n, coalesce(o.item_id, k.item_id) AS item_id, o.k AS old_rank, k.k AS new_rank
  FROM k FULL JOIN k o ON o.nation_id = k.nation_id AND o.item_id = k.item_id AND o.n + 1 = k.n)
SELECT c.nation_id, CAST(x.day AS BIGINT) AS arrival_day, c.item_id, CAST(x.b AS INTEGER) AS batch, CASE WHEN old_rank IS NULL THEN 'enter' WHEN new_rank IS NULL THEN 'exit' ELSE 'move' END AS change,
  CAST(old_rank AS INTEGER) AS old_rank, CAST(new_rank AS INTEGER) AS new_rank, CAST(revenue AS BIGINT) AS revenue
FROM c JOIN x ON x.nation_id = c.nation_id AND x.n = c.n AND x.item_id = c.item_id WHERE old_rank IS DISTINCT FROM new_rank
"""


def op13_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repair.repair(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", repair.digest(F.col("repaired")).alias("repaired_sha256"))


OP13_SQL = rf"""
{CRC_TABLE},
z AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc_sql("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS z FROM conversations, crc_table),
d AS (SELECT conv_id, turn, CASE WHEN z = 4 THEN 'user' ELSE role END AS role, CASE z WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM z, range(2) r(j) WHERE z <> 0 AND (j = 0 OR z = 3)),
o AS (SELECT *, row_number() OVER w AS i, lag(role[1]) OVER w AS before FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 256), sha256(text))),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen, CASE WHEN NOT regexp_matches(text, {WORD_SQL}) THEN 'b' WHEN seen > 1 THEN 'd' WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM o),
n AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (before IS NOT NULL AND before || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
ins(p, m, letters, put) AS (VALUES (0, 0, '', ''), (1, 1, '', ''), (2, 2, '', ''), (3, 3, '', ''), (0, 2, 'I', 'user:' || chr(10)), (1, 2, 'I', 'user:' || chr(10)), (3, 2, 'I', 'user:' || chr(10)), (2, 3, 'I', 'assistant:' || chr(10)),
  (0, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (3, 3, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 'II', 'assistant:' || chr(10) || 'user:' || chr(10))),
op(letter, who, m, q, cost) AS (VALUES ('D', '', 0, 0, 4), ('D', '', 1, 1, 4), ('D', '', 2, 2, 4), ('D', '', 3, 3, 4), ('K', 's', 0, 1, 0), ('K', 'u', 0, 2, 0), ('K', 'u', 1, 2, 0), ('K', 'u', 3, 2, 0), ('K', 'a', 2, 3, 0),
  ('R', 'user', 0, 2, 3), ('R', 'user', 1, 2, 3), ('R', 'user', 3, 2, 3), ('R', 'assistant', 2, 3, 3)),
dp(conv_id, i, q, b) AS (
  SELECT conv_id, CAST(0 AS BIGINT), 0, {{'cost': 0, 'audit': '', 'put': ''}} FROM n
  UNION ALL
  SELECT f.conv_id, f.i, op.q, min({{'cost': b.cost + 3 * length(letters) + op.cost + CASE WHEN fault = 't' AND letter <> 'D' THEN 3 ELSE 0 END, 'audit': b.audit || letters || letter,
    'put': b.put || ins.put || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN role || ':' || text || chr(10) ELSE who || ':' || text || chr(10) END}})
  FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.i = dp.i + 1 JOIN ins ON ins.p = dp.q JOIN op ON op.m = ins.m AND (letter = 'D' OR (fault NOT IN ('b', 'd') AND (letter = 'R' OR role[1] = who)))
  GROUP BY f.conv_id, f.i, op.q),
e AS (SELECT dp.conv_id, min({{'cost': b.cost + 3 * length(letters), 'audit': b.audit || letters, 'put': b.put || ins.put}}) AS b
  FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN ins ON ins.p = dp.q AND ins.m IN (0, 3) GROUP BY dp.conv_id)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(b.cost, 0) AS BIGINT) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(b.put[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN n ON n.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_mix_sources": op2_mix_sources,
    "op3_score_texts": op3_score_texts,
    "op4_filter_urls": op4_filter_urls,
    "op5_format_chat": op5_format_chat,
    "op6_pack": op6_pack,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_quality_rules": op8_quality_rules,
    "op9_count_tokens": op9_count_tokens,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_toxicity": op11_toxicity,
    "op12_leader_changes": op12_leader_changes,
    "op13_repair_conversations": op13_repair_conversations,
}
ORACLES = {"op1_top_k": OP1_SQL, "op4_filter_urls": OP4_SQL, "op5_format_chat": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op8_quality_rules": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op12_leader_changes": OP12_SQL, "op13_repair_conversations": OP13_SQL}
