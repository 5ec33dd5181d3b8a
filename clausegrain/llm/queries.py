"""The queries opN_<name> over whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausegrain.llm import chat, decontam, packing, pii, ppm, quality, resample, secrets, simhash, topk, urlrules, veccodes, warc
from clausegrain.llm.common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op8_simhash_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents")).drop("lang", "source")


def op6_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.scores(table(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    more = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "IF(id = 0, 'user', 'assistant') AS role").withColumn("text", F.lit(said))
    return chat.digests(chat.rendered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)))


def op3_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op4_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.table_of(table(spark, sf_dir, "documents"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.table_of(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=10, least_words=20)


def op12_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), k=10, every=100)


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return veccodes.codes(table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_chat_formatting, op3_url_rules, op4_secret_spans, op5_quality_rules, op6_warc_captures, op7_ppm_scores, op8_simhash_links, op9_pii_spans, op10_decontamination, op11_importance_resampling, op12_threshold_topk, op13_vector_codes)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Whole components of the vectors that take part.
WHOLE = """e AS (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))"""


def _codes_sql(rounds: int = 4) -> str:
    """The rounds of op13, one after another: a (nearest entries) and c (entries) of each. Products of doubles are exact at these sizes."""
    near = """a{k} AS (SELECT rid, part, min_by(entry, struct_pack(d := d, e := entry)) AS entry, min(d) AS d
         FROM (SELECT p.rid, p.part, c.entry, p.pp - 2 * list_dot_product(p.x, c.x) + list_dot_product(c.x, c.x) AS d FROM p JOIN c{k} AS c USING (part)) GROUP BY rid, part)"""
    move = """s{k} AS (SELECT part, entry, i, floor(sum(x[i]) / count(*)) AS m FROM p JOIN a{k} USING (rid, part), (SELECT unnest(range(1, CAST((SELECT w FROM width) AS BIGINT) + 1)) AS i) GROUP BY ALL),
m{k} AS (SELECT part, entry, list(m ORDER BY i) AS x FROM s{k} GROUP BY ALL),
c{n} AS (SELECT part, entry, coalesce(m{k}.x, c{k}.x) AS x FROM c{k} LEFT JOIN m{k} USING (part, entry))"""
    steps = ",\n".join(t.format(k=k, n=k + 1) for k in range(rounds) for t in (near, move)) + ",\n" + near.format(k=rounds)
    return f"""
WITH {WHOLE},
width AS (SELECT max(len(v)) // 4 AS w FROM e),
p AS (SELECT rid, part, x, list_dot_product(x, x) AS pp FROM (SELECT rid, part, CAST(v[part * w + 1:part * w + w] AS DOUBLE[]) AS x FROM e, width, (SELECT unnest(range(4)) AS part))),
c0 AS (SELECT part, entry, x FROM p JOIN (SELECT rid, row_number() OVER (ORDER BY vec_id, v) - 1 AS entry FROM e WHERE vec_id IS NOT NULL QUALIFY entry < 256) USING (rid)),
{steps},
o AS (SELECT rid, string_agg(lower(printf('%02x', CAST(entry AS INTEGER))), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN o USING (rid), h"""


ORACLE_SQL: dict[str, str] = {
    "op11_importance_resampling": rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
g AS (SELECT regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
dw AS (SELECT rid, unnest(ws) AS word FROM t), bw AS (SELECT unnest(ws) AS word FROM g),
words AS (SELECT word, lower(hex(encode(word))) AS hex FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
step AS (SELECT list_transform(range(16), lambda i: list_reduce([i, 1, 1, 1, 1], lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS table16),
crc AS (SELECT word, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(length(hex)), lambda i: CAST(instr('0123456789abcdef', hex[i + 2 - 2 * (i % 2):i + 2 - 2 * (i % 2)]) - 1 AS BIGINT))),
               lambda c, n: xor(table16[xor(c % 16, n) + 1], c // 16))) % 10000 AS bucket FROM words, step),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN crc USING (word) GROUP BY bucket), b AS (SELECT bucket, count(*) AS t FROM bw JOIN crc USING (word) GROUP BY bucket),
n AS (SELECT (SELECT count(*) FROM dw) AS s_all, (SELECT count(*) FROM bw) AS t_all),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST((coalesce(t, 0) + 1) * (s_all + 10000) AS DOUBLE) / CAST((s + 1) * (t_all + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN b USING (bucket), n),
w AS (SELECT rid, count(*) AS n_features, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM dw JOIN crc USING (word) JOIN gain USING (bucket) GROUP BY rid),
o AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || sha256(concat('2024:', doc_id))[1:8] AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM t LEFT JOIN w USING (rid)),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) FILTER (n_features >= 20) OVER () AS eligible FROM o)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * eligible // 100 THEN place END AS rank FROM r""",
    "op12_threshold_topk": f"""
WITH {WHOLE},
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score FROM e AS q JOIN e AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10""",
    "op13_vector_codes": _codes_sql(),
    "op2_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, CASE WHEN regexp_matches(text, '\\|</turn>|### (User|Assistant|System|Tool|@[^\\:\n]*): ') THEN len(regexp_replace(text, '(\\|</turn>|### )', '+\1', 'g')) ELSE len(text) END AS body FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(len(role) + 14 + body) AS BIGINT) AS formatted_chars FROM e GROUP BY conv_id""",
    "op5_quality_rules": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, ws[i:i + 4] AS win FROM w, unnest(range(1, len(ws) - 3)) AS t(i)),
again AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
rep AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS j FROM again) GROUP BY rid),
c AS (SELECT rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(rep.n, 0) AS n_repeat_words, CAST(len(ls) AS BIGINT) AS n_lines, CAST(length(regexp_replace(text, '[^!-/:-@\x5B-\x60\x7B-\x7E]', '', 'g')) AS BIGINT) AS n_marks
      FROM w LEFT JOIN rep USING (rid)),
r AS (SELECT *, (n_marks + 1) / (word_chars + 20) AS marks, word_chars / greatest(n_words, 1) AS word_length, greatest(n_words, 1) / greatest(n_lines, 1) AS line_length FROM c),
long AS (SELECT lang, source, unnest(['marks', 'word_length', 'line_length']) AS metric, unnest([marks, word_length, line_length]) AS value FROM r WHERE n_words > 0),
b AS (SELECT lang, source, metric, CAST(ceil(ln(value) / ln(1.01 / 0.99)) AS INTEGER) AS bucket, count(*) AS n FROM long GROUP BY ALL),
s AS (SELECT lang, source, 0 AS level, metric, bucket, n FROM b
      UNION ALL SELECT lang, NULL, 1, metric, bucket, sum(n) FROM b GROUP BY lang, metric, bucket
      UNION ALL SELECT NULL, NULL, 2, metric, bucket, sum(n) FROM b GROUP BY metric, bucket),
u AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, level, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, level, metric) AS total,
             ln(2 * pow(1.01 / 0.99, bucket) / (1.01 / 0.99 + 1)) AS v FROM s),
q AS (SELECT lang, source, level, metric, max(total) AS n, min(v) FILTER (4 * upto >= total) AS q1, min(v) FILTER (4 * upto >= 3 * total) AS q3 FROM u GROUP BY ALL),
q1 AS (SELECT o.lang, o.metric, (o.n * o.q1 + 100 * p.q1) / (o.n + 100) AS q1, (o.n * o.q3 + 100 * p.q3) / (o.n + 100) AS q3 FROM q AS o JOIN q AS p ON o.level = 1 AND p.level = 2 AND o.metric = p.metric),
q0 AS (SELECT o.lang, o.source, o.metric, (o.n * o.q1 + 100 * p.q1) / (o.n + 100) AS q1, (o.n * o.q3 + 100 * p.q3) / (o.n + 100) AS q3
       FROM q AS o JOIN q1 AS p ON o.level = 0 AND o.metric = p.metric AND o.lang IS NOT DISTINCT FROM p.lang),
l AS (SELECT lang, source, exp(max(q3 + 3 * (q3 - q1)) FILTER (metric = 'marks')) AS high_marks, exp(max(q1 - 3 * (q3 - q1)) FILTER (metric = 'word_length')) AS low_word,
             exp(max(q3 + 3 * (q3 - q1)) FILTER (metric = 'word_length')) AS high_word, exp(max(q1 - 3 * (q3 - q1)) FILTER (metric = 'line_length')) AS low_line FROM q0 GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND (greatest(n_marks - 2 * sqrt(n_marks), 0) + 1) / (word_chars + 20) <= high_marks
       AND word_length * (1 + 2 / sqrt(greatest(n_words, 1))) >= low_word AND word_length * (1 - 2 / sqrt(greatest(n_words, 1))) <= high_word
       AND line_length * (1 + 2 / sqrt(greatest(n_lines, 1))) >= low_line AS kept
FROM r LEFT JOIN l ON r.lang IS NOT DISTINCT FROM l.lang AND r.source IS NOT DISTINCT FROM l.source""",
    "op6_warc_captures": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
bits AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || hex[5 * i + 1:5 * i + 5] AS BIGINT)) AS parts, max(page_id) OVER (PARTITION BY hex) AS first FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
       array_to_string(flatten(list_transform(parts, lambda x: list_transform([32768, 1024, 32, 1], lambda d: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(x // d % 32 AS INTEGER) + 1]))), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM bits""",
    "op10_decontamination": rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
items AS (SELECT row_number() OVER () AS bid, CAST(item_id AS VARCHAR) AS item, ws FROM b WHERE len(ws) > 0),
win AS (SELECT bid, item, j, least(13, len(ws)) AS k, array_to_string(ws[j:j + 12], ' ') AS win FROM items, unnest(range(1, greatest(2, len(ws) - 11))) AS t(j)),
places AS (SELECT rid, i, k, array_to_string(ws[i:i + k - 1], ' ') AS win
       FROM d, unnest(range(1, len(ws) + 1)) AS t(i), (SELECT DISTINCT k FROM win) AS ks WHERE i + k - 1 <= len(ws)),
occ AS (SELECT rid, i, k, bid, item, j, i - j AS diagonal FROM places JOIN win USING (win, k)),
hit AS (SELECT rid, count(DISTINCT w) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS w FROM occ) GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid),
parts AS (SELECT *, i - row_number() OVER (PARTITION BY rid, bid, diagonal ORDER BY i) AS part FROM occ),
matches AS (SELECT rid, item, min(i) - 1 AS doc_start, min(j) - 1 AS item_start, CAST(max(k) + count(*) - 1 AS BIGINT) AS longest FROM parts GROUP BY rid, bid, item, diagonal, part),
best AS (SELECT rid, longest, item AS longest_item, item_start, doc_start FROM matches QUALIFY row_number() OVER (PARTITION BY rid ORDER BY longest DESC, doc_start, item, item_start) = 1)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated, longest, longest_item, item_start, doc_start
FROM d LEFT JOIN hit USING (rid) LEFT JOIN found USING (rid) LEFT JOIN best USING (rid)""",
}
