"""Queries of sources, sinks, runs, training and streams: the given tables are written to the shared folder and come back through the library, with the SQL that gives the same rows."""

from __future__ import annotations

import lzma
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausegrain.functions import labels as L
from clausegrain.functions.taxonomy import CATEGORIES, label_col
from clausegrain.operators import linear, quality, relations as R, runs, selection as S, splits
from clausegrain.plans import adapters as A, suites
from clausegrain.plans.adapters import CLAUSES, LABELLED, TAXONOMY, table
from clausegrain.plans.catalogue import ENSEMBLE, ORACLE_SQL, SPLIT, VOTES, query, scored, with_split
from clausegrain.sources import files, sinks, versions
from clausegrain.streaming.resume import shared_dir


#: Folders that files of single documents are dealt to.
FOLDERS = 256


def folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def name_of(path: str = "path"):
    return F.regexp_extract(path, r"([^/]+)$", 1)


def named_texts(spark: SparkSession, d: str) -> DataFrame:
    """documents with a text, each as a file name and its text."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", "text", F.format_string("%d.txt", "doc_id").alias("name"))


# ---------------------------------------------------------------- sources

LATIN = "regexp_matches(text, '^[\\x{00}-\\x{FF}]*$') AND regexp_matches(text, '[\\x{C0}-\\x{FF}][\\x{00}-\\x{7F}]')"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(length(text) AS INTEGER) AS n_chars, md5(text) AS digest,
CASE WHEN NOT regexp_matches(text, '\\S') THEN 'empty document' WHEN {LATIN} THEN 'decoded as Latin-1' END AS warning FROM documents WHERE text IS NOT NULL""")
def text_files(spark: SparkSession, d: str) -> DataFrame:
    """Files of texts, some in Latin-1, read with the fallback."""
    at = folder(spark, "texts")
    latin = F.col("text").rlike(r"^[\x00-\xFF]*\z") & F.col("text").rlike(r"[\xC0-\xFF][\x00-\x7F]")
    body = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    sinks.write_files(named_texts(spark, d).select("name", body.alias("content")), at, spread=FOLDERS)
    return files.texts(spark, at, recursive=True).select("document_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "warning")


@query("SELECT doc_id || '.txt' AS name, CAST(strlen(text) AS BIGINT) AS length FROM documents WHERE text IS NOT NULL")
def file_listing(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "texts")
    sinks.write_files(named_texts(spark, d).select("name", F.col("text").alias("content")), at, spread=FOLDERS)
    return files.listing(spark, at, ".TXT", recursive=True).select(name_of().alias("name"), "length")


@query("""WITH b AS (SELECT doc_id, pos, trim(ls[pos + 1], chr(32) || chr(9) || chr(10)) AS text, pos % 4 = 3 AS no_tag, pos % 5 = 2 AS no_labels FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(len(ls))) AS t(pos))
SELECT CAST(doc_id AS VARCHAR) AS doc_id, CAST(pos AS INTEGER) AS clause_index, CASE WHEN NOT no_tag AND NOT no_labels AND text <> '' THEN text END AS text, CASE WHEN no_tag THEN 'no class tag' WHEN no_labels THEN 'no labels' WHEN text = '' THEN 'empty text' END AS warning FROM b""")
def annotated_folder(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "annotated")
    blocks = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("[INIT_CLAUSE]"), x, F.when(i % 4 == 3, "").otherwise(F.concat(F.lit("[INIT_CLASSE]"), F.when(i % 5 == 2, " , ").otherwise(" Purpose, NDA Type "), F.lit("[END_CLASSE]"))), F.lit("[END_CLAUSE]")))
    sinks.write_files(named_texts(spark, d).select("name", F.array_join(blocks, "\n").alias("content")), at, spread=FOLDERS)
    return files.annotated(spark, at, recursive=True).select("doc_id", "clause_index", "text", "warning")


def as_csv(spark: SparkSession, d: str) -> str:
    at = folder(spark, "csv")
    table(spark, d, "documents").select("doc_id", "lang", "source", "text").write.options(**sinks.WHOLE).csv(at, header=True, quoteAll=True)
    return at


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS digest FROM documents")
def strict_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.strict_csv(spark, as_csv(spark, d)).select("doc_id", "lang", "source", F.md5("text").alias("digest"))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, nullif(coalesce(lang, ''), 'de') AS lang, md5(coalesce(text, '')) AS digest FROM documents")
def lenient_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    return files.lenient_csv(spark, as_csv(spark, d), ("doc_id", "lang", "source", "text"), "de").select("doc_id", "lang", F.md5("text").alias("digest"))


@query("""SELECT CASE WHEN o_orderkey % 7 = 1 THEN NULL ELSE o_orderkey END AS key, CASE WHEN o_orderkey % 5 IN (1, 2) THEN NULL ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 3 = 1 THEN NULL ELSE o_orderstatus END AS status,
'key,price,status' AS columns FROM orders""")
def typed_csv_rows(spark: SparkSession, d: str) -> DataFrame:
    at, k = folder(spark, "csv"), F.col("o_orderkey")
    odd = table(spark, d, "orders").select(
        F.when(k % 7 == 1, "N/A").otherwise(k.cast("string")).alias("key"), F.when(k % 5 == 1, "nan").when(k % 5 == 2, "much").otherwise(F.col("o_totalprice").cast("string")).alias("price"), F.when(k % 3 == 1, "NULL").otherwise(F.col("o_orderstatus")).alias("status"),
    )
    odd.write.csv(at, header=True)
    rows = files.typed_csv(spark, at, "key long, price double, status string")
    return rows.withColumn("columns", F.lit(",".join(files.header(spark, at))))


@query("""SELECT CAST(conv_id AS VARCHAR) || '.json' AS name, 1 + count(*) AS records, count(*) FILTER (coalesce(text, '') <> '' AND coalesce(role, '') = 'assistant') AS candidates FROM conversations GROUP BY conv_id""")
def label_audit_rows(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file for each conversation; the assistant's turns have a label."""
    at = folder(spark, "json")
    turn = F.struct(F.col("turn"), F.col("text"), F.array_compact(F.array(F.when(F.col("role") == "assistant", "said"))).alias("Labels"))
    whole = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    sinks.write_files(whole.select(F.format_string("%d.json", "conv_id").alias("name"), F.to_json(F.struct(F.col("conv_id").alias("number"), "turns")).alias("content")), at)
    return files.label_audit(spark, at).select(name_of().alias("name"), "records", "candidates")


@query("""SELECT [CAST(doc_id AS VARCHAR), coalesce(lang, '')] AS keys, coalesce(source, '') AS source, CAST(length(coalesce(text, '')) AS VARCHAR) AS n_chars FROM documents""")
def xz_rows(spark: SparkSession, d: str) -> DataFrame:
    """XZ files of a task's rows each, six columns."""
    at = folder(spark, "xz")
    line = F.concat_ws("\t", F.concat_ws(" ", F.col("doc_id").cast("string"), F.coalesce("lang", F.lit(""))), F.coalesce("source", F.lit("")), F.length(F.coalesce("text", F.lit(""))).cast("string"), F.lit("a"), F.lit("b"), F.lit("c"))
    parts = table(spark, d, "documents").select(line.alias("line"), F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")).groupBy("part").agg(F.concat(F.array_join(F.collect_list("line"), "\n"), F.lit("\n")).alias("content"))
    sinks.write_files(parts.select(F.format_string("%d.tsv.xz", "part").alias("name"), "content"), at, pack=lzma.compress)
    return files.xz_tsv(spark, at).select("keys", F.col("fields")[1].alias("source"), F.col("fields")[2].alias("n_chars"))


@query("SELECT line, split_part(pair, '=', 1) AS key, split_part(pair, '=', 2) AS value FROM (SELECT line, unnest(string_split(line, ' ')) AS pair FROM (SELECT 'order=' || o_orderkey || ' status=' || o_orderstatus || ' customer=' || o_custkey AS line FROM orders))")
def key_value_rows(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "pairs")
    table(spark, d, "orders").select(F.format_string("order=%d status=%s customer=%d", "o_orderkey", "o_orderstatus", "o_custkey")).write.text(at)
    return files.key_values(spark, at)


@query("SELECT event_type AS experiment, 'N/A' AS model, count(*) / 8 AS macro_f1, count(DISTINCT user_id) / 8 AS micro_f1, 0.0 AS weighted_f1 FROM events GROUP BY event_type")
def experiment_logs(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "experiments")
    logs = table(spark, d, "events").groupBy("event_type").agg((F.count("*") / 8).alias("macro_f1"), (F.count_distinct("user_id") / 8).alias("micro_f1"))
    broken = spark.range(1).select(F.lit("broken.json").alias("name"), F.lit('{"macro_f1": ').alias("content"))
    sinks.write_files(logs.select(F.concat("event_type", F.lit(".json")).alias("name"), F.to_json(F.struct(F.col("event_type").alias("experiment"), "macro_f1", "micro_f1")).alias("content")).unionByName(broken), at)
    return files.experiments(spark, at).select("experiment", "model", "macro_f1", "micro_f1", "weighted_f1").where("macro_f1 > 0")


@query("SELECT CAST(doc_id AS VARCHAR) AS document_id FROM documents")
def manifest_ids(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of some documents each."""
    at = folder(spark, "manifests")
    parts = table(spark, d, "documents").groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(64)).alias("part")).agg(F.collect_list(F.col("doc_id").cast("string")).alias("document_ids"))
    body = F.to_json(F.struct(F.size("document_ids").alias("sample_size"), F.lit(42).alias("random_seed"), F.size("document_ids").alias("actual_count"), "document_ids"))
    sinks.write_files(parts.select(F.format_string("%d.json", "part").alias("name"), body.alias("content")), at)
    return files.manifest(spark, at)


LEVEL = "t{k} AS (SELECT left(p, {k}) AS p, sha256(string_agg(p || '=' || d, chr(10) ORDER BY p)) AS d FROM t{up} GROUP BY left(p, {k}))"


@query(f"""WITH t4 AS (SELECT left(md5(doc_id || '.txt'), 4) AS p, sha256(string_agg(doc_id || '.txt=' || sha256(text) || '=1', chr(10) ORDER BY doc_id || '.txt' || '=')) AS d FROM documents WHERE text IS NOT NULL GROUP BY 1),
{', '.join(LEVEL.format(k=k, up=k + 1) for k in (3, 2, 1, 0))} SELECT d AS digest FROM t0""")
def files_digest(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "texts")
    sinks.write_files(named_texts(spark, d).select("name", F.col("text").alias("content")), at, spread=FOLDERS)
    return files.manifest_digest(files.fingerprints(spark, at).withColumn("path", name_of()))


SPANNED = """spanned AS (SELECT doc_id, pos, text, printf('%d_clause_%03d', doc_id, pos) AS clause_id, CAST(pos * 10 AS INTEGER) AS start FROM clauses)"""


def spanned(spark: SparkSession, d: str) -> DataFrame:
    return A.clauses(spark, d).select(
        F.col("doc_id").cast("string").alias("document_id"), "clause_id", "text", (F.col("pos") * 10).alias("start"), (F.col("pos") * 10 + F.length("text")).alias("end"), F.when(F.col("pos") % 3 == 0, "header").otherwise("legal_clause").alias("segment_type"), (F.col("pos") % 4 == 0).alias("is_suspicious"),
    )


@query(f"""WITH {CLAUSES}, {SPANNED} SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id || '.json' AS source, clause_id, text AS clause_text, start, CAST(start + length(text) AS INTEGER) AS "end",
CASE WHEN pos % 3 = 0 THEN 'header' ELSE 'legal_clause' END AS segment_type, pos % 4 = 0 AS is_suspicious FROM spanned""")
def segmented_files(spark: SparkSession, d: str) -> DataFrame:
    """A JSON file for each segmented document, read with its checks of identity."""
    at = folder(spark, "segmented")
    clause = F.struct("document_id", "clause_id", "text", "start", "end", "segment_type", "is_suspicious")
    nested = spanned(spark, d).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start", clause.alias("c")))).alias("of"))
    body = F.to_json(F.struct("document_id", F.concat("document_id", F.lit(".txt")).alias("source_file"), F.size("of").alias("num_clauses"), F.transform("of", lambda x: x["c"]).alias("clauses")))
    sinks.write_files(nested.select(F.concat("document_id", F.lit(".json")).alias("name"), body.alias("content")), at)
    return files.segmented_checked(spark, at)


# ---------------------------------------------------------------- sinks


@query(f"WITH {CLAUSES}, {SPANNED} SELECT CAST(doc_id AS VARCHAR) AS document_id, count(*) AS num_clauses, string_agg(clause_id, ',' ORDER BY start) AS ids, CAST(max(start) AS BIGINT) AS last_start FROM spanned GROUP BY doc_id")
def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "nested")
    sinks.write_documents(spanned(spark, d), at)
    back = spark.read.json(at)
    return back.select("document_id", "num_clauses", F.array_join(F.transform("clauses", lambda c: c["clause_id"]), ",").alias("ids"), F.array_max(F.transform("clauses", lambda c: c["start"])).alias("last_start"))


@query(f"WITH {CLAUSES}, {LABELLED} SELECT clause_id, md5(text) AS digest, array_to_string(labels, ', ') AS labels FROM clause_labels")
def clauses_as_csv(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "csv")
    sinks.write_clauses(A.clause_labels(spark, d).select("clause_id", "text", "labels"), at, "csv")
    return files.lenient_csv(spark, at, ("clause_id", "text", "labels")).select("clause_id", F.md5("text").alias("digest"), "labels")


@query(f"WITH {CLAUSES}, {LABELLED} SELECT clause_id, md5(text) AS digest, labels FROM clause_labels")
def clauses_as_json(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "json")
    sinks.write_clauses(A.clause_labels(spark, d).select("clause_id", "text", "labels"), at)
    return spark.read.schema("clause_id string, text string, labels array<string>").json(at).select("clause_id", F.md5("text").alias("digest"), "labels")


@query(f"WITH {CLAUSES}, {LABELLED}, s AS (SELECT *, {SPLIT} AS split FROM clause_labels) SELECT split, count(*) AS clauses, count(DISTINCT doc_id) AS documents, count(*) AS rows_read, count(DISTINCT doc_id) AS documents_read FROM s GROUP BY split")
def split_files(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "splits")
    sinks.write_splits(with_split(A.clause_labels(spark, d)), at)
    rows = spark.read.json(f"{at}/rows").groupBy("split").agg(F.count("*").alias("rows_read"))
    documents = spark.read.json(f"{at}/split_documents").groupBy("split").agg(F.count("*").alias("documents_read"))
    return spark.read.json(f"{at}/split_info").join(rows, "split").join(documents, "split")


@query(f"WITH {CLAUSES} SELECT unnest(['clauses', 'documents', 'longest']) AS metric, unnest([CAST(count(*) AS VARCHAR), CAST(count(DISTINCT doc_id) AS VARCHAR), CAST(max(length(text)) AS VARCHAR)]) AS value FROM clauses")
def statistics_file(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "statistics")
    sinks.write_statistics(A.clauses(spark, d).agg(F.count("*").alias("clauses"), F.count_distinct("doc_id").alias("documents"), F.max(F.length("text")).alias("longest")), at)
    return files.lenient_csv(spark, at, ("metric", "value"))


@query(f"WITH {CLAUSES} SELECT CAST(count(*) AS BIGINT) AS clauses, CAST(count(DISTINCT doc_id) AS BIGINT) AS documents FROM clauses")
def metadata_file(spark: SparkSession, d: str) -> DataFrame:
    at = folder(spark, "metadata")
    sinks.write_metadata(A.clauses(spark, d).agg(F.count("*").alias("clauses"), F.count_distinct("doc_id").alias("documents")), at)
    return spark.read.schema("clauses long, documents long").json(at)


@query("SELECT doc_id, lang, source FROM documents UNION ALL SELECT doc_id, NULL, source FROM documents")
def aligned_append(spark: SparkSession, d: str) -> DataFrame:
    """A table to which rows with a column more and one less are appended."""
    at, rows = folder(spark, "aligned"), table(spark, d, "documents").select("doc_id", "lang", "source")
    sinks.append_aligned(rows, at)
    sinks.append_aligned(rows.drop("lang").withColumn("extra", F.lit(1)), at)
    return spark.read.parquet(at)


@query("""WITH u AS (SELECT l_orderkey AS o_orderkey, 'X' AS o_orderstatus, max(l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey),
v AS (SELECT o.o_orderkey, coalesce(u.o_orderstatus, o.o_orderstatus) AS o_orderstatus, coalesce(CAST(u.lines AS BIGINT), 0) AS lines, o.o_orderdate FROM orders o LEFT JOIN u USING (o_orderkey)
  UNION ALL SELECT o_orderkey, o_orderstatus, CAST(lines AS BIGINT), NULL FROM u WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders))
SELECT o_orderkey, o_orderstatus, lines, o_orderdate, 3 AS version FROM v WHERE lines < 6""")
def versioned_table(spark: SparkSession, d: str) -> DataFrame:
    """Three versions of a table: orders; what their lines say in place of them, but for the date; those of fewer than six lines, as the others are done."""
    at = folder(spark, "orders")
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.lit(0).cast("long").alias("lines"), "o_orderdate")
    versions.write(orders, at)
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_linenumber").cast("long").alias("lines"))
    changed = lines.select("o_orderkey", F.lit("X").alias("o_orderstatus"), "lines", F.lit(None).cast(orders.schema["o_orderdate"].dataType).alias("o_orderdate"))
    versions.upsert(changed, at, "o_orderkey", keep=("o_orderdate",))
    number = versions.shrink(lines.where("lines >= 6"), at, "o_orderkey")
    return versions.read(spark, at).withColumn("version", F.lit(number))


@query(f"""WITH {CLAUSES}, {LABELLED}, {TAXONOMY}, n AS (SELECT category, count(*) AS n FROM (SELECT unnest(labels) AS category FROM clause_labels) GROUP BY 1),
r AS (SELECT t.category, coalesce(n, 0) AS n, row_number() OVER (ORDER BY coalesce(n, 0) DESC, t.category) AS k FROM taxonomy t LEFT JOIN n USING (category)),
l AS (SELECT 0 AS k, '| category | n |' AS line UNION ALL SELECT 1, '| --- | --- |' UNION ALL SELECT k + 1, '| ' || category || ' | ' || n || ' |' FROM r) SELECT CAST(k AS BIGINT) AS line_number, line FROM l""")
def markdown_lines(spark: SparkSession, d: str) -> DataFrame:
    """Fourteen rows as Markdown."""
    counts = A.clause_labels(spark, d).select(F.explode("labels").alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    all_ = spark.createDataFrame([(c,) for c in CATEGORIES], "category string").join(counts, "category", "left").na.fill(0)
    text = sinks.markdown(all_.orderBy(F.desc("n"), "category"))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line_number long, line string")


@query(f"WITH {CLAUSES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos, text) AS k FROM clauses) SELECT doc_id, md5(string_agg('[' || k || '] ' || text, chr(10) || chr(10) ORDER BY k)) AS digest FROM n GROUP BY doc_id")
def review_texts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.document_text(A.clauses(spark, d), "doc_id", "pos").select("doc_id", F.md5("text").alias("digest"))


# ---------------------------------------------------------------- relations, rows that other queries leave out


@query(f"WITH {CLAUSES}, {LABELLED} SELECT clause_id, doc_id, position FROM (SELECT clause_id, doc_id, row_number() OVER (ORDER BY length(text) DESC, clause_id) AS position FROM clauses) WHERE position <= 500")
def ordered_subset(spark: SparkSession, d: str) -> DataFrame:
    """The clauses of a list, with their places in it."""
    listed = A.clauses(spark, d).select("clause_id", F.length("text").alias("n")).orderBy(F.desc("n"), "clause_id").limit(500)
    order = R.numbered(listed, None, F.desc("n"), "clause_id").select("clause_id", (F.col("_rank") + 1).alias("position"))
    return R.in_order(A.clauses(spark, d).select("clause_id", "doc_id"), order, "clause_id", "position").select("clause_id", "doc_id", "position")


@query("""WITH s AS (SELECT CASE WHEN doc_id % 3 = 0 THEN 'p' ELSE 's' END AS k, clause_id FROM clauses), o AS (SELECT *, row_number() OVER (ORDER BY md5(clause_id), clause_id) AS r FROM s WHERE k = 's')
SELECT clause_id, 'priority' AS reason FROM s WHERE k = 'p' UNION ALL SELECT clause_id, 'sample' FROM o WHERE r <= 20""".replace("WITH s", f"WITH {CLAUSES}, s"))
def audited_queue(spark: SparkSession, d: str) -> DataFrame:
    return S.audited_queue(A.clauses(spark, d).select("clause_id", "doc_id"), F.col("doc_id") % 3 == 0, "clause_id", 20).select("clause_id", "reason")


@query(f"WITH {CLAUSES} SELECT clause_id, score, CAST(row_number() OVER (ORDER BY score DESC, clause_id) AS INTEGER) AS rank FROM (SELECT clause_id, (doc_id * 7 + pos * 3 + length(text)) % 997 AS score FROM clauses)")
def ranked_all(spark: SparkSession, d: str) -> DataFrame:
    """Every clause with its rank: the path without a top."""
    return S.ranked(scored(spark, d).select("clause_id", "score"), "score", "clause_id").withColumn("rank", F.col("rank").cast("int"))


@query(f"""WITH {ENSEMBLE}, f AS (SELECT clause_id, count(*) FILTER (status <> 'SUCCESS') AS bad, count(*) AS n, string_agg(CASE WHEN status = 'SUCCESS' THEN 'said by ' || model ELSE 'down' END, ' | ' ORDER BY model) AS said FROM votes GROUP BY clause_id)
SELECT clause_id, CASE WHEN bad > 0 THEN '[' || bad || '/' || n || ' models failed] ' ELSE '' END || left(said, 250) AS reason FROM f""")
def ensemble_reason(spark: SparkSession, d: str) -> DataFrame:
    from clausegrain.operators import ensemble

    said = F.when(F.col("status") == "SUCCESS", F.concat(F.lit("said by "), "model")).otherwise("down")
    return ensemble.combine(A.votes(spark, d).withColumn("reason", said)).select("clause_id", "reason")


# ---------------------------------------------------------------- runs

RUN_VOTES = "votes AS (" + " UNION ALL ".join(
    f"SELECT clause_id, doc_id, pos, text, '{m}' AS model, [{suites.QUOTED(CATEGORIES)}][length(text) % {k} + 1:length(text) % {k} + 1] AS labels, CAST({c} AS DOUBLE) AS confidence, CASE WHEN {bad} THEN 'API_ERROR' ELSE 'SUCCESS' END AS status FROM clauses"
    for m, k, c, bad in (("a", 14, 0.9, "{a}"), ("b", 7, 0.8, "{b}"), ("c", 14, 0.7, "{c}"))
) + ")"
RUN_ENSEMBLE = ENSEMBLE.removeprefix(f"{CLAUSES}, ").replace(VOTES, RUN_VOTES)


def run_scorer(size: int, confidence: float, dead: tuple[int, ...] = ()):
    """A scorer by rule: the category of a text's length; a text whose length is a multiple of a number in dead fails."""

    def score(texts: list[str]) -> list[tuple[list[str], float, str, str]]:
        return [([], 0.0, "API_ERROR", "down") if any(len(t) % k == 0 for k in dead) else ([CATEGORIES[len(t) % size]], confidence, "SUCCESS", "") for t in texts]

    return score


def _renamed(ctes: str, suffix: str) -> str:
    for name in ("votes", "g", "j", "ens"):
        ctes = ctes.replace(f"{name} AS (", f"{name}{suffix} AS (").replace(f"FROM {name})", f"FROM {name}{suffix})").replace(f"FROM {name} ", f"FROM {name}{suffix} ")
    return ctes


@query(f"""WITH {CLAUSES}, {_renamed(RUN_ENSEMBLE.format(a='length(text) % 5 = 0', b='length(text) % 5 = 0 OR length(text) % 7 = 0', c='length(text) % 5 = 0'), '_ill')}, {_renamed(RUN_ENSEMBLE.format(a='false', b='false', c='false'), '_well')},
o AS (SELECT clause_id, length(text) % 5 = 0 AS bad, row_number() OVER (ORDER BY clause_id) AS r FROM clauses), w AS (SELECT *, r - coalesce(max(r) FILTER (NOT bad) OVER (ORDER BY r), 0) AS in_a_row FROM o),
e AS (SELECT coalesce(min(r), (SELECT max(r) FROM w)) AS last FROM w WHERE in_a_row >= 5)
SELECT clause_id, CASE WHEN w.bad OR r > last THEN 2 ELSE 1 END AS run, CASE WHEN w.bad OR r > last THEN x.labels ELSE y.labels END AS labels, CASE WHEN w.bad OR r > last THEN x.quality ELSE y.quality END AS quality, CASE WHEN w.bad OR r > last THEN x.successes ELSE y.successes END AS successes
FROM w JOIN ens_well AS x USING (clause_id) JOIN ens_ill AS y USING (clause_id), e""")
def ensemble_run(spark: SparkSession, d: str) -> DataFrame:
    """A run that the fifth failure in a row ends, and a second one by scorers that are well, which does the rest."""
    log, queue = folder(spark, "run"), A.clauses(spark, d).select("clause_id", "text")
    runs.run(queue, log, {"a": run_scorer(14, 0.9, (5,)), "b": run_scorer(7, 0.8, (5, 7)), "c": run_scorer(14, 0.7, (5,))}, batch_rows=50_000)
    first = runs.results(spark, log).agg(F.max("batch")).first()[0]
    runs.run(queue, log, {"a": run_scorer(14, 0.9), "b": run_scorer(7, 0.8), "c": run_scorer(14, 0.7)}, batch_rows=500_000)
    return runs.results(spark, log).select("clause_id", F.when(F.col("batch") <= first, 1).otherwise(2).alias("run"), "labels", "quality", "successes")


# ---------------------------------------------------------------- training

TERMS = 2000


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]{{2,}}') AS ws FROM documents),
x AS (SELECT doc_id, unnest(ws) AS term FROM t UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM t),
c AS (SELECT doc_id, term, count(*) AS n FROM x GROUP BY ALL), k AS (SELECT term, sum(n) AS n, count(*) AS df FROM c GROUP BY term ORDER BY n DESC, term LIMIT {TERMS}),
w AS (SELECT doc_id, c.term, (1 + ln(c.n)) * (ln(CAST(1 + (SELECT count(*) FROM documents) AS DOUBLE) / (1 + df)) + 1) AS w FROM c JOIN k USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_weights(spark: SparkSession, d: str) -> DataFrame:
    model, counted = linear.fit_counted(table(spark, d, "documents"), "doc_id", size=TERMS)
    return linear.weighted(counted, model.known, "doc_id").select("doc_id", "term", F.round("weight", 6).alias("weight"))


@query()
def category_models(spark: SparkSession, d: str) -> DataFrame:
    """All categories' classifiers, trained on the clauses of the train documents and judged on the others: category, support, f1."""
    from clausegrain.operators import learning, metrics
    from clausegrain.plans.catalogue import ruled

    rows = with_split(ruled(spark, d))
    model, found = learning.train(rows.where("split = 'train'"), list(CATEGORIES), vocabulary=TERMS, most=30)
    held = rows.where("split <> 'train'").select("clause_id", "text", "labels")
    judged = held.join(learning.predict(held, model, found, "clause_id"), "clause_id").select("category", F.array_contains("labels", F.col("category")).cast("int").alias("y_true"), "y_prob")
    return metrics.per_category(metrics.confusion(judged)).select("category", "support", "f1")


# ---------------------------------------------------------------- streams


@query("""WITH c AS (SELECT user_id, count(*) FILTER (event_type IN ('click', 'error', 'view')) AS reviewed, count(*) FILTER (event_type = 'click') AS accepted, count(*) FILTER (event_type = 'error') AS overridden, count(*) FILTER (event_type = 'view') AS manual,
2 * count(*) FILTER (event_type NOT IN ('click', 'error', 'view')) AS total, min(ts) FILTER (event_type IN ('click', 'error', 'view')) AS first_time, max(ts) FILTER (event_type IN ('click', 'error', 'view')) AS last_time,
arg_max(event_type, {t: ts, e: event_id}) FILTER (event_type IN ('click', 'error', 'view')) AS last_action FROM events GROUP BY user_id)
SELECT user_id, reviewed, accepted, overridden, manual, first_time, last_time, last_action, greatest(0, total - reviewed) AS unreviewed FROM c""")
def review_counters(spark: SparkSession, d: str) -> DataFrame:
    from clausegrain.streaming.counters import of_events

    return of_events(spark, f"{d}/events.parquet", folder(spark, "counters"))


# ---------------------------------------------------------------- strategies and more suites

STRATEGIES = {
    "seventy": "CASE WHEN 100 * size_rank < 70 * docs THEN 'train' WHEN 100 * size_rank < 85 * docs THEN 'validation' ELSE 'test' END", "sixty": "CASE WHEN 100 * size_rank < 60 * docs THEN 'train' WHEN 100 * size_rank < 80 * docs THEN 'validation' ELSE 'test' END",
    "most_categories_tested": "CASE WHEN category_rank = 0 THEN 'test' WHEN category_rank <= 2 THEN 'validation' ELSE 'train' END", "most_categories_trained": "CASE WHEN category_rank = 0 THEN 'train' WHEN category_rank IN (1, 3) THEN 'validation' WHEN size_rank < 5 THEN NULL ELSE 'test' END",
}
PER_SPLIT = ", ".join(
    f"coalesce(max(documents) FILTER (split = '{s}'), 0) AS {s}_documents, coalesce(max(clauses) FILTER (split = '{s}'), 0) AS {s}_clauses, count(*) FILTER (split = '{s}' AND n > 0) AS {s}_categories, list(t.category ORDER BY cat_idx) FILTER (split = '{s}' AND n = 0) AS {s}_lacks" for s in splits.SPLITS
)


@query(f"""WITH {CLAUSES}, {LABELLED}, {TAXONOMY}, n AS (SELECT doc_id, category, count(*) AS n FROM (SELECT doc_id, unnest(labels) AS category FROM clause_labels) GROUP BY ALL), k AS (SELECT doc_id, count(*) AS k FROM n GROUP BY doc_id),
p AS (SELECT doc_id, count(*) AS clauses, coalesce(any_value(k), 0) AS n_categories, row_number() OVER (ORDER BY count(*) DESC, doc_id) - 1 AS size_rank FROM clauses LEFT JOIN k USING (doc_id) GROUP BY doc_id),
q AS (SELECT *, row_number() OVER (ORDER BY n_categories DESC, clauses DESC, doc_id) - 1 AS category_rank, count(*) OVER () AS docs FROM p),
a AS ({" UNION ALL ".join(f"SELECT '{k}' AS strategy, doc_id, clauses, {v} AS split FROM q" for k, v in STRATEGIES.items())}),
s AS (SELECT strategy, split, count(*) AS documents, sum(clauses) AS clauses FROM a GROUP BY ALL), c AS (SELECT strategy, split, category, sum(n) AS n FROM a JOIN n USING (doc_id) GROUP BY ALL),
f AS (SELECT st.strategy, sp.split, t.category, cat_idx, coalesce(n, 0) AS n, documents, s.clauses FROM (SELECT DISTINCT strategy FROM a) AS st, (SELECT unnest(['train', 'validation', 'test']) AS split) AS sp, taxonomy AS t LEFT JOIN s ON s.strategy = st.strategy AND s.split = sp.split LEFT JOIN c ON c.strategy = st.strategy AND c.split = sp.split AND c.category = t.category)
SELECT f.strategy, {PER_SPLIT.replace('t.category', 'f.category')}, (SELECT count(*) FROM a WHERE a.strategy = f.strategy AND a.split IS NULL) AS unassigned FROM f GROUP BY f.strategy""")
def split_strategies(spark: SparkSession, d: str) -> DataFrame:
    """Four strategies over the same documents, in one pass."""
    profile = splits.ranked_profile(A.clause_labels(spark, d), "doc_id")
    profile = profile.crossJoin(F.broadcast(profile.agg(F.count("*").alias("docs"))))  # one row
    rows = splits.judged(profile, {k: F.expr(v) for k, v in STRATEGIES.items()}, "doc_id")
    return rows.withColumns({f"{s}_lacks": F.when(F.size(f"{s}_lacks") > 0, F.col(f"{s}_lacks")) for s in splits.SPLITS})


ANNOTATION_SQL = ORACLE_SQL["dq_annotation_suite"]


@query(f"""SELECT 'queue' AS "table", * FROM ({ANNOTATION_SQL}) UNION ALL SELECT 'db', * FROM ({ANNOTATION_SQL.replace('doc_id * 5 + pos', 'doc_id * 11 + pos')})""")
def dq_annotation_tables(spark: SparkSession, d: str) -> DataFrame:
    known = A.clauses(spark, d).select("clause_id", F.col("doc_id").cast("string").alias("document_id"))
    database = suites.annotation_rows(spark, d, 11).withColumnsRenamed({"label_verified": "verified", "label_reviewer": "reviewer", "label_source": "selection_source"})
    return quality.annotation_tables(suites.annotation_rows(spark, d), database, known).select("table", *suites.SHOWN)


BENCH = suites.BENCH


def checks_sql(values: dict[str, str], more: str = "") -> str:
    return f"WITH {BENCH}{more} " + " UNION ALL ".join(f"""SELECT '{k}' AS "check", CASE WHEN ({v}) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, CAST(({v}) AS BIGINT) AS value FROM v""" for k, v in values.items())


@query(checks_sql({"duplicate_clause_ids": "ids", "document_leakage": "documents", "blank_fields": f"(SELECT count(*) FILTER ({suites.BLANK('clause_text')}) FROM b) + no_doc", "error_rows": "failed", "label_columns": "0"}))
def training_preflight(spark: SparkSession, d: str) -> DataFrame:
    rows = suites.benchmark_rows(spark, d)
    hot = rows.select("clause_id", "document_id", "clause_text", "split", F.col("quality").alias("pseudo_label_quality"), *L.multi_hot(F.coalesce("labels", F.array().cast("array<string>"))))
    return quality.training_preflight(hot)


SYNTHETIC = """, y AS (SELECT clause_text || CASE WHEN split = 'test' AND document_id % 3 = 0 THEN ' ' ELSE '!' END AS clause_text, clause_id FROM b)"""
TRIMMED = lambda split: f"(SELECT count(DISTINCT trim(clause_text, chr(32) || chr(9) || chr(10))) FROM y WHERE clause_text IS NOT NULL AND trim(clause_text, chr(32) || chr(9) || chr(10)) IN (SELECT trim(clause_text, chr(32) || chr(9) || chr(10)) FROM b WHERE split = '{split}' AND clause_text IS NOT NULL))"


@query(checks_sql({
    "row_count": "(SELECT abs(count(*) - 5000) FROM y)", "label_columns": "0", "label_values": "0", "blank_texts": f"(SELECT count(*) FILTER ({suites.BLANK('clause_text')}) FROM y)", "duplicate_clause_ids": "ids", "duplicate_texts": "(SELECT count(*) - count(DISTINCT clause_text) - max(CAST(clause_text IS NULL AS INTEGER)) FROM y)",
    "same_label_columns": "0", "same_schemas": "1", "validation_isolation": TRIMMED("validation"), "test_isolation": TRIMMED("test")}, SYNTHETIC))
def synthetic_preflight(spark: SparkSession, d: str) -> DataFrame:
    """Rows made from the benchmark's, some with a text of its test split, against split tables of which one has a column more."""
    hot = suites.benchmark_rows(spark, d).select("document_id", "clause_id", "clause_text", "split", *L.multi_hot(F.coalesce("labels", F.array().cast("array<string>"))))
    parts = [hot.where(F.col("split") == s).drop("split") for s in splits.SPLITS]
    tail = F.when((F.col("split") == "test") & (F.col("document_id") % 3 == 0), " ").otherwise("!")
    made = hot.withColumn("clause_text", F.concat("clause_text", tail)).drop("split", "document_id")
    return quality.synthetic_preflight(made, parts[0], parts[1], parts[2].withColumn("more", F.lit(1)))


@query(f"""WITH {BENCH} SELECT split, count(*) AS row_count, CAST(CASE WHEN split = 'test' THEN 2 ELSE 1 END AS INTEGER) AS missing_columns, count(*) FILTER (clause_text IS NULL) AS null_texts, count(*) FILTER (document_id IS NULL) AS null_docs, split <> 'test' AS binary_labels_valid FROM b GROUP BY split""")
def interface_report(spark: SparkSession, d: str) -> DataFrame:
    hot = suites.benchmark_rows(spark, d).select("document_id", "clause_id", "clause_text", "split", *L.multi_hot(F.coalesce("labels", F.array().cast("array<string>"))))
    parts = {s: hot.where(F.col("split") == s).drop("split") for s in splits.SPLITS}
    parts["test"] = parts["test"].drop(label_col(CATEGORIES[0]))
    return quality.interface_report(parts, ("document_id", "clause_id", "clause_text", "source_file", *map(label_col, CATEGORIES)))


# ---------------------------------------------------------------- inference, artefacts, actions, reasons


def chances(texts: list[str]):
    """Of each category a hundredth of a remainder of the text's length."""
    import numpy as np

    return np.array([[(len(t) * (k + 3) + k) % 100 / 100 for k in range(len(CATEGORIES))] for t in texts]).reshape(len(texts), len(CATEGORIES))


@query(f"""WITH {CLAUSES}, {TAXONOMY}, p AS (SELECT clause_id, category, (length(text) * (cat_idx + 3) + cat_idx) % 100 / 100 AS y_prob FROM clauses, taxonomy)
SELECT clause_id, coalesce(list(category ORDER BY category) FILTER (y_prob >= 0.9), [arg_min(category, {{p: -y_prob, c: category}})]) AS labels, max(y_prob) AS top_probability FROM p GROUP BY clause_id""")
def batch_inference(spark: SparkSession, d: str) -> DataFrame:
    """All clauses through a model that workers hold."""
    from clausegrain.operators import inference

    return inference.decided(inference.infer(A.clauses(spark, d), lambda: chances, list(CATEGORIES), "remainders-1"), 0.9)


@query(f"""WITH {ENSEMBLE} SELECT 'distribution' AS artefact, category AS name, CAST(count(e.clause_id) AS VARCHAR) AS value FROM (SELECT unnest([{suites.QUOTED(CATEGORIES)}]) AS category) LEFT JOIN (SELECT clause_id, unnest(labels) AS category FROM ens) AS e USING (category) GROUP BY category
UNION ALL SELECT 'to_verify', clause_id, quality FROM ens WHERE quality IN ('DISAGREEMENT', 'LOW_CONFIDENCE', 'API_ERROR', 'INVALID_RESPONSE')
UNION ALL SELECT 'figures', unnest(['rows', 'clauses', 'agreements', 'disagreements', 'failures', 'duplicates']), unnest([CAST(count(*) AS VARCHAR), CAST(count(DISTINCT clause_id) AS VARCHAR), CAST(count(*) FILTER (quality IN ('HIGH_CONFIDENCE', 'MEDIUM_CONFIDENCE', 'LOW_CONFIDENCE')) AS VARCHAR), CAST(count(*) FILTER (quality = 'DISAGREEMENT') AS VARCHAR), CAST(count(*) FILTER (quality = 'API_ERROR') AS VARCHAR), CAST(count(*) - count(DISTINCT clause_id) AS VARCHAR)]) FROM ens""")
def run_artefacts(spark: SparkSession, d: str) -> DataFrame:
    """A run's artefacts as files, three of them read back."""
    from clausegrain.operators import artefacts, ensemble

    votes = A.votes(spark, d)
    texts = A.clauses(spark, d).select("clause_id", "text")
    at = artefacts.write(ensemble.combine(votes).join(texts, "clause_id"), folder(spark, "artefacts"))
    long = lambda name, key, value: spark.read.csv(at[name], header=True, multiLine=True, quote='"', escape='"').select(F.lit(name).alias("artefact"), F.col(key).alias("name"), F.col(value).alias("value"))
    figures = spark.read.csv(at["figures"], header=True)
    names = ("rows", "clauses", "agreements", "disagreements", "failures", "duplicates")
    counted = figures.select(F.lit("figures").alias("artefact"), F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in names))))
    return long("distribution", "category", "count").unionByName(long("to_verify", "clause_id", "quality")).unionByName(counted)


@query(f"""WITH {CLAUSES}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (pos % 3 = 0) AS seed, count(*) FILTER (pos % 3 = 0 AND doc_id % 4 > 0) AS done, count(*) FILTER (doc_id % 5 > 0) AS annotated, count(*) FILTER (pos % 3 = 1) AS pending FROM clauses GROUP BY doc_id)
SELECT doc_id, CASE WHEN annotated = 0 THEN 'annotate the seed' WHEN done < seed THEN 'annotate ' || (seed - done) || ' more of the seed' WHEN doc_id % 3 = 0 THEN 'train the first round' WHEN pending > 0 THEN 'annotate ' || pending || ' uncertain clauses' ELSE 'train the next round' END AS action FROM g""")
def next_actions(spark: SparkSession, d: str) -> DataFrame:
    from clausegrain.operators import stats

    i, p = F.col("doc_id"), F.col("pos")
    g = A.clauses(spark, d).groupBy("doc_id").agg(F.count_if(p % 3 == 0).alias("seed"), F.count_if((p % 3 == 0) & (i % 4 > 0)).alias("done"), F.count_if(i % 5 > 0).alias("annotated"), F.count_if(p % 3 == 1).alias("pending"))
    return g.select("doc_id", stats.next_action(F.col("annotated"), F.col("done"), F.col("seed"), i % 3 != 0, F.col("pending")).alias("action"))


@query(f"""WITH {CLAUSES}, k AS (SELECT clause_id, (doc_id * 7 + pos) % 10 AS k FROM clauses)
SELECT clause_id, ['', 'a structural exclusion, no category', 'the merge isn''t applied', '', 'the split isn''t applied', 'no suggestion, as the service failed', 'a human said KEEP', 'evidence conflicts, is incomplete, or holds a corrected text; a human said SPLIT', 'not reviewed, and of priority', 'not reviewed'][k + 1] AS review_reason FROM k""")
def evidence_reasons(spark: SparkSession, d: str) -> DataFrame:
    from clausegrain.operators.evidence import resolve
    from clausegrain.plans.catalogue import review_tables

    return resolve(*review_tables(spark, d)).select("clause_id", "review_reason")


@query(f"""WITH {CLAUSES}, k AS (SELECT clause_id, (doc_id * 7 + pos) % 10 AS k FROM clauses) SELECT clause_id, k <> 1 AS retained FROM k""")
def evidence_partition(spark: SparkSession, d: str) -> DataFrame:
    from clausegrain.operators.evidence import partition, resolve
    from clausegrain.plans.catalogue import review_tables

    kept, gone = partition(resolve(*review_tables(spark, d)))
    return kept.select("clause_id", F.lit(True).alias("retained")).unionByName(gone.select("clause_id", F.lit(False).alias("retained")))


@query("""WITH e AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '429 quota exceeded for requests per day' WHEN 1 THEN 'RESOURCE_EXHAUSTED: daily limit' WHEN 2 THEN '429 retry in 5s' WHEN 3 THEN 'daily report' END AS message FROM events) SELECT event_id, event_id % 5 < 2 AS spent FROM e""")
def daily_quotas(spark: SparkSession, d: str) -> DataFrame:
    from clausegrain.functions.text import is_daily_quota

    k = F.col("event_id") % 5
    message = F.when(k == 0, "429 quota exceeded for requests per day").when(k == 1, "RESOURCE_EXHAUSTED: daily limit").when(k == 2, "429 retry in 5s").when(k == 3, "daily report")
    return table(spark, d, "events").select("event_id", F.coalesce(is_daily_quota(message), F.lit(False)).alias("spent"))
