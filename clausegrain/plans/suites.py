"""Queries of the check suites, gates, row filters and summaries, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausegrain.functions import labels as L, text as X
from clausegrain.functions.taxonomy import CATEGORIES, label_col
from clausegrain.operators import ensemble, filters, metrics, quality, relations as R, segment, selection as S, splits, stats
from clausegrain.plans import adapters as A
from clausegrain.plans.adapters import CLAUSES, LABELLED, PREDICTIONS, SECTIONS, TAXONOMY, table
from clausegrain.plans.catalogue import CONF, ENSEMBLE, PAIR, PER, SPLIT, SUMMARY, SWEPT, VOTES, combined, query, with_split

Checks = dict[str, tuple[str, str, bool]]
SHOWN = ("check", "severity", "status", "count", "ids_checksum")


def suite_sql(ctes: str, checks: Checks, key: str = "clause_id") -> str:
    """SQL of quality.run() over the table r: for each check a condition, a severity and whether some row must be marked."""
    each = " UNION ALL ".join(f"""SELECT '{name}' AS "check", '{severity}' AS severity, {str(needs).lower()} AS needs, count(*) FILTER ({bad}) AS count, CAST(coalesce(sum(h) FILTER ({bad}), 0) AS BIGINT) AS ids_checksum FROM h""" for name, (bad, severity, needs) in checks.items())
    return f"""WITH {ctes}, h AS (SELECT *, CAST('0x' || substr(md5(coalesce({key}, '')), 1, 8) AS BIGINT) AS h FROM r), f AS ({each})
SELECT "check", severity, CASE WHEN needs = (count > 0) THEN 'PASS' ELSE severity END AS status, count, ids_checksum FROM f"""


def errors(**checks: str) -> Checks:
    return {k: (v, "ERROR", False) for k, v in checks.items()}


BLANK = lambda c: f"coalesce(trim({c}, chr(32) || chr(9) || chr(10)), '') = ''"
MOD = lambda k: (F.col("doc_id") * k + F.col("pos"))


def one_of(column, default: str | None, values: dict[int, object]):
    out = F.when(F.lit(False), None)
    for k, v in values.items():
        out = out.when(column == k, v if not isinstance(v, str) else F.lit(v))
    return out.otherwise(F.lit(default) if default is None or isinstance(default, str) else default)


# ---------------------------------------------------------------- suites

SIMPLE = {"odd_position": ("pos % 50 = 7", "ERROR", False), "short_text": ("length(text) < 25", "WARN", False), "never": ("false", "ERROR", False), "has_third": ("doc_id % 100 = 3", "BLOCKED", True)}


def simple_rules() -> list[quality.Rule]:
    return [quality.Rule("odd_position", F.col("pos") % 50 == 7), quality.Rule("short_text", F.length("text") < 25, "WARN"), quality.Rule("never", F.lit(False)), quality.Rule("has_third", F.col("doc_id") % 100 == 3, "BLOCKED", needs=True)]


@query(suite_sql(f"{CLAUSES}, r AS (SELECT * FROM clauses)", SIMPLE))
def dq_suite(spark: SparkSession, d: str) -> DataFrame:
    return quality.run(A.clauses(spark, d), simple_rules(), "clause_id").select(*SHOWN)


@query(f"WITH {CLAUSES}, r AS (SELECT clause_id AS id, unnest([" + ", ".join(f"CASE WHEN {bad} THEN '{name}' END" for name, (bad, _, _) in SIMPLE.items()) + """]) AS "check" FROM clauses) SELECT "check", id FROM r WHERE "check" IS NOT NULL""")
def dq_offenders(spark: SparkSession, d: str) -> DataFrame:
    return quality.offenders(A.clauses(spark, d), simple_rules(), "clause_id")


STATES = ("PSEUDO_KEEP", "PENDING_MERGE", "PENDING_REVIEW", "PENDING_SPLIT", "API_FAILURE", "HUMAN_RECORDED_KEEP", "CONFLICT_REVIEW", "PRIORITY_UNREVIEWED", "UNREVIEWED", "UNREVIEWED")


def clean_rows(spark: SparkSession, d: str) -> DataFrame:
    """Clauses with something wrong with one in twenty-three of them in each of many ways."""
    m, k = MOD(3) % 23, MOD(7) % 10
    return A.clauses(spark, d).select(
        F.when(m == 1, "other").otherwise(F.col("doc_id").cast("string")).alias("document_id"), F.when(m == 2, "").when(m == 3, F.concat(F.col("doc_id").cast("string"), F.lit("_dup"))).otherwise(F.col("clause_id")).alias("clause_id"),
        F.when(m == 4, None).when(m == 5, "  ").when(m == 6, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("clause_text"), F.when(m == 7, "x").otherwise("doc").alias("source"),
        F.when(m == 8, "").when(m == 9, "ODD").otherwise(F.element_at(F.array(*map(F.lit, STATES)), (k + 1).cast("int"))).alias("review_status"), F.when(m == 10, "DROP").when(k == 1, "REMOVE_NON_LEGAL").when(k == 2, "KEEP").otherwise("").alias("review_action"),
        one_of(m, "", {11: "1.5", 12: "abc", 13: "0.5"}).alias("confidence"), F.lit("").alias("review_reason"),
        one_of(m, None, {14: '["Purpose"]', 15: '["Purpose","Employees"]', 16: '["Purpose","Purpose"]', 17: "[", 18: '["Nope"]'}).alias("category_labels"),
        F.when(F.col("pos") % 2 == 0, "true").otherwise("").alias("label_verified"), F.lit("human").alias("label_source"), F.lit("me").alias("label_reviewer"),
    )


QUOTED = lambda names: ", ".join(f"'{n}'" for n in names)
CLEAN = f"""{CLAUSES}, m AS (SELECT *, (doc_id * 3 + pos) % 23 AS m, (doc_id * 7 + pos) % 10 AS k FROM clauses),
c AS (SELECT m, pos, CASE WHEN m = 1 THEN 'other' ELSE CAST(doc_id AS VARCHAR) END AS document_id, CASE m WHEN 2 THEN '' WHEN 3 THEN doc_id || '_dup' ELSE clause_id END AS clause_id, CASE m WHEN 4 THEN NULL WHEN 5 THEN '  ' WHEN 6 THEN text || '!' ELSE text END AS body, m <> 7 AS same_source,
  CASE m WHEN 8 THEN '' WHEN 9 THEN 'ODD' ELSE [{QUOTED(STATES)}][k + 1] END AS status, CASE WHEN m = 10 THEN 'DROP' WHEN k = 1 THEN 'REMOVE_NON_LEGAL' WHEN k = 2 THEN 'KEEP' ELSE '' END AS action FROM m),
j AS (SELECT c.*, x.clause_id IS NOT NULL AS known, CAST(x.doc_id AS VARCHAR) AS doc, x.text AS whole, trim(regexp_replace(coalesce(body, ''), '\\s+', ' ', 'g')) AS flat FROM c LEFT JOIN clauses x USING (clause_id)),
r AS (SELECT *, count(*) OVER (PARTITION BY clause_id) > 1 AS same_id, flat <> '' AND count(*) OVER (PARTITION BY flat) > 1 AS same_text, m IN (14, 15) AND pos % 2 = 0 AND known AS sure FROM j)"""


@query(suite_sql(CLEAN, errors(
    missing_clause_ids=BLANK("clause_id"), duplicate_clause_ids="same_id", missing_clause_text="coalesce(body, '') = ''", empty_clauses="body <> '' AND flat = ''") | {"duplicate_text": ("same_text", "WARN", False)} | errors(
    invalid_review_actions="action = 'DROP'", missing_review_status=BLANK("status"), invalid_review_status=f"status NOT IN ({QUOTED(quality.STATUSES)})",
    action_status_consistency="action = 'REMOVE_NON_LEGAL' OR (action = '' AND status NOT IN ('UNREVIEWED', 'PRIORITY_UNREVIEWED', 'API_FAILURE'))", inconsistent_document_ids="NOT known OR document_id IS DISTINCT FROM doc",
    source_text_integrity="known AND body IS DISTINCT FROM whole", source_provenance="known AND NOT same_source", confidence_range="m IN (11, 12)", multi_label_format="m IN (16, 17, 18)") | {
    "label_provenance": ("m IN (14, 15) AND pos % 2 = 1", "BLOCKED", False), "label_availability": ("sure", "BLOCKED", True), "multi_label_availability": ("sure AND m = 15", "BLOCKED", True)}))
def dq_clean_suite(spark: SparkSession, d: str) -> DataFrame:
    reference = A.clauses(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), "clause_id", F.col("text").alias("clause_text"), F.lit("doc").alias("source"))
    return quality.clean_dataset(clean_rows(spark, d), reference).select(*SHOWN)


@query(f"""WITH {CLAUSES}, a AS (SELECT DISTINCT CASE WHEN (doc_id * 3 + pos) % 23 = 2 THEN '' WHEN (doc_id * 3 + pos) % 23 = 3 THEN doc_id || '_dup' ELSE clause_id END AS id FROM clauses), odd AS (SELECT id FROM a ANTI JOIN clauses ON id = clause_id UNION ALL SELECT clause_id FROM clauses ANTI JOIN a ON id = clause_id)
SELECT 'cleaning_coverage' AS "check", CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'ERROR' END AS status, count(*) AS count FROM odd""")
def cleaning_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The check of clean_dataset() that every expected clause is there and no other."""
    reference = A.clauses(spark, d).select(F.col("doc_id").cast("string").alias("document_id"), "clause_id", F.col("text").alias("clause_text"), F.lit("doc").alias("source"))
    return quality.clean_dataset(clean_rows(spark, d), reference, reference).where(F.col("check") == "cleaning_coverage").select("check", "status", "count")


ANNOTATED = {5: "[", 6: '["Nope"]', 7: '["Purpose","Purpose"]'} | dict.fromkeys(range(8, 13), '["Purpose"]')


def annotation_rows(spark: SparkSession, d: str, step: int = 5) -> DataFrame:
    m = MOD(step) % 19
    return A.clauses(spark, d).select(
        F.when(m == 1, "").when(m == 2, F.concat(F.col("doc_id").cast("string"), F.lit("_dup"))).otherwise(F.col("clause_id")).alias("clause_id"), F.when(m == 3, "zz").when(m == 4, "").otherwise(F.col("doc_id").cast("string")).alias("document_id"),
        one_of(m, "", ANNOTATED).alias("category_labels"), one_of(m, "PENDING", {8: "COMPLETED", 9: "VERIFIED", 11: "ODD", 13: "COMPLETED"}).alias("annotation_status"), one_of(m, "", {9: "yes", 12: "yes", 14: "true"}).alias("label_verified"),
        F.when(m == 12, "").otherwise("human").alias("label_source"), F.when(m == 9, "").otherwise("me").alias("label_reviewer"), (F.col("pos") % 4).cast("string").alias("annotation_round"),
    )


@query(suite_sql(f"""{CLAUSES}, c AS (SELECT (doc_id * 5 + pos) % 19 AS m, CASE (doc_id * 5 + pos) % 19 WHEN 1 THEN '' WHEN 2 THEN doc_id || '_dup' ELSE clause_id END AS clause_id, CASE (doc_id * 5 + pos) % 19 WHEN 3 THEN 'zz' WHEN 4 THEN '' ELSE CAST(doc_id AS VARCHAR) END AS document_id FROM clauses),
r AS (SELECT c.*, x.clause_id IS NOT NULL AS known, CAST(x.doc_id AS VARCHAR) AS doc, m BETWEEN 6 AND 12 AS filled, m IN (8, 9, 13) AS done, m IN (9, 12, 14) AS verified, count(*) OVER (PARTITION BY c.clause_id) > 1 AS same_id FROM c LEFT JOIN clauses x USING (clause_id))""", errors(
    missing_clause_id="clause_id = ''", missing_document_id="document_id = ''", duplicate_clause_id="same_id", unknown_clause="NOT known", document_mismatch="known AND document_id <> doc", malformed_labels="m = 5", unknown_category="m = 6", repeated_category="m = 7",
    invalid_status="m = 11", done_without_labels="done AND NOT filled") | {"labels_without_done": ("filled AND NOT done", "WARN", False)} | errors(verified_without_labels="verified AND NOT filled") | {
    "missing_label_source": ("filled AND m = 12", "BLOCKED", False), "missing_reviewer": ("filled AND verified AND m = 9", "BLOCKED", False)}))
def dq_annotation_suite(spark: SparkSession, d: str) -> DataFrame:
    known = A.clauses(spark, d).select("clause_id", F.col("doc_id").cast("string").alias("document_id"))
    return quality.annotations(annotation_rows(spark, d), known).select(*SHOWN)


VALID = QUOTED(quality.VALID_QUALITY)
KNOWN = QUOTED(CATEGORIES)


@query(suite_sql(f"{ENSEMBLE}, r AS (SELECT *, count(*) OVER (PARTITION BY clause_id) > 1 AS same_id FROM ens)", errors(
    missing_clause_id=BLANK("clause_id"), duplicate_clause_id="same_id", no_labels=f"len(labels) = 0 AND quality IN ({VALID})", unknown_category=f"len(list_filter(labels, lambda x: x NOT IN ({KNOWN}))) > 0", repeated_category="len(list_distinct(labels)) < len(labels)",
    confidence_range="NOT coalesce(average_confidence BETWEEN 0 AND 1, false)", agreement_range="NOT coalesce(agreement_score BETWEEN 0 AND 1, false)", unknown_quality=f"quality NOT IN ({VALID}, 'API_ERROR', 'API_QUOTA_EXHAUSTED', 'INVALID_RESPONSE', 'QUOTA_WAITING')") | {
    "failed_with_agreement": ("quality = 'API_ERROR' AND agreement_score > 0", "WARN", False), "any_valid": (f"quality IN ({VALID})", "BLOCKED", True)}))
def dq_pseudo_label_suite(spark: SparkSession, d: str) -> DataFrame:
    return quality.pseudo_labels(combined(spark, d)).select(*SHOWN)


LEAKS = lambda key: f"min(split) OVER (PARTITION BY {key}) < max(split) OVER (PARTITION BY {key})"


@query(suite_sql(f"{CLAUSES}, {LABELLED}, s AS (SELECT *, {SPLIT} AS split FROM clause_labels), r AS (SELECT *, {LEAKS('doc_id')} AS by_doc, {LEAKS('clause_id')} AS by_id, {LEAKS('trim(text)')} AS by_text, count(*) OVER (PARTITION BY clause_id) > 1 AS same_id FROM s)", errors(
    unknown_split="false", document_leakage="by_doc", clause_leakage="by_id") | {"text_leakage": ("by_text", "WARN", False)} | errors(duplicate_clause="same_id", empty_text=BLANK("text"), no_labels="len(labels) = 0", unknown_category="false") | {
    f"{s}_not_empty": (f"split = '{s}'", "FAIL", True) for s in ("train", "validation", "test")}))
def dq_split_suite(spark: SparkSession, d: str) -> DataFrame:
    rows = with_split(A.clause_labels(spark, d)).withColumn("document_id", F.col("doc_id"))
    return quality.splits(rows).select(*SHOWN)


# ---------------------------------------------------------------- gates


def benchmark_rows(spark: SparkSession, d: str) -> DataFrame:
    """Clauses of splits that leak a little, with buckets, sources and scores."""
    split = F.when((F.col("doc_id") % 50 == 0) & (F.col("pos") % 2 == 0), "train")
    rows = with_split(A.clause_labels(spark, d))
    return rows.select(
        F.when(F.col("doc_id") % 97 == 5, None).otherwise(F.col("doc_id")).alias("document_id"), F.when(F.col("pos") % 61 == 9, F.lit("same")).otherwise(F.col("clause_id")).alias("clause_id"), F.when(F.col("doc_id") % 89 == 4, None).otherwise(F.col("text")).alias("clause_text"),
        F.coalesce(split, "split").alias("split"), F.when(F.col("pos") % 71 == 3, None).otherwise(F.col("labels")).alias("labels"), F.when(F.col("doc_id") % 40 == 7, "API_ERROR").otherwise("HIGH_CONFIDENCE").alias("quality"),
        F.when(F.col("pos") % 31 == 5, "rules").otherwise("llm_pseudo_label").alias("label_source"), F.lit(0.5).alias("agreement_score"), F.lit(0.5).alias("average_confidence"),
    )


BENCH = f"""{CLAUSES}, {LABELLED}, b AS (SELECT CASE WHEN doc_id % 97 = 5 THEN NULL ELSE doc_id END AS document_id, CASE WHEN pos % 61 = 9 THEN 'same' ELSE clause_id END AS clause_id, CASE WHEN doc_id % 89 = 4 THEN NULL ELSE text END AS clause_text,
  CASE WHEN doc_id % 50 = 0 AND pos % 2 = 0 THEN 'train' ELSE {SPLIT} END AS split, CASE WHEN pos % 71 = 3 THEN NULL ELSE labels END AS labels, doc_id % 40 = 7 AS failed, pos % 31 = 5 AS by_rules FROM clause_labels),
per_doc AS (SELECT document_id, bool_or(split = 'train') AS tr, bool_or(split = 'validation') AS va, bool_or(split = 'test') AS te FROM b WHERE document_id IS NOT NULL GROUP BY 1), per_text AS (SELECT clause_text, bool_or(split = 'train') AS tr, bool_or(split = 'validation') AS va, bool_or(split = 'test') AS te FROM b WHERE clause_text IS NOT NULL GROUP BY 1),
cat AS (SELECT category, count(*) AS n, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'validation') AS va, count(*) FILTER (split = 'test') AS te FROM (SELECT split, unnest(list_distinct(labels)) AS category FROM b) GROUP BY 1),
v AS (SELECT (SELECT count(*) FILTER (tr AND va) + count(*) FILTER (tr AND te) + count(*) FILTER (va AND te) FROM per_doc) AS documents, (SELECT count(*) - count(DISTINCT clause_id) FROM b) AS ids, (SELECT count(*) FILTER (tr AND va) + count(*) FILTER (tr AND te) FROM per_text) AS texts,
  (SELECT count(*) FILTER (clause_text IS NULL) FROM b) AS no_text, (SELECT count(*) FILTER (document_id IS NULL) FROM b) AS no_doc, (SELECT count(*) FILTER (failed) FROM b) AS failed, (SELECT sum(n - tr) FROM cat) AS beyond, (SELECT least(count(*) FILTER (va > 0), count(*) FILTER (te > 0)) FROM cat) AS least_cats,
  (SELECT count(*) FROM cat) AS cats, (SELECT count(*) FILTER (te > 0) FROM cat) AS test_cats, (SELECT count(DISTINCT document_id) FROM b) AS n_docs, (SELECT count(*) FILTER (labels IS NULL) FROM b) AS unparsed, (SELECT count(*) FILTER (by_rules) FROM b) AS unsourced)"""


def gates_sql(gates: dict[str, tuple[str, str]]) -> str:
    return f"WITH {BENCH} " + " UNION ALL ".join(f"""SELECT '{k}' AS "check", {status} AS status, CAST({value} AS BIGINT) AS value FROM v""" for k, (value, status) in gates.items())


NONE = lambda c, bad="FAIL": (c, f"CASE WHEN {c} = 0 THEN 'PASS' ELSE '{bad}' END")


@query(gates_sql({
    "document_disjointness": NONE("documents"), "clause_id_uniqueness": NONE("ids"), "text_isolation": NONE("texts"), "completeness": NONE("(no_text + no_doc)"), "quarantined_rows": NONE("failed"), "provenance": ("0", "'PASS'"),
    "class_weight_safeguard": ("beyond", "CASE WHEN beyond = 0 THEN 'FAIL' ELSE 'PASS' END"), "threshold_safeguard": ("0", "'PASS'"), "category_coverage": ("least_cats", "CASE WHEN least_cats < 10 THEN 'BLOCKED' ELSE 'PASS' END")}))
def leakage_suite(spark: SparkSession, d: str) -> DataFrame:
    return quality.leakage(benchmark_rows(spark, d))


@query(gates_sql({
    "document_diversity": ("n_docs", "CASE WHEN n_docs >= 15 THEN 'PASS' WHEN n_docs >= 10 THEN 'WARN' ELSE 'FAIL' END"), "document_leakage": NONE("documents"), "category_coverage": ("cats", "CASE WHEN cats = 14 THEN 'PASS' ELSE 'FAIL' END"),
    "duplicate_records": NONE("ids"), "invalid_labels": NONE("unparsed"), "api_errors": NONE("failed"), "missing_text": NONE("no_text"), "missing_document_ids": NONE("no_doc"), "metadata": ("0", "'PASS'"),
    "test_category_coverage": ("test_cats", "CASE WHEN test_cats = 14 THEN 'PASS' ELSE 'WARN' END"), "human_verification": ("0", "'WARN'"), "pseudo_label_provenance": NONE("unsourced", "WARN")}))
def readiness_suite(spark: SparkSession, d: str) -> DataFrame:
    return quality.readiness(benchmark_rows(spark, d))


@query(f"""WITH {BENCH}, p AS (SELECT * FROM v, (SELECT count(*) FILTER ({BLANK('clause_text')}) AS blank_text, count(*) FILTER (split = 'test') AS n_test FROM b))
SELECT "check", status, CAST(value AS BIGINT) AS value FROM (SELECT unnest([
{{'check': 'labels_exist', 'status': 'FAIL', 'value': 1}}, {{'check': 'columns_match', 'status': 'FAIL', 'value': 1}}, {{'check': 'document_overlap', 'status': CASE WHEN documents = 0 THEN 'PASS' ELSE 'FAIL' END, 'value': documents}},
{{'check': 'missing_text', 'status': CASE WHEN blank_text = 0 THEN 'PASS' ELSE 'FAIL' END, 'value': blank_text}}, {{'check': 'missing_document_ids', 'status': CASE WHEN no_doc = 0 THEN 'PASS' ELSE 'FAIL' END, 'value': no_doc}},
{{'check': 'label_values', 'status': CASE WHEN n_test = 0 THEN 'PASS' ELSE 'FAIL' END, 'value': n_test}}, {{'check': 'label_dimensions', 'status': 'FAIL', 'value': 1}}], recursive := true) FROM p)""")
def preflight_suite(spark: SparkSession, d: str) -> DataFrame:
    """Of three split tables of which the test one lacks a label column and has odd values in another."""
    rows = benchmark_rows(spark, d).select("document_id", "clause_text", "split", *L.multi_hot(F.coalesce("labels", F.array().cast("array<string>"))))
    parts = {s: rows.where(F.col("split") == s).drop("split") for s in splits.SPLITS}
    test = parts["test"].drop(label_col(CATEGORIES[0])).withColumn(label_col(CATEGORIES[1]), F.lit(2))
    return quality.preflight(parts["train"], parts["validation"], test)


GATE_REASONS = {"documents": "fewer than 14 documents", "category_documents": "categories in fewer than 3 documents", "leakage": "documents leak", "train_coverage": "train lacks categories", "validation_coverage": "validation lacks categories", "test_coverage": "test lacks categories"}


@query(f"""WITH {CLAUSES}, {LABELLED}, {TAXONOMY}, s AS (SELECT *, {SPLIT} AS split FROM clause_labels), pd AS (SELECT doc_id, count(DISTINCT split) AS k FROM s GROUP BY 1),
e AS (SELECT category, count(DISTINCT doc_id) AS docs, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM (SELECT doc_id, split, unnest(list_distinct(labels)) AS category FROM s) GROUP BY 1),
f AS (SELECT category, coalesce(docs, 0) AS docs, coalesce(train, 0) AS train, coalesce(validation, 0) AS validation, coalesce(test, 0) AS test FROM taxonomy LEFT JOIN e USING (category)),
c AS (SELECT count(*) FILTER (docs > 0) AS categories, min(docs) AS least_documents, count(*) FILTER (train > 0) AS train_categories, count(*) FILTER (validation > 0) AS validation_categories, count(*) FILTER (test > 0) AS test_categories,
  {', '.join(f"max(docs) FILTER (category = '{v}') AS {k}_documents" for k, v in splits.AUDITED.items())} FROM f),
o AS (SELECT * FROM (SELECT count(*) AS rows, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'validation') AS validation_rows, count(*) FILTER (split = 'test') AS test_rows FROM s), (SELECT count(*) AS documents, count(*) FILTER (k > 1) AS leaking_documents, CAST(sum(k * (k - 1) // 2) AS BIGINT) AS shared_documents FROM pd), c),
g AS (SELECT *, documents >= 14 AS gate_documents, {', '.join(f'{k}_documents >= 3 AS gate_{k}' for k in splits.AUDITED)}, least_documents >= 3 AS gate_category_documents, shared_documents = 0 AS gate_leakage, train_categories = 14 AS gate_train_coverage, validation_categories = 14 AS gate_validation_coverage, test_categories = 14 AS gate_test_coverage FROM o),
h AS (SELECT *, gate_train_coverage AND gate_validation_coverage AND gate_test_coverage AS gate_split_coverage, gate_documents AND gate_category_documents AND gate_leakage AND gate_train_coverage AS gate_final FROM g)
SELECT *, array_to_string(list_filter([{', '.join(f"CASE WHEN NOT gate_{k} THEN '{v}' END" for k, v in GATE_REASONS.items())}], lambda x: x IS NOT NULL), '; ') AS reasons,
CASE WHEN NOT gate_final THEN 'BLOCKED' WHEN gate_validation_coverage AND gate_test_coverage THEN 'READY' ELSE 'CONDITIONALLY_READY' END AS status FROM h""")
def split_audit(spark: SparkSession, d: str) -> DataFrame:
    return splits.audit(with_split(A.clause_labels(spark, d)), "doc_id")


# ---------------------------------------------------------------- filters

BUCKET = ("HIGH_CONFIDENCE", "MEDIUM_CONFIDENCE", "LOW_CONFIDENCE", "DISAGREEMENT", "API_ERROR", "INVALID_RESPONSE", "QUOTA_WAITING", "NEW", None)
WHY = (filters.RULES_REASON, "API call failed: 503", "models agree", None)


def bucketed(spark: SparkSession, d: str) -> DataFrame:
    pick = lambda values, k: one_of(F.col("pos") * 3 % 101 % k, None, dict(enumerate(values)))
    return A.clauses(spark, d).select("doc_id", "clause_id", pick(BUCKET, 9).alias("quality"), pick(WHY, 4).alias("reason"))


PICK = lambda values, k: f"[{', '.join('NULL' if v is None else repr(v) for v in values)}][pos * 3 % 101 % {k} + 1]"


@query(f"""WITH {CLAUSES}, q AS (SELECT clause_id, {PICK(BUCKET, 9)} AS quality, {PICK(WHY, 4)} AS reason FROM clauses), k AS (SELECT *, coalesce(quality IN ({VALID}), false) AS valid FROM q)
SELECT clause_id, valid, quality IS NULL OR quality NOT IN ('API_ERROR', 'API_QUOTA_EXHAUSTED', 'INVALID_RESPONSE', 'QUOTA_WAITING') AS not_quarantined, coalesce(quality = 'HIGH_CONFIDENCE', false) AS high, coalesce(quality IN ('HIGH_CONFIDENCE', 'MEDIUM_CONFIDENCE'), false) AS high_or_medium,
coalesce(quality IN ('API_ERROR', 'INVALID_RESPONSE'), false) OR coalesce(contains(reason, 'API call failed'), false) AS retryable, valid AND reason IS DISTINCT FROM '{filters.RULES_REASON}' AS genuine FROM k""")
def row_filters(spark: SparkSession, d: str) -> DataFrame:
    q, why = F.col("quality"), F.col("reason")
    return bucketed(spark, d).select("clause_id", filters.is_valid(q).alias("valid"), filters.not_quarantined(q).alias("not_quarantined"), filters.is_sure(q).alias("high"), filters.is_sure(q, "MEDIUM_CONFIDENCE").alias("high_or_medium"), filters.is_retryable(q, why).alias("retryable"), filters.is_genuine(q, why).alias("genuine"))


@query(f"""WITH {CLAUSES}, {LABELLED}, t AS (SELECT labels FROM clause_labels WHERE pos % 6 IN (1, 2) AND pos % 5 <> 0 AND len(labels) > 0), n AS (SELECT (SELECT count(*) FROM t) AS examples, (SELECT count(DISTINCT c) FROM (SELECT unnest(labels) AS c FROM t)) AS categories)
SELECT *, CASE WHEN examples = 0 THEN 'no valid annotations' WHEN examples < 50 THEN 'too few annotations' WHEN categories < 5 THEN 'too few categories' ELSE '' END AS reason, examples >= 50 AND categories >= 5 AS ready FROM n""")
def training_gate(spark: SparkSession, d: str) -> DataFrame:
    status, source = one_of(F.col("pos") % 6, "PENDING", {1: "ANNOTATED", 2: "VERIFIED"}), F.when(F.col("pos") % 5 == 0, "rules").otherwise(" human_annotation ")
    return filters.training_gate(A.clause_labels(spark, d).where(filters.is_trainable(status, source, F.col("labels"))))


@query(f"""WITH {CLAUSES}, {LABELLED}, s AS (SELECT clause_id, {SPLIT} AS split, {PICK(BUCKET, 9)} AS quality FROM clause_labels) SELECT clause_id, split FROM s WHERE split <> 'train' OR coalesce(quality IN ('HIGH_CONFIDENCE', 'MEDIUM_CONFIDENCE'), false)""")
def sure_training(spark: SparkSession, d: str) -> DataFrame:
    return filters.sure_training(with_split(bucketed(spark, d)), "MEDIUM_CONFIDENCE").select("clause_id", "split")


# ---------------------------------------------------------------- summaries


@query(f"""WITH {CLAUSES}, b AS (SELECT doc_id, count(*) AS k FROM clauses GROUP BY 1), s AS (SELECT doc_id % 7 AS s FROM documents)
SELECT (SELECT count(*) FROM s) AS documents_processed, (SELECT count(*) FILTER (s NOT IN (0, 1)) FROM s) AS successful_documents, (SELECT count(*) FILTER (s IN (0, 1)) FROM s) AS failed_documents, (SELECT count(*) FROM b) AS documents_with_clauses, count(*) AS clauses, (SELECT avg(k) FROM b) AS avg_clauses,
(SELECT min(k) FROM b) AS min_clauses, (SELECT max(k) FROM b) AS max_clauses, avg(length(text)) AS avg_length, CAST(min(length(text)) AS INTEGER) AS min_length, CAST(max(length(text)) AS INTEGER) AS max_length FROM clauses""")
def segmentation_stats(spark: SparkSession, d: str) -> DataFrame:
    extracted = table(spark, d, "documents").select("doc_id", one_of(F.col("doc_id") % 7, "success", {0: "failed", 1: "empty", 2: "partial"}).alias("status"))
    return stats.segmentation(extracted, A.clauses(spark, d), "doc_id")


VERSIONS = f"""{CLAUSES}, v AS (SELECT doc_id, text, pos % 9 = 2 AS bad, CASE WHEN pos % 6 = 0 THEN 'header' ELSE 'legal_clause' END AS kind, length(text) AS n, length(trim(text)) < 20 AS short, pos % 3 <> 0 AND doc_id % 10 <> 0 AS in_old FROM clauses),
cmp AS (SELECT doc_id, count(*) AS new_clauses, count(*) FILTER (bad) AS new_suspicious, count(*) FILTER (short) AS new_short, count(*) FILTER (in_old) AS old_clauses, count(*) FILTER (bad AND in_old) AS old_suspicious, count(*) FILTER (short AND in_old) AS old_short,
  count(*) FILTER (kind = 'header' AND n > 500) AS large_headers, CAST(coalesce(max(n) FILTER (kind = 'header'), 0) AS INTEGER) AS largest_header, CAST(coalesce(max(n) FILTER (kind = 'legal_clause'), 0) AS INTEGER) AS largest_legal_clause FROM v GROUP BY 1)"""


def versions(spark: SparkSession, d: str) -> DataFrame:
    new = A.clauses(spark, d).withColumns({"is_suspicious": F.col("pos") % 9 == 2, "segment_type": F.when(F.col("pos") % 6 == 0, "header").otherwise("legal_clause")})
    return segment.compare_versions(new.where("pos % 3 <> 0 AND doc_id % 10 <> 0"), new, "doc_id")


@query(f"WITH {VERSIONS} SELECT * FROM cmp")
def version_comparison(spark: SparkSession, d: str) -> DataFrame:
    return versions(spark, d)


@query(f"""WITH {VERSIONS} SELECT count(*) AS documents, {', '.join(f'CAST(sum({v}_{c}) AS BIGINT) AS {v}_{c}' for v in ('old', 'new') for c in ('clauses', 'suspicious', 'short'))}, count(*) FILTER (abs(old_clauses - new_clauses) > 10) AS mismatches,
CAST(sum(large_headers) AS BIGINT) AS large_headers, max(largest_header) AS largest_header, max(largest_legal_clause) AS largest_legal_clause FROM cmp""")
def version_totals(spark: SparkSession, d: str) -> DataFrame:
    return segment.version_totals(versions(spark, d))


@query(f"""WITH {PREDICTIONS}, q AS (SELECT *, unnest(list_filter(['ALL', CASE WHEN doc_id % 4 < 2 THEN 'HIGH_MEDIUM' END, CASE WHEN doc_id % 4 = 0 THEN 'HIGH' END], lambda x: x IS NOT NULL)) AS subset FROM predictions),
conf AS (SELECT subset, category, count(*) FILTER (y_true = 1 AND y_prob >= 0.5) AS tp, count(*) FILTER (y_true <> 1 AND y_prob >= 0.5) AS fp, count(*) FILTER (y_true = 1 AND y_prob < 0.5) AS fn, count(*) FILTER (y_true <> 1 AND y_prob < 0.5) AS tn FROM q GROUP BY 1, 2),
{PER} SELECT subset, {SUMMARY}, avg(f1) AS minority_f1 FROM per GROUP BY subset""")
def confidence_ablation(spark: SparkSession, d: str) -> DataFrame:
    bucket = one_of(F.col("doc_id") % 4, "LOW_CONFIDENCE", {0: "HIGH_CONFIDENCE", 1: "MEDIUM_CONFIDENCE"})
    return metrics.ablation(A.predictions(spark, d).withColumn("quality", bucket))


@query(f"""WITH {CLAUSES}, m AS (SELECT pos, (doc_id * 5 + pos) % 19 AS m FROM clauses) SELECT count(*) AS total_clauses, count(*) FILTER (m BETWEEN 6 AND 12) AS labeled_clauses, count(*) FILTER (m IN (9, 12, 14)) AS verified_clauses, count(*) FILTER (m = 7) AS multi_labeled_clauses,
count(*) FILTER (m NOT IN (8, 9, 11, 13)) AS pending, 0 AS annotated, 0 AS disputed, 0 AS skipped, max(pos % 4) AS current_round FROM m""".replace(" 0 AS", " CAST(0 AS BIGINT) AS").replace("max(pos % 4)", "CAST(max(pos % 4) AS BIGINT)"))
def annotation_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = annotation_rows(spark, d).withColumn("labels", L.parse(F.col("category_labels"), "null"))
    return stats.annotation_summary(rows)


@query(f"""WITH {CLAUSES}, {LABELLED}, {TAXONOMY}, e AS (SELECT category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(labels) AS category FROM clause_labels) GROUP BY 1), f AS (SELECT cat_idx, category, coalesce(n, 0) AS n, coalesce(docs, 0) AS docs FROM taxonomy LEFT JOIN e USING (category)),
t AS (SELECT greatest(sum(n), 1) AS t FROM f) SELECT category, n AS total_annotations, 100 * n / t AS percentage, docs AS documents_present, CASE WHEN cat_idx < 3 THEN cat_idx * 10 ELSE 0 END AS round_1, n AS round_2, CASE WHEN n = 0 THEN 'ZERO_EXAMPLES' WHEN n < 5 THEN 'SPARSE' WHEN n < t * 0.1 THEN 'UNDERREPRESENTED' ELSE '' END AS warning FROM f, t""")
def round_distribution(spark: SparkSession, d: str) -> DataFrame:
    earlier = spark.createDataFrame([(c, 10 * i, -1) for i, c in enumerate(CATEGORIES[:3])], "category string, round_1 int, round_2 int")
    return stats.round_distribution(A.clause_labels(spark, d), earlier, 2, "doc_id")


@query("""WITH a AS (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 3 = 0 GROUP BY 1), j AS (SELECT event_type, coalesce(b.v, 0) - coalesce(a.v, 0) AS delta FROM a FULL JOIN b USING (event_type))
SELECT event_type, delta, CASE WHEN delta > 0.02 THEN 'IMPROVED' WHEN delta < -0.02 THEN 'DEGRADED' ELSE 'NEUTRAL' END AS impact FROM j""")
def impact_tags(spark: SparkSession, d: str) -> DataFrame:
    from clausegrain.plans.catalogue import QUERIES

    return QUERIES["before_after"](spark, d).select("event_type", "delta", L.impact(F.col("delta")).alias("impact"))


@query(f"WITH {SWEPT} SELECT * FROM swept ORDER BY round(macro_f1, 1) DESC, minority_f1 DESC, macro_mcc DESC, threshold LIMIT 1")
def threshold_best_rounded(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_threshold(metrics.sweep(A.predictions(spark, d)), digits=1, ties=("minority_f1", "macro_mcc"))


@query(f"WITH {SWEPT} SELECT * FROM swept ORDER BY round(macro_f1, 4) DESC, minority_f1 DESC, macro_mcc DESC, threshold LIMIT 1")
def threshold_best_four(spark: SparkSession, d: str) -> DataFrame:
    return metrics.best_threshold(metrics.sweep(A.predictions(spark, d)), ties=("minority_f1", "macro_mcc"))


@query(f"""WITH {CLAUSES}, k AS (SELECT clause_id, pos % 101 / 100 AS c, ['KEEP', 'REMOVE_NON_LEGAL', 'REVIEW', 'SPLIT'][pos % 4 + 1] AS a, pos % 3 AS p FROM clauses)
SELECT clause_id, CASE WHEN c >= 0.9 THEN 'HIGH' WHEN c >= 0.7 THEN 'MEDIUM' ELSE 'LOW' END AS tier, CASE WHEN a IN ('KEEP', 'SPLIT') THEN 'true' WHEN a = 'REMOVE_NON_LEGAL' THEN 'false' ELSE '' END AS validity, CASE WHEN p > 0 THEN printf('1:%.1f', 7 / p) ELSE 'N/A' END AS ratio FROM k""")
def review_tiers(spark: SparkSession, d: str) -> DataFrame:
    action = one_of(F.col("pos") % 4, "", dict(enumerate(("KEEP", "REMOVE_NON_LEGAL", "REVIEW", "SPLIT"))))
    return A.clauses(spark, d).select("clause_id", L.review_tier(F.col("pos") % 101 / 100).alias("tier"), L.human_validity(action).alias("validity"), L.pos_neg_ratio(F.col("pos") % 3, F.lit(7)).alias("ratio"))


@query(f"""WITH {CLAUSES}, q AS (SELECT doc_id, clause_id, doc_id * 100000 + pos AS position, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 9 END AS valid FROM clauses) SELECT clause_id, position, CASE WHEN coalesce(valid, 0) = 0 THEN 0 WHEN valid < 5 THEN 1 ELSE 2 END AS tier FROM q""")
def stable_tiers(spark: SparkSession, d: str) -> DataFrame:
    queue = A.clauses(spark, d).select("doc_id", "clause_id", (F.col("doc_id") * 100000 + F.col("pos")).alias("position"))
    counts = table(spark, d, "documents").where("doc_id % 4 <> 0").select("doc_id", one_of(F.col("doc_id") % 4, F.lit(9), {1: F.lit(0), 2: F.lit(3)}).alias("valid")).distinct()
    return S.stable_tiers(queue, counts, "doc_id", "position").select("clause_id", "position", "tier")


@query(f"WITH {SECTIONS}, p AS (SELECT document_id, trim(unnest(string_split(text, chr(10) || chr(10))), chr(32) || chr(9) || chr(10)) AS text FROM sections) SELECT document_id, text FROM p WHERE length(text) >= 30")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return segment.paragraphs(A.sections(spark, d))


@query(f"""WITH {CLAUSES}, k AS (SELECT *, pos % 4 = 1 AND doc_id % 3 <> 0 AND length(text) >= 30 AS legal FROM clauses), w AS (SELECT *, bool_or(legal) OVER (PARTITION BY doc_id) AS has_legal FROM k) SELECT clause_id FROM w WHERE CASE WHEN has_legal THEN legal ELSE length(text) >= 30 END""")
def usable_clauses(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when((F.col("pos") % 4 == 1) & (F.col("doc_id") % 3 != 0), "legal_clause").otherwise("header")
    return S.legal_or_long(A.clauses(spark, d).withColumn("kind", kind), "doc_id", "kind", "text").select("clause_id")


@query(f"WITH {CLAUSES}, {LABELLED} SELECT count(*) FILTER (len(labels) = 1) AS single_label, count(*) FILTER (len(labels) > 1) AS multi_label FROM clause_labels")
def single_or_multi(spark: SparkSession, d: str) -> DataFrame:
    return stats.single_or_multi(A.clause_labels(spark, d))


@query("""WITH r AS (SELECT event_type AS model, avg(value) AS macro_f1, max(value) AS minority_f1, min(value) AS macro_mcc, count(*) AS weighted_f1 FROM events GROUP BY 1)
SELECT *, CAST(row_number() OVER (ORDER BY macro_f1 DESC, minority_f1 DESC, macro_mcc DESC, weighted_f1 DESC, model) AS INTEGER) AS rank FROM r""")
def rank_models(spark: SparkSession, d: str) -> DataFrame:
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("model")).agg(F.avg("value").alias("macro_f1"), F.max("value").alias("minority_f1"), F.min("value").alias("macro_mcc"), F.count("*").alias("weighted_f1"))
    return metrics.rank_models(runs)


@query(f"""WITH {CLAUSES}, {VOTES}, w AS (SELECT clause_id, model, CASE WHEN status = 'SUCCESS' THEN list_sort(labels) ELSE ['Additional Information'] END AS l, CASE WHEN status = 'SUCCESS' THEN confidence ELSE 0.5 END AS c FROM votes),
g AS (SELECT clause_id, list(l ORDER BY model) AS ls, list(c ORDER BY model) AS cs FROM w GROUP BY 1),
j AS (SELECT *, list_sum(cs) / 3 AS average_confidence, ({PAIR.format('ls[1]', 'ls[2]')} + {PAIR.format('ls[1]', 'ls[3]')} + {PAIR.format('ls[2]', 'ls[3]')}) / 3 AS agreement_score, list_filter(list_distinct(flatten(ls)), lambda x: len(list_filter(flatten(ls), lambda y: y = x)) >= 2) AS major FROM g)
SELECT clause_id, list_sort(CASE WHEN len(major) > 0 THEN major ELSE ls[list_position(cs, list_max(cs))] END) AS labels, average_confidence, agreement_score,
CASE WHEN agreement_score >= 0.8 AND average_confidence >= 0.8 THEN 'HIGH_CONFIDENCE' WHEN agreement_score >= 0.5 AND average_confidence >= 0.6 THEN 'MEDIUM_CONFIDENCE' WHEN agreement_score < 0.5 THEN 'DISAGREEMENT' ELSE 'LOW_CONFIDENCE' END AS quality FROM j""")
def ensemble_always_three(spark: SparkSession, d: str) -> DataFrame:
    return ensemble.combine(A.votes(spark, d), count_failures=True).select("clause_id", "labels", "average_confidence", "agreement_score", "quality")


@query(f"""WITH {CLAUSES}, {LABELLED}, b AS (SELECT doc_id, count(*) AS n FROM clause_labels GROUP BY 1), w AS (SELECT *, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS nw FROM clause_labels)
SELECT (SELECT count(*) FROM b) AS documents, count(*) AS clauses, (SELECT min(n) FROM b) AS min_clauses, (SELECT max(n) FROM b) AS max_clauses, (SELECT avg(n) FROM b) AS avg_clauses, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars, avg(length(text)) AS avg_chars,
CAST(min(nw) AS INTEGER) AS min_words, CAST(max(nw) AS INTEGER) AS max_words, avg(nw) AS avg_words, count(*) FILTER (len(labels) = 1) AS single_label, count(*) FILTER (len(labels) > 1) AS multi_label, CASE WHEN count(*) = 0 THEN 'no documents' END AS error FROM w""")
def dataset_statistics(spark: SparkSession, d: str) -> DataFrame:
    return stats.dataset(A.clause_labels(spark, d), "doc_id")


@query(f"WITH {CLAUSES}, {LABELLED} SELECT doc_id, min({SPLIT}) AS split, count(*) AS clauses, list_sort(list_distinct(flatten(list(labels)))) AS categories FROM clause_labels GROUP BY doc_id")
def document_coverage(spark: SparkSession, d: str) -> DataFrame:
    return stats.document_profile(with_split(A.clause_labels(spark, d)), "doc_id", split="split")


@query(f"""WITH {CLAUSES}, {LABELLED} SELECT clause_id, CASE WHEN pos % 3 = 0 THEN ['Odd'] ELSE [] END AS unapproved FROM clause_labels""")
def unapproved_labels(spark: SparkSession, d: str) -> DataFrame:
    more = F.when(F.col("pos") % 3 == 0, F.array(F.lit("Odd"))).otherwise(F.array().cast("array<string>"))
    return A.clause_labels(spark, d).select("clause_id", L.unapproved(F.concat("labels", more)).alias("unapproved"))


@query("SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY doc_id) - 1 AS position FROM documents LEFT JOIN labels USING (doc_id)")
def ordered_left_join(spark: SparkSession, d: str) -> DataFrame:
    return R.ordered_left(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", "position")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events)), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = (SELECT max(event_type) FROM events) AND event_id % 3 = 0)
SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NOT NULL AND b.user_id IS NOT NULL THEN 'both' WHEN a.user_id IS NOT NULL THEN 'left' ELSE 'right' END AS side FROM a FULL JOIN b ON a.user_id = b.user_id""")
def set_operations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kinds = e.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))  # one row
    return R.set_operations(e.join(F.broadcast(kinds), F.col("event_type") == F.col("lo")), e.where("event_id % 3 = 0").join(F.broadcast(kinds), F.col("event_type") == F.col("hi")), "user_id")


@query(f"WITH {CLAUSES} SELECT clause_id FROM clauses WHERE regexp_matches(text, '(?i)(?:th[ae]n)|(?:und)')")
def signal_filter(spark: SparkSession, d: str) -> DataFrame:
    return A.clauses(spark, d).where(L.holds_any(F.col("text"), ["th[ae]n", "und"])).select("clause_id")


@query(f"""WITH {CLAUSES}, k AS (SELECT clause_id, [NULL, '', ' PENDING ', 'ANNOTATED', 'SKIPPED'][pos % 5 + 1] AS s, [' True', '1', 'no', NULL][pos % 4 + 1] AS t, 'key AIza' || substr(md5(clause_id), 1, 6) || ' x' AS secret FROM clauses)
SELECT clause_id, trim(coalesce(s, '')) NOT IN ('', 'PENDING') AS done, coalesce(lower(trim(t)) IN ('true', '1'), false) AS truth, regexp_replace(secret, 'AIza[\\w-]+', '[REDACTED]', 'g') AS redacted FROM k""")
def small_parsers(spark: SparkSession, d: str) -> DataFrame:
    states, truths = one_of(F.col("pos") % 5, None, {1: "", 2: " PENDING ", 3: "ANNOTATED", 4: "SKIPPED"}), one_of(F.col("pos") % 4, None, {0: " True", 1: "1", 2: "no"})
    secret = F.concat(F.lit("key AIza"), F.substring(F.md5("clause_id"), 1, 6), F.lit(" x"))
    return A.clauses(spark, d).select("clause_id", filters.is_done(states).alias("done"), X.truthy(truths).alias("truth"), X.redact(secret).alias("redacted"))


@query(f"""WITH {CLAUSES} SELECT clause_id, pos % 6 IN (0, 1) AS valid FROM clauses""")
def review_validator(spark: SparkSession, d: str) -> DataFrame:
    good = '{"suggested_action": "KEEP", "confidence": 0.9, "reason": "r", "needs_context": false}'
    raw = one_of(F.col("pos") % 6, None, {0: good, 1: good.replace("suggested_action", "action"), 2: good.replace("0.9", "1.9"), 3: good.replace("KEEP", "DROP"), 4: good.replace('"r"', '" "')})
    return A.clauses(spark, d).select("clause_id", L.is_valid_review(raw).alias("valid"))


@query(f"""WITH {CLAUSES}, k AS (SELECT ['KEEP', 'SPLIT', 'REVIEW'][pos % 3 + 1] AS suggested_action, doc_id % 101 / 100 AS c FROM clauses)
SELECT suggested_action, count(*) AS n, count(*) FILTER (c >= 0.9) AS high, count(*) FILTER (c >= 0.7 AND c < 0.9) AS medium, count(*) FILTER (c < 0.7) AS low, 100 * count(*) / sum(count(*)) OVER () AS percent FROM k GROUP BY 1""")
def review_statistics(spark: SparkSession, d: str) -> DataFrame:
    from clausegrain.operators.evidence import review_statistics as statistics

    action = one_of(F.col("pos") % 3, None, {0: "KEEP", 1: "SPLIT", 2: "REVIEW"})
    return statistics(A.clauses(spark, d).select(action.alias("suggested_action"), (F.col("doc_id") % 101 / 100).alias("confidence")))


LEGAL_HITS = " + ".join(f"CAST(contains(lower(t), '{w}') AS INTEGER)" for w in segment.LEGAL_WORDS)
LIKE = lambda p: f"regexp_matches(t, '{p}')"
EXHIBIT, PAGE = LIKE(segment.EXHIBIT), f"({LIKE(segment.PAGE)} AND ((regexp_matches(t, '^\\d+$') AND n <= 3) OR contains(lower(t), 'page') OR contains(t, '-')))"
HEADING = lambda most, title: f"(n < {most} AND {LIKE(segment.HEADING % title)} AND NOT ends_with(t, '.'))"
UPPER = r"regexp_matches(t, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$')"
NO_WORDS = LIKE("^[" + segment.MARKS.replace("'", "''") + "]+$")


@query(f"""WITH {CLAUSES}, v AS (SELECT clause_id, CASE pos % 8 WHEN 0 THEN 'EX-10.1 title' WHEN 1 THEN 'Page 3 of 9' WHEN 2 THEN 'SECTION CONFIDENTIAL MATTERS' WHEN 3 THEN '...' WHEN 4 THEN left(text, 12) WHEN 5 THEN upper(left(text, 40)) WHEN 6 THEN text || ' the party shall disclose' ELSE text END AS t0 FROM clauses),
w AS (SELECT clause_id, trim(t0, chr(32) || chr(9) || chr(10)) AS t, length(t0) AS n0 FROM v), u AS (SELECT *, length(t) AS n FROM w), l AS (SELECT *, n >= 50 AND ({LEGAL_HITS} >= 2 OR n > 300) AS legal FROM u),
k AS (SELECT *, CASE WHEN t = '' THEN 'fragment' WHEN {EXHIBIT} THEN 'header' WHEN {PAGE} THEN 'page_number' WHEN {HEADING(80, 60)} THEN 'section_heading' WHEN n < 60 AND {UPPER} AND NOT ends_with(t, '.') THEN 'section_heading' WHEN {NO_WORDS} THEN 'fragment' WHEN n < 20 THEN 'fragment' ELSE 'legal_clause' END AS kind_2,
  CASE WHEN t = '' THEN 'fragment' WHEN {NO_WORDS} THEN 'fragment' WHEN {EXHIBIT} AND legal THEN 'legal_clause' WHEN {EXHIBIT} AND n < 300 THEN 'header' WHEN {PAGE} THEN 'page_number' WHEN NOT legal AND {HEADING(150, 100)} THEN 'section_heading'
    WHEN NOT legal AND n < 100 AND {UPPER} AND NOT ends_with(t, '.') AND len(regexp_split_to_array(t, '\\s+')) < 15 THEN 'section_heading' WHEN n < 20 AND NOT legal THEN 'fragment' ELSE 'legal_clause' END AS kind_3 FROM l)
SELECT clause_id, legal, kind_2, kind_3, n0 < 20 OR kind_2 IN ('fragment', 'page_number', 'header') AS suspicious_2, n0 < 15 OR kind_3 IN ('fragment', 'page_number') OR (kind_3 = 'header' AND n0 > 500) AS suspicious_3 FROM k""")
def segment_kinds(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    made = one_of(F.col("pos") % 8, t, {0: "EX-10.1 title", 1: "Page 3 of 9", 2: "SECTION CONFIDENTIAL MATTERS", 3: "...", 4: F.left(t, F.lit(12)), 5: X.upper_by_letter(F.left(t, F.lit(40))), 6: F.concat(t, F.lit(" the party shall disclose"))})
    rows = A.clauses(spark, d).select("clause_id", made.alias("t"))
    kinds = rows.select("clause_id", "t", segment.has_legal_content(X.strip(F.col("t"))).alias("legal"), segment.segment_type(F.col("t"), 2).alias("kind_2"), segment.segment_type(F.col("t"), 3).alias("kind_3"))
    return kinds.select("clause_id", "legal", "kind_2", "kind_3", segment.is_suspicious(F.col("t"), F.col("kind_2"), 2).alias("suspicious_2"), segment.is_suspicious(F.col("t"), F.col("kind_3"), 3).alias("suspicious_3"))


KIND_2 = f"""CASE WHEN t = '' THEN 'fragment' WHEN {EXHIBIT} THEN 'header' WHEN {PAGE} THEN 'page_number' WHEN {HEADING(80, 60)} THEN 'section_heading' WHEN n < 60 AND {UPPER} AND NOT ends_with(t, '.') THEN 'section_heading' WHEN {NO_WORDS} THEN 'fragment' WHEN n < 20 THEN 'fragment' ELSE 'legal_clause' END"""
KIND_3 = f"""CASE WHEN t = '' THEN 'fragment' WHEN {NO_WORDS} THEN 'fragment' WHEN {EXHIBIT} AND legal THEN 'legal_clause' WHEN {EXHIBIT} AND n < 300 THEN 'header' WHEN {PAGE} THEN 'page_number' WHEN NOT legal AND {HEADING(150, 100)} THEN 'section_heading'
    WHEN NOT legal AND n < 100 AND {UPPER} AND NOT ends_with(t, '.') AND len(regexp_split_to_array(t, '\\s+')) < 15 THEN 'section_heading' WHEN n < 20 AND NOT legal THEN 'fragment' ELSE 'legal_clause' END"""
ODD = {2: "n < 20 OR segment_type IN ('fragment', 'page_number', 'header')", 3: "n < 15 OR segment_type IN ('fragment', 'page_number') OR (segment_type = 'header' AND n > 500)"}
BEGINS = {2: r"regexp_matches(own, '^\d{1,2}\.\s+[A-Z]')", 3: r"regexp_matches(own, '^\d{1,3}\.\s+[A-Z0-9]')"}
STAYS = {2: r"length(said) >= 25 OR regexp_matches(said, '^(?i)(?:EX-|EXHIBIT|Page|\d+$)')", 3: r"length(said) >= 20 OR regexp_matches(said, '^(?i)(?:SECTION|ARTICLE|EX-|EXHIBIT)') OR (length(said) > 5 AND regexp_matches(said, '^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$'))"}


def pieces_sql(version: int) -> str:
    """CTEs up to seg, the typed clauses of sections: a piece may begin at a numbered line (at the line end before it), in version 3 also after a blank line; pieces that don't stay join what follows, one edge after another."""
    after_blank = "UNION SELECT document_id, place FROM placed WHERE i > 0" if version == 3 else ""
    return f"""{SECTIONS}, docs AS MATERIALIZED (SELECT document_id, text FROM sections WHERE regexp_matches(text, '\\S')),
ln AS (SELECT document_id, i, (i + 1) || '. ' || ls[i + 1] AS own FROM (SELECT doc_id AS document_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(len(ls))) AS t(i)),
placed AS (SELECT *, coalesce(sum(length(own) + 2) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM ln),
edges AS (SELECT document_id, place - 1 AS e FROM placed WHERE i > 0 AND {BEGINS[version]} {after_blank} UNION SELECT document_id, length(text) FROM docs),
rk AS MATERIALIZED (SELECT document_id, CAST(e AS BIGINT) AS e, row_number() OVER (PARTITION BY document_id ORDER BY e) AS k, count(*) OVER (PARTITION BY document_id) AS m FROM edges WHERE e > 0),
f AS (SELECT document_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS open, 0 AS idx, CAST(NULL AS BIGINT) AS s, CAST(NULL AS BIGINT) AS e, 0 AS out_idx FROM docs UNION ALL
  SELECT document_id, k, CASE WHEN closes THEN e ELSE open END, idx + CAST(closes AS INTEGER), CASE WHEN closes AND said <> '' THEN open END, e, idx FROM (SELECT *, k = m OR {STAYS[version]} AS closes FROM
    (SELECT rk.document_id, rk.k, rk.m, rk.e, f.open, f.idx, trim(substr(docs.text, f.open + 1, rk.e - f.open), chr(32) || chr(9) || chr(10)) AS said FROM f JOIN rk ON rk.document_id = f.document_id AND rk.k = f.k + 1 JOIN docs ON docs.document_id = f.document_id))),
cutted AS (SELECT f.document_id, printf('%d_clause_%03d', f.document_id, out_idx) AS clause_id, trim(substr(docs.text, s + 1, e - s), chr(32) || chr(9) || chr(10)) AS t, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end" FROM f JOIN docs USING (document_id) WHERE s IS NOT NULL),
u AS (SELECT *, length(t) AS n FROM cutted), l AS (SELECT *, n >= 50 AND ({LEGAL_HITS} >= 2 OR n > 300) AS legal FROM u), kd AS (SELECT *, {KIND_2 if version == 2 else KIND_3} AS segment_type FROM l),
seg AS (SELECT document_id, clause_id, t AS text, "start", "end", segment_type, {ODD[version]} AS is_suspicious FROM kd)"""


@query(f"WITH RECURSIVE {pieces_sql(2)} SELECT * FROM seg")
def segment_v2_types(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment(A.sections(spark, d), 2)


@query(f"WITH RECURSIVE {pieces_sql(3)} SELECT * FROM seg")
def segment_v3_types(spark: SparkSession, d: str) -> DataFrame:
    return segment.segment(A.sections(spark, d), 3)


@query(f"""WITH RECURSIVE {pieces_sql(3)}, c AS (SELECT document_id, count(*) AS n, count(*) FILTER (segment_type = 'legal_clause') AS legal, count(*) FILTER (is_suspicious) AS bad FROM seg GROUP BY 1)
SELECT DISTINCT document_id, coalesce(n, 0) AS num_clauses, coalesce(legal, 0) AS num_legal_clauses, coalesce(bad, 0) AS n_suspicious, CASE WHEN coalesce(n, 0) <= 3 OR 10 * bad > 4 * n THEN 'HIGH_RISK' WHEN bad > 0 OR n > 100 THEN 'REVIEW' ELSE 'OK' END AS quality_status FROM sections LEFT JOIN c USING (document_id)""")
def segment_v3_status(spark: SparkSession, d: str) -> DataFrame:
    docs = A.sections(spark, d)
    return segment.document_status(segment.segment(docs, 3), docs)


@query(f"""WITH {CLAUSES}, c AS (SELECT doc_id, count(*) AS n, count(*) FILTER (pos % 9 = 2) AS bad, count(*) FILTER (pos % 6 <> 0) AS legal FROM clauses GROUP BY 1)
SELECT doc_id AS document_id, coalesce(n, 0) AS num_clauses, coalesce(legal, 0) AS num_legal_clauses, coalesce(bad, 0) AS n_suspicious, CASE WHEN coalesce(n, 0) <= 3 OR 10 * bad > 4 * n THEN 'HIGH_RISK' WHEN bad > 0 OR n > 100 THEN 'REVIEW' ELSE 'OK' END AS quality_status FROM documents LEFT JOIN c USING (doc_id)""")
def document_status(spark: SparkSession, d: str) -> DataFrame:
    rows = A.clauses(spark, d).select(F.col("doc_id").alias("document_id"), (F.col("pos") % 9 == 2).alias("is_suspicious"), F.when(F.col("pos") % 6 == 0, "header").otherwise("legal_clause").alias("segment_type"))
    return segment.document_status(rows, table(spark, d, "documents").select(F.col("doc_id").alias("document_id")))


@query(f"""WITH {CLAUSES}, r AS (SELECT clause_id, row_number() OVER (ORDER BY md5(clause_id), clause_id) AS r FROM clauses) SELECT clause_id FROM r WHERE r <= 30""")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return S.hash_sample(A.clauses(spark, d).select("clause_id"), "clause_id", 30)


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, 0) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    return R.enrich(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", {"quality": -1, "toxic": 0})


# ---------------------------------------------------------------- one row after another, in SQL by recursion


@query(f"""WITH RECURSIVE {CLAUSES}, b AS (SELECT doc_id, clause_id, CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 400 THEN 'medium' ELSE 'long' END AS bucket, pos % 3 <> 0 AS later, CAST('0x' || substr(md5(clause_id), 1, 4) AS BIGINT) AS h FROM clauses),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY later, h, clause_id) AS r FROM b), n AS (SELECT doc_id, count(*) FILTER (bucket = 'short') AS ns, count(*) FILTER (bucket = 'medium') AS nm, count(*) FILTER (bucket = 'long') AS nl FROM k GROUP BY 1),
st AS (SELECT doc_id, 0 AS turn, CAST('' AS VARCHAR) AS took, 0 AS ts, 0 AS tm, 0 AS tl, ns, nm, nl FROM n UNION ALL
  SELECT doc_id, turn + 1, p, ts + CAST(p = 'short' AS INTEGER), tm + CAST(p = 'medium' AS INTEGER), tl + CAST(p = 'long' AS INTEGER), ns, nm, nl FROM (SELECT *, coalesce(CASE ['short', 'medium', 'long', 'medium', 'long'][turn + 1]
    WHEN 'short' THEN CASE WHEN ts < ns THEN 'short' WHEN tm < nm THEN 'medium' WHEN tl < nl THEN 'long' END WHEN 'medium' THEN CASE WHEN tm < nm THEN 'medium' WHEN tl < nl THEN 'long' WHEN ts < ns THEN 'short' END
    ELSE CASE WHEN tl < nl THEN 'long' WHEN tm < nm THEN 'medium' WHEN ts < ns THEN 'short' END END, '') AS p FROM st WHERE turn < 5))
SELECT k.doc_id, k.clause_id, st.turn - 1 AS turn, k.bucket AS length_bucket, 'wanted ' || ['short', 'medium', 'long', 'medium', 'long'][st.turn] || ', took ' || took AS selection_reason
FROM st JOIN k ON k.doc_id = st.doc_id AND k.bucket = st.took AND k.r = CASE took WHEN 'short' THEN ts WHEN 'medium' THEN tm ELSE tl END WHERE took <> ''""")
def seed_batch(spark: SparkSession, d: str) -> DataFrame:
    rows = A.clauses(spark, d).withColumn("review_status", F.when(F.col("pos") % 3 == 0, "PRIORITY_UNREVIEWED").otherwise("UNREVIEWED"))
    return S.seed_batch(rows, "doc_id", "clause_id", "text", "review_status").select("doc_id", "clause_id", "turn", "length_bucket", "selection_reason")


@query(f"""WITH RECURSIVE {CLAUSES}, s AS MATERIALIZED (SELECT doc_id, n, row_number() OVER (ORDER BY n DESC, doc_id) AS r FROM (SELECT doc_id, count(*) AS n FROM clauses GROUP BY 1)),
f AS (SELECT CAST(0 AS BIGINT) AS r, [0, 0, 0, 0, 0]::BIGINT[] AS load, CAST(NULL AS BIGINT) AS doc_id, 0 AS fold UNION ALL
  SELECT s.r, list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN s.n ELSE 0 END), s.doc_id, list_position(load, list_min(load)) - 1 FROM f JOIN s ON s.r = f.r + 1)
SELECT doc_id, CAST(fold AS INTEGER) AS fold FROM f WHERE r > 0""")
def group_folds(spark: SparkSession, d: str) -> DataFrame:
    return splits.group_folds(A.clauses(spark, d), "doc_id")


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def resume_stream(spark: SparkSession, d: str) -> DataFrame:
    from clausegrain.streaming.resume import latest_by_user

    return latest_by_user(spark, f"{d}/events.parquet")
