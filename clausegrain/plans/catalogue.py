"""Every query of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausegrain.functions import labels as L, text as X
from clausegrain.functions.taxonomy import CATEGORIES, RISK, label_col
from clausegrain.operators import ensemble, metrics, relations as R, risk, segment, selection as S, splits, stats
from clausegrain.plans import adapters as A
from clausegrain.plans.adapters import CLAUSES, LABELLED, PREDICTIONS, SECTIONS, TAXONOMY, VOTES, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.strip()
        return f

    return register


# Terms that the driver's invented prose holds, in the rule classifier's form.
PROSE_TERMS = {c: t for c, t in zip(CATEGORIES, ("the|der|les", "and|und|el", "that|die|des", "with|von|por", "for|mit|para", "was|ist|pour", "are|sich|su", "this|dem|dans", "from|nicht|como", "or|das|une", "license|rights"), strict=False)}
CASES = ", ".join(f"CASE WHEN regexp_matches(lower(text), '(^|[^\\pL\\pN_])({t})($|[^\\pL\\pN_])') THEN '{c}' END" for c, t in PROSE_TERMS.items())
RULED = f"ruled AS (SELECT *, CASE WHEN len(found) = 0 THEN ['Additional Information'] ELSE list_sort(found) END AS labels FROM (SELECT *, list_filter([{CASES}], lambda x: x IS NOT NULL) AS found FROM clauses))"


def ruled(spark: SparkSession, d: str) -> DataFrame:
    return A.clauses(spark, d).withColumn("labels", L.by_rules(F.col("text"), PROSE_TERMS))


# ---------------------------------------------------------------- text and labels


@query(f"WITH {CLAUSES} SELECT doc_id, pos, clause_id, CAST(length(text) AS INTEGER) AS n_chars, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS n_words FROM clauses")
def clause_explode(spark, d):
    return A.clauses(spark, d).select("doc_id", "pos", "clause_id", F.length("text").alias("n_chars"), X.n_words(F.col("text")).alias("n_words"))


@query(f"""WITH b AS (SELECT doc_id, pos, trim(ls[pos + 1], chr(32) || chr(9) || chr(10)) AS text, pos % 4 = 3 AS no_tag, pos % 5 = 2 AS no_labels FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(len(ls))) AS t(pos))
SELECT doc_id, CAST(pos AS INTEGER) AS clause_index, printf('%d_clause_%d', doc_id, pos) AS global_id, CASE WHEN NOT no_tag AND NOT no_labels AND text <> '' THEN text END AS text,
  CASE WHEN no_tag THEN 'no class tag' WHEN no_labels THEN 'no labels' WHEN text = '' THEN 'empty text' END AS warning, CASE WHEN no_tag OR no_labels OR text = '' THEN 0 ELSE 2 END AS num_labels FROM b""")
def annotated_parse(spark, d):
    from clausegrain.sources.annotated import parse

    blocks = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.lit("[INIT_CLAUSE]"), x, F.when(i % 4 == 3, "").otherwise(F.concat(F.lit("[INIT_CLASSE]"), F.when(i % 5 == 2, " , ").otherwise(" Purpose, NDA Type "), F.lit("[END_CLASSE]"))), F.lit("[END_CLAUSE]")))
    tagged = table(spark, d, "documents").where("text is not null").select(F.col("doc_id"), F.array_join(blocks, "\n").alias("text"))
    return parse(tagged, "doc_id").select("doc_id", "clause_index", "global_id", "text", "warning", "num_labels")


MESSY = "replace(replace(text, 'e ', 'e  ' || chr(9)), '. ', '. ' || chr(10) || chr(10) || chr(10) || ' ' || chr(7))"


def messy(spark, d):
    t = F.replace(F.col("text"), F.lit("e "), F.lit("e  \t"))
    return table(spark, d, "documents").select("doc_id", F.replace(t, F.lit(". "), F.lit(". \n\n\n \x07")).alias("text"))


CONTROLS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


@query(rf"""WITH m AS (SELECT doc_id, nfc_normalize(regexp_replace({MESSY}, '{CONTROLS}', '', 'g')) AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(translate(t, chr(9), ' '), '[ \r\f\v]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM m)
SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x)), chr(10)), '^\s+', ''), '\s+$', '') AS text FROM s""")
def text_clean(spark, d):
    return messy(spark, d).select("doc_id", X.clean_clause(F.col("text")).alias("text"))


@query(rf"""WITH m AS (SELECT doc_id, regexp_replace(nfc_normalize({MESSY}), '{CONTROLS}', '', 'g') AS t FROM documents),
s AS (SELECT doc_id, regexp_replace(translate(t, chr(9), ' '), '[ \r\f\v]+', ' ', 'g') AS t FROM m)
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: rtrim(x)), chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '') AS text FROM s""")
def text_clean_pdf(spark, d):
    return messy(spark, d).select("doc_id", X.clean_extracted(F.col("text")).alias("text"))


@query(f"WITH {CLAUSES}, {LABELLED} SELECT clause_id, list_sort(list_distinct(list_filter(list_transform(list_concat(labels, list_transform(labels, lambda x: ' ' || upper(x) || ' '), ['  ']), lambda x: lower(trim(x))), lambda x: x <> ''))) AS labels FROM clause_labels")
def label_normalise(spark, d):
    noisy = F.concat("labels", F.transform("labels", lambda x: F.concat(F.lit(" "), F.upper(x), F.lit(" "))), F.array(F.lit("  ")))
    return A.clause_labels(spark, d).select("clause_id", L.normalize(noisy).alias("labels"))


@query(f"WITH {CLAUSES}, {LABELLED} SELECT clause_id, " + ", ".join(f"CAST(list_contains(labels, '{c}') AS INTEGER) AS \"{label_col(c)}\"" for c in CATEGORIES) + " FROM clause_labels")
def multi_hot(spark, d):
    return A.clause_labels(spark, d).select("clause_id", *L.multi_hot(F.col("labels")))


@query(f"""WITH {CLAUSES} SELECT clause_id, len(text) < 50 AS is_short, CASE WHEN length(text) < 100 THEN 'short' WHEN length(text) < 400 THEN 'medium' ELSE 'long' END AS bucket,
CAST(('0x' || substr(md5(clause_id), 1, 4)) AS BIGINT) AS spread, regexp_replace(clause_id, '_\\d+$', '_') || printf('%03d', CAST(regexp_extract(clause_id, '_(\\d+)$', 1) AS INTEGER) + 1) AS next_id, left(clause_id, 8) AS short_id FROM clauses""")
def clause_keys(spark, d):
    return A.clauses(spark, d).select("clause_id", (F.length("text") < 50).alias("is_short"), X.length_bucket(F.col("text")).alias("bucket"), X.hash_order(F.col("clause_id")).alias("spread"), X.neighbour_id(F.col("clause_id"), 1).alias("next_id"), F.left("clause_id", F.lit(8)).alias("short_id"))


@query(f"WITH {CLAUSES}, {RULED} SELECT doc_id, clause_id, labels FROM ruled")
def rule_labels(spark, d):
    return ruled(spark, d).select("doc_id", "clause_id", "labels")


RAW = "CASE doc_id % 5 WHEN 0 THEN '[\"Purpose\",\"Unknown\"]' WHEN 1 THEN '\"Purpose\"' WHEN 2 THEN 'Purpose; Employees' WHEN 3 THEN '[]' ELSE '{\"a\":1}' END"


@query(f"""WITH r AS (SELECT doc_id, doc_id % 5 AS k, {RAW} AS raw FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN ['Purpose'] ELSE [] END AS known, CASE k WHEN 0 THEN ['Purpose', 'Unknown'] WHEN 3 THEN [] END AS or_null,
CASE k WHEN 0 THEN ['Purpose', 'Unknown'] WHEN 1 THEN ['Purpose'] ELSE [] END AS scalar, CASE k WHEN 0 THEN ['Purpose', 'Unknown'] WHEN 3 THEN [] WHEN 2 THEN ['Purpose', 'Employees'] ELSE [raw] END AS parted,
CASE k WHEN 0 THEN ['Purpose', 'Unknown'] WHEN 3 THEN [] ELSE ['Additional Information'] END AS fallback FROM r""")
def label_parsers(spark, d):
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, '["Purpose","Unknown"]').when(k == 1, '"Purpose"').when(k == 2, "Purpose; Employees").when(k == 3, "[]").otherwise('{"a":1}')
    rows = table(spark, d, "documents").select("doc_id", raw.alias("raw"))
    r = F.col("raw")
    return rows.select("doc_id", L.parse(r).alias("known"), L.parse(r, "null").alias("or_null"), L.parse(r, "scalar").alias("scalar"), L.parse(r, "split").alias("parted"), L.parse(r, "fallback").alias("fallback"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ['Purpose'] WHEN doc_id % 3 = 1 THEN ['NDA Type', 'NDA Type'] ELSE [] END AS labels,
CASE WHEN doc_id % 3 = 0 THEN least(1.0, doc_id % 150 / 100) WHEN doc_id % 3 = 1 THEN 0.5 ELSE 0.0 END AS confidence, CASE WHEN doc_id % 3 = 2 THEN 'INVALID_RESPONSE' ELSE 'SUCCESS' END AS status FROM documents""")
def response_parse(spark, d):
    i = F.col("doc_id")
    raw = F.when(i % 3 == 0, F.concat(F.lit('```json\n{"label": "purpose", "confidence": '), (i % 150 / 100).cast("string"), F.lit(', "reason": "r"}\n```'))).when(i % 3 == 1, '{"labels": ["nda type", "?", "NDA TYPE"], "reason": "x"}').otherwise("no json")
    return table(spark, d, "documents").select("doc_id", L.parse_response(raw).alias("r")).select("doc_id", "r.labels", "r.confidence", "r.status")


# ---------------------------------------------------------------- segmentation

V1_SQL = f"""WITH {SECTIONS},
ln AS (SELECT document_id, text, i, (i + 1) || '. ' || ls[i + 1] AS own FROM (SELECT document_id, text, string_split(d.text2, chr(10)) AS ls FROM (SELECT s.document_id, s.text, o.text AS text2 FROM sections s JOIN documents o ON o.doc_id = s.document_id) d), unnest(range(len(ls))) AS t(i)),
at AS (SELECT *, coalesce(sum(length(own) + 2) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place FROM ln),
sp AS (SELECT *, CASE WHEN i = 0 THEN 0 ELSE place - 1 END AS s, coalesce(lead(place) OVER (PARTITION BY document_id ORDER BY i) - 1, length(text)) AS e FROM at),
g AS (SELECT *, sum(CASE WHEN i = 0 OR length(own) >= 30 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY i) AS gid FROM sp),
isl AS (SELECT *, min(s) OVER (PARTITION BY document_id, gid) AS gs, max(e) OVER (PARTITION BY document_id, gid) AS ge, min(i) OVER (PARTITION BY document_id, gid) AS gi FROM g),
cut AS (SELECT document_id, text, i, CASE WHEN ge - gs - CASE WHEN gi > 0 THEN 1 ELSE 0 END - CASE WHEN ge < length(text) THEN 1 ELSE 0 END > 5000 THEN CASE WHEN i = gi THEN gs ELSE place END ELSE gs END AS s,
  CASE WHEN ge - gs - CASE WHEN gi > 0 THEN 1 ELSE 0 END - CASE WHEN ge < length(text) THEN 1 ELSE 0 END > 5000 THEN CASE WHEN e = ge THEN ge ELSE place + length(own) END ELSE ge END AS e FROM isl),
u AS (SELECT DISTINCT document_id, text, s, e FROM cut)
SELECT document_id, printf('%d_clause_%03d', document_id, row_number() OVER (PARTITION BY document_id ORDER BY s) - 1) AS clause_id, CAST(s AS INTEGER) AS "start", CAST(e AS INTEGER) AS "end",
  regexp_replace(regexp_replace(substr(text, CAST(s AS BIGINT) + 1, CAST(e - s AS BIGINT)), '^\\s+', ''), '\\s+$', '') AS text FROM u"""


@query(V1_SQL.replace("\nat AS (", "\nplaced AS (").replace("FROM at)", "FROM placed)"))
def segment_v1(spark, d):
    return segment.segment_v1(A.sections(spark, d)).select("document_id", "clause_id", "start", "end", "text")


# ---------------------------------------------------------------- statistics

NW = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


@query(f"""WITH {CLAUSES}, b AS (SELECT doc_id, count(*) AS n FROM clauses GROUP BY doc_id)
SELECT (SELECT count(*) FROM b) AS documents, count(*) AS clauses, (SELECT min(n) FROM b) AS min_clauses, (SELECT max(n) FROM b) AS max_clauses, (SELECT avg(n) FROM b) AS avg_clauses,
CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars, avg(length(text)) AS avg_chars, CAST(min({NW}) AS INTEGER) AS min_words, CAST(max({NW}) AS INTEGER) AS max_words, avg({NW}) AS avg_words FROM clauses""")
def corpus_stats(spark, d):
    return stats.corpus(A.clauses(spark, d), "doc_id")


@query(f"""WITH {CLAUSES} SELECT doc_id, count(*) AS clauses, avg(length(text)) AS mean_chars, CAST(median(length(text)) AS DOUBLE) AS median_chars, CAST(min(length(text)) AS INTEGER) AS min_chars, CAST(max(length(text)) AS INTEGER) AS max_chars,
count(*) FILTER (length(text) < 20) AS short, CASE WHEN count(*) <= 6 THEN 'few' WHEN count(*) >= 40 THEN 'many' ELSE 'ok' END AS note FROM clauses GROUP BY doc_id""")
def doc_audit(spark, d):
    return stats.document_audit(A.clauses(spark, d), "doc_id")


@query(f"""WITH {CLAUSES}, a AS (SELECT doc_id, count(*) AS clauses, avg(length(text)) AS mean_chars, max(length(text)) AS max_chars FROM clauses GROUP BY doc_id)
SELECT 'clauses' AS metric, doc_id, CAST(clauses AS DOUBLE) AS value FROM (SELECT * FROM a ORDER BY clauses DESC, doc_id LIMIT 1) UNION ALL SELECT 'mean_chars', doc_id, mean_chars FROM (SELECT * FROM a ORDER BY mean_chars DESC, doc_id LIMIT 1)
UNION ALL SELECT 'max_chars', doc_id, max_chars FROM (SELECT * FROM a ORDER BY max_chars DESC, doc_id LIMIT 1)""")
def extreme_documents(spark, d):
    return stats.extremes(stats.document_audit(A.clauses(spark, d), "doc_id"), "doc_id", ("clauses", "mean_chars", "max_chars"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '12' WHEN 1 THEN 'Section 4' WHEN 2 THEN 'Page 3' WHEN 3 THEN 'EXHIBIT A' WHEN 4 THEN '...' ELSE text END AS text FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'short_<=20_chars; only_punctuation; only_numbers; only_section_numbers; page_numbers' WHEN 1 THEN 'short_<=20_chars; only_section_numbers' WHEN 2 THEN 'short_<=20_chars; page_numbers'
WHEN 3 THEN 'short_<=20_chars; header_or_title' WHEN 4 THEN 'short_<=20_chars; only_punctuation' ELSE array_to_string(list_filter([CASE WHEN length(text) <= 20 THEN 'short_<=20_chars' END, CASE WHEN contains(lower(text), 'exhibit') OR (text = upper(text) AND length(text) < 40 AND text NOT LIKE '%.') THEN 'header_or_title' END], lambda x: x IS NOT NULL), '; ') END AS reasons FROM t""")
def audit_reasons(spark, d):
    k = F.col("doc_id") % 6
    t = F.when(k == 0, "12").when(k == 1, "Section 4").when(k == 2, "Page 3").when(k == 3, "EXHIBIT A").when(k == 4, "...").otherwise(F.col("text"))
    return table(spark, d, "documents").select("doc_id", stats.audit_reasons(t).alias("reasons"))


@query(f"""WITH {CLAUSES}, {LABELLED}, e AS (SELECT unnest(labels) AS label FROM clause_labels), n AS (SELECT label, count(*) AS n FROM e GROUP BY label)
SELECT label, n, 100 * n / sum(n) OVER () AS percent, n >= avg(n) OVER () AS is_majority FROM n""")
def label_frequency(spark, d):
    return stats.label_frequency(A.clause_labels(spark, d))


DIST = "e AS (SELECT doc_id, unnest(list_distinct(labels)) AS category FROM {src}), per_cat AS (SELECT category, count(*) AS clauses, count(DISTINCT doc_id) AS documents FROM e GROUP BY category)"


@query(f"""WITH {CLAUSES}, {RULED}, {TAXONOMY}, {DIST.format(src='ruled')}
SELECT cat_idx, category, coalesce(clauses, 0) AS clauses, coalesce(documents, 0) AS documents, 100 * coalesce(clauses, 0) / (SELECT count(*) FROM ruled) AS percent FROM taxonomy LEFT JOIN per_cat USING (category)""")
def category_distribution(spark, d):
    return stats.category_distribution(ruled(spark, d), "doc_id")


@query(f"""WITH {CLAUSES}, {RULED}, {TAXONOMY}, {DIST.format(src='ruled')}, t AS (SELECT count(*) AS n FROM ruled)
SELECT cat_idx, category, coalesce(clauses, 0) AS positives, n - coalesce(clauses, 0) AS negatives, 100 * coalesce(clauses, 0) / n AS percent, coalesce(documents, 0) AS document_frequency,
CASE WHEN clauses > 0 THEN (n - clauses) / clauses END AS neg_per_pos, coalesce(clauses, 0) >= 15 AS is_majority FROM taxonomy LEFT JOIN per_cat USING (category) CROSS JOIN t""")
def class_imbalance(spark, d):
    return stats.class_imbalance(ruled(spark, d), "doc_id")


@query(f"""WITH {CLAUSES}, {LABELLED}, e AS (SELECT doc_id, unnest(list_distinct(labels)) AS category FROM clause_labels), n AS (SELECT doc_id, count(*) AS clauses FROM clause_labels GROUP BY doc_id),
c AS (SELECT doc_id, """ + ", ".join(f"count(*) FILTER (category = '{c}') AS \"{c}\"" for c in CATEGORIES) + """, count(DISTINCT category) AS categories_present FROM e GROUP BY doc_id)
SELECT n.doc_id, clauses, """ + ", ".join(f'coalesce("{c}", 0) AS "{c}"' for c in CATEGORIES) + ", coalesce(categories_present, 0) AS categories_present FROM n LEFT JOIN c USING (doc_id)")
def doc_category_matrix(spark, d):
    return stats.document_categories(A.clause_labels(spark, d), "doc_id")


@query(f"""WITH {CLAUSES}, {LABELLED}, {TAXONOMY}, e AS (SELECT doc_id, unnest(list_distinct(labels)) AS category FROM clause_labels), n AS (SELECT category, doc_id, count(*) AS n FROM e GROUP BY ALL),
b AS (SELECT category, CAST(sum(n) AS BIGINT) AS clauses, count(*) AS documents, count(*) FILTER (n >= 2) AS ge_2, count(*) FILTER (n >= 3) AS ge_3 FROM n GROUP BY category)
SELECT category, coalesce(clauses, 0) AS clauses, coalesce(documents, 0) AS documents, coalesce(ge_2, 0) AS ge_2, coalesce(ge_3, 0) AS ge_3, 100 * coalesce(documents, 0) / (SELECT count(DISTINCT doc_id) FROM clauses) AS percent_documents FROM taxonomy LEFT JOIN b USING (category)""")
def coverage_by_category(spark, d):
    return stats.coverage(A.clause_labels(spark, d), "doc_id")


SPLIT = "CASE doc_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"


def with_split(df):
    k = F.col("doc_id") % 10
    return df.withColumn("split", F.when(k == 0, "test").when(k == 1, "validation").otherwise("train"))


@query(f"""WITH {CLAUSES}, {LABELLED}, {TAXONOMY}, e AS (SELECT {SPLIT} AS split, unnest(list_distinct(labels)) AS category FROM clause_labels),
n AS (SELECT category, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation, count(*) FILTER (split = 'test') AS test FROM e GROUP BY category),
f AS (SELECT category, coalesce(train, 0) AS train, coalesce(validation, 0) AS validation, coalesce(test, 0) AS test FROM taxonomy LEFT JOIN n USING (category))
SELECT *, array_to_string(list_filter([CASE WHEN train = 0 THEN 'train' END, CASE WHEN validation = 0 THEN 'validation' END, CASE WHEN test = 0 THEN 'test' END], lambda x: x IS NOT NULL), ',') AS missing_in FROM f""")
def split_support(spark, d):
    return stats.split_support(with_split(A.clause_labels(spark, d)))


@query(f"""WITH {CLAUSES}, {LABELLED} SELECT doc_id, count(*) AS clauses, list_sort(list_distinct(flatten(list(labels)))) AS categories FROM clause_labels GROUP BY doc_id""")
def document_profile(spark, d):
    return stats.document_profile(A.clause_labels(spark, d), "doc_id")


@query(f"WITH {CLAUSES}, {VOTES} SELECT model, count(*) AS calls, count(*) FILTER (confidence > 0) AS successes, count(*) FILTER (confidence > 0) / count(*) AS rate FROM votes GROUP BY model")
def model_success(spark, d):
    return stats.success_rate(A.votes(spark, d))


@query(f"SELECT source, count(*) AS documents, avg({NW}) AS avg_words, CAST(min({NW}) AS INTEGER) AS min_words, CAST(max({NW}) AS INTEGER) AS max_words FROM documents GROUP BY source")
def source_inventory(spark, d):
    return stats.inventory(table(spark, d, "documents"), "source", "text")


@query("SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{s}') AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY o_orderpriority")
def status_crosstab(spark, d):
    return stats.crosstab(table(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


# ---------------------------------------------------------------- ensembles and scores

PAIR = "CASE WHEN len(list_distinct(list_concat({0}, {1}))) = 0 THEN 1.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
ENSEMBLE = f"""{CLAUSES}, {VOTES}, g AS (SELECT clause_id, any_value(text) AS text, any_value(doc_id) AS doc_id, count(*) AS models, count(*) FILTER (status = 'SUCCESS') AS n, list(list_sort(labels) ORDER BY model) FILTER (status = 'SUCCESS') AS ls, list(confidence ORDER BY model) FILTER (status = 'SUCCESS') AS cs FROM votes GROUP BY clause_id),
j AS (SELECT *, CASE WHEN n >= 2 THEN (list_sum(cs)) / n ELSE coalesce(cs[1], 0.0) END AS average_confidence,
  CASE WHEN n = 3 THEN ({PAIR.format('ls[1]', 'ls[2]')} + {PAIR.format('ls[1]', 'ls[3]')} + {PAIR.format('ls[2]', 'ls[3]')}) / 3 WHEN n = 2 THEN {PAIR.format('ls[1]', 'ls[2]')} ELSE 0.0 END AS agreement_score,
  list_filter(list_distinct(flatten(coalesce(ls, []))), lambda x: len(list_filter(flatten(ls), lambda y: y = x)) >= 2) AS major FROM g),
ens AS (SELECT clause_id, doc_id, text, CAST(models AS INTEGER) AS models, CAST(n AS INTEGER) AS successes, average_confidence, agreement_score,
  list_sort(CASE WHEN n < 2 THEN coalesce(ls[1], []) WHEN len(major) > 0 THEN major ELSE ls[list_position(cs, list_max(cs))] END) AS labels, n >= 2 AND len(list_distinct(ls)) > 1 AS label_disagreement,
  CASE WHEN n < 2 THEN 'API_ERROR' WHEN agreement_score >= 0.8 AND average_confidence >= 0.8 THEN 'HIGH_CONFIDENCE' WHEN agreement_score >= 0.5 AND average_confidence >= 0.6 THEN 'MEDIUM_CONFIDENCE' WHEN agreement_score < 0.5 THEN 'DISAGREEMENT' ELSE 'LOW_CONFIDENCE' END AS quality FROM j)"""


def combined(spark, d):
    votes = A.votes(spark, d)
    return ensemble.combine(votes)


@query(f"WITH {ENSEMBLE} SELECT clause_id, models, successes, labels, label_disagreement FROM ens")
def ensemble_vote(spark, d):
    return combined(spark, d).select("clause_id", "models", "successes", "labels", "label_disagreement")


@query(f"WITH {ENSEMBLE} SELECT clause_id, average_confidence, agreement_score, quality FROM ens")
def ensemble_quality(spark, d):
    return combined(spark, d).select("clause_id", "average_confidence", "agreement_score", "quality")


@query(f"WITH {ENSEMBLE} SELECT quality, count(*) AS rows, min(average_confidence) AS min_confidence, max(average_confidence) AS max_confidence, avg(average_confidence) AS avg_confidence, coalesce(stddev_samp(average_confidence), 0.0) AS std_confidence, avg(agreement_score) AS avg_agreement FROM ens GROUP BY quality")
def quality_summary(spark, d):
    return stats.quality_summary(combined(spark, d), "quality", "average_confidence", "agreement_score")


@query(f"""WITH {ENSEMBLE}, e AS (SELECT quality, unnest(labels) AS category FROM ens) SELECT category, """ + ", ".join(f"count(*) FILTER (quality = '{q}') AS \"{q}\"" for q in ("HIGH_CONFIDENCE", "MEDIUM_CONFIDENCE", "LOW_CONFIDENCE", "DISAGREEMENT")) + " FROM e GROUP BY category")
def quality_crosstab(spark, d):
    each = combined(spark, d).select("quality", F.explode("labels").alias("category"))
    return stats.crosstab(each, "category", "quality", ["HIGH_CONFIDENCE", "MEDIUM_CONFIDENCE", "LOW_CONFIDENCE", "DISAGREEMENT"])


WEIGHTS = "CASE quality WHEN 'API_ERROR' THEN 1.0 WHEN 'INVALID_RESPONSE' THEN 1.0 WHEN 'DISAGREEMENT' THEN 0.9 WHEN 'LOW_CONFIDENCE' THEN 0.7 WHEN 'MEDIUM_CONFIDENCE' THEN 0.4 WHEN 'HIGH_CONFIDENCE' THEN 0.1 ELSE 0.5 END"


@query(f"WITH {ENSEMBLE} SELECT clause_id, quality, (1 - agreement_score) + 0.5 * (1 - average_confidence) + CAST({WEIGHTS} AS DOUBLE) + least(length(text) / 1000, 0.5) AS priority FROM ens")
def review_priority(spark, d):
    rows = combined(spark, d).join(A.clauses(spark, d).select("clause_id", "text"), "clause_id")
    return rows.select("clause_id", "quality", L.review_priority(F.col("agreement_score"), F.col("average_confidence"), F.col("quality"), F.col("text")).alias("priority"))


PROSE_SIGNALS = {"Liability for Damages": r"\b(?:the|der|les)", "Competition Rights": r"\b(?:and|und)", "Intellectual Property": r"\b(?:lic|right)", "Governing Law and Jurisdiction": r"\b(?:of|von|de)"}
# The other engine's word boundary knows ASCII letters only.
SQL_SIGNALS = [p.replace("\\b", "(?:^|[^\\pL\\pN_])") for p in PROSE_SIGNALS.values()]
COUNTS = [f"len(regexp_extract_all(lower(text), '{p}'))" for p in SQL_SIGNALS]


@query(f"""WITH {CLAUSES} SELECT clause_id, CASE WHEN doc_id % 3 = 0 THEN 30.0 ELSE 0.0 END + 15.0 * ({' + '.join(f'CAST({c} > 0 AS INTEGER)' for c in COUNTS)}) + least(20.0, 2.0 * ({' + '.join(COUNTS)})) + least(10.0, CAST(0.05 AS DOUBLE) * {NW}) AS score FROM clauses""")
def heuristic_score(spark, d):
    return A.clauses(spark, d).select("clause_id", L.heuristic_score(F.col("text"), F.col("doc_id") % 3 == 0, PROSE_SIGNALS).alias("score"))


@query(f"""WITH {CLAUSES}, h AS (SELECT doc_id, {', '.join(f"sum(CAST(regexp_matches(lower(text), '{p}') AS INTEGER)) AS s{i}" for i, p in enumerate(SQL_SIGNALS))}, count(*) AS clauses FROM clauses GROUP BY doc_id)
SELECT doc_id, clauses, {' + '.join(f'CAST(s{i} > 0 AS INTEGER)' for i in range(4))} AS distinct_signals, CAST(s0 + s1 + s2 + s3 AS BIGINT) AS total_signals, 10 * ({' + '.join(f'CAST(s{i} > 0 AS INTEGER)' for i in range(4))}) + 2 * (s0 + s1 + s2 + s3) + CAST(0.1 AS DOUBLE) * clauses AS score FROM h""")
def doc_signal_score(spark, d):
    return stats.signal_score(A.clauses(spark, d), PROSE_SIGNALS, "doc_id")


@query("SELECT vec_id, 1 - list_sum(list_transform(embedding, lambda x: abs(1 / (1 + exp(-CAST(x AS DOUBLE))) - 0.5))) / len(embedding) AS uncertainty, len(list_filter(embedding, lambda x: 1 / (1 + exp(-CAST(x AS DOUBLE))) >= 0.5)) AS positives FROM embeddings")
def score_uncertainty(spark, d):
    p = F.transform("embedding", lambda x: L.sigmoid(x.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", L.uncertainty(p).alias("uncertainty"), F.size(F.filter(p, lambda x: x >= 0.5)).cast("long").alias("positives"))


P = "least(greatest(y_prob, 1e-12), 1 - 1e-12)"
BCE = f"-(y_true * ln({P}) + (1 - y_true) * ln(1 - {P}))"


@query(f"""WITH {PREDICTIONS} SELECT category, avg({BCE}) AS bce, avg(-(2.0 * y_true * ln({P}) + (1 - y_true) * ln(1 - {P}))) AS weighted_bce,
avg(CASE WHEN y_true = 1 THEN 0.25 ELSE 0.75 END * pow(1 - CASE WHEN y_true = 1 THEN y_prob ELSE 1 - y_prob END, 2) * {BCE}) AS focal FROM predictions GROUP BY category""")
def losses(spark, d):
    p, y = F.col("y_prob"), F.col("y_true")
    return A.predictions(spark, d).groupBy("category").agg(F.avg(L.bce(p, y)).alias("bce"), F.avg(L.bce(p, y, 2.0)).alias("weighted_bce"), F.avg(L.focal(p, y)).alias("focal"))


# ---------------------------------------------------------------- selection


def scored(spark, d):
    return A.clauses(spark, d).select("doc_id", "clause_id", "pos", (A.formula() % 997).alias("score"))


SCORED = f"{CLAUSES}, scored AS (SELECT doc_id, clause_id, pos, (doc_id * 7 + pos * 3 + length(text)) % 997 AS score FROM clauses)"


@query(f"WITH {SCORED} SELECT doc_id, clause_id, pos, score, CAST(row_number() OVER (ORDER BY score DESC, clause_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 200")
def ranked_queue(spark, d):
    return S.ranked(scored(spark, d), "score", "clause_id", 200)


@query(f"WITH {SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score, clause_id) AS own FROM scored) SELECT doc_id, clause_id, pos, score FROM o WHERE own <= 3 ORDER BY score, clause_id LIMIT 100")
def capped_topk(spark, d):
    return S.capped_top(scored(spark, d), "score", "clause_id", "doc_id", 3, 100)


@query(f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY score DESC, clause_id) AS r FROM scored), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r) AS own FROM r WHERE r <= 150),
u AS (SELECT *, 0 AS stage FROM p WHERE own <= 3 UNION ALL SELECT *, 0, 1 FROM r WHERE r > 150) SELECT doc_id, clause_id, pos, score FROM u ORDER BY stage, r LIMIT 50""")
def uncertain_batch(spark, d):
    return S.uncertain_batch(scored(spark, d), "score", "clause_id", "doc_id", 50)


TIERS = "t AS (SELECT s.*, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 9 END AS valid FROM scored s), k AS (SELECT *, CASE WHEN coalesce(valid, 0) = 0 THEN 0 WHEN valid < 5 THEN 1 ELSE 2 END AS tier, doc_id * 100000 + pos AS position FROM t)"


@query(f"""WITH {SCORED}, {TIERS}, o AS (SELECT *, min(position) OVER (PARTITION BY doc_id) AS first_position, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS own FROM k)
SELECT doc_id, clause_id, tier, first_position, position FROM o WHERE own <= 4 ORDER BY tier, first_position, position LIMIT 300""")
def tiered_expansion(spark, d):
    queue = scored(spark, d).withColumn("position", F.col("doc_id") * 100000 + F.col("pos"))
    k = F.col("doc_id") % 4
    counts = table(spark, d, "documents").where("doc_id % 4 <> 0").select("doc_id", F.when(k == 1, 0).when(k == 2, 3).otherwise(9).alias("valid")).distinct()
    return S.tiered_expansion(queue, counts, "doc_id", "position", 4, 300).select("doc_id", "clause_id", "tier", "first_position", "position")


@query(f"""WITH {ENSEMBLE}, s AS (SELECT clause_id, quality, count(*) OVER (PARTITION BY quality) AS s, count(*) OVER () AS n, row_number() OVER (PARTITION BY quality ORDER BY md5(clause_id), clause_id) AS r FROM ens)
SELECT clause_id, quality FROM s WHERE r <= greatest(1, floor(s * least(40, n) / n))""")
def stratified_sample(spark, d):
    return S.stratified_sample(combined(spark, d).select("clause_id", "quality"), "quality", "clause_id")


@query("SELECT doc_id, source FROM (SELECT * FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 50)")
def document_sample(spark, d):
    return S.document_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 50)


@query(f"""WITH {SCORED} SELECT clause_id, list_filter([CASE WHEN pos % 7 = 0 THEN 'NEEDS_CONTEXT' END, CASE WHEN score / 997 < 0.7 THEN 'LOW_CONFIDENCE' END, CASE WHEN pos % 5 = 1 THEN 'SPLIT' END,
CASE WHEN score / 997 >= 0.9 AND CAST('0x' || substr(md5(clause_id), 1, 4) AS BIGINT) % 100 < 10 THEN 'AUDIT' END], lambda x: x IS NOT NULL) AS reasons FROM scored""")
def review_routing(spark, d):
    rows = scored(spark, d).select("clause_id", F.when(F.col("pos") % 5 == 1, "SPLIT").otherwise("KEEP").alias("action"), (F.col("score") / 997).alias("confidence"), (F.col("pos") % 7 == 0).alias("ctx"))
    return S.routing(rows, "clause_id", "action", "confidence", "ctx").select("clause_id", "reasons")


@query(f"""WITH {CLAUSES} SELECT clause_id, pos % 9 = 0 OR length(text) < 20 OR length(text) > 3000 OR count(*) OVER (PARTITION BY doc_id) < 5 OR count(*) OVER (PARTITION BY doc_id) > 60 AS needs_review FROM clauses""")
def human_review_flags(spark, d):
    rows = A.clauses(spark, d).withColumns({"suspicious": F.col("pos") % 9 == 0, "kind": F.lit("legal_clause")})
    return S.review_needed(rows, "doc_id", "text", "kind", "suspicious", ("fragment", "header", "page_number", "section_heading")).select("clause_id", "needs_review")


# ---------------------------------------------------------------- relations


@query("SELECT o.* FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_returnflag = 'R')")
def pending_anti_join(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.pending(table(spark, d, "orders"), done, "o_orderkey")


@query("SELECT o.* FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)")
def completed_semi_join(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.completed(table(spark, d, "orders"), done, "o_orderkey")


@query("""WITH new AS (SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey + 100000000, 'N', o_totalprice, o_orderdate FROM orders WHERE o_orderkey % 50 = 0)
SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM new) UNION ALL SELECT n.o_orderkey, n.o_orderstatus, n.o_totalprice, coalesce(o.o_orderdate, n.o_orderdate) FROM new n LEFT JOIN orders o USING (o_orderkey)""")
def keyed_upsert(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    changed = old.where("o_orderkey % 3 = 0").withColumns({"o_orderstatus": F.lit("X"), "o_totalprice": F.col("o_totalprice") + 1})
    added = old.where("o_orderkey % 50 = 0").withColumns({"o_orderkey": F.col("o_orderkey") + 100000000, "o_orderstatus": F.lit("N")})
    return R.upsert(old, changed.unionByName(added), "o_orderkey", ("o_orderdate",))


@query("""SELECT c.conv_id, c.turn, coalesce(p.text, 'N/A') AS previous_text, coalesce(n.text, 'N/A') AS next_text FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
LEFT JOIN conversations n ON n.conv_id = c.conv_id AND n.turn = c.turn + 1""")
def neighbour_context(spark, d):
    return R.neighbours(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "previous_text", "next_text")


@query("SELECT conv_id, turn, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text FROM conversations WHERE turn % 3 <> 1 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def nearest_context(spark, d):
    return R.nearest_rows(table(spark, d, "conversations").where("turn % 3 <> 1"), "conv_id", "turn", "text").select("conv_id", "turn", "previous_text", "next_text")


@query("SELECT DISTINCT trim(text) AS key FROM documents WHERE text IN (SELECT text FROM documents WHERE doc_id % 2 = 0) AND doc_id % 2 = 1")
def text_leakage(spark, d):
    docs = table(spark, d, "documents").select("doc_id", X.strip(F.col("text")).alias("key"))
    return R.overlap(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), "key")


@query(f"SELECT md5(text) AS key, list_sort(list_distinct(list({SPLIT}))) AS splits FROM documents GROUP BY text HAVING count(DISTINCT {SPLIT}) > 1")
def split_leakage(spark, d):
    return R.shared_keys(with_split(table(spark, d, "documents")), F.md5("text"), "split")


@query("SELECT doc_id, count(*) OVER (PARTITION BY text) > 1 AS in_group, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS is_repeat FROM documents")
def duplicate_text(spark, d):
    return R.duplicates(table(spark, d, "documents").select("doc_id", "text"), F.md5("text"), "doc_id").select("doc_id", "in_group", "is_repeat")


@query("""WITH a AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 11 <> 0 UNION ALL SELECT doc_id + 10000000, text FROM documents WHERE doc_id % 17 = 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'missing' WHEN b.doc_id IS NULL THEN 'unknown' WHEN a.text IS DISTINCT FROM b.text THEN 'changed' ELSE 'same' END AS state FROM a FULL JOIN documents b ON a.doc_id = b.doc_id""")
def integrity_full_outer(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    rows = docs.where("doc_id % 11 <> 0").withColumn("text", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    more = docs.where("doc_id % 17 = 0").withColumn("doc_id", F.col("doc_id") + 10000000)
    return R.integrity(rows.unionByName(more), docs, "doc_id", "text")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def first_event(spark, d):
    return R.first_of_each(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query(f"WITH {CLAUSES} SELECT clause_id, doc_id FROM clauses WHERE left(clause_id, 8) IN (SELECT DISTINCT left(clause_id, 8) FROM clauses WHERE doc_id % 20 = 0)")
def prefix_join(spark, d):
    c = A.clauses(spark, d).select("clause_id", "doc_id")
    return R.by_prefix(c, c.where("doc_id % 20 = 0").select(F.left("clause_id", F.lit(8)).alias("p")), "clause_id", "p")


@query("""WITH a AS (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY event_type), b AS (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 3 = 0 GROUP BY event_type)
SELECT event_type, coalesce(a.v, 0) AS before, coalesce(b.v, 0) AS after, coalesce(b.v, 0) - coalesce(a.v, 0) AS delta, CASE WHEN coalesce(a.v, 0) <> 0 THEN 100 * (coalesce(b.v, 0) - a.v) / a.v END AS delta_percent FROM a FULL JOIN b USING (event_type)""")
def before_after(spark, d):
    e = table(spark, d, "events")
    of = lambda k: e.where(f"user_id % {k} = 0").groupBy("event_type").agg(F.avg("value").alias("v"))
    return R.compare(of(2), of(3), "event_type", "v")


@query("""SELECT doc_id, quality, toxic, NULL AS note, 'SYNTHETIC' AS origin FROM labels WHERE false UNION ALL SELECT doc_id, quality, toxic, 'real', 'SYNTHETIC' FROM labels UNION ALL SELECT doc_id + 1000000, 1, 0, 'SYNTHETIC', 'made' FROM labels""")
def union_filled(spark, d):
    lab = table(spark, d, "labels")
    return R.union_filled(lab.withColumn("note", F.lit("real")), lab.select((F.col("doc_id") + 1000000).alias("doc_id"), F.lit(1).alias("quality"), F.lit("made").alias("origin")))


# ---------------------------------------------------------------- splits

@query(f"""WITH {CLAUSES}, s AS (SELECT doc_id, count(*) AS n FROM clauses GROUP BY doc_id), r AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS upto FROM s)
SELECT doc_id, n, CASE WHEN upto < (SELECT floor(0.2 * sum(n)) FROM s) THEN 'validation' ELSE 'train' END AS split FROM r""")
def split_smallest_docs(spark, d):
    return splits.smallest_to_validation(A.clauses(spark, d), "doc_id")


@query("""WITH k AS (SELECT DISTINCT doc_id FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':42'), doc_id) AS r, count(*) OVER () AS n FROM k)
SELECT doc_id, CASE WHEN r <= round_even(n * 0.7, 0) THEN 'train' WHEN r <= round_even(n * 0.7, 0) + round_even(n * 0.15, 0) THEN 'validation' ELSE 'test' END AS split FROM r""")
def split_hash_ratio(spark, d):
    return splits.by_ratio(table(spark, d, "documents"), "doc_id")


def _brings(seen: str) -> str:
    return f"len(list_filter(categories, lambda x: NOT list_contains({seen}, x))) > 0"


@query(f"""WITH RECURSIVE {CLAUSES}, {LABELLED}, p AS (SELECT doc_id, count(*) AS n, list_sort(list_distinct(flatten(list(labels)))) AS categories FROM clause_labels GROUP BY 1),
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY len(list_filter(categories, lambda x: x IN ({', '.join(f"'{c}'" for c in sorted(splits.RARE))}))) DESC, n DESC, doc_id DESC) AS r, sum(n) OVER () AS total FROM p),
f AS (SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS doc_id, CAST('' AS VARCHAR) AS split, CAST([] AS VARCHAR[]) AS st, CAST([] AS VARCHAR[]) AS sv, CAST([] AS VARCHAR[]) AS sx, CAST(0 AS HUGEINT) AS ft, CAST(0 AS HUGEINT) AS fv, CAST(0 AS HUGEINT) AS fx UNION ALL
  SELECT r, doc_id, split, CASE split WHEN 'train' THEN list_distinct(list_concat(st, categories)) ELSE st END, CASE split WHEN 'validation' THEN list_distinct(list_concat(sv, categories)) ELSE sv END, CASE split WHEN 'test' THEN list_distinct(list_concat(sx, categories)) ELSE sx END,
    ft + CASE split WHEN 'train' THEN n ELSE 0 END, fv + CASE split WHEN 'validation' THEN n ELSE 0 END, fx + CASE split WHEN 'test' THEN n ELSE 0 END
  FROM (SELECT o.r, o.doc_id, o.n, o.categories, st, sv, sx, ft, fv, fx, CASE WHEN {_brings('st')} AND ft / total < 0.65 THEN 'train' WHEN {_brings('sv')} AND fv / total < 0.25 THEN 'validation' WHEN {_brings('sx')} AND fx / total < 0.25 THEN 'test'
    WHEN ft / total < 0.60 THEN 'train' WHEN fv / total < 0.20 THEN 'validation' ELSE 'test' END AS split FROM f JOIN o ON o.r = f.r + 1))
SELECT doc_id, split FROM f WHERE r > 0""")
def split_greedy(spark, d):
    return splits.greedy_coverage(stats.document_profile(A.clause_labels(spark, d), "doc_id"), "doc_id")


@query(f"""WITH RECURSIVE {CLAUSES}, {LABELLED}, o AS MATERIALIZED (SELECT doc_id, count(*) AS n, list_distinct(flatten(list(labels))) AS categories, md5(doc_id || ':42') AS h FROM clause_labels GROUP BY 1), t AS MATERIALIZED (SELECT sum(n) AS total FROM o),
f AS (SELECT 0 AS step, 0 AS phase, 0.2::DOUBLE * total AS target, total, CAST(0 AS HUGEINT) AS held, CAST([] AS BIGINT[]) AS taken, CAST([] AS VARCHAR[]) AS has, CAST(NULL AS BIGINT) AS doc_id, CAST('' AS VARCHAR) AS split FROM t UNION ALL
  SELECT step + 1, CASE WHEN b IS NULL THEN phase + 1 ELSE phase END, CASE WHEN b IS NULL THEN 0.15::DOUBLE * total ELSE target END, total, CASE WHEN b IS NULL THEN 0 ELSE held + b.n END, CASE WHEN b IS NULL THEN taken ELSE list_append(taken, b.doc_id) END,
    CASE WHEN b IS NULL THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_concat(has, b.categories)) END, b.doc_id, ['test', 'validation'][phase + 1]
  FROM (SELECT step, phase, target, total, held, taken, has, arg_max(struct_pack(doc_id := o.doc_id, n := o.n, categories := o.categories), struct_pack(a := len(list_filter(o.categories, lambda x: NOT list_contains(has, x))), b := o.h)) FILTER (held < target AND held + o.n <= 1.5 * target AND NOT list_contains(taken, o.doc_id)) AS b
    FROM f, o WHERE phase < 2 GROUP BY step, phase, target, total, held, taken, has))
SELECT o.doc_id, coalesce(f.split, 'train') AS split FROM o LEFT JOIN (SELECT doc_id, split FROM f WHERE doc_id IS NOT NULL) AS f USING (doc_id)""")
def split_greedy_target(spark, d):
    profile = stats.document_profile(A.clause_labels(spark, d), "doc_id")
    return splits.greedy_target(profile, {"test": 0.2, "validation": 0.15}, "doc_id")


# ---------------------------------------------------------------- metrics

CONF = f"{PREDICTIONS}, conf AS (SELECT category, count(*) FILTER (y_true = 1 AND y_prob >= 0.5) AS tp, count(*) FILTER (y_true <> 1 AND y_prob >= 0.5) AS fp, count(*) FILTER (y_true = 1 AND y_prob < 0.5) AS fn, count(*) FILTER (y_true <> 1 AND y_prob < 0.5) AS tn FROM predictions GROUP BY category)"
Z = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0 ELSE ({a}) / ({b}) END"
PER = f"per AS (SELECT *, {Z('tp', 'tp + fp')} AS precision, {Z('tp', 'tp + fn')} AS recall, {Z('2 * tp', '2 * tp + fp + fn')} AS f1, {Z('CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn', 'sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn))')} AS mcc, tp + fn AS support, tp + fp AS predicted FROM conf)"


@query(f"WITH {CONF}, {PER} SELECT * FROM per")
def confusion(spark, d):
    return metrics.per_category(metrics.confusion(A.predictions(spark, d)))


SUMMARY = f"""avg(f1) AS macro_f1, {Z('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')} AS micro_f1, {Z('sum(f1 * support)', 'sum(support)')} AS weighted_f1, avg(precision) AS macro_precision, avg(recall) AS macro_recall,
{Z('sum(tp)', 'sum(tp) + sum(fp)')} AS micro_precision, {Z('sum(tp)', 'sum(tp) + sum(fn)')} AS micro_recall, {Z('sum(fp) + sum(fn)', 'sum(tp) + sum(fp) + sum(fn) + sum(tn)')} AS hamming_loss,
avg(CASE WHEN (tp + fn = 0 OR fp + tn = 0) AND (tp + fp = 0 OR fn + tn = 0) THEN CASE WHEN fp + fn = 0 THEN 1.0 ELSE 0.0 END ELSE mcc END) AS macro_mcc"""


@query(f"WITH {CONF}, {PER} SELECT {SUMMARY}, avg(f1) FILTER (category = 'toxic') AS minority_f1 FROM per")
def f1_suite(spark, d):
    per = metrics.per_category(metrics.confusion(A.predictions(spark, d)))
    return metrics.summary(per, per.where("category = 'toxic'"))


SWEPT = f"""{PREDICTIONS}, at AS (SELECT p.*, t AS threshold FROM predictions p, unnest([0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7]::DOUBLE[]) AS g(t)),
conf AS (SELECT threshold, category, count(*) FILTER (y_true = 1 AND y_prob >= threshold) AS tp, count(*) FILTER (y_true <> 1 AND y_prob >= threshold) AS fp, count(*) FILTER (y_true = 1 AND y_prob < threshold) AS fn, count(*) FILTER (y_true <> 1 AND y_prob < threshold) AS tn FROM at GROUP BY threshold, category),
{PER}, swept AS (SELECT threshold, {SUMMARY}, avg(f1) AS minority_f1 FROM per GROUP BY threshold)""".replace(", at AS (", ", grid AS (").replace("FROM at ", "FROM grid ")


@query(f"WITH {SWEPT} SELECT * FROM swept")
def threshold_sweep(spark, d):
    return metrics.sweep(A.predictions(spark, d))


@query(f"WITH {SWEPT} SELECT * FROM swept ORDER BY macro_f1 DESC, threshold LIMIT 1")
def threshold_best(spark, d):
    return metrics.best_threshold(metrics.sweep(A.predictions(spark, d)), digits=None)


@query(f"""WITH {CLAUSES}, {LABELLED}, e AS (SELECT clause_id, unnest(list_distinct(labels)) AS c FROM clause_labels) SELECT a.c AS category_a, b.c AS category_b, count(*) AS n FROM e a JOIN e b USING (clause_id) WHERE a.c <= b.c GROUP BY a.c, b.c""")
def cooccurrence(spark, d):
    return metrics.cooccurrence(A.clause_labels(spark, d))


COUNTED = f"{CLAUSES}, {LABELLED}, n AS (SELECT category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest(labels) AS category FROM clause_labels) GROUP BY category)"


def train_counts(spark, d):
    return A.clause_labels(spark, d).select("doc_id", F.explode("labels").alias("category")).groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {COUNTED} SELECT category, n, least(((SELECT count(*) FROM clause_labels) - n) / greatest(n, 1), 25.0) AS weight FROM n")
def class_weights(spark, d):
    total = A.clauses(spark, d).agg(F.count("*").alias("rows"))  # one row
    counts = train_counts(spark, d).select("category", "n").crossJoin(F.broadcast(total))
    return metrics.class_weights(counts, F.col("rows"), cap=25.0).drop("rows")


@query(f"WITH {COUNTED} SELECT category, n FROM n WHERE n < (SELECT greatest(15, median(n)) FROM n)")
def minority_categories(spark, d):
    return metrics.minority(train_counts(spark, d))


@query(f"""WITH {COUNTED}, r AS (SELECT *, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2 AS ra, rank() OVER (ORDER BY docs) + (count(*) OVER (PARTITION BY docs) - 1) / 2 AS rb FROM n) SELECT corr(n, docs) AS pearson, corr(ra, rb) AS spearman FROM r""")
def support_correlation(spark, d):
    return metrics.correlations(train_counts(spark, d), "n", "docs")


@query(f"WITH {CONF} SELECT category, fp, fn, CASE WHEN fp >= 1.5 * fn THEN 'FP_DOMINATED' WHEN fn >= 1.5 * fp THEN 'FN_DOMINATED' ELSE 'MIXED' END AS pattern FROM conf")
def error_patterns(spark, d):
    return metrics.confusion(A.predictions(spark, d)).select("category", "fp", "fn", metrics.error_pattern(F.col("fp"), F.col("fn")).alias("pattern"))


DAILY = "l AS (SELECT event_type, CAST(ts AS DATE) AS day, avg(value) AS m FROM events GROUP BY ALL)"


@query(f"""WITH {DAILY}, b AS (SELECT *, max(m) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k FROM l),
c AS (SELECT *, best_before IS NULL OR m > best_before AS is_best FROM b), e AS (SELECT *, k - max(CASE WHEN is_best THEN k END) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS since_best FROM c)
SELECT event_type, day, m, best_before, is_best, CAST(since_best AS INTEGER) AS since_best, since_best >= 3 AND count(*) FILTER (since_best >= 3) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) = 1 AS stops FROM e""")
def early_stopping(spark, d):
    log = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("m"))
    return metrics.early_stopping(log, "event_type", "day", "m")


@query("""WITH r AS (SELECT event_type AS model, user_id % 3 AS loss, avg(value) AS macro_f1 FROM events GROUP BY ALL) SELECT model, max(macro_f1) AS macro_f1 FROM r GROUP BY model""")
def best_experiments(spark, d):
    runs = table(spark, d, "events").groupBy(F.col("event_type").alias("model"), (F.col("user_id") % 3).alias("loss")).agg(F.avg("value").alias("macro_f1"))
    return metrics.best_of_each(runs, "model")


# ---------------------------------------------------------------- quality, evidence, risk

RISK_SQL = ", ".join(f"('{c}', {w}, {('LOW', 'MEDIUM', 'HIGH').index(t)})" for c, (w, t) in RISK.items())


@query(f"""WITH {CLAUSES}, {LABELLED}, rk AS (SELECT * FROM (VALUES {RISK_SQL}) AS v(category, w, tier)), e AS (SELECT doc_id, clause_id, unnest(labels) AS category FROM clause_labels),
c AS (SELECT doc_id, clause_id, max(coalesce(tier, 0)) AS tier FROM e LEFT JOIN rk USING (category) GROUP BY ALL), lv AS (SELECT l.doc_id, count(*) FILTER (tier = 2) AS high_clauses, count(*) FILTER (tier = 1) AS medium_clauses FROM clause_labels l LEFT JOIN c USING (clause_id) GROUP BY l.doc_id),
s AS (SELECT doc_id, least(sum(coalesce(w, 0)), 100) AS score FROM (SELECT DISTINCT doc_id, category FROM e) LEFT JOIN rk USING (category) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(score, 0) AS BIGINT) AS score, high_clauses, medium_clauses, CASE WHEN coalesce(score, 0) >= 65 OR high_clauses >= 2 THEN 'HIGH' WHEN coalesce(score, 0) >= 35 OR medium_clauses >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM lv LEFT JOIN s USING (doc_id)""")
def document_risk(spark, d):
    return risk.document_risk(A.clause_labels(spark, d), "doc_id")


def review_tables(spark, d):
    c = A.clauses(spark, d)
    k = (F.col("doc_id") * 7 + F.col("pos")) % 10
    text = lambda x: F.lit(x)
    records = c.select(
        "clause_id", F.when(k < 5, "suggestions").otherwise("review").alias("review_file"), F.when(k == 6, "KEEP").when(k == 7, "SPLIT").otherwise("").alias("human_action"), F.when(k == 7, "fixed").otherwise("").alias("human_corrected_text"),
        F.when(k.isin(6, 7), "true").otherwise("").alias("reviewed"), F.when(k == 0, "KEEP").when(k == 1, "REMOVE_NON_LEGAL").when(k == 2, "MERGE_WITH_NEXT").when(k == 3, "REVIEW").when(k == 4, "SPLIT").otherwise("").alias("ai_suggested_action"), F.when(k < 5, "0.9").otherwise("").alias("ai_confidence"), text("").alias("review_reason"),
    )
    log = c.where(k <= 5).select("clause_id", F.when(k == 5, "ERROR").otherwise("SUCCESS").alias("status"), F.when(k == 0, "KEEP").when(k == 1, "REMOVE_NON_LEGAL").when(k == 2, "MERGE_WITH_NEXT").when(k == 3, "REVIEW").when(k == 4, "SPLIT").otherwise("").alias("suggested_action"), F.when(k < 5, "0.90").otherwise("").alias("confidence"), text("2024-01-01").alias("timestamp"))
    return c.select("clause_id", "doc_id"), records, log, c.where(k == 8).select("clause_id")


@query(f"""WITH {CLAUSES}, k AS (SELECT clause_id, doc_id, (doc_id * 7 + pos) % 10 AS k FROM clauses)
SELECT clause_id, doc_id, ['PSEUDO_KEEP', 'EXCLUDED_NON_LEGAL', 'PENDING_MERGE', 'PENDING_REVIEW', 'PENDING_SPLIT', 'API_FAILURE', 'HUMAN_RECORDED_KEEP', 'CONFLICT_REVIEW', 'PRIORITY_UNREVIEWED', 'UNREVIEWED'][k + 1] AS review_status,
['KEEP', 'REMOVE_NON_LEGAL', 'MERGE_WITH_NEXT', 'REVIEW', 'SPLIT', '', 'KEEP', 'REVIEW', '', ''][k + 1] AS review_action, CASE WHEN k < 5 THEN '0.90' END AS confidence, CASE k WHEN 6 THEN 'KEEP' WHEN 7 THEN 'SPLIT' ELSE '' END AS human_actions,
k <> 1 AS needs_human_review, k = 2 AS unresolved_merge, k IN (4, 7) AS unresolved_split, CASE WHEN k < 5 THEN 'SUCCESS' WHEN k = 5 THEN 'ERROR' ELSE 'NOT_REVIEWED' END AS llm_status, CASE WHEN k < 5 THEN 'LLM_SUGGESTION' ELSE '' END AS confidence_basis,
CASE WHEN k < 5 THEN '2024-01-01' ELSE '' END AS review_timestamp, CASE WHEN k < 5 THEN 'suggestions' WHEN k IN (6, 7) THEN 'review' ELSE '' END AS review_sources, k = 8 AS is_priority,
CASE k WHEN 6 THEN '[{{"review_file":"review","human_action":"KEEP","human_corrected_text":""}}]' WHEN 7 THEN '[{{"review_file":"review","human_action":"SPLIT","human_corrected_text":"fixed"}}]' ELSE '[]' END AS human_review_records FROM k""")
def evidence_resolution(spark, d):
    from clausegrain.operators.evidence import resolve

    return resolve(*review_tables(spark, d)).drop("review_reason")


from clausegrain.plans import suites  # noqa: E402, F401  more queries, which build on these
from clausegrain.plans import storage  # noqa: E402, F401  isort: skip
