"""The driver's tables seen as clauses, labels, votes and predictions, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clausegrain.functions.taxonomy import CATEGORIES
from clausegrain.functions.text import is_blank
from clausegrain.sources.files import dealt


#: Tables of texts, whose rows cost much more to work on than to move.
TEXTS = ("documents", "conversations", "pages")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows, f"{sf_dir}/{name}.parquet") if name in TEXTS else rows


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with a word is a clause: doc_id, pos, clause_id, text."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    return lines.where(~is_blank(F.col("text"))).select("doc_id", "pos", F.format_string("%d_clause_%03d", "doc_id", "pos").alias("clause_id"), "text")


def formula(shift: int = 0):
    return F.col("doc_id") * 7 + F.col("pos") * 3 + F.length("text") + shift


def _labels(shift: int = 0):
    return F.array_compact(F.array(*(F.when(formula(shift * (i + 1)) % (3 + i) == 0, c) for i, c in enumerate(CATEGORIES))))


def clause_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clauses(spark, sf_dir).withColumn("labels", _labels())


MODELS = (("model_a", 0), ("model_b", 1), ("model_c", 5))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scorers' labels of each clause: clause_id, doc_id, text, model, labels, confidence, status. One pass over the clauses."""
    each = [F.struct(F.lit(m).alias("model"), _labels(s).alias("labels"), (formula(s * 17) % 101 / 100).alias("confidence"), F.when(formula(s * 3) % 11 == 0, "API_ERROR").otherwise("SUCCESS").alias("status")) for m, s in MODELS]
    return clauses(spark, sf_dir).select("clause_id", "doc_id", "pos", "text", F.inline(F.array(*each)))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, category (quality, toxic), y_true, y_prob."""
    both = F.array(F.struct(F.lit("quality").alias("category"), F.col("quality").alias("y_true"), F.lit(0).alias("k")), F.struct(F.lit("toxic").alias("category"), F.col("toxic").alias("y_true"), F.lit(1).alias("k")))
    rows = table(spark, sf_dir, "labels").select("doc_id", F.inline(both))
    return rows.select("doc_id", "category", "y_true", ((F.col("doc_id") * 7919 + F.col("k") * 131 + F.col("y_true") * 350) % 1000 / 1000).alias("y_prob"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with the structure of a contract: line i becomes `<i>. <line>`, lines parted by blank lines."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.array_join(numbered, "\n\n").alias("text"))


# ---------------------------------------------------------------- the same in SQL

_F = lambda shift: f"(doc_id * 7 + pos * 3 + length(text) + {shift})"
_L = lambda shift: "list_filter([" + ", ".join(f"CASE WHEN {_F(shift * (i + 1))} % {3 + i} = 0 THEN '{c}' END" for i, c in enumerate(CATEGORIES)) + "], lambda x: x IS NOT NULL)"

CLAUSES = r"""clauses AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, printf('%d_clause_%03d', doc_id, pos) AS clause_id, ls[pos + 1] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(len(ls))) AS t(pos) WHERE regexp_matches(ls[pos + 1], '\S'))"""
LABELLED = f"clause_labels AS (SELECT *, {_L(0)} AS labels FROM clauses)"
TAXONOMY = "taxonomy AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(CATEGORIES)) + ") AS v(cat_idx, category))"
VOTES = "votes AS (" + " UNION ALL ".join(
    f"SELECT clause_id, doc_id, pos, text, '{m}' AS model, {_L(s)} AS labels, {_F(s * 17)} % 101 / 100 AS confidence, CASE WHEN {_F(s * 3)} % 11 = 0 THEN 'API_ERROR' ELSE 'SUCCESS' END AS status FROM clauses" for m, s in MODELS
) + ")"
PREDICTIONS = """predictions AS (SELECT doc_id, category, y_true, (doc_id * 7919 + k * 131 + y_true * 350) % 1000 / 1000 AS y_prob
  FROM (SELECT doc_id, 'quality' AS category, quality AS y_true, 0 AS k FROM labels UNION ALL SELECT doc_id, 'toxic', toxic, 1 FROM labels))"""
SECTIONS = """sections AS (SELECT doc_id AS document_id, array_to_string(list_transform(range(len(ls)), lambda i: (i + 1) || '. ' || ls[i + 1]), chr(10) || chr(10)) AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))"""
