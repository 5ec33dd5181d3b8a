"""Annotated text: blocks of a clause and its labels between tags."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from clausegrain.functions.text import is_blank, let, strip


# The tags of annotated files.
@dataclass(frozen=True)
class Tags:
    clause_open: str = "[INIT_CLAUSE]"
    clause_close: str = "[END_CLAUSE]"
    class_open: str = "[INIT_CLASSE]"
    class_close: str = "[END_CLASSE]"


def parse(docs: DataFrame, doc_id: str = "doc_id", tags: Tags = Tags()) -> DataFrame:
    """doc_id, clause_index, global_id, text, labels, num_labels, warning: a row for each block, and one for a document without any.

    A block with a warning has no text. The index counts blocks with warnings too. Built-ins alone, so nothing leaves the JVM."""
    q = lambda s: re.sub(r"([\[\](){}.*+?^$|\\])", r"\\\1", s)
    block = rf"(?s){q(tags.clause_open)}(.*?){q(tags.clause_close)}"
    label = rf"(?s){q(tags.class_open)}(.*?){q(tags.class_close)}"
    # a row carries its block alone, not its document, which Spark would look at again for each block; a document without a block is one element that tells whether it is blank
    one = lambda of, blank: F.struct(of.alias("block"), blank.alias("blank"))
    none_in = F.array(one(F.lit(None).cast("string"), is_blank(F.col("text"))))
    found = let(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(block), 1), lambda x: F.when(F.size(x) > 0, F.transform(x, lambda b: one(b, F.lit(False)))).otherwise(none_in))
    each = docs.select(doc_id, F.posexplode(found).alias("_at", "_one"))
    rows = each.select(doc_id, F.when(F.col("_one.block").isNotNull(), F.col("_at")).alias("clause_index"), F.col("_one.block").alias("_block"), F.col("_one.blank").alias("_blank"))
    has_tag = F.col("_block").rlike(label)
    inside = F.regexp_extract("_block", label, 1)
    labels = F.filter(F.transform(F.split(inside, ","), strip), lambda x: x != "")
    text = strip(F.regexp_extract("_block", rf"(?s)^(.*?){q(tags.class_open)}.*?{q(tags.class_close)}", 1))
    warning = (
        F.when(F.col("_blank"), "empty document").when(F.col("_block").isNull(), "no clause blocks").when(~has_tag, "no class tag").when(inside == "", "empty class tag")
        .when(F.size(labels) == 0, "no labels").when(text == "", "empty text")
    )
    out = rows.withColumns({"warning": warning, "_labels": labels, "_text": text})
    ok = F.col("warning").isNull()
    none = F.array().cast("array<string>")
    return out.select(doc_id, "clause_index", F.concat(F.col(doc_id).cast("string"), F.lit("_clause_"), F.col("clause_index").cast("string")).alias("global_id"), F.when(ok, F.col("_text")).alias("text"), F.when(ok, F.col("_labels")).otherwise(none).alias("labels"), F.when(ok, F.size("_labels")).otherwise(0).alias("num_labels"), "warning")


def clean(parsed: DataFrame, compose: bool = True, whitespace: bool = True) -> DataFrame:
    """Parsed clauses without warnings, cleaned texts and normalised labels; rows left without text or labels go."""
    from clausegrain.functions.labels import normalize
    from clausegrain.functions.text import clean_clause

    kept = parsed.where("warning is null").withColumns({"text": clean_clause(F.col("text"), compose, whitespace), "labels": normalize(F.col("labels"))})
    return kept.where((F.col("text") != "") & (F.size("labels") > 0)).withColumn("num_labels", F.size("labels"))
