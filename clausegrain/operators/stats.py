"""Statistics of clauses, labels and documents. Averages aren't rounded; presentation may round them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausegrain.functions.labels import pos_neg_ratio
from clausegrain.functions.taxonomy import CATEGORIES, dimension
from clausegrain.functions.text import n_words, strip, truthy


def corpus(clauses: DataFrame, document: str = "document_id", text: str = "text") -> DataFrame:
    """One row: documents, clauses, clauses a document, and lengths in characters and words."""
    by_doc = clauses.groupBy(document).agg(
        F.count("*").alias("n"), *(f(F.length(text)).alias(f"c_{k}") for k, f in (("min", F.min), ("max", F.max), ("sum", F.sum))), *(f(n_words(F.col(text))).alias(f"w_{k}") for k, f in (("min", F.min), ("max", F.max), ("sum", F.sum)))
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return by_doc.agg(
        F.count("*").alias("documents"), zero(F.sum("n")).alias("clauses"), F.min("n").alias("min_clauses"), F.max("n").alias("max_clauses"), F.avg("n").alias("avg_clauses"),
        F.min("c_min").alias("min_chars"), F.max("c_max").alias("max_chars"), (F.sum("c_sum") / F.sum("n")).alias("avg_chars"),
        F.min("w_min").alias("min_words"), F.max("w_max").alias("max_words"), (F.sum("w_sum") / F.sum("n")).alias("avg_words"),
    )


def label_frequency(labelled: DataFrame, labels: str = "labels") -> DataFrame:
    """label, n, percent of assignments, is_majority (at least the mean count)."""
    n = labelled.select(F.explode(labels).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("_sum"), F.avg("n").alias("_mean"))  # one row
    return n.crossJoin(F.broadcast(total)).select("label", "n", (100 * F.col("n") / F.col("_sum")).alias("percent"), (F.col("n") >= F.col("_mean")).alias("is_majority"))


def single_or_multi(labelled: DataFrame, labels: str = "labels") -> DataFrame:
    return labelled.agg(F.count_if(F.size(labels) == 1).alias("single_label"), F.count_if(F.size(labels) > 1).alias("multi_label"))


def document_audit(clauses: DataFrame, document: str = "document_id", text: str = "text", boundaries: str | None = None) -> DataFrame:
    """Of each document: clauses, mean, median, least and greatest length, short ones, and a note on odd counts."""
    n = F.length(text)
    extra = [F.first(boundaries).alias("boundaries")] if boundaries else []
    out = clauses.groupBy(document).agg(F.count("*").alias("clauses"), F.avg(n).alias("mean_chars"), F.median(n).alias("median_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"), F.count_if(n < 20).alias("short"), *extra)
    note = F.when(F.col("clauses") <= 6, "few").when(F.col("clauses") >= 40, "many")
    note = note.when(F.abs(F.col("boundaries") - F.col("clauses")) > 10, "mismatch") if boundaries else note
    return out.withColumn("note", note.otherwise("ok"))


def extremes(audit: DataFrame, document: str, metrics: tuple[str, ...]) -> DataFrame:
    """metric and the document that has most of it; the smallest id among equals."""
    found = audit.agg(*(F.max(F.struct(F.col(m), -F.col(document))).alias(m) for m in metrics))
    return found.select(F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), (-F.col(m)["col2"]).alias(document), F.col(m)[m].cast("double").alias("value")) for m in metrics))).alias("r")).select("r.*")


# Clauses that are section numbers or page numbers alone.
SECTION_ALONE = r"(?i)^(?:Section|Article|Clause|\d+[.\d]*)\s*\d*$"
PAGE_ALONE = r"(?i)^(?:Page\s*\d+|\d+\s*of\s*\d+|-\s*\d+\s*-|\d+)$"


def audit_reasons(text: Column) -> Column:
    """What is odd about a clause, as reasons joined by semicolons."""
    from clausegrain.functions.text import is_upper
    from clausegrain.operators.segment import MARKS

    t, low = strip(text), F.lower(strip(text))
    some = t != ""
    return F.array_join(F.array_compact(F.array(
        F.when(~some, "empty").when(F.length(text) <= 20, "short_<=20_chars"),
        F.when(some & t.rlike(rf"^[{MARKS}]+\z"), "only_punctuation"), F.when(t.rlike(r"^\d+\z"), "only_numbers"),
        F.when(t.rlike(SECTION_ALONE), "only_section_numbers"), F.when(t.rlike(PAGE_ALONE), "page_numbers"),
        F.when(some & (t.startswith("EX-") | low.contains("exhibit") | (is_upper(t) & (F.length(t) < 40) & ~t.endswith("."))), "header_or_title"),
    )), "; ")


def _distribution(labelled: DataFrame, document: str, labels: str, values: tuple[str, ...] = ()) -> DataFrame:
    """Counts of all fourteen categories and _n, the number of clauses, from one pass: each clause also counts once for the empty category."""
    of = F.concat(F.array_distinct(F.coalesce(labels, F.array().cast("array<string>"))), F.array(F.lit("")))
    each = labelled.select(document, *values, F.explode(of).alias("category")).groupBy("category").agg(F.count("*").alias("clauses"), F.count_distinct(document).alias("documents"), *(F.avg(v).alias(f"avg_{v}") for v in values))
    every = each.join(dimension(labelled.sparkSession).select("cat_idx", "category"), "category", "full")  # a row for each category
    total = F.coalesce(F.max(F.when(F.col("category") == "", F.col("clauses"))).over(W.partitionBy()), F.lit(0))
    return every.withColumn("_n", total).where("cat_idx is not null").na.fill(0)


def category_distribution(labelled: DataFrame, document: str = "document_id", labels: str = "labels", values: tuple[str, ...] = ()) -> DataFrame:
    """All fourteen categories: clauses, documents, percent of clauses, and means of value columns over the clauses that have it."""
    full = _distribution(labelled, document, labels, values)
    return full.select("cat_idx", "category", "clauses", "documents", *(f"avg_{v}" for v in values), _percent().alias("percent"))


def _percent() -> Column:
    return F.when(F.col("_n") > 0, 100 * F.col("clauses") / F.col("_n")).otherwise(0.0)


def scarcity(clauses: Column, percent: Column) -> Column:
    return F.when(clauses == 0, "ZERO").when(clauses < 5, "SPARSE").when(percent < 10, "UNDERREPRESENTED").otherwise("OK")


def class_imbalance(labelled: DataFrame, document: str = "document_id", labels: str = "labels") -> DataFrame:
    """Of each category: positives, negatives, percent, documents, ratio of negatives, whether it is a majority (15 and more)."""
    pos, neg = F.col("clauses"), F.col("_n") - F.col("clauses")
    return _distribution(labelled, document, labels).select(
        "cat_idx", "category", pos.alias("positives"), neg.alias("negatives"), _percent().alias("percent"), F.col("documents").alias("document_frequency"), F.when(pos > 0, neg / pos).alias("neg_per_pos"), (pos >= 15).alias("is_majority")
    )


def with_ratio_text(imbalance: DataFrame) -> DataFrame:
    return imbalance.withColumn("ratio", pos_neg_ratio(F.col("positives"), F.col("negatives")))


def crosstab(rows: DataFrame, index: str, column: str, values: list[str]) -> DataFrame:
    """Counts by index and column; values are given, so no pass is spent on finding them."""
    return rows.groupBy(index).pivot(column, values).count().na.fill(0)


def document_categories(labelled: DataFrame, document: str = "document_id", labels: str = "labels") -> DataFrame:
    """document, one count column a category, categories_present (of the fourteen), clauses. One aggregation over the rows as they are."""
    counts = labelled.groupBy(document).agg(F.count("*").alias("clauses"), *(F.count_if(F.array_contains(labels, c)).alias(c) for c in CATEGORIES))
    return counts.withColumn("categories_present", sum(((F.col(f"`{c}`") > 0).cast("long") for c in CATEGORIES), F.lit(0).cast("long")))


def coverage(labelled: DataFrame, document: str = "document_id", labels: str = "labels") -> DataFrame:
    """Of each category: clauses, documents, percent of documents, documents with two and with three clauses and more."""
    each = labelled.select(document, F.explode(F.array_distinct(labels)).alias("category")).groupBy("category", document).agg(F.count("*").alias("n"))
    by = each.groupBy("category").agg(F.sum("n").alias("clauses"), F.count("*").alias("documents"), F.count_if(F.col("n") >= 2).alias("ge_2"), F.count_if(F.col("n") >= 3).alias("ge_3"))
    total = labelled.agg(F.count_distinct(document).alias("_d"))  # one row
    full = dimension(labelled.sparkSession).select("category").join(by, "category", "left").na.fill(0)
    return full.crossJoin(F.broadcast(total)).withColumn("percent_documents", F.when(F.col("_d") > 0, 100 * F.col("documents") / F.col("_d")).otherwise(0.0)).drop("_d")


def split_support(labelled: DataFrame, split: str = "split", labels: str = "labels", splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """Of each category, clauses in each split, and the splits that lack it."""
    each = labelled.select(split, F.explode(F.array_distinct(labels)).alias("category")).groupBy("category").agg(*(F.count_if(F.col(split) == s).alias(s) for s in splits))
    full = dimension(labelled.sparkSession).select("category").join(each, "category", "left").na.fill(0)
    return full.withColumn("missing_in", F.array_join(F.array_compact(F.array(*(F.when(F.col(s) == 0, s) for s in splits))), ","))


def document_profile(labelled: DataFrame, document: str = "document_id", labels: str = "labels", split: str | None = None) -> DataFrame:
    """document, clauses, its categories as a sorted set; with a split column also that (the smallest, where a document leaks)."""
    more = [F.min(split).alias(split)] if split else []
    return labelled.groupBy(document).agg(*more, F.count("*").alias("clauses"), F.array_sort(F.array_distinct(F.flatten(F.collect_set(labels)))).alias("categories"))


def quality_summary(rows: DataFrame, quality: str, confidence: str, agreement: str) -> DataFrame:
    """Of each quality bucket: rows; least, greatest, mean and sample deviation (0 for one row) of confidence; mean agreement."""
    return rows.groupBy(quality).agg(
        F.count("*").alias("rows"), F.min(confidence).alias("min_confidence"), F.max(confidence).alias("max_confidence"), F.avg(confidence).alias("avg_confidence"),
        F.coalesce(F.stddev_samp(confidence), F.lit(0.0)).alias("std_confidence"), F.avg(agreement).alias("avg_agreement"),
    )


def success_rate(votes: DataFrame, model: str = "model", confidence: str = "confidence") -> DataFrame:
    return votes.groupBy(model).agg(F.count("*").alias("calls"), F.count_if(F.col(confidence) > 0).alias("successes"), (F.count_if(F.col(confidence) > 0) / F.count("*")).alias("rate"))


def inventory(docs: DataFrame, source: str, text: str) -> DataFrame:
    """Of each source: documents, and their mean, least and greatest words."""
    n = n_words(F.col(text))
    return docs.groupBy(source).agg(F.count("*").alias("documents"), F.avg(n).alias("avg_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"))


def segmentation(extracted: DataFrame, clauses: DataFrame, document: str = "document_id", text: str = "text") -> DataFrame:
    """One row: documents by outcome of their extraction (status), and clauses by document and length; zeros without clauses."""
    outcome = extracted.agg(F.count("*").alias("documents_processed"), F.count_if(F.col("status").isin("success", "partial")).alias("successful_documents"), F.count_if(F.col("status").isin("failed", "empty")).alias("failed_documents"))
    n = F.length(text)
    by_doc = clauses.groupBy(document).agg(F.count("*").alias("k"), F.sum(n).alias("s"), F.min(n).alias("lo"), F.max(n).alias("hi"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    found = by_doc.agg(
        F.count("*").alias("documents_with_clauses"), zero(F.sum("k")).alias("clauses"), zero(F.avg("k")).alias("avg_clauses"), zero(F.min("k")).alias("min_clauses"), zero(F.max("k")).alias("max_clauses"),
        zero(F.sum("s") / F.sum("k")).alias("avg_length"), zero(F.min("lo")).alias("min_length"), zero(F.max("hi")).alias("max_length"),
    )
    return outcome.crossJoin(found)  # two tables of one row


def annotation_summary(rows: DataFrame, labels: str = "labels", status: str = "annotation_status", verified: str = "label_verified", round_: str = "annotation_round") -> DataFrame:
    """One row: clauses, labelled, verified and multi-label ones, counts by status (blank is pending), and the latest round (a whole number)."""
    state = F.upper(F.coalesce(F.nullif(strip(F.col(status)), F.lit("")), F.lit("PENDING")))
    size = F.coalesce(F.size(labels), F.lit(0))
    number = F.when(F.col(round_).rlike("^[0-9]+$"), F.col(round_).cast("long"))
    return rows.agg(
        F.count("*").alias("total_clauses"), F.count_if(size > 0).alias("labeled_clauses"), F.count_if(truthy(F.col(verified), ("true", "1", "yes"))).alias("verified_clauses"), F.count_if(size > 1).alias("multi_labeled_clauses"),
        *(F.count_if(state == s).alias(s.lower()) for s in ("PENDING", "ANNOTATED", "DISPUTED", "SKIPPED")), F.coalesce(F.max(number), F.lit(0)).alias("current_round"),
    )


def next_action(annotated: Column, seed_annotated: Column, seed_total: Column, has_model: Column, pending: Column) -> Column:
    """What an annotation project does next: the seed, the rest of it, the first model, the batch that is picked, or another round."""
    return (
        F.when(annotated == 0, "annotate the seed").when(seed_annotated < seed_total, F.format_string("annotate %d more of the seed", seed_total - seed_annotated)).when(~has_model, "train the first round")
        .when(pending > 0, F.format_string("annotate %d uncertain clauses", pending)).otherwise("train the next round")
    )


def round_distribution(labelled: DataFrame, earlier: DataFrame | None, number: int, document: str = "document_id", labels: str = "labels") -> DataFrame:
    """All fourteen categories: annotations, percent of them, documents, the round_N columns of an earlier distribution (0 where it lacks a
    category), this round's, and a warning on scarce ones."""
    each = labelled.select(document, F.explode(labels).alias("category")).groupBy("category").agg(F.count("*").alias("total_annotations"), F.count_distinct(document).alias("documents_present"))
    full = dimension(labelled.sparkSession).select("category").join(each, "category", "left").na.fill(0)
    n, total = F.col("total_annotations"), F.greatest(F.sum("total_annotations").over(W.partitionBy()), F.lit(1))  # fourteen rows
    out = full.withColumn("percentage", 100 * n / total).withColumn("warning", F.when(n == 0, "ZERO_EXAMPLES").when(n < 5, "SPARSE").when(n < total * 0.1, "UNDERREPRESENTED").otherwise(""))
    old = [c for c in (earlier.columns if earlier is not None else []) if c.startswith("round_") and c != f"round_{number}"]
    if old:
        out = out.join(earlier.select("category", *old), "category", "left").na.fill(0, old)
    return out.select("category", "total_annotations", "percentage", "documents_present", *old, n.alias(f"round_{number}"), "warning")


def signal_score(clauses: DataFrame, signals: dict[str, str], document: str = "document_id", text: str = "text") -> DataFrame:
    """Of each document: clauses, how many signals some clause holds, how many clauses hold each summed up, and a score of these."""
    names = [f"_s{i}" for i in range(len(signals))]
    hits = clauses.groupBy(document).agg(*(F.count_if(F.lower(text).rlike("(?U)" + p)).alias(n) for n, p in zip(names, signals.values(), strict=True)), F.count("*").alias("clauses"))
    distinct, total = sum(((F.col(n) > 0).cast("int") for n in names), F.lit(0)), sum((F.col(n) for n in names), F.lit(0))
    return hits.select(document, "clauses", distinct.alias("distinct_signals"), total.cast("long").alias("total_signals"), (10 * distinct + 2 * total + 0.1 * F.col("clauses")).alias("score"))


def dataset(labelled: DataFrame, document: str = "document_id", text: str = "text", labels: str = "labels") -> DataFrame:
    """corpus() with single- and multi-label clauses, and an error where there is no clause."""
    out = corpus(labelled, document, text).crossJoin(single_or_multi(labelled, labels))  # two tables of one row
    return out.withColumn("error", F.when(F.col("clauses") == 0, "no documents"))
