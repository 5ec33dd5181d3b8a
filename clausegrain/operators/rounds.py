"""A round of active learning: gate, split, train, measure, score what has no labels, pick the next batch, keep a record."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from clausegrain.functions.labels import uncertainty
from clausegrain.operators import filters, learning, metrics, selection, splits
from clausegrain.sources.scratch import written
from clausegrain.sources.sinks import append_aligned


@dataclass(frozen=True)
class Round:
    """What a round gives: its gate (one row), and where that is ready a summary, the scores of rows without labels, and the next batch."""

    gate: DataFrame
    summary: DataFrame | None = None
    scores: DataFrame | None = None
    batch: DataFrame | None = None


def run(annotated: DataFrame, unlabelled: DataFrame, categories: list[str], number: int, log: str | None = None, size: int = 50, per_document: int = 3, min_examples: int = 50, min_categories: int = 5, **options) -> Round:
    """annotated: document_id, clause_id, text, labels, annotation_status, label_source. unlabelled: document_id, clause_id, text. Trains on documents apart
    from those that validate; with a log, appends the round's record there. A gate that isn't ready ends the round."""
    rows = annotated.where(filters.is_trainable(F.col("annotation_status"), F.col("label_source"), F.col("labels")))
    gate = filters.training_gate(rows, "labels", min_examples, min_categories)
    ready = gate.first()
    if not ready["ready"]:
        _record(gate, None, number, log)
        return Round(gate)
    parts = written(splits.assign(rows, splits.smallest_to_validation(rows, "document_id"), "document_id"), "parts")
    model, found = learning.train(parts.where("split = 'train'"), categories, **options)
    truth = parts.where("split = 'validation'").select("clause_id", "labels", F.explode(F.array(*map(F.lit, sorted(found)))).alias("category"))
    judged = truth.join(learning.predict(parts.where("split = 'validation'"), model, found, "clause_id"), ["clause_id", "category"])
    summary = metrics.summary(metrics.per_category(metrics.confusion(judged.select("category", F.array_contains("labels", F.col("category")).cast("int").alias("y_true"), "y_prob"))))
    each = learning.predict(unlabelled, model, found, "clause_id").groupBy("clause_id").agg(uncertainty(F.collect_list("y_prob")).alias("score"))  # as many as categories
    scores = unlabelled.select("document_id", "clause_id").join(each, "clause_id")
    _record(gate, summary, number, log)
    return Round(gate, summary, scores, selection.uncertain_batch(scores, "score", "clause_id", "document_id", size, per_document))


def _record(gate: DataFrame, summary: DataFrame | None, number: int, log: str | None) -> None:
    if log is not None:
        none = [F.lit(None).cast("double").alias(c) for c in ("macro_f1", "micro_f1")]
        figures = summary.select("macro_f1", "micro_f1") if summary is not None else gate.select(*none)
        append_aligned(gate.crossJoin(figures).select(F.lit(number).alias("round"), "examples", "categories", "ready", "reason", "macro_f1", "micro_f1"), log)  # one row
