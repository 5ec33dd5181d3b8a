"""Batch inference: a model is loaded once a worker, and decides on every row."""

import os
import uuid

import numpy as np
import pytest

from clausegrain.operators import artefacts, inference, splits


def test_a_model_is_loaded_once_a_worker(spark, tmp_path):
    folder = str(tmp_path)

    def load():
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(os.getpid()))

        def model(texts):
            assert len(texts) <= 7
            return np.array([[len(t) % 2, 0.25] for t in texts], float)

        return model

    rows = spark.range(500).selectExpr("id AS clause_id", "repeat('x', CAST(id % 9 AS INT)) AS text").unionByName(spark.range(1).selectExpr("-1L AS clause_id", "CAST(NULL AS STRING) AS text")).repartition(16)
    name = f"m-{uuid.uuid4().hex}"
    for _ in range(3):
        got = {(r.clause_id, r.category): r.y_prob for r in inference.infer(rows, load, ["a", "b"], name, batch_rows=7).collect()}
        assert got == {(i, c): float(i % 9 % 2) if c == "a" else 0.25 for i in range(500) for c in ("a", "b")} | {(-1, "a"): 0.0, (-1, "b"): 0.25}
    loads = [(tmp_path / f).read_text() for f in os.listdir(folder)]
    assert loads and len(loads) == len(set(loads))  # 48 tasks, and no worker has loaded it twice


def test_labels_from_chances(spark):
    judged = spark.createDataFrame([("x", "a", 0.7), ("x", "b", 0.5), ("x", "c", 0.1), ("y", "b", 0.2), ("y", "a", 0.2), ("y", "c", 0.1)], "clause_id string, category string, y_prob double")
    assert {r.clause_id: (r.labels, r.top_probability) for r in inference.decided(judged).collect()} == {"x": (["a", "b"], 0.7), "y": (["a"], 0.2)}


def test_a_model_must_answer_for_each_text(spark):
    rows = spark.createDataFrame([(1, "t")], "clause_id long, text string")
    with pytest.raises(Exception, match="gave"):
        inference.infer(rows, lambda: lambda texts: np.zeros((3, 1)), ["a"], "odd").collect()
    assert inference.infer(rows.limit(0), lambda: lambda texts: np.zeros((0, 1)), ["a"], "none").count() == 0


def test_artefacts_are_written_and_ordered(spark, tmp_path):
    rows = spark.createDataFrame([("c1", "text, with a comma", ["Purpose"], "HIGH_CONFIDENCE", 0.9, 1.0), ("c2", 'a "quote"\nand a line', ["Purpose", "NDA Type"], "DISAGREEMENT", 0.5, 0.1), ("c3", "t", [], "API_ERROR", 0.0, 0.0)], "clause_id string, text string, labels array<string>, quality string, average_confidence double, agreement_score double")
    at = artefacts.write(rows, str(tmp_path))
    read = lambda name: spark.read.csv(at[name], header=True, multiLine=True, quote='"', escape='"')
    assert [r.clause_id for r in read("queue").collect()] == ["c3", "c2", "c1"]
    assert [(r.clause_id, r.text, r.labels) for r in read("to_verify").orderBy("clause_id").collect()] == [("c2", 'a "quote"\nand a line', '["Purpose","NDA Type"]'), ("c3", "t", "[]")]
    assert {r.category: r["count"] for r in read("distribution").collect() if r["count"] != "0"} == {"Purpose": "2", "NDA Type": "1"}
    figures = read("figures").first()
    assert (figures.rows, figures.disagreements, figures.failures, figures.duplicates, figures.mean_confidence) == ("3", "1", "1", "0", "0.4667")
    assert "| 3 | 3 |" in "\n".join(r.value for r in spark.read.text(at["report"]).collect())


def test_strategies_of_documents_without_a_split(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("d1", ["Purpose"]), ("d1", []), ("d2", ["NDA Type", "Purpose"]), ("d3", None)], "document_id string, labels array<string>")
    profile = splits.ranked_profile(rows)
    assert [(r.document_id, r.clauses, r.n_categories, r.size_rank, r.category_rank) for r in profile.orderBy("document_id").collect()] == [("d1", 2, 1, 0, 1), ("d2", 1, 2, 1, 0), ("d3", 1, 0, 2, 2)]
    got = splits.judged(profile, {"one": F.when(F.col("size_rank") == 0, "train").when(F.col("size_rank") == 1, "test")}).first()
    assert (got.train_documents, got.train_clauses, got.train_categories, got.validation_documents, got.validation_categories, got.test_categories, got.unassigned) == (1, 2, 1, 0, 0, 2, 1)
    assert len(got.validation_lacks) == 14 and "Purpose" not in got.test_lacks
