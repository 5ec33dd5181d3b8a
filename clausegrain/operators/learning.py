"""Baseline classifiers: TF-IDF of words and pairs of words, one logistic regression a category, classes balanced by weight."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import DataFrame, functions as F

from clausegrain.operators import linear, metrics, splits
from clausegrain.sources.scratch import dropped, free, written


def train(rows: DataFrame, categories: list[str], labels: str = "labels", least: int = 1, vocabulary: int = 20_000, stop_words: bool = False, sublinear: bool = True, strength: float = 1.0, most: int = 100) -> tuple[linear.Vocabulary, dict[str, np.ndarray]]:
    """A vocabulary, and the weights (terms, then the constant) of a classifier for each category that has enough positives and negatives. rows: text, labels.
    All categories are trained in the same passes."""
    own = written(rows.select("text", labels, F.monotonically_increasing_id().alias("_row")), "rows")
    n = own.agg(F.count("*").alias("_n"), *(F.count_if(F.array_contains(labels, c)).alias(str(i)) for i, c in enumerate(categories))).first()
    able = [(c, n[str(i)]) for i, c in enumerate(categories) if min(n[str(i)], n["_n"] - n[str(i)]) >= max(least, 1)]
    words = tuple(StopWordsRemover.loadDefaultStopWords("english")) if stop_words else ()
    model, counted = linear.fit_counted(own, "_row", size=vocabulary, sublinear=sublinear, stop_words=words)
    if not able:
        return model, {}
    y = F.array(*(F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("byte") for c, _ in able)).alias("y")
    vectors = own.select("_row", y).join(model.unscaled(counted, "_row"), "_row", "left")
    blocks = written(linear.packed(vectors, len(able)), "blocks")
    balance = np.array([[n["_n"] / (2.0 * (n["_n"] - k)) for _, k in able], [n["_n"] / (2.0 * k) for _, k in able]])
    weights, _ = linear.descend(blocks, model.size, balance, strength, most)
    dropped(own)
    dropped(counted)
    dropped(blocks)
    return model, {c: weights[:, k] for k, (c, _) in enumerate(able)}


def predict(rows: DataFrame, model: linear.Vocabulary, classifiers: dict[str, np.ndarray], key: str) -> DataFrame:
    """key, category, y_prob in long form, all categories in one pass; keys are taken to tell rows apart, and rows without a known term get the constants' chances."""
    names, w = list(classifiers), np.stack(list(classifiers.values()), axis=1) if classifiers else np.zeros((model.size + 1, 0))
    kind = rows.schema[key].dataType.simpleString()
    k = free([key], "k")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, of, ids, weights = linear.scaled(batch)
            m = linear.margins(of, ids, weights, n, w)
            chances = pa.FixedSizeListArray.from_arrays(pa.array((1 / (1 + np.exp(-np.clip(m, -500, 500)))).ravel()), max(1, w.shape[1])).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch[k], chances], names=[k, "chances"])

    own = rows.select(F.col(key).alias(k), "text")
    vectors = own.select(k).join(model.unscaled(linear.counts(linear.tokens(own, k, "text", model.stop_words), model.known, k), k), k, "left") if names else own.limit(0).selectExpr(k, "array(0) AS ids", "array(0D) AS weights")
    judged = vectors.mapInArrow(run, f"{k} {kind}, chances array<double>")
    each = F.arrays_zip(F.array(*map(F.lit, names)).cast("array<string>").alias("category"), F.col("chances").alias("y_prob"))
    return judged.select(F.col(k).alias(key), F.inline(each).alias("category", "y_prob"))


def cross_validate(rows: DataFrame, categories: list[str], document: str = "document_id", key: str = "clause_id", labels: str = "labels", folds: int = 5, **options) -> DataFrame:
    """fold, macro and micro F1, precision and recall: for each fold of documents a model of the others judges it. A loop over a few folds; rows stay on the cluster."""
    dealt = written(rows.join(splits.group_folds(rows, document, folds), document), "folds")
    out = None
    for fold in sorted(r[0] for r in dealt.select("fold").distinct().collect()):
        model, found = train(dealt.where(F.col("fold") != fold), categories, labels, **options)
        held = dealt.where(F.col("fold") == fold)
        judged = predict(held, model, found, key) if found else held.select(key).limit(0).selectExpr(key, "'' AS category", "0D AS y_prob")
        truth = held.select(key, labels, F.explode(F.array(*map(F.lit, categories))).alias("category"))
        both = truth.join(judged, [key, "category"], "left").select("category", F.array_contains(labels, F.col("category")).cast("int").alias("y_true"), F.coalesce("y_prob", F.lit(0.0)).alias("y_prob"))
        one = metrics.summary(metrics.per_category(metrics.confusion(both))).select(F.lit(fold).alias("fold"), "macro_f1", "micro_f1", "micro_precision", "micro_recall")
        out = one if out is None else out.unionByName(one)
    return out


def completed(spark, path: str, parts: tuple[str, ...]) -> bool:
    """Whether all parts of a run's results are there, so that it needn't run again."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return all(fs.exists(hadoop(f"{path}/{p}")) for p in parts)
