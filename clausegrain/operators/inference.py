"""Batch inference by a model of any kind: it is loaded once in a worker's life and fed Arrow batches."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: What a loaded model does: texts to an array of chances (texts by categories).
Model = Callable[[list[str]], np.ndarray]


def held(name: str, load: Callable[[], Model]) -> Model:
    """The model that load() gave in this worker under this name; another name takes its place. Tasks unpickle their functions anew, so it is held outside of them."""
    kept = sys.modules.setdefault("clausegrain_models", types.ModuleType("clausegrain_models")).__dict__
    if kept.get("name") != name:
        kept.pop("model", None)
        kept["model"], kept["name"] = load(), name
    return kept["model"]


def infer(rows: DataFrame, load: Callable[[], Model], categories: list[str], name: str, key: str = "clause_id", text: str = "text", batch_rows: int = 256) -> DataFrame:
    """key, category, y_prob in long form of every row (null text: empty). load() runs once in each Python worker that takes part, not once a task or batch; name is the model's, version included.
    The model gets so many texts at most at a time."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(name, load)
        for whole in batches:
            for at in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(at, batch_rows)
                chances = np.asarray(model([t or "" for t in batch[text].to_pylist()]), float)
                if chances.shape != (batch.num_rows, len(categories)):
                    raise ValueError(f"{name} gave {chances.shape} for {batch.num_rows} texts and {len(categories)} categories")
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, chances.size + 1, len(categories)), pa.int32()), pa.array(chances.ravel()))
                yield pa.RecordBatch.from_arrays([batch[key], lists], names=[key, "chances"])

    judged = rows.select(key, text).mapInArrow(run, f"{key} {kind}, chances array<double>")
    each = F.arrays_zip(F.array(*map(F.lit, categories)).alias("category"), F.col("chances").alias("y_prob"))
    return judged.select(key, F.inline(each).alias("category", "y_prob"))


def decided(judged: DataFrame, threshold: float = 0.5, key: str = "clause_id") -> DataFrame:
    """key, labels (those at the threshold and above, else the likeliest, the first of equals), top_probability."""
    by = judged.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("y_prob") >= threshold, F.col("category")))).alias("own"), F.min(F.struct((-F.col("y_prob")).alias("p"), F.col("category").alias("c"))).alias("first"))  # as many as categories
    return by.select(key, F.when(F.size("own") > 0, F.col("own")).otherwise(F.array("first.c")).alias("labels"), (-F.col("first.p")).alias("top_probability"))
