"""Vectors as integers: what the operators on embeddings share.

Defined results: a vector that is null, or holds a null or a component that isn't finite, takes no part; a shorter vector counts as if zeros
followed it up to the longest one's length, and an empty one is all zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

SCALE = 1024


def whole(column: str, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, in doubles; null if the vector takes no part. Values beyond 64 bits are the nearest that fit."""
    x = F.col(column)
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < F.lit(float("inf")), F.lit(False)))  # NaN is above infinity here
    return F.when(finite, F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A batch's list<long> column as rows of the width."""
    flat, lengths = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False), np.asarray(column.value_lengths().fill_null(0))
    if (lengths == width).all():
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def width_of(rows: DataFrame, column: str) -> int:
    return rows.agg(F.coalesce(F.max(F.size(column)), F.lit(0))).first()[0]
