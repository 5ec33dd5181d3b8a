"""Vector codes: product quantisation by treeAggregate over columnar blocks.

The vectors are cut into equal parts and packed, by tasks, into blocks of BLOCK rows: one column of whole numbers a dimension, in as few bytes as they
need, written to the shared folder. A round goes over the blocks as an RDD: distances accumulate dimension by dimension, the nearest entry is the
first of the smallest, np.add.at adds each part to its entry's sums and counts, and treeAggregate merges these tensors (parts, entries, width) through a
reduction tree, so the driver gets one of them however many tasks there are. Entries go out with the task. All sums are integers, so the result doesn't
depend on how rows are dealt.

Defined results: vectors as in vectors.py, zeros following where the length isn't a multiple of the parts; rows without an id are coded, but start no entry.
Fewer rows than entries make as many entries; ties of ids start by their vectors; repeated rows count each; an empty table gives no rows. Distances are exact while they fit 64 bits.
Further columns of any name are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausegrain.llm.common import discard, join_hot, materialize, sliced
from clausegrain.llm.vectors import SCALE, matrix, whole, width_of

#: Rows of a block, and rows whose distances are held at a time.
BLOCK, ROWS = 4096, 512
PACKED = "n int, kind string, columns binary, ids array<long>, labels array<string>"


def packed(rows: DataFrame, dims: int) -> DataFrame:
    """Blocks of rows (id, label, v): n, the columns of their vectors one after another, ids and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK):
            columns = np.ascontiguousarray(matrix(batch["v"], dims).T)
            low, high = int(columns.min(initial=0)), int(columns.max(initial=0))
            kind = next(k for k in ("i2", "i4", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.num_rows], pa.int32()), pa.array([kind]), pa.array([columns.astype("<" + kind).tobytes()], pa.binary()), pa.array([batch["id"].to_pylist()], pa.list_(pa.int64())), pa.array([batch["label"].to_pylist()], pa.list_(pa.string()))],
                names=["n", "kind", "columns", "ids", "labels"],
            )

    return rows.mapInArrow(run, PACKED)


def unpacked(n: int, kind: str, columns: bytes, parts: int) -> np.ndarray:
    """(parts, width, n) of a block."""
    return np.frombuffer(columns, "<" + kind).reshape(parts, -1, n)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, n) of each part's nearest entry, the first of equals, and of its squared distance."""
    parts, width, n = block.shape
    reach = int(np.abs(block).max(initial=0)) + int(np.abs(books).max(initial=0))
    kind = np.int32 if reach * reach * max(1, width) < 1 << 31 else np.int64
    codes, errors = np.zeros((parts, n), np.int64), np.zeros((parts, n), np.int64)
    for p in range(parts):
        entries = books[p].astype(kind)
        for at in range(0, n, ROWS):
            some = block[p, :, at : at + ROWS].astype(kind)
            distance, gap = np.zeros((some.shape[1], len(entries)), kind), np.empty((some.shape[1], len(entries)), kind)
            for d in range(width):
                np.subtract(some[d][:, None], entries[:, d], out=gap)
                np.multiply(gap, gap, out=gap)
                distance += gap
            best = distance.argmin(axis=1)
            codes[p, at : at + ROWS] = best
            errors[p, at : at + ROWS] = distance[np.arange(len(best)), best]
    return codes, errors


def summed(held, block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """held (sums, counts) and the parts of one more block, each added to its entry."""
    sums, counts = held or (np.zeros_like(books), np.zeros(books.shape[:2], np.int64))
    codes, _ = nearest(block, books)
    for p in range(len(books)):
        np.add.at(sums[p], codes[p], block[p].T.astype(np.int64))
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def added(one, other):
    if one is None or other is None:
        return one or other
    one[0].__iadd__(other[0])
    one[1].__iadd__(other[1])
    return one


def trained(blocks: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """The codebooks (parts, entries, width) after some rounds over all blocks; each entry becomes the floored mean of its parts."""
    of = blocks.select("n", "kind", "columns").rdd
    for _ in range(rounds):
        now, parts = books, len(books)
        got = of.treeAggregate(None, lambda held, r: summed(held, unpacked(r[0], r[1], bytes(r[2]), parts), now), added)
        if got is not None:
            sums, counts = got
            books = np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books)
    return books


def codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, id_column: str = "vec_id", vector: str = "embedding", label: str = "label", scale: int = SCALE) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of each row that takes part; at most 256 entries a part."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry's number is two hex digits")
    rows = materialize(vectors.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("string").alias("label"), whole(vector, scale).alias("v")).where("v IS NOT NULL"), "vectors")
    dims = -(-max(1, width_of(rows, "v")) // parts) * parts
    blocks = materialize(packed(rows, dims), "blocks")
    first = rows.where("id IS NOT NULL").orderBy("id", "v").limit(entries).select("v").collect()
    start = np.zeros((max(1, len(first)), dims), np.int64)
    for i, r in enumerate(first):
        start[i, : len(r[0])] = r[0]
    books = trained(blocks, np.ascontiguousarray(start.reshape(len(start), parts, -1).swapaxes(0, 1)), rounds)
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            n, kind, columns, ids, labels = (batch[c][0].as_py() for c in ("n", "kind", "columns", "ids", "labels"))
            code, error = nearest(unpacked(n, kind, columns, parts), books)
            hexed = code.astype(np.uint8).T.copy()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array([x.tobytes().hex() for x in hexed]), pa.array(error.sum(axis=0), pa.int64())], names=["id", "label", "code", "error"])

    coded = materialize(blocks.mapInArrow(run, "id long, label string, code string, error long"), "codes")
    discard(rows)
    discard(blocks)
    keyed = coded.withColumn("key", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null")))
    met = join_hot(keyed, keyed.groupBy("key").agg(F.sum("error").alias("label_error")), "key", "left")
    return met.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
