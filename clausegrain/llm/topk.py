"""Exact top-k by inner product: the threshold algorithm over sorted per-dimension lists.

The rows are written once, as integers with a number each, and dealt into blocks of BLOCK rows. A block is sorted along each dimension when a
task gets it; queries are copied to all blocks (a stated set of queries against all rows, in blocks) and stream past the block's lists. For a query the lists of
its non-zero components are read in step from their better ends; each row that shows for the first time is scored in full; the best score that an
unread row can still have is the sum of what the lists show next, and reading stops once that is below the query's floor. The floor is the kth score so far,
or at first the kth score among SAMPLE rows, which every query is held against beforehand: no row below it can be among the k best, so
blocks hand back only rows at or above it. Where the lists have shown half of a block without a stop, its other rows are scored at once, as nothing is
left to save. Each block's best k meet in a window by query.

A task holds one block and a batch of queries; the copies of the queries are what the shuffle carries, blocks times a hundredth of the rows.

Defined results: vectors as in vectors.py; rows without an id take no part, and an empty table gives no rows. A query is not held against rows of its own id.
Repeated rows are candidates of their own, and as queries they are answered once each. Equal scores go by vec_id. Scores are exact while they fit 64 bits, and wrap around beyond.
Further columns of any name are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from clausegrain.llm.common import Shared, materialize, sliced
from clausegrain.llm.vectors import SCALE, matrix, whole, width_of

#: Rows of a block at most, about; rows that give the first floors; how far each list is read before the first stop.
BLOCK, SAMPLE, FIRST = 1 << 16, 4096, 8


class Block:
    """Rows of a block with their lists: values[d] ascending, order[d] the rows that have them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.most = ids, rows, int(np.abs(rows).max(initial=0))
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").astype(np.int32).T)
        self.values = np.take_along_axis(rows.T, self.order, axis=1)
        self.plain = rows.astype(np.float64)

    def exact(self, queries: np.ndarray) -> bool:
        """Whether all sums of products fit the digits of a double, whatever their order."""
        return self.most * int(np.abs(queries).max(initial=0)) * max(1, self.rows.shape[1]) < 1 << 53

    def read(self, own: int, query: np.ndarray, k: int, floor: int | None, plain: bool) -> tuple[list[tuple[int, int]], np.ndarray | None, int | None]:
        """The best (score, id) so far, the rows seen (None: the lists were read far enough) and the floor."""
        n, used = len(self.ids), np.flatnonzero(query)
        up, q, rows = query[used] > 0, query[used], self.plain if plain else self.rows
        best, seen, depth, step = [], np.zeros(n, bool), 0, FIRST
        while used.size:
            upto = min(n, depth + step)
            heads = np.where(up[:, None], self.order[used, n - upto : n - depth], self.order[used, depth:upto])
            fresh = np.unique(heads)
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
            scores = rows[fresh] @ (query.astype(np.float64) if plain else query)
            best, floor = merged(best, self.ids[fresh], scores, own, k, floor)
            depth = upto
            if depth == n or floor is not None and int((q * np.where(up, self.values[used, n - depth - 1], self.values[used, depth])).sum()) < floor:
                return best, None, floor
            if 2 * int(seen.sum()) >= n:
                break
            step *= 2
        return best, seen, floor

    def answers(self, own: np.ndarray, queries: np.ndarray, floors: list[int | None], k: int) -> list[list[tuple[int, int]]]:
        """(score, id) of each query's best rows of the block: all that can be among the k best of all blocks."""
        plain, out, rest = self.exact(queries), [], []
        for i, (query, floor) in enumerate(zip(queries, floors, strict=True)):
            best, seen, floor = self.read(int(own[i]), query, k, floor, plain)
            out.append(best)
            if seen is not None:
                rest.append((i, seen, floor))
        some = max(1, (4 << 20) // max(1, len(self.ids)))
        for at in range(0, len(rest), some):
            part = rest[at : at + some]
            q = queries[[i for i, _, _ in part]]
            scores = q.astype(np.float64) @ self.plain.T if plain else q @ self.rows.T
            for (i, seen, floor), s in zip(part, scores, strict=True):
                left = np.flatnonzero(~seen if floor is None else ~seen & (s >= floor))
                out[i], _ = merged(out[i], self.ids[left], s[left], int(own[i]), k, floor)
        return out


def merged(best: list[tuple[int, int]], ids: np.ndarray, scores: np.ndarray, own: int, k: int, floor: int | None) -> tuple[list[tuple[int, int]], int | None]:
    """The k best of best and of the rows that aren't the query's own, and the floor that follows."""
    fit = ids != own if floor is None else (ids != own) & (scores >= floor)
    ids, scores = ids[fit], scores[fit].astype(np.int64)
    if len(ids) > k:  # all that tie with the kth stay for the choice by id
        fit = scores >= np.partition(scores, len(scores) - k)[-k]
        ids, scores = ids[fit], scores[fit]
    first = np.lexsort((ids, -scores))[:k]
    best = sorted([*best, *zip(scores[first].tolist(), ids[first].tolist(), strict=True)], key=lambda x: (-x[0], x[1]))[:k]
    return best, best[-1][0] if len(best) == k else floor


def numbered(vectors: DataFrame, id_column: str, vector: str, scale: int) -> DataFrame:
    """row (a number of its own), id, v of the rows that take part, written to the shared folder."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), whole(vector, scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    return materialize(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")


def search(vectors: DataFrame, k: int = 10, every: int = 100, id_column: str = "vec_id", vector: str = "embedding", scale: int = SCALE, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of each query, a row whose id is divisible by `every`."""
    rows = numbered(vectors, id_column, vector, scale)
    width, n, cores = width_of(rows, "v"), rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // block), min(2 * cores, -(-n // 1024)))
    known = rows.select("id", "v").limit(sample).toArrow()
    sent = Shared(rows.sparkSession, (np.asarray(known["id"]), matrix(known["v"].combine_chunks(), width)))

    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampled = None
        for batch in sliced(batches, 1024):
            sampled = sampled or Block(*sent.value)
            own, queries = np.asarray(batch["id"]), matrix(batch["v"], width)
            plain, low = sampled.exact(queries), []
            scores = queries.astype(np.float64) @ sampled.plain.T if plain else queries @ sampled.rows.T
            for i, s in zip(own, scores, strict=True):
                others = s[sampled.ids != i]
                low.append(int(np.partition(others, len(others) - k)[-k]) if len(others) >= k else None)
            yield pa.RecordBatch.from_arrays([batch["row"], batch["id"], batch["v"], pa.array(low, pa.int64())], names=["row", "id", "v", "floor"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, made = None, [], None
        for batch in sliced(batches, 1024):
            numbers = np.asarray(batch["block"])
            edges = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for low, high in zip(edges, edges[1:], strict=False):
                part = batch.slice(low, high - low)
                if at != numbers[low]:
                    at, held, made = numbers[low], [], None
                is_query = np.asarray(part["is_query"])
                own, values = np.asarray(part["id"]), matrix(part["v"], width)
                held.append((own[is_query == 0], values[is_query == 0]))
                own, values = own[is_query == 1], values[is_query == 1]
                if not len(own):
                    continue
                made, held = made or Block(*map(np.concatenate, zip(*held, strict=True))), []
                low_ = part["floor"].to_pylist()[-len(own) :]
                found = made.answers(own, values, low_, k)
                asked = part["row"].to_pylist()[-len(own) :]
                flat = [(r, i, s, c) for r, i, f in zip(asked, own.tolist(), found, strict=True) for s, c in f]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*flat, strict=True)], names=["row", "query_id", "score", "vec_id"])

    queries = rows.where(F.col("id") % every == 0).mapInArrow(floors, "row long, id long, v array<long>, floor long")
    copies = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("is_query", F.lit(1))
    dealt = rows.select("row", "id", "v", F.lit(None).cast("long").alias("floor"), F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("is_query"))
    met = dealt.unionByName(copies).repartitionById(blocks, "block").sortWithinPartitions("block", "is_query")
    # Written before the window, as its rows are what the search costs.
    found = materialize(met.mapInArrow(answered, "row long, query_id long, score long, vec_id long"), "found")
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
