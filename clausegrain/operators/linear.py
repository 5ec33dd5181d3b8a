"""TF-IDF as a relation, and logistic regressions of all categories in one pass an iteration.

The vocabulary is the most frequent words and pairs of words; the terms of a text are rows (row, term_id, n), looked up in it and counted by an aggregation; weights are (1 + ln n) or n, times the
smoothed inverse document frequency, and each row's weights are scaled to length one. The rows' sparse vectors and labels are packed into blocks in the shared folder.

Each category has an objective of its own, |w|^2 / 2 + C * sum of weighted losses, and its own quasi-Newton steps, but a pass over the blocks gives the losses and gradients of all of them at
once: a tree aggregation of arrays (vocabulary by categories), whose size doesn't depend on the rows. A category whose step was too long tries a shorter one in the next pass, along with the others' next steps.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from clausegrain.sources.scratch import dropped, free, written

# A token is two or more letters, digits or underscores.
TOKEN = r"[\p{L}\p{N}_]{2,}"
BLOCK_ROWS, HISTORY, MOST_PASSES = 5000, 10, 1000
PACKED = "n int, rows binary, terms binary, weights binary, labels binary"


def tokens(rows: DataFrame, key: str, text: str = "text", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """key, words: the words of each text in order, stop words left out."""
    own = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), 0)
    return rows.select(key, (F.filter(own, lambda w: ~w.isin(*stop_words)) if stop_words else own).alias(free([key], "words")))


def _each(tokenised: DataFrame, key: str) -> DataFrame:
    """key, _w, _next: each word of tokens() and the one after it, null after the last."""
    words = F.col(free([key], "words"))
    return tokenised.select(key, F.inline(F.arrays_zip(words.alias("_w"), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))).alias("_next"))))


def most_frequent(tokenised: DataFrame, key: str, size: int = 20_000) -> DataFrame:
    """term, term_id of the `size` most frequent words and pairs of neighbours (ties by the term); ids follow the terms' order.

    A pair is no more frequent than either of its words. So where `size` words have a count of L or more, no term below L is among the most frequent, and only pairs of
    words that reach L are counted: what is shuffled is words, and pairs of some `size` of them, not all pairs."""
    each = _each(tokenised, key)
    words = written(each.groupBy("_w").agg(F.count("*").alias("n")), "words")
    top = words.orderBy(F.desc("n")).limit(size).agg(F.count("*").alias("k"), F.min("n").alias("n")).first()
    least = top["n"] if size and top["k"] == size else 0
    often = words.where(F.col("n") >= least)
    paired = each.where("_next IS NOT NULL").join(often.select("_w"), "_w").join(often.select(F.col("_w").alias("_next")), "_next")
    pairs = paired.groupBy("_w", "_next").agg(F.count("*").alias("n")).where(F.col("n") >= least).select(F.concat_ws(" ", "_w", "_next").alias("term"), "n")
    most = often.select(F.col("_w").alias("term"), "n").unionByName(pairs).orderBy(F.desc("n"), "term").limit(size)
    ids = most.agg(F.array_sort(F.collect_list("term")).alias("_t"))  # `size` terms at most
    known = written(ids.select(F.posexplode("_t").alias("term_id", "term")).select("term", "term_id").coalesce(1), "terms")
    dropped(words)
    return known


def counts(tokenised: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, term_id, n: how often each known term is in each text. Ids are looked up before anything is shuffled, and a text's are counted where it lies."""
    parts = F.split("term", " ")
    placed = known.select(parts[0].alias("_w"), F.get(parts, F.lit(1)).alias("_next"), "term_id")
    one = placed.where("_next IS NULL").select("_w", F.col("term_id").alias("_one"))
    two = placed.where("_next IS NOT NULL").select("_w", "_next", F.col("term_id").alias("_two"))
    found = _each(tokenised, key).join(F.broadcast(one), "_w", "left").join(F.broadcast(two), ["_w", "_next"], "left")  # a vocabulary's size
    return found.select(key, F.explode(F.array_compact(F.array("_one", "_two"))).alias("term_id")).groupBy(key, "term_id").agg(F.count("*").alias("n"))


def with_idf(known: DataFrame, counted: DataFrame, rows: int) -> DataFrame:
    """term, term_id, idf of known terms, whose counts() in all of so many rows are given."""
    df = counted.groupBy("term_id").agg(F.count("*").alias("_df"))
    return known.join(df, "term_id").select("term", "term_id", (F.log((1.0 + rows) / (1 + F.col("_df"))) + 1).alias("idf"))


def _scaled(counted: DataFrame, known: DataFrame, key: str, sublinear: bool) -> DataFrame:
    tf = 1 + F.log("n") if sublinear else F.col("n").cast("double")
    return counted.join(F.broadcast(known), "term_id").select(key, "term_id", (tf * F.col("idf")).alias("_weight"))


def weighted(counted: DataFrame, known: DataFrame, key: str, sublinear: bool = True) -> DataFrame:
    """key, term, term_id, weight: each row's weights, scaled to length one."""
    own = W.partitionBy(key).orderBy("term_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # the known terms of one text
    w = F.col("_weight")
    scaled = _scaled(counted, known, key, sublinear).select(key, "term_id", (w / F.sqrt(F.sum(w * w).over(own))).alias("weight"))
    return scaled.join(F.broadcast(known.select("term", "term_id")), "term_id").select(key, "term", "term_id", "weight")


@dataclass(frozen=True)
class Vocabulary:
    """What turns texts into vectors: term, term_id, idf, and how."""

    known: DataFrame
    size: int
    sublinear: bool
    stop_words: tuple[str, ...]

    def vectors(self, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
        """key, ids, weights (arrays) of each row that holds a known term."""
        return self.vectors_of(counts(tokens(rows, key, text, self.stop_words), self.known, key), key)

    def vectors_of(self, counted: DataFrame, key: str) -> DataFrame:
        """vectors() of texts whose counts() are given."""
        raw = self.unscaled(counted, key)
        norm = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda acc, x: acc + x * x))
        return raw.withColumn("_norm", norm).select(key, "ids", F.transform("weights", lambda x: x / F.col("_norm")).alias("weights"))

    def unscaled(self, counted: DataFrame, key: str) -> DataFrame:
        """vectors_of() before they are scaled to length one, which scaled() does by Arrow batch much faster than functions on arrays do."""
        of = F.sort_array(F.collect_list(F.struct("term_id", F.col("_weight").alias("w")))).alias("_of")  # the known terms of one text
        both = _scaled(counted, self.known, key, self.sublinear).groupBy(key).agg(of)
        return both.select(key, F.col("_of.term_id").alias("ids"), F.col("_of.w").alias("weights"))


def fit_counted(rows: DataFrame, key: str, text: str = "text", size: int = 20_000, sublinear: bool = True, stop_words: tuple[str, ...] = ()) -> tuple[Vocabulary, DataFrame]:
    """A vocabulary of the rows, and their counts(), written to the shared folder."""
    tokenised = written(tokens(rows, key, text, stop_words), "tokens")
    found = most_frequent(tokenised, key, size)
    counted = written(counts(tokenised, found, key), "counts")
    known = written(with_idf(found, counted, tokenised.count()).coalesce(1), "vocabulary")
    dropped(tokenised)
    dropped(found)
    return Vocabulary(known, known.count(), sublinear, stop_words), counted


def fit_vocabulary(rows: DataFrame, key: str, text: str = "text", size: int = 20_000, sublinear: bool = True, stop_words: tuple[str, ...] = ()) -> Vocabulary:
    model, counted = fit_counted(rows, key, text, size, sublinear, stop_words)
    dropped(counted)
    return model


def scaled(batch: pa.RecordBatch) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """A batch of sparse vectors (ids, weights; null for none) as how many there are and, entry by entry, their row, term and weight, each row's weights scaled to length one."""
    sizes = np.asarray(batch["ids"].value_lengths().fill_null(0))
    of, weights = np.repeat(np.arange(len(sizes)), sizes), np.asarray(batch["weights"].flatten(), np.float64)
    norms = np.sqrt(np.bincount(of, weights * weights, minlength=len(sizes)))
    return len(sizes), of, np.asarray(batch["ids"].flatten(), np.int64), weights / norms[of]


def packed(vectors: DataFrame, labels: int) -> DataFrame:
    """Blocks of rows (ids, weights, which are scaled to length one, y: an array of so many 0 or 1) as PACKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                n, of, ids, weights = scaled(batch)
                arrays = (of.astype("<i4"), ids.astype("<i4"), weights.astype("<f8"), np.asarray(batch["y"].flatten(), "i1"))
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=["n", "rows", "terms", "weights", "labels"])

    return vectors.select("ids", "weights", "y").mapInArrow(run, PACKED)


def margins(of: np.ndarray, terms_: np.ndarray, weights: np.ndarray, n: int, w: np.ndarray) -> np.ndarray:
    """(rows, categories): each row's product with each category's weights, of which the last is its constant."""
    of, terms_ = of.astype(np.intp), terms_.astype(np.intp)  # once, not for each category
    out = np.zeros((w.shape[1], n))
    for c, own in enumerate(np.ascontiguousarray(w.T)):
        out[c] = np.bincount(of, own[terms_] * weights, minlength=n) + own[-1]
    return out.T


def loss_and_gradient(held, row, w: np.ndarray, balance: np.ndarray):
    """held plus the losses (categories) and gradients (terms and constant, categories) of a block (n, rows, terms, weights, and labels as an array), its rows weighted by balance (negatives', positives').
    Arrays lie category by category, so each category's sums read memory in order."""
    n, of, ids, weights, y = row[0], np.frombuffer(row[1], "<i4").astype(np.intp), np.frombuffer(row[2], "<i4").astype(np.intp), np.frombuffer(row[3], "<f8"), np.ascontiguousarray(row[4].T)
    m = np.ascontiguousarray(margins(of, ids, weights, n, w).T)
    s = np.where(y == 1, balance[1][:, None], balance[0][:, None])
    loss = (s * (np.log1p(np.exp(-np.abs(m))) + np.maximum(m, 0) - y * m)).sum(axis=1)
    r = s * (1 / (1 + np.exp(-np.clip(m, -500, 500))) - y)
    gradient = np.empty_like(w)
    for c, own in enumerate(r):
        gradient[:-1, c] = np.bincount(ids, own[of] * weights, minlength=len(w) - 1)
    gradient[-1] = r.sum(axis=1)
    if held is None:
        return loss, gradient
    held[0].__iadd__(loss)
    held[1].__iadd__(gradient)
    return held


def joined(one, other):
    if one is None or other is None:
        return one or other
    one[0].__iadd__(other[0])
    one[1].__iadd__(other[1])
    return one


class Descent:
    """One category's limited-memory quasi-Newton steps: next_point() says where to look, told() what was there."""

    def __init__(self, size: int, tolerance: float, most: int):
        self.x, self.f, self.g, self.steps = np.zeros(size), None, None, deque(maxlen=HISTORY)
        self.tolerance, self.most, self.taken, self.t, self.d, self.done = tolerance, most, 0, 0.0, np.zeros(size), False

    def next_point(self) -> np.ndarray:
        return self.x + self.t * self.d

    def told(self, f: float, g: np.ndarray) -> None:
        if self.done:
            return
        at = self.next_point()
        if self.f is not None:
            if f > self.f + 1e-4 * self.t * float(self.g @ self.d):
                self.t /= 2
                self.done = self.t < 1e-10
                return
            s, y = at - self.x, g - self.g
            if (sy := float(s @ y)) > 1e-12:
                self.steps.append((s, y, 1 / sy))
            self.taken += 1
        self.x, self.f, self.g = at, f, g
        self.done = float(np.abs(g).max()) <= self.tolerance or self.taken >= self.most
        self._turn()

    def _turn(self) -> None:
        q, kept = self.g.copy(), []
        for s, y, r in reversed(self.steps):
            a = r * float(s @ q)
            kept.append(a)
            q -= a * y
        if self.steps:
            s, y, r = self.steps[-1]
            q /= r * float(y @ y)
        for (s, y, r), a in zip(self.steps, reversed(kept), strict=True):
            q += s * (a - r * float(y @ q))
        self.d, self.t = -q, 1.0 if self.steps else 1 / max(1.0, float(np.linalg.norm(self.g)))


def descend(blocks: DataFrame, size: int, balance: np.ndarray, strength: float = 1.0, most: int = 100, tolerance: float = 1e-3) -> tuple[np.ndarray, int]:
    """(terms and constant, categories): the minimum of each category's objective, and the passes over the blocks that it took."""
    context = blocks.sparkSession.sparkContext
    ways, passes = [Descent(size + 1, tolerance, most) for _ in range(balance.shape[1])], 0
    while not all(way.done for way in ways) and passes < MOST_PASSES:
        open_ = [k for k, way in enumerate(ways) if not way.done]
        w = np.stack([ways[k].next_point() for k in open_], axis=1)
        sent = context.broadcast((w, balance[:, open_], open_))

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            (w, b, which), held = sent.value, None
            for batch in batches:
                for n, *arrays, labels in zip(*(batch[c] for c in ("n", "rows", "terms", "weights", "labels")), strict=True):
                    y = np.frombuffer(labels.as_buffer(), "i1").reshape(n.as_py(), -1)[:, which]
                    held = loss_and_gradient(held, (n.as_py(), *(x.as_buffer() for x in arrays), y), w, b)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in held], ["loss", "gradient"])

        def add(held, row, shape=w.shape):
            return joined(held, (np.frombuffer(row[0]).copy(), np.frombuffer(row[1]).reshape(shape).copy()))

        # blocks go to Python as Arrow, and a task's sums alone are rows of an RDD
        got = blocks.mapInArrow(step, "loss binary, gradient binary").rdd.treeAggregate(None, add, joined)
        sent.destroy()
        passes += 1
        losses, gradients = got if got is not None else (np.zeros(len(open_)), np.zeros_like(w))
        for i, k in enumerate(open_):
            own = w[:, i].copy()
            own[-1] = 0  # the constant is free
            ways[k].told(float(strength * losses[i] + own @ own / 2), strength * gradients[:, i] + own)
    return np.stack([way.x for way in ways], axis=1) if ways else np.zeros((size + 1, 0)), passes
