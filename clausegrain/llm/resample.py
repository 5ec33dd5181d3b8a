"""Importance resampling towards a target distribution, with ranks by an external merge.

Counts: tasks add the features of their texts into one array of BUCKETS and hand it on; the sums of all documents and of all target texts give each
bucket's gain, an array that goes out to all tasks. Weights: a batch's buckets index that array, and sums by text give the floored means. Noise comes from
a hash of the id, so a draw repeats.

Draw: scores are whole numbers in a narrow span (at most some 110,000 values, whatever the corpus: the gains of counts below 2^63 and the noise of 32 bits bound them), so
the count of eligible rows by score is small and exact; it gives the draw's last score, and ranges of about RANGE_ROWS rows with the ranks
above each. Tasks sort the eligible rows from that score up into runs: files of small batches under the shared folder, by descending score and ascending
id. For each range a tournament tree merges the runs' batches that meet it, holding one batch of each, numbers the rows from the
rank above, and stops numbering at the exact count; what ties with the last score beyond it stays undrawn. A merge's memory follows the number of runs (RUN_ROWS rows each), not the rows.

Defined results: null and empty texts have no features, weight 0 and no part in the draw; very long texts are worked through in pieces; a null id counts as an empty
text in the hash and sorts before others; repeated rows are rows of their own, and take ranks after one another; an empty table gives no rows, an empty target counts of 0. Further columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausegrain.llm.common import as_bytes, discard, map_batches, materialize, shared_dir, sliced
from clausegrain.llm.warc import LoserTree, filesystem

BUCKETS = 10_000
#: Bytes of a text at a time; rows of a run at most, of a run's batch, and of a range, about.
PIECE, RUN_ROWS, BATCH_ROWS, RANGE_ROWS = 1 << 20, 1 << 22, 512, 1 << 18
#: A-Z lower-cased; what is neither a digit, a letter nor beyond ASCII becomes a space.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BETWEEN = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
SCORED = "doc_id long, n_features long, weight long, score long, n_words long"
DRAWN = "doc_id long, n_features long, weight long, score long, rank long"
FIELDS = ["doc_id", "n_features", "weight", "score"]


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # up to the end of a word
            gap = BETWEEN.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].translate(PLAIN).split()
        at = end


def features(text: bytes, longest: int, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of the runs of 1 to `longest` words of a text, and its words, some at a time."""
    before: list[bytes] = []
    for words in pieces(text):
        both = before + words
        runs = (words, *(map(b" ".join, zip(*(both[max(0, len(before) - n + 1) :][i:] for i in range(n)), strict=False)) for n in range(2, longest + 1)))
        found = np.concatenate([np.fromiter(map(zlib.crc32, r), np.int64) for r in runs]) % buckets
        before = both[max(0, len(both) - longest + 1) :] if longest > 1 else []
        yield found, len(words)


def counted(texts: DataFrame, longest: int, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in sliced(batches):
            for text in as_bytes(batch["text"]):
                for found, _ in features(text, longest, buckets):
                    total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n")).collect():  # a row for each bucket at most
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's floored log ratio of target to source, both smoothed by one a bucket, in thousandths."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log(float((y + 1) * (s + k)) / float((x + 1) * (t + k)))) for x, y in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, longest: int, seed: int) -> DataFrame:
    """SCORED of every document."""

    def work(batch: pa.RecordBatch) -> dict:
        ids, weights, sizes, words = batch["doc_id"].to_pylist(), [], [], []
        for text in as_bytes(batch["text"]):
            total = size = n = 0
            for found, w in features(text, longest, len(gain)):
                total, size, n = total + int(gain[found].sum()), size + len(found), n + w
            weights.append(total // size if size else 0)
            sizes.append(size)
            words.append(n)
        return {"doc_id": ids, "n_features": sizes, "weight": weights, "score": [w + noise(i, seed) for i, w in zip(ids, weights, strict=True)], "n_words": words}

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), work, SCORED)


def key(row: tuple) -> tuple:
    """By descending score, then ascending id, null first."""
    return -row[3], row[0] is not None, row[0] or 0


def runs(rows: DataFrame, folder: str) -> DataFrame:
    """Rows (FIELDS) as sorted runs of RUN_ROWS rows at most: run, batch, rows, high, low (scores) of each batch of the runs' files."""

    def written(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        held = pa.Table.from_batches(parts).combine_chunks()
        ids = held["doc_id"].combine_chunks()
        order = np.lexsort((np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid()), -np.asarray(held["score"])))
        held = held.take(pa.array(order))
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name, made = uuid.uuid4().hex, []
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out, pa.ipc.new_file(out, held.schema) as file:
            for at in range(0, held.num_rows, BATCH_ROWS):
                batch = held.slice(at, BATCH_ROWS)
                file.write_table(batch, max_chunksize=BATCH_ROWS)
                made.append((f"{folder}/{name}", len(made), batch.num_rows, batch["score"][0].as_py(), batch["score"][-1].as_py()))
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], ["run", "batch", "rows", "high", "low"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch in batches:
            if n and n + batch.num_rows > RUN_ROWS:
                yield written(parts)
                parts, n = [], 0
            parts.append(batch)
            n += batch.num_rows
        if n:
            yield written(parts)

    return materialize(rows.select(*FIELDS).mapInArrow(run, "run string, batch int, rows long, high long, low long"), "runs")


def read(run: str, batches: list[int], high: int, low: int) -> Iterator[tuple]:
    """The rows of a run's batches with scores from high down to low, one batch at a time; no file stays open between batches."""
    for number in batches:
        fs, path = filesystem(run)
        with fs.open_input_file(path) as file:
            batch = pa.ipc.open_file(file).get_batch(number)
        for row in zip(*(batch[c].to_pylist() for c in FIELDS), strict=True):
            if low <= row[3] <= high:
                yield row


def ranges(by_score: list[tuple[int, int]], draw: int, rows: int) -> list[tuple[int, int, int]]:
    """(high, low, rows above) of ranges of about so many rows each, from the counts by descending score, down to the score at which the draw is full."""
    out, above, start, held = [], 0, None, 0
    for score, n in by_score:
        if above + held >= draw:
            break
        start = score if start is None else start
        held += n
        if held >= rows or above + held >= draw:
            out.append((start, score, above))
            above, start, held = above + held, None, 0
    return out


def merged(pieces: DataFrame, of: list[tuple[int, int, int]], draw: int) -> DataFrame:
    """DRAWN of the runs' rows: each range by a tournament tree over the runs that meet it; ranks end at the draw's size."""
    lows = [-low for _, low, _ in of]  # ascending

    def met(batch: pa.RecordBatch) -> dict:
        out = [(k, run, number) for run, number, high, low in zip(*(batch[c].to_pylist() for c in ("run", "batch", "high", "low")), strict=True) for k in range(bisect_left(lows, -high), min(len(of) - 1, bisect_left(lows, -low)) + 1)]
        return dict(zip(("range", "run", "batch"), map(list, zip(*out, strict=True)), strict=True)) if out else {"range": [], "run": [], "batch": []}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> Iterator[pa.RecordBatch]:
            high, low, above = of[unit]
            rows, rank = [], above
            for row in LoserTree([read(r, sorted(b), high, low) for r, b in of_run.items()], key):
                rank += 1
                rows.append((*row, rank if rank <= draw else None))
                if len(rows) == 10_000:
                    yield table(rows)
                    rows = []
            if rows:
                yield table(rows)

        unit, of_run = None, {}
        for batch in batches:
            for k, name, number in zip(*(batch[c].to_pylist() for c in ("range", "run", "batch")), strict=True):
                if unit != k:
                    if unit is not None:
                        yield from done()
                    unit, of_run = k, {}
                of_run.setdefault(name, []).append(number)
        if unit is not None:
            yield from done()

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [*FIELDS, "rank"])

    each = map_batches(pieces, met, "range int, run string, batch int")
    return each.repartitionById(max(1, len(of)), "range").sortWithinPartitions("range", "run", "batch").mapInArrow(run, DRAWN)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, seed: int = 2024, buckets: int = BUCKETS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_features, weight, score of every document, and its rank if it is among the drawn percent of those with so many words at least."""
    spark = docs.sparkSession
    gain = gains(counted(docs, longest, buckets), counted(target, longest, buckets))
    all_ = materialize(scored(docs, gain, longest, seed), "scored")
    eligible = F.col("n_words") >= least_words
    by_score = sorted(map(tuple, all_.where(eligible).groupBy("score").count().collect()), reverse=True)
    draw = percent * sum(n for _, n in by_score) // 100
    of = ranges(by_score, draw, range_rows)
    if not of:
        return all_.select(*FIELDS, F.lit(None).cast("long").alias("rank"))
    in_reach = eligible & (F.col("score") >= of[-1][1])
    reached = sum(n for score, n in by_score if score >= of[-1][1])
    tasks = max(min(spark.sparkContext.defaultParallelism, -(-reached // BATCH_ROWS)), -(-reached // RUN_ROWS))
    folder = f"{shared_dir(spark)}/sorted-{uuid.uuid4().hex}"
    made = runs(all_.where(in_reach).repartition(tasks), folder)
    drawn = materialize(merged(made, of, draw), "drawn")
    discard(made)
    fs, base = filesystem(folder)
    fs.delete_dir(base)
    return drawn.unionByName(all_.where(~in_reach).select(*FIELDS, F.lit(None).cast("long").alias("rank")))
