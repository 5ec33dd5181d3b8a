"""Quality rules: fixed base rules, then thresholds that adapt to each language and source.

Each text gives three ratios that are never zero: marks (ASCII marks a character), mean word length and mean line length in words.
Their distributions are kept as quantile sketches: counts by logarithmic bucket, so two sketches merge by adding
counts, the result doesn't depend on the order or partitioning, and every quantile is within ACCURACY of its value.
Sketches of a language and source merge to one for the language and one for all. The quartiles of a group are drawn towards
its parent's as if the parent had lent it PRIOR texts, by one rule for groups of any size; Tukey's fences around them, on
the logarithmic scale, are the limits. No limit is fixed. A text fails if its ratio is beyond the limit by more than CHANCE
standard errors, as a few words tell little. Limits then filter the rows they are joined with.

Defined results: null and empty texts have no words and fail the base; a null language or source is a group of
its own; repeated rows are counted and judged as often as they come; an empty table gives no rows; further columns of
any name stay as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausegrain.llm.common import as_bytes, free, map_batches, materialize

SYMBOLS = b"#*$%&|<>"
#: White space and UTF-8 continuation bytes: what is left has a byte for each code point of the words.
NOT_COUNTED = b" \t\n\v\f\r" + bytes(range(0x80, 0xC0))
#: ASCII characters that are neither letters, digits nor white space.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
WINDOW = 5
ACCURACY = 0.01
GAMMA = (1 + ACCURACY) / (1 - ACCURACY)
#: How many texts a parent's quartiles count as in a group's.
PRIOR = 100
#: Tukey's "far out" fence: so many times the quartiles' distance beyond them.
FENCE = 3.0
#: Standard errors that a text's ratio may lie beyond a limit.
CHANCE = 2.0
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")
METRICS = ("marks", "word_length", "line_length")
LIMITS = ("max_marks", "min_word_length", "max_word_length", "min_line_length")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows that occur twice or more in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    bits = max(1, (len(known) - 1).bit_length())
    key, width = ids[:n].copy(), bits
    for k in range(1, window):
        if width + bits > 63:  # number the beginnings anew, so that keys stay exact
            key = np.unique(key, return_inverse=True)[1]
            width = max(1, int(key.max()).bit_length())
        key = (key << bits) | ids[k : n + k]
        width += bits
    order = np.sort(key)
    if not (order[1:] == order[:-1]).any():
        return 0
    _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
    edge = np.zeros(len(words) + 1, np.int64)
    again = np.flatnonzero(counts[inverse] > 1)
    edge[again] += 1
    edge[again + window] -= 1
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: bytes) -> tuple[int, ...]:
    """COUNTS of a text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(words), len(text.translate(None, NOT_COUNTED)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), len(text) - len(text.translate(None, MARKS))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of each row of docs."""

    def run(batch: pa.RecordBatch) -> dict:
        made = np.array([measure(x) for x in as_bytes(batch.column("text"))], np.int64)
        return {c: batch.column(c) for c in ("doc_id", "lang", "source")} | {c: made[:, k] for k, c in enumerate(COUNTS)}

    return map_batches(docs.select("doc_id", "lang", "source", "text"), run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def ratios() -> list[Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return [((F.col("n_marks") + 1) / (F.col("word_chars") + 20)).alias("marks"), (F.col("word_chars") / words).alias("word_length"), (words / lines).alias("line_length")]


def sketches(counted: DataFrame) -> DataFrame:
    """lang, source, level (0: language and source, 1: language, 2: all), metric, bucket, n: mergeable by adding n."""
    bucket = F.ceil(F.log("value") / math.log(GAMMA)).cast("int")
    long = counted.where("n_words > 0").select("lang", "source", *ratios()).unpivot(["lang", "source"], list(METRICS), "metric", "value")
    finest = long.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    none = F.lit(None).cast("string")
    merged = lambda *keys: finest.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    by_lang = merged("lang").select("lang", none.alias("source"), F.lit(1).alias("level"), "metric", "bucket", "n")
    of_all = merged().select(none.alias("lang"), none.alias("source"), F.lit(2).alias("level"), "metric", "bucket", "n")
    return finest.select("lang", "source", F.lit(0).alias("level"), "metric", "bucket", "n").unionByName(by_lang).unionByName(of_all)


def quartiles(sketched: DataFrame) -> DataFrame:
    """lang, source, level, n and <metric>_q1, _q2, _q3 from sketches."""
    group = W.partitionBy("lang", "source", "level", "metric")
    run = sketched.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("total", F.sum("n").over(group))
    value = 2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1)
    at = lambda metric, k: F.min(F.when((F.col("metric") == metric) & (4 * F.col("upto") >= k * F.col("total")), value)).alias(f"{metric}_q{k}")
    return run.groupBy("lang", "source", "level").agg(F.max("total").alias("n"), *(at(m, k) for m in METRICS for k in (1, 2, 3)))


def limits(counted: DataFrame) -> DataFrame:
    """lang, source and LIMITS for the texts of each group."""
    q = materialize(quartiles(sketches(counted)), "quartiles")
    names = [f"{m}_q{k}" for m in METRICS for k in (1, 3)]
    drawn = lambda c, parent: (F.col("n") * F.log(c) + PRIOR * F.col(parent)) / (F.col("n") + PRIOR)
    every = q.where("level = 2").select(*(F.log(c).alias(f"all_{c}") for c in names))  # one row
    lang = q.where("level = 1").crossJoin(F.broadcast(every)).select(F.col("lang").alias("l"), *(drawn(c, f"all_{c}").alias(f"lang_{c}") for c in names))
    own = q.where("level = 0").join(lang, F.col("lang").eqNullSafe(F.col("l"))).select("lang", "source", *(drawn(c, f"lang_{c}").alias(c) for c in names))
    low = lambda m: F.exp(F.col(f"{m}_q1") - FENCE * (F.col(f"{m}_q3") - F.col(f"{m}_q1")))
    high = lambda m: F.exp(F.col(f"{m}_q3") + FENCE * (F.col(f"{m}_q3") - F.col(f"{m}_q1")))
    return own.select("lang", "source", high("marks").alias("max_marks"), low("word_length").alias("min_word_length"), high("word_length").alias("max_word_length"), low("line_length").alias("min_line_length"))


def within() -> Column:
    """Whether COUNTS of a text keep LIMITS."""
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    marks = F.greatest(F.col("n_marks") - CHANCE * F.sqrt("n_marks"), F.lit(0.0)) + 1
    length, by_word, by_line = F.col("word_chars") / words, CHANCE / F.sqrt(words), CHANCE / F.sqrt(lines)
    return (
        (marks / (F.col("word_chars") + 20) <= F.col("max_marks")) & (length * (1 + by_word) >= F.col("min_word_length"))
        & (length * (1 - by_word) <= F.col("max_word_length")) & (words / lines * (1 + by_line) >= F.col("min_line_length"))
    )


def _with_limits(rows: DataFrame, found: DataFrame) -> DataFrame:
    lang, source = free(rows.columns + found.columns, "limit_lang"), free(rows.columns + found.columns, "limit_source")
    named = found.withColumnsRenamed({"lang": lang, "source": source})
    return rows.join(named, F.col("lang").eqNullSafe(F.col(lang)) & F.col("source").eqNullSafe(F.col(source)), "left").drop(lang, source)


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, COUNTS, base_failed and kept for each row of docs (doc_id, text, lang, source)."""
    counted = materialize(counts(docs), "counts")
    ok = F.coalesce(within(), F.lit(True))  # texts without words have no group, and fail the base
    return _with_limits(counted, limits(counted)).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ok).select("doc_id", "lang", "source", *COUNTS, "base_failed", "kept")


def filtered(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, in all their columns. Limits come from one pass over the texts, decisions from a second one, so no text is shuffled for its verdict."""
    found = materialize(limits(materialize(counts(docs), "counts")), "limits")
    names = docs.columns
    own = {c: free(names, c) for c in LIMITS}
    rows = _with_limits(docs, found.withColumnsRenamed(own))

    def run(batch: pa.RecordBatch) -> dict:
        high_marks, low_word, high_word, low_line = (batch.column(own[c]).to_numpy(zero_copy_only=False).astype(float) for c in LIMITS)
        n, chars, _, _, repeat, lines, marks = np.array([measure(x) for x in as_bytes(batch.column("text"))], np.float64).reshape(-1, len(COUNTS)).T
        out = (n < 10) | (100 * repeat > 20 * n)
        words, lines = np.maximum(n, 1), np.maximum(lines, 1)
        by_word, by_line = CHANCE / np.sqrt(words), CHANCE / np.sqrt(lines)
        marks = (np.maximum(marks - CHANCE * np.sqrt(marks), 0) + 1) / (chars + 20)
        with np.errstate(invalid="ignore"):
            for bad in (marks > high_marks, chars / words * (1 + by_word) < low_word, chars / words * (1 - by_word) > high_word, words / lines * (1 + by_line) < low_line):
                out |= bad
        kept = batch.filter(pa.array(~out))
        return {c: kept.column(c) for c in names}

    return map_batches(rows, run, docs.schema)
