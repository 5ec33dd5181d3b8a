"""A run of several scorers over a queue that can stop anywhere and go on.

The queue's rows that the log has no success of are numbered in order and scored in micro-batches, each by all tasks. A batch's results are looked at in the order of the
queue before any of them counts: the first row that is the fifth failure in a row (those at the end of the batch before count too), or
that meets a spent quota, ends the run, and rows behind it aren't recorded, whatever partitions they were scored in. What counts goes to the log as one whole
folder under the batch's number, so a run that is cut off loses one batch at most. A dead service is asked for one batch, of which each task gives up after a few failures.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from clausegrain.functions.text import is_daily_quota
from clausegrain.operators.ensemble import Scorer, combine, score_with
from clausegrain.operators.relations import numbered, pending
from clausegrain.sources.scratch import dropped, written
from clausegrain.streaming.resume import _numbered, latest

# What a clause counts as that too few models answered.
FAILED = ("API_ERROR", "API_QUOTA_EXHAUSTED")


@dataclass(frozen=True)
class Outcome:
    """Rows recorded by the run, those of them that succeeded, why it ended (failures, quota, limit, done), and rows of the queue still without a success."""

    recorded: int
    succeeded: int
    ended: str
    remaining: int


def results(spark: SparkSession, log: str, clause: str = "clause_id") -> DataFrame | None:
    """The newest result of each clause in a log, with the batch that gave it; None before the first batch."""
    found = _numbered(spark, log)
    return latest(spark.read.parquet(*(f"{log}/{k}" for k in found)), clause, "batch") if found else None


def succeeded(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("quality").isin(*FAILED))


def _left(queue: DataFrame, log: str, clause: str) -> DataFrame:
    done = results(queue.sparkSession, log, clause)
    return pending(queue, succeeded(done), clause) if done is not None else queue


def _scored(batch: DataFrame, scorers: dict[str, Scorer], clause: str, text: str, options: dict) -> DataFrame:
    votes = None
    for model, scorer in scorers.items():
        own = score_with(batch, model, scorer, clause, text, **options)
        votes = own if votes is None else votes.unionByName(own)
    spent = (F.col("status") == "API_ERROR") & is_daily_quota(F.col("reason"))
    return combine(votes.withColumn("status", F.when(spent, "API_QUOTA_EXHAUSTED").otherwise(F.col("status"))), clause, least=min(2, len(scorers)))


def run(queue: DataFrame, log: str, scorers: dict[str, Scorer], clause: str = "clause_id", text: str = "text", order: str | None = None, batch_rows: int = 10_000, most_failures: int = 5, limit: int | None = None, **options) -> Outcome:
    """Scores what the log has no success of, in the order of a column (by default the id), and records combine()'s rows with their batch. limit: rows to record at most.
    An id that the queue repeats is scored once; options go to score_with()."""
    spark, order = queue.sparkSession, order or clause
    once = _left(queue, log, clause).groupBy(clause).agg(F.min(order).alias("_order"), F.min(text).alias("_text")).where(F.col(clause).isNotNull())
    # Only ids are numbered, and the texts, which lie by id already, meet their ranks there; sorted, so that a batch's rows are found by the files' own ranges.
    ranks = numbered(once.select(clause, "_order"), None, "_order", clause).select(clause, "_rank")
    todo = written(once.select(clause, F.col("_text").alias(text)).join(ranks, clause).sortWithinPartitions("_rank"), "todo")
    total, tasks = todo.count(), spark.sparkContext.defaultParallelism
    number, at, failing, recorded, good, ended = max(_numbered(spark, log), default=-1) + 1, 0, 0, 0, 0, "done"
    while at < total and ended == "done":
        upto = min(total, at + batch_rows, *([] if limit is None else [limit]))
        if upto == at:
            ended = "limit"
            break
        batch = todo.where((F.col("_rank") >= at) & (F.col("_rank") < upto))
        scored = _scored(batch.repartition(tasks), scorers, clause, text, {"most_failed_batches": most_failures} | options)
        held = written(scored.join(batch.select(clause, "_rank"), clause), "scored")
        failed, spent = F.col("quality").isin(*FAILED), F.col("quality") == "API_QUOTA_EXHAUSTED"
        before = F.max(F.when(~failed, F.col("_rank"))).over(W.orderBy("_rank"))  # over one batch, whose size is a parameter
        row = held.select("_rank", failed.alias("failed"), spent.alias("spent"), (F.col("_rank") - F.coalesce(before, F.lit(at - 1 - failing))).alias("in_a_row"))
        stop, quota, last = row.agg(F.min(F.when(F.col("in_a_row") >= most_failures, F.col("_rank"))), F.min(F.when(F.col("spent"), F.col("_rank"))), F.max_by("in_a_row", "_rank")).first()
        end = min([x for x in (stop, quota) if x is not None], default=upto - 1)
        if end == quota:
            ended = "quota"
        elif end == stop:
            ended = "failures"
        counted = held.where(F.col("_rank") <= end).drop("_rank").withColumn("batch", F.lit(number).cast("long"))
        counted.write.mode("overwrite").parquet(f"{log}/{number}")
        good += succeeded(spark.read.parquet(f"{log}/{number}")).count()
        recorded, failing, number, at = recorded + end + 1 - at, last, number + 1, upto
        dropped(held)
    dropped(todo)
    return Outcome(recorded, good, ended, _left(queue, log, clause).select(clause).distinct().count())
