"""Counters of a stream of decisions by reviewer, late ones too.

A micro-batch is reduced to one row of sums for each reviewer (tasks sum before they shuffle, so a busy reviewer costs no more than another) and kept under its number; the counters are the
sums over all batches, so a late decision counts like any other, in whatever batch it comes, and a batch that is repeated counts once. It is late if its time lies
more than a delay before the newest of the batches before its own; late ones are counted apart too, as figures that were given out have changed by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausegrain.streaming.resume import kept, record, stream_of


def _sums(n_of: Column, rows: DataFrame, key: str, counts: list[str]) -> DataFrame:
    return rows.groupBy(key).agg(n_of.alias("reviewed"), *(F.sum(c).alias(c) for c in [*counts, "late"]), F.min("first_time").alias("first_time"), F.max("newest").alias("newest"))


def merged(rows: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Sums of sums."""
    return _sums(F.sum("reviewed"), rows, key, counts)


def reduced(batch: DataFrame, key: str, time: str, order: str, action: str, actions: dict[str, str], newest=None, delay: str = "1 day") -> DataFrame:
    """One row of sums for each reviewer of a batch: actions names the counter of each action; newest is the greatest time of the batches before."""
    late = F.lit(0) if newest is None else (F.col(time) < F.lit(newest) - F.expr(f"INTERVAL {delay}")).cast("long")
    each = batch.select(
        key, *(F.coalesce((F.col(action) == a).cast("long"), F.lit(0)).alias(c) for a, c in actions.items()), F.coalesce(late, F.lit(0)).cast("long").alias("late"),
        F.col(time).alias("first_time"), F.struct(F.col(time).alias("time"), F.col(order).alias("order"), F.col(action).alias("action")).alias("newest"),
    )
    return _sums(F.count("*"), each, key, list(actions.values()))


def count_stream(stream: DataFrame, target: str, checkpoint: str, key: str, time: str, order: str, action: str, actions: dict[str, str], delay: str = "1 day"):
    """Keeps what counters() reads under target; runs over what is there, and then ends."""
    merge = lambda rows: merged(rows, key, list(actions.values()))

    def apply(batch: DataFrame, number: int) -> None:
        before = kept(batch.sparkSession, target, merge, below=number)
        newest = before.agg(F.max("newest.time")).first()[0] if before is not None else None
        record(reduced(batch, key, time, order, action, actions, newest, delay), number, target, merge)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(spark: SparkSession, target: str, key: str, actions: dict[str, str], totals: DataFrame | None = None) -> DataFrame | None:
    """By reviewer: reviewed, a counter for each action, late, first_time, last_time, last_action; with totals (key, total) also unreviewed, at least 0, and a row for each reviewer of totals."""
    found = kept(spark, target, lambda rows: merged(rows, key, list(actions.values())))
    if found is None:
        return None
    rows = found.select(key, "reviewed", *actions.values(), "late", "first_time", F.col("newest.time").alias("last_time"), F.col("newest.action").alias("last_action"))
    if totals is None:
        return rows
    both = totals.select(key, "total").join(rows, key, "left").na.fill(0, ["reviewed", *actions.values(), "late"])
    return both.withColumn("unreviewed", F.greatest(F.lit(0), F.col("total") - F.col("reviewed"))).drop("total")


def of_events(spark: SparkSession, events: str, folder: str) -> DataFrame:
    """The events table as a stream of decisions: clicks accept, errors override, views are manual; what a user has left of their purchases and signups is unreviewed."""
    actions = {"click": "accepted", "error": "overridden", "view": "manual"}
    decisions = stream_of(spark, events).where(F.col("event_type").isin(*actions))
    count_stream(decisions.select("user_id", "ts", "event_id", "event_type"), f"{folder}/state", f"{folder}/checkpoint", "user_id", "ts", "event_id", "event_type", actions).awaitTermination()
    totals = spark.read.parquet(events).groupBy("user_id").agg((2 * F.count_if(~F.col("event_type").isin(*actions))).alias("total"))
    found = counters(spark, f"{folder}/state", "user_id", actions, totals)
    return found.drop("late") if found is not None else totals.limit(0)
