"""Incremental, resumable processing: an append-only log as a stream, its latest state by key as a table.

Each micro-batch is reduced to its latest row of each key and written as one more folder of a log, under the batch's number, so a batch that is repeated
writes the same folder again. Now and then the log is compacted to a snapshot, which counts once it is whole; so a batch costs what it holds, and a run that
is stopped anywhere goes on where it was. state() reads the newest whole snapshot and the batches after it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Batches between two snapshots.
COMPACT = 16


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="clausegrain-stream-")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest ordinal of each key; an aggregation, so a busy key is combined before it is shuffled."""
    rest = [c for c in rows.columns if c not in (key, order)]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(order, *rest), order).alias("_r"))
    return newest.select(key, "_r.*")


def _numbered(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole folders below a path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(hadoop(f"{path}/*/_SUCCESS")) or []
    return sorted(int(s.getPath().getParent().getName()) for s in found)


def kept(spark: SparkSession, target: str, merge: Callable[[DataFrame], DataFrame], below: int | None = None) -> DataFrame | None:
    """What the batches under target (those below a number) come to by merge, which is given their rows or snapshots' rows; None before the first batch."""
    fits = lambda k: below is None or k < below
    snapshots = [k for k in _numbered(spark, f"{target}/snapshots") if fits(k)][-1:]
    batches = [k for k in _numbered(spark, f"{target}/batches") if fits(k) and (not snapshots or k > snapshots[0])]
    parts = [f"{target}/snapshots/{k}" for k in snapshots] + [f"{target}/batches/{k}" for k in batches]
    return merge(spark.read.parquet(*parts)) if parts else None


def record(rows: DataFrame, number: int, target: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Writes a batch's rows under its number, and now and then a snapshot of all so far; older batches and snapshots go."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{target}/batches/{number}")
    if number % COMPACT == COMPACT - 1:
        kept(spark, target, merge).write.mode("overwrite").parquet(f"{target}/snapshots/{number}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for folder, least in (("batches", number + 1), ("snapshots", number)):
            for k in _numbered(spark, f"{target}/{folder}"):
                if k < least:
                    fs.delete(hadoop(f"{target}/{folder}/{k}"), True)


def state(spark: SparkSession, target: str, key: str, order: str) -> DataFrame | None:
    """The latest row of each key that upsert_stream() has kept under target; None before its first batch."""
    return kept(spark, target, lambda rows: latest(rows, key, order))


def upsert_stream(stream: DataFrame, target: str, checkpoint: str, key: str, order: str):
    """Keeps what state() reads under target at the latest row of each key of a stream; runs over what is there, and then ends."""
    merge = lambda rows: latest(rows, key, order)
    apply = lambda batch, number: record(merge(batch), number, target, merge)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_of(spark: SparkSession, table: str) -> DataFrame:
    """A Parquet table, a folder or a single file, as a stream, file by file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    reader = spark.readStream.schema(spark.read.parquet(table).schema).option("maxFilesPerTrigger", 1)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        table, name = table.rsplit("/", 1)  # a stream reads folders
        reader = reader.option("pathGlobFilter", name)
    return reader.parquet(table)


def latest_by_user(spark: SparkSession, events: str, folder: str | None = None) -> DataFrame:
    """The events table as a stream: each user's latest event (user_id, event_id, event_type, value)."""
    folder = folder or f"{shared_dir(spark)}/resume-{uuid.uuid4().hex}"
    columns = ["user_id", "event_id", "event_type", "value"]
    upsert_stream(stream_of(spark, events).select(*columns), f"{folder}/state", f"{folder}/checkpoint", "user_id", "event_id").awaitTermination()
    found = state(spark, f"{folder}/state", "user_id", "event_id")
    return found.select(*columns) if found is not None else spark.read.parquet(events).select(*columns).limit(0)


def remaining(queue: DataFrame, log: DataFrame, key: str, ok: str = "status = 'SUCCESS'") -> DataFrame:
    """What is left to do: rows of the queue without a success in the log."""
    return queue.join(log.where(ok).select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def distinct_stream(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """The first row of each key of a stream, with state kept for as long as late rows are waited for."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
