"""Tables of versions: each write is a folder of its own, and a small file that is put in place last makes it the table.

    path/data/<name>         a Parquet folder for each version
    path/_versions/<number>  names the folder of a version; never changed once it is there

A reader takes the greatest number, so it finds a whole table at every moment, and keeps its version however many follow. A writer says which version it read;
its own gets the next number by a rename that fails where that number is taken, so of two writers from the same version one gets a Conflict, and update() begins anew from
what the other wrote. A write that is cut off leaves a folder that no version names; vacuum() clears these and old versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from clausegrain.operators import relations


class Conflict(Exception):
    """Another writer has made the next version."""


def _hadoop(spark: SparkSession, path: str):
    """The path maker, the path's file system, and its context, whose renames can refuse to replace."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    maker = jvm.org.apache.hadoop.fs.Path
    fs = maker(path).getFileSystem(conf)
    return maker, fs, jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)


def versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a table's versions, the oldest first."""
    maker, fs, _ = _hadoop(spark, path)
    found = fs.globStatus(maker(f"{path}/_versions/*")) or []
    return sorted(int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit())


def current(spark: SparkSession, path: str) -> int:
    """The number of the newest version; 0 if there is none."""
    return max(versions(spark, path), default=0)


def _folder(spark: SparkSession, path: str, version: int) -> str:
    maker, fs, _ = _hadoop(spark, path)
    stream = fs.open(maker(f"{path}/_versions/{version:020d}"))
    try:
        return f"{path}/data/{stream.readUTF()}"
    finally:
        stream.close()


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of a version, by default the newest."""
    version = current(spark, path) if version is None else version
    if not version:
        raise FileNotFoundError(f"{path} has no version")
    return spark.read.parquet(_folder(spark, path, version))


def write(rows: DataFrame, path: str, expected: int | None = None) -> int:
    """Makes rows, which may be read from the table itself, its next version, and gives its number. Conflict, if the newest one isn't the expected one (by
    default that of the moment before the rows are written)."""
    spark = rows.sparkSession
    maker, fs, context = _hadoop(spark, path)
    expected = current(spark, path) if expected is None else expected
    name = f"{expected + 1}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/data/{name}")
    beside = maker(f"{path}/_versions/.{name}")
    out = fs.create(beside)
    out.writeUTF(name)
    out.close()
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        if current(spark, path) != expected:
            raise Conflict(f"{path}: version {expected} isn't the newest any more")
        context.rename(beside, maker(f"{path}/_versions/{expected + 1:020d}"), options)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        raise Conflict(f"{path}: version {expected + 1} is there already") from None
    finally:
        if fs.exists(beside):  # it lost
            fs.delete(beside, False)
            fs.delete(maker(f"{path}/data/{name}"), True)
    return expected + 1


def update(spark: SparkSession, path: str, change: Callable[[DataFrame | None], DataFrame], attempts: int = 10) -> int:
    """Makes change(the newest version, or None) the next version; where another writer is faster, does it again from that one's."""
    for attempt in range(attempts):
        at = current(spark, path)
        try:
            return write(change(read(spark, path, at) if at else None), path, at)
        except Conflict:
            if attempt == attempts - 1:
                raise
    raise ValueError("attempts must be positive")


def upsert(rows: DataFrame, path: str, key: str, keep: tuple[str, ...] = ()) -> int:
    """Rows take the place of those of their key; columns in keep stay as they were."""
    return update(rows.sparkSession, path, lambda old: rows if old is None else relations.upsert(old, rows, key, keep))


def shrink(done: DataFrame, path: str, key: str) -> int:
    """A queue without the rows whose key is done."""
    return update(done.sparkSession, path, lambda old: relations.pending(old, done, key) if old is not None else done.limit(0))


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the newest `keep` versions, and folders that no version names. Not while a write is under way."""
    maker, fs, _ = _hadoop(spark, path)
    known = versions(spark, path)
    held = {_folder(spark, path, v).rsplit("/", 1)[1] for v in known[-keep:]}
    for v in known[:-keep]:
        fs.delete(maker(f"{path}/_versions/{v:020d}"), False)
    for s in fs.globStatus(maker(f"{path}/data/*")) or []:
        if s.getPath().getName() not in held:
            fs.delete(s.getPath(), True)
