"""What the operators of this folder share: Arrow batches, tables in the shared folder, small helpers."""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clausegrain.sources.files import dealt

#: The words of most contracts: runs without ASCII white space. bytes.split() splits at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset and the master is local (tests)."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    known = context._jsc.sc().getCheckpointDir()
    if not known.isDefined():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="clausegrain-"))
        known = context._jsc.sc().getCheckpointDir()
    return known.get().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet under the shared folder and read back: a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialize() wrote, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 2000, most: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut into slices of so many rows and about so many bytes at most, so that a task holds little beside the batch it was given."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        del batch  # the next one is read without this one beside it


class Shared:
    """A broadcast of an object of this package's classes, which travel with it by value; value is made once a task and dropped by drop()."""

    def __init__(self, spark: SparkSession, value):
        self.sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self.sent.__dict__.pop("_value", None)

    def __getstate__(self) -> dict:
        return {"sent": self.sent}

    @property
    def value(self):
        if "made" not in self.__dict__:
            self.made = pickle.loads(self.sent.value)
            self.sent.__dict__.pop("_value", None)
        return self.made

    def drop(self) -> None:
        self.__dict__.pop("made", None)


def kept_in_worker(name: str, owner: str, make: Callable):
    """What make() gives, kept in a Python worker's life (a task's own copy of this package ends with the task) until another name or owner asks: one at a time."""
    held = sys.modules.setdefault("clausegrain_worker_state", types.ModuleType("clausegrain_worker_state")).__dict__
    if held.get("kept", ("", ""))[:2] != (name, owner):
        held.pop("kept", None)
        held["kept"] = (name, owner, make())
    return held["kept"][2]


def free(taken: list[str], name: str) -> str:
    """name, or name with underscores before it until no column that is taken has it (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name = "_" + name
    return name


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 of each text, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], dict | None], schema: str | T.StructType, rows: int = 2000, most: int = 32 << 20) -> DataFrame:
    """mapInArrow by a function from a batch of so many rows and about so many bytes at most to a dict of columns; empty batches are skipped."""
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    out = to_arrow_schema(struct)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, rows, most):
            if (cols := fn(batch)) is not None:
                arrays = [pa.array(cols[f.name], type=f.type) for f in out]
                made = pa.RecordBatch.from_arrays(arrays, schema=out)
                for at in range(0, made.num_rows, 20_000):
                    yield made.slice(at, 20_000)
                del arrays, made, cols
            del batch
        pa.default_memory_pool().release_unused()  # workers live on

    return df.mapInArrow(run, struct)


def join_hot(rows: DataFrame, known: DataFrame, key: str, how: str = "inner", share: int = 10_000) -> DataFrame:
    """rows joined with known, which has each key once at most. Keys of more than one in `share` rows, of which there are fewer than
    share, are joined by a broadcast, so that no task gets all rows of such a key; null keys match nothing."""
    counts = materialize(rows.groupBy(key).agg(F.count("*").alias("n")), "key_counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where((F.col("n") > max(1, total // share)) & F.col(key).isNotNull()).select(key)
    hot = materialize(often.join(known, key, how), "hot_keys")
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(known.join(F.broadcast(hot.select(key)), key, "left_anti"), key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return dealt(rows, f"{sf_dir}/{name}.parquet") if name in ("documents", "pages", "conversations") else rows
