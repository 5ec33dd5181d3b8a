"""Tables in the folder that driver and executors share, for what is read more than once: a lost executor costs no recomputation, and nothing stays in executors' storage."""

from __future__ import annotations

import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from clausegrain.streaming.resume import shared_dir


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table of its own under the shared folder, read back."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table of written(), once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all executors reach, and the folder's path in it. A local path is taken as it is, as Spark does, whatever marks it holds."""
    return (pafs.LocalFileSystem(), "/" + folder[5:].lstrip("/")) if folder.startswith("file:") else pafs.FileSystem.from_uri(folder)


def free(columns: list[str], name: str) -> str:
    """name, or name with underscores before it until no column has it, in any case."""
    low = {c.lower() for c in columns}
    while name.lower() in low:
        name = "_" + name
    return name
