"""Relations as files."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausegrain.operators.relations import pending
from clausegrain.sources.scratch import store


#: A CSV field keeps its white space and its quotes.
WHOLE = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_files(rows: DataFrame, folder: str, name: str = "name", content: str = "content", pack: Callable[[bytes], bytes] | None = None, spread: int = 0) -> None:
    """A file for each row in a folder (a URI that all executors reach): its name and its content, a text or bytes, perhaps packed. Names must not repeat. A file
    is written in a hidden folder of its task and moved to its place whole, so tries that fail leave no part of it, and tasks don't wait for one another's folder twice a file.
    spread puts the files into so many folders below that one, by a hash of their names, so that no single folder must hold, and no task list, millions of files."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        own, made = f"{base}/.{uuid.uuid4().hex}", set()
        fs.create_dir(own, recursive=True)
        for batch in batches:
            for of, body in zip(batch[name], batch[content], strict=True):
                beside, final, at = f"{own}/{uuid.uuid4().hex}", of.as_py(), base
                if spread:
                    at = f"{base}/{zlib.crc32(final.encode()) % spread:04x}"
                    if at not in made:
                        fs.create_dir(at, recursive=True)
                        made.add(at)
                with fs.open_output_stream(beside, compression=None) as out:
                    out.write(pack(body.as_py() or b"") if pack else body.as_py() or b"")
                fs.move(beside, f"{at}/{final}")
        fs.delete_dir(own)
        yield from ()

    rows.select(name, F.col(content).cast("binary").alias(content)).mapInArrow(run, "none int").write.format("noop").mode("overwrite").save()


def write_clauses(clauses: DataFrame, path: str, format: str = "json") -> None:  # noqa: A002
    """Labelled clauses as JSON lines, or as CSV with labels joined by commas; an empty relation writes its header."""
    if format == "json":
        clauses.write.mode("overwrite").json(path)
    elif format == "csv":
        clauses.withColumn("labels", F.array_join("labels", ", ")).write.mode("overwrite").options(**WHOLE).csv(path, header=True)
    else:
        raise ValueError(f"unknown format: {format}")


def write_splits(rows: DataFrame, path: str, document: str = "doc_id") -> DataFrame:
    """Rows by split, a folder each; each split's documents, a row each, in split_documents; and a row of counts for each split in split_info."""
    rows.write.mode("overwrite").partitionBy("split").json(f"{path}/rows")
    rows.select("split", document).distinct().write.mode("overwrite").partitionBy("split").json(f"{path}/split_documents")
    sizes = rows.groupBy("split").agg(F.count("*").alias("clauses"), F.count_distinct(document).alias("documents"))
    sizes.coalesce(1).write.mode("overwrite").json(f"{path}/split_info")
    return sizes


def write_documents(clauses: DataFrame, path: str, document: str = "document_id") -> None:
    """A JSON row for each segmented document, its clauses nested in order."""
    rest = [c for c in clauses.columns if c != document]
    nested = clauses.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("start", *(c for c in rest if c != "start")))).alias("clauses"))
    nested.withColumn("num_clauses", F.size("clauses")).write.mode("overwrite").json(path)


def write_texts(extracted: DataFrame, path: str) -> None:
    """Extracted texts but for those that failed or are empty."""
    extracted.where("status NOT IN ('failed', 'empty')").select("document_id", "text").write.mode("overwrite").parquet(path)


def write_statistics(one_row: DataFrame, path: str) -> None:
    """A one-row aggregate as (metric, value) in CSV."""
    long = one_row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in one_row.columns))).alias("r")).select("r.*")
    long.coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_queue(rows: DataFrame, path: str) -> None:
    """A review queue in CSV, nothing of it verified yet."""
    rows.withColumn("human_verified", F.lit("false")).write.mode("overwrite").options(**WHOLE).csv(path, header=True)


def shrink_queue(spark, path: str, done: DataFrame, key: str) -> None:
    """A Parquet queue without the rows whose key is done."""
    restored(spark, path)
    replace_table(pending(spark.read.parquet(path), done, key), path)


def write_frequency(frequency: DataFrame, path: str) -> None:
    """label_frequency() in CSV, the most frequent first, each with its tag."""
    tagged = frequency.select("label", "n", "percent", F.when(F.col("is_majority"), "majority").otherwise("minority").alias("class"))
    tagged.orderBy(F.desc("n"), "label").coalesce(1).write.mode("overwrite").csv(path, header=True)  # as many rows as labels


def write_metadata(one_row: DataFrame, path: str) -> None:
    one_row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def _files(spark, path: str):
    """A path maker and the file system of the path."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return hadoop, hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def restored(spark, path: str) -> None:
    """Puts a table back that a replace_table() which was cut off between its renames had moved aside."""
    hadoop, fs = _files(spark, path)
    if not fs.exists(hadoop(path)):
        left = sorted((s.getModificationTime(), s.getPath().toString()) for s in fs.globStatus(hadoop(f"{path}.old-*")) or [])
        if left:
            fs.rename(hadoop(left[-1][1]), hadoop(path))


def replace_table(rows: DataFrame, path: str) -> None:
    """Writes beside the table, moves the old one aside and puts the new one in its place; rows may be read from the path itself. For the moment
    between the two renames the path is absent; a run cut off there is mended by restored(), which this calls first."""
    spark = rows.sparkSession
    restored(spark, path)
    hadoop, fs = _files(spark, path)
    beside, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    rows.write.parquet(beside)
    had = fs.exists(hadoop(path))
    if had:
        fs.rename(hadoop(path), hadoop(old))
    fs.rename(hadoop(beside), hadoop(path))
    if had:
        fs.delete(hadoop(old), True)


def append_aligned(rows: DataFrame, path: str) -> None:
    """Appends to a Parquet table in its columns: columns it lacks are dropped, columns rows lack are null."""
    spark = rows.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(hadoop(path)):
        schema = spark.read.parquet(path).schema
        rows = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    rows.write.mode("append").parquet(path)


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small table as Markdown."""
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [[cell(x) for x in r] for r in rows.limit(most).collect()]
    return "\n".join("| " + " | ".join(line) + " |" for line in [rows.columns, ["---"] * len(rows.columns), *lines])


def document_text(clauses: DataFrame, document: str = "document_id", order: str = "start", text: str = "text") -> DataFrame:
    """A document's clauses as one text for review, numbered."""
    listed = F.array_sort(F.collect_list(F.struct(order, text)))
    return clauses.groupBy(document).agg(F.array_join(F.transform(listed, lambda c, i: F.format_string("[%d] %s", i + 1, c[text])), "\n\n").alias("text"))
