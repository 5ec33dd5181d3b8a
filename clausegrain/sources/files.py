"""Files as relations. Schemas are explicit; nothing is inferred from data. Spark's readers pass over files without a byte; found() and contents() don't."""

from __future__ import annotations

import io
import lzma
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clausegrain.functions.text import clean_extracted, is_blank, n_lines, n_words
from clausegrain.sources.json_records import label_counts
from clausegrain.sources.scratch import store
from clausegrain.sources.strict import strict_csv  # noqa: F401  one of the sources
from clausegrain.streaming.resume import shared_dir

SPAN_V1 = "array<struct<clause_id:string,text:string,start_position:int,end_position:int>>"
SPAN_V3 = "array<struct<document_id:string,clause_id:string,text:string,start:int,end:int,segment_type:string,is_suspicious:boolean>>"
SEGMENTED_V1 = f"document_id string, source_file string, total_characters int, num_clauses int, clauses {SPAN_V1}"
SEGMENTED_V3 = f"document_id string, source_file string, total_characters int, num_clauses int, num_legal_clauses int, quality_status string, clauses {SPAN_V3}"


def dealt(df: DataFrame, path: str) -> DataFrame:
    """A table's rows, dealt to all cores if it is a single file: that may be one row group, which one task reads. Tables of many files stay as they are."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    single = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isFile()
    return df.repartition(spark.sparkContext.defaultParallelism) if single else df


def stem() -> Column:
    """A path's file name without its suffix."""
    return F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)


#: Bytes of files that a task reads, bytes and files of a batch.
TASK_BYTES, BATCH_BYTES, BATCH_FILES = 64 << 20, 8 << 20, 1000


def hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder by its name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _root(spark: SparkSession, directory: str) -> str:
    """A folder's path with its scheme."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(f"no file or folder {directory}")
    return fs.makeQualified(at).toString()


def found(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """path, length and modificationTime of each file of a directory, or below it, empty ones too; hidden ones are left out.

    Tasks do the listing, one the directory and then one or more at a time each folder in it, and write it to the shared folder: the driver holds the names of the folders right below the directory,
    a task what lies right in one folder, and nothing holds all files."""
    root, kept = _root(spark, directory), "_folder boolean, path string, length long, modificationTime timestamp"

    def entries(whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fs, base = store(root)
            for batch in batches:
                stack = batch["folder"].to_pylist()
                while stack:
                    at = base + stack.pop()
                    one = fs.get_file_info(at)
                    infos = [one] if one.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(at))
                    for k in range(0, len(infos), 10_000):
                        some = [i for i in infos[k : k + 10_000] if not hidden(i.base_name)]
                        if whole:
                            stack += [i.path[len(base) :] for i in some if i.type == pafs.FileType.Directory]
                            some = [i for i in some if i.type != pafs.FileType.Directory]
                        columns = [i.type == pafs.FileType.Directory for i in some], [root + i.path[len(base) :] for i in some], [i.size or 0 for i in some], [i.mtime for i in some]
                        kinds = pa.bool_(), pa.string(), pa.int64(), pa.timestamp("us", "UTC")
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_folder", "path", "length", "modificationTime"])
                    del infos

        return run

    at = f"{shared_dir(spark)}/listing-{uuid.uuid4().hex}"

    def put(folders: list[str], whole: bool) -> DataFrame:
        rows = spark.createDataFrame(pa.table({"folder": pa.array(folders, pa.string())})).repartition(min(len(folders), 2 * spark.sparkContext.defaultParallelism))
        rows.mapInArrow(entries(whole), kept).write.mode("append").parquet(at)
        return spark.read.schema(kept).parquet(at)

    listed = put([""], False)
    below = [r.path[len(root) :] for r in listed.where("_folder").select("path").collect()] if recursive else []
    return (put(below, True) if below else listed).where("NOT _folder").drop("_folder")


def contents(spark: SparkSession, files: DataFrame, directory: str) -> DataFrame:
    """path and content of files of found() in a directory, as many tasks as their bytes need; a task holds a batch of them."""
    root = _root(spark, directory)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(root)
        paths, bodies, held = [], [], 0
        pack = lambda: pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])
        for batch in batches:
            for path in batch["path"].to_pylist():
                with fs.open_input_stream(base + path[len(root) :], compression=None) as stream:
                    body = stream.read()
                paths.append(path)
                bodies.append(body)
                held += len(body)
                if held >= BATCH_BYTES or len(paths) == BATCH_FILES:
                    yield pack()
                    paths, bodies, held = [], [], 0
        if paths:
            yield pack()

    dealt_ = files.select("path").repartition(max(spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))
    return dealt_.mapInArrow(run, "path string, content binary")


def listing(spark: SparkSession, directory: str, suffix: str, recursive: bool = False) -> DataFrame:
    """path and length of a directory's files of a suffix in any case, sorted; contents aren't read, and each file is looked at once, as the sort reads what was written of them."""
    return found(spark, directory, recursive).where(F.lower("path").endswith(suffix.lower())).orderBy("path")


def _chosen(spark: SparkSession, directory: str, suffixes: tuple[str, ...], recursive: bool) -> DataFrame:
    return found(spark, directory, recursive).where(F.lower(F.regexp_extract("path", r"(\.[^./]*)$", 1)).isin(*(s.lower() for s in suffixes)))


def _decoded(files: DataFrame) -> DataFrame:
    utf8 = F.expr("is_valid_utf8(cast(content AS string))")
    text = F.when(utf8, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    out = files.select(stem().alias("document_id"), text.alias("text"), F.when(~utf8, "decoded as Latin-1").alias("warning"))
    return out.withColumn("warning", F.when(is_blank(F.col("text")), "empty document").otherwise(F.col("warning")))


def texts(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = (".txt",), recursive: bool = False) -> DataFrame:
    """document_id, text, warning of each text file: UTF-8, or Latin-1 with a warning; blank files have a warning too."""
    return _decoded(contents(spark, _chosen(spark, directory, suffixes, recursive), directory))


def annotated(spark: SparkSession, directory: str, suffixes: tuple[str, ...] = (".txt",), recursive: bool = False) -> DataFrame:
    """The blocks of a directory of annotated files; no file of a suffix is an error."""
    from clausegrain.sources.annotated import parse

    chosen = _chosen(spark, directory, suffixes, recursive)
    if chosen.isEmpty():
        raise ValueError(f"no file with {', '.join(suffixes)} in {directory}")
    return parse(_decoded(contents(spark, chosen, directory)).withColumnRenamed("document_id", "doc_id"))


def segmented(spark: SparkSession, directory: str, version: int = 3) -> DataFrame:
    """A row for each segmented document; F.inline('clauses') gives its clauses."""
    return spark.read.schema(SEGMENTED_V1 if version == 1 else SEGMENTED_V3).json(directory, multiLine=True, pathGlobFilter="*.json")


def segmented_checked(spark: SparkSession, directory: str) -> DataFrame:
    """Clauses (document_id, clause_id, clause_text, source) of segmented documents; any breach of identity fails the read."""
    docs = spark.read.schema(SEGMENTED_V3).json(directory, multiLine=True, pathGlobFilter="*.json").withColumn("path", F.col("_metadata.file_path"))
    ids = F.transform("clauses", lambda c: c["clause_id"])
    problem = (
        F.when(~F.col("document_id").eqNullSafe(stem()), "file name isn't the document's id").when(~F.size("clauses").eqNullSafe(F.col("num_clauses")), "num_clauses isn't the number of clauses")
        .when(F.coalesce(F.size("clauses"), F.lit(0)) <= 0, "no clauses").when(F.size(F.array_distinct(ids)) < F.size(ids), "a clause id twice").when(F.exists(ids, lambda i: ~i.startswith(F.concat("document_id", F.lit("_clause_")))), "a clause id of another document")
    )
    checked = docs.where(F.when(problem.isNotNull(), F.raise_error(F.concat("path", F.lit(": "), problem)).cast("boolean")).otherwise(True))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return checked.select("document_id", name.alias("source"), F.inline("clauses").alias("_d", "clause_id", "clause_text", "start", "end", "segment_type", "is_suspicious")).drop("_d")


def lenient_csv(spark: SparkSession, path: str, columns: tuple[str, ...], null_value: str | None = None) -> DataFrame:
    """A CSV file as strings; a missing file is an empty relation, empty fields stay empty texts unless they are the null value."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    try:
        return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False, emptyValue="", nullValue=null_value or "\x00")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], schema)


# Texts that stand for a missing value in inferred CSV files.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def typed_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file in a schema's columns and types; every text that stands for a missing value is null, and what isn't of its type too. A missing file is an empty relation."""
    fields = T.StructType.fromDDL(schema).fields
    rows = lenient_csv(spark, path, tuple(f.name for f in fields))
    return rows.select(*(F.when(~F.col(f.name).isin(*MISSING), F.col(f.name)).try_cast(f.dataType).alias(f.name) for f in fields))


def header(spark: SparkSession, path: str) -> list[str]:
    """The columns of a CSV file, from its first line; no row is read."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


EXPERIMENT = "experiment string, model string, loss string, macro_f1 double, micro_f1 double, weighted_f1 double, minority_f1 double, hamming_loss double, macro_mcc double"


def experiments(spark: SparkSession, pattern: str) -> DataFrame:
    """Experiment logs as JSON files; missing fields are 0 or N/A, broken files are passed over, no file is an empty relation."""
    schema = T.StructType.fromDDL(EXPERIMENT)
    try:
        read = spark.read.schema(schema).json(pattern, multiLine=True, mode="DROPMALFORMED")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e.getCondition() or e):
            raise
        return spark.createDataFrame([], schema)
    return read.na.fill(0.0).na.fill("N/A")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """document_id of each document in a sample manifest."""
    return spark.read.schema("sample_size int, random_seed int, actual_count int, document_ids array<string>, document_files array<string>").json(path, multiLine=True).select(F.explode("document_ids").alias("document_id"))


def fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    """path and SHA-256 of each file below a directory."""
    return contents(spark, found(spark, directory, True), directory).select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.exceptAll(after).unionByName(after.exceptAll(before)).select("path").distinct()


def manifest_digest(files: DataFrame, levels: int = 4) -> DataFrame:
    """One digest of all files (path, sha256), whatever their order and partitions: a tree of digests over the hex digits of the paths' MD5. A leaf holds the files of one of 16^levels
    beginnings (some hundred of ten million), each other node its sixteen children; a path that repeats is one entry with its count."""
    once = files.groupBy("path", "sha256").agg(F.count("*").alias("n"))
    digest = lambda parts: F.sha2(F.array_join(F.array_sort(F.collect_list(parts)), "\n"), 256)
    nodes = once.groupBy(F.substring(F.md5("path"), 1, levels).alias("p")).agg(digest(F.concat_ws("=", "path", "sha256", "n")).alias("d"))
    for level in range(levels - 1, -1, -1):
        nodes = nodes.groupBy(F.substring("p", 1, level).alias("p")).agg(digest(F.concat_ws("=", "p", "d")).alias("d"))
    return nodes.agg(F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("digest"))


def xz_tsv(spark: SparkSession, path: str, columns: int = 6) -> DataFrame:
    """fields (array) and keys (first field split at white space) of each row of XZ-packed TSV files; another number of columns is an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with lzma.open(io.BytesIO(content), "rt", encoding="utf-8", newline="\n") as stream:
                    rows = []
                    for line in stream:
                        fields = line.rstrip("\n").split("\t")
                        if len(fields) != columns:
                            raise ValueError(f"{len(fields)} columns, not {columns}")
                        rows.append({"fields": fields, "keys": fields[0].split()})
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows)
                            rows = []
                    if rows:
                        yield pd.DataFrame(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "fields array<string>, keys array<string>")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """line, key, value of each key=value word of a text file's lines that aren't blank."""
    lines = spark.read.text(path).where(~is_blank(F.col("value"))).select(F.col("value").alias("line"))
    pairs = lines.select("line", F.explode(F.split("line", r"\s+")).alias("pair")).where(F.col("pair").contains("="))
    return pairs.select("line", F.substring_index("pair", "=", 1).alias("key"), F.expr("substring(pair, instr(pair, '=') + 1)").alias("value"))


# Names of fields that hold a label, and of those that identify what is labelled.
LABEL_FIELDS = ("label", "labels", "category", "categories", "class", "classes", "class_labels", "clause_labels", "clause_category", "clause_categories", "category_labels", "label_ids")
IDENTITY_FIELDS = ("clause_id", "document_id", "id", "text", "clause_text")


def label_audit(spark: SparkSession, directory: str) -> DataFrame:
    """path, records, candidates, problem: how many records of each CSV, JSON, JSONL, TSV and text file have an identity and a label."""
    return label_counts(spark, directory, IDENTITY_FIELDS, LABEL_FIELDS)


def pdfs(spark: SparkSession, directory: str, pages_of: Callable[[bytes], list[str]] | None = None, min_characters: int = 50) -> DataFrame:
    """document_id, text, character, word, line and page counts, pages_with_text, status, error of each PDF file.

    pages_of gives the texts of a file's pages; by default it asks pypdf, where that is installed. A page that can't be read is empty,
    a file that can't is failed."""

    def by_library(content: bytes) -> list[str]:
        from pypdf import PdfReader

        def page(p) -> str:
            try:
                return p.extract_text() or ""
            except Exception:  # noqa: BLE001  whatever the library raises, the page is empty
                return ""

        return [page(p) for p in PdfReader(io.BytesIO(content)).pages]

    read = pages_of or by_library

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    out.append((path, read(content), None))
                except Exception as e:  # noqa: BLE001
                    out.append((path, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "pages", "error_message"])

    files = spark.read.format("binaryFile").load(directory).where(F.lower("path").endswith(".pdf")).select("path", "content")
    read_ = files.mapInPandas(run, "path string, pages array<string>, error_message string")
    some = F.filter("pages", lambda p: ~is_blank(p))
    out = read_.select(stem().alias("document_id"), clean_extracted(F.array_join(some, "\n\n")).alias("text"), F.size("pages").alias("page_count"), F.size(some).alias("pages_with_text"), "error_message")
    n = F.length("text")
    status = F.when(F.col("error_message").isNotNull(), "failed").when(n == 0, "empty").when(n < min_characters, "partial").when(F.col("pages_with_text") < F.col("page_count"), "partial").otherwise("success")
    return out.withColumns({"character_count": n, "word_count": n_words(F.col("text")), "line_count": n_lines(F.col("text")), "status": status})


def extraction_counts(extracted: DataFrame) -> DataFrame:
    """One row: documents, and how many came out whole, in part, empty and not at all."""
    return extracted.agg(F.count("*").alias("documents"), *(F.count_if(F.col("status") == s).alias(s) for s in ("success", "partial", "empty", "failed")))


def config(path: str, most_parents: int = 10) -> dict:
    """A YAML configuration, sought from its folder upward; driver-side."""
    from pathlib import Path

    import yaml

    here = Path(path).absolute()
    for folder in [here.parent, *here.parent.parents][: most_parents + 1]:
        if (folder / here.name).is_file():
            return yaml.safe_load((folder / here.name).read_text(encoding="utf-8"))
    raise FileNotFoundError(f"{here.name} in {here.parent} or above")
