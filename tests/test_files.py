"""Files that Spark's readers pass over, folders of folders, and queries over documents without a character."""

import os
import time

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from clausegrain.sources import files, sinks
from clausegrain.sources.annotated import parse

TEXTS = ["", "one", None, " \n", "\u00e9 a", "\u00e9 a\u2028", "\u00ff \u2029", "\u00e9\n", "\ufeffa \u00e9", "a\x00b"]


@pytest.mark.parametrize("name", ["file_listing", "files_digest", "text_files"])
def test_documents_without_a_character_are_files_too(spark, tmp_path, name):
    at = str(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array(range(len(TEXTS)), pa.int64()), "text": pa.array(TEXTS, pa.string())}), at)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{at}'")
    sql = con.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, str(tmp_path)).select(*sql.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(sql.fetchall(), key=repr)


def test_found_files_are_all_that_spark_shows_and_empty_ones(spark, tmp_path):
    at = tmp_path / "a b%20c"
    for f, body in (("a.txt", "a"), ("empty.TXT", ""), ("_hidden.txt", "x"), (".hidden.txt", "x"), ("x._COPYING_", "x"), ("in/b.txt", "bc"), ("in/deep/c.txt", ""), ("_in/d.txt", "x"), ("k=1/e.txt", "e")):
        (at / f).parent.mkdir(parents=True, exist_ok=True)
        (at / f).write_text(body)
    root = "file:" + str(at)
    assert [(r.path, r.length) for r in files.listing(spark, str(at), ".txt").collect()] == [(f"{root}/a.txt", 1), (f"{root}/empty.TXT", 0)]
    assert [(r.path[len(root) + 1 :], r.length) for r in files.listing(spark, root, ".txt", True).collect()] == [("a.txt", 1), ("empty.TXT", 0), ("in/b.txt", 2), ("in/deep/c.txt", 0), ("k=1/e.txt", 1)]
    shown = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(at)).select("path", "length", "modificationTime")
    own = files.found(spark, str(at), True)
    assert {tuple(r) for r in own.where("length > 0").selectExpr("path", "length", "date_trunc('millisecond', modificationTime)").collect()} == {tuple(r) for r in shown.collect()}
    assert {(r.document_id, r.text, r.warning) for r in files.texts(spark, str(at)).collect()} == {("a", "a", None), ("empty", "", "empty document")}
    assert files.fingerprints(spark, str(at)).count() == 5
    assert [r.path for r in files.found(spark, str(at / "in" / "b.txt")).collect()] == [f"{root}/in/b.txt"] and files.texts(spark, str(at / "in" / "b.txt")).first().text == "bc"
    with pytest.raises(FileNotFoundError):
        files.texts(spark, str(at / "none"))
    (at / "nothing").mkdir()
    assert files.texts(spark, str(at / "nothing")).count() == 0 == files.listing(spark, str(at / "nothing"), ".txt").count()


def test_files_are_dealt_to_folders(spark, tmp_path):
    at = f"file://{tmp_path}/texts"
    rows = spark.range(300).selectExpr("concat(id, '.txt') AS name", "repeat('x', id) AS content").repartition(5)
    sinks.write_files(rows, at, spread=8)
    assert sorted(os.listdir(tmp_path / "texts")) == [f"{k:04x}" for k in range(8)]
    assert {(r.path.rsplit("/", 1)[1], r.length) for r in files.listing(spark, at, ".txt", True).collect()} == {(f"{i}.txt", i) for i in range(300)}
    assert {(r.document_id, r.text) for r in files.texts(spark, at, recursive=True).collect()} == {(str(i), "x" * i) for i in range(300)}


def test_a_folder_of_annotated_files_is_read_in_few_tasks_and_listed_by_tasks(spark, tmp_path):
    at = f"file://{tmp_path}/annotated"
    body = "concat('[INIT_CLAUSE]', id, '[INIT_CLASSE]Purpose[END_CLASSE][END_CLAUSE]\\n[INIT_CLAUSE]no tag[END_CLAUSE]')"
    rows = spark.range(300).selectExpr("concat(id, '.txt') AS name", f"CASE WHEN id % 100 = 0 THEN ' ' WHEN id % 100 = 1 THEN '' ELSE {body} END AS content").repartition(5)
    sinks.write_files(rows, at, spread=8)
    got = files.annotated(spark, at, recursive=True)
    own = spark.sparkContext.defaultParallelism
    assert len(got.inputFiles()) <= 1 + 2 * own and got.rdd.getNumPartitions() <= own  # neither has to do with the number of files
    want = {(str(i), 0, None, "empty document") for i in range(300) if i % 100 < 2} | {(str(i), k, str(i) if k == 0 else None, "no class tag" if k else None) for i in range(300) if i % 100 > 1 for k in (0, 1)}
    assert {(r.doc_id, r.clause_index or 0, r.text, r.warning) for r in got.collect()} == want


def test_a_document_is_not_looked_at_again_for_each_block(spark):
    """A long document of many blocks takes time by its length, not by its length times its blocks."""
    block = "[INIT_CLAUSE]a  b c  d[INIT_CLASSE]Purpose[END_CLASSE][END_CLAUSE]\n"
    docs = spark.createDataFrame([(1, block * 3000), (2, " \n"), (3, "none"), (4, None)], "doc_id int, text string").coalesce(1)
    began = time.perf_counter()
    got = parse(docs).groupBy("doc_id", "warning").count().collect()
    assert {tuple(r) for r in got} == {(1, None, 3000), (2, "empty document", 1), (3, "no clause blocks", 1), (4, "empty document", 1)}
    assert time.perf_counter() - began < 30
