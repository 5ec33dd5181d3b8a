"""What is asked of many rows or files is worked out once."""

import os

from pyspark.sql import functions as F, types as T

from clausegrain.operators import artefacts
from clausegrain.sources import files, sinks


def counted(spark, rows, column):
    """rows, whose column passes a function that counts its calls."""
    calls = spark.sparkContext.accumulator(0)

    def seen(x):
        calls.add(1)
        return x

    return rows.withColumn(column, F.udf(seen, T.StringType()).asNondeterministic()(column)), calls


def test_artefacts_work_their_rows_out_once(spark, tmp_path):
    plain = spark.range(200).select(
        F.format_string("c%03d", "id").alias("clause_id"), F.lit("a text").alias("text"), F.array(F.lit("Purpose")).alias("labels"), F.when(F.col("id") % 4 == 0, "DISAGREEMENT").otherwise("HIGH_CONFIDENCE").alias("quality"),
        F.lit(0.9).alias("average_confidence"), F.lit(1.0).alias("agreement_score"),
    )
    rows, calls = counted(spark, plain, "quality")
    at = artefacts.write(rows, str(tmp_path / "out"))
    assert calls.value == 200
    assert spark.read.csv(at["to_verify"], header=True).count() == 50 and spark.read.csv(at["queue"], header=True).count() == 200
    figures = spark.read.csv(at["figures"], header=True).first()
    assert (figures["rows"], figures["agreements"], figures["disagreements"]) == ("200", "150", "50")
    assert "| 200 |" in "\n".join(r[0] for r in spark.read.text(at["report"]).collect())


def test_a_listing_looks_at_its_files_once(spark, tmp_path):
    at = f"file://{tmp_path}/texts"
    rows = spark.range(300).select(F.format_string("%d.txt", "id").alias("name"), F.repeat(F.lit("x"), F.col("id").cast("int") + 1).alias("content")).repartition(7)
    sinks.write_files(rows, at)
    assert sorted(os.listdir(tmp_path / "texts")) == sorted(f"{i}.txt" for i in range(300))  # no hidden folder is left
    found = files.listing(spark, at, ".TXT")
    assert [(r.path.rsplit("/", 1)[1], r.length) for r in found.collect()] == sorted((f"{i}.txt", i + 1) for i in range(300))
    assert "binaryFile" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_seed_batches_need_no_python_by_document(spark):
    """Picks of all sizes of documents are those of taking one after another, without a Python function by group."""
    from clausegrain.operators import selection as S

    wanted, instead = ("short", "medium", "long", "medium", "long"), ("medium", "long", "short")
    lengths = {"short": 10, "medium": 200, "long": 500}
    rows = [(d, f"{d}_{b}_{k}", "x" * lengths[b], "OTHER") for d, sizes in enumerate([(1, 0, 0), (7, 1, 0), (0, 0, 3), (0, 9, 0), (2, 2, 2), (6, 6, 6), (0, 1, 1)]) for b, n in zip(lengths, sizes, strict=True) for k in range(n)]
    table = spark.createDataFrame([*rows, (None, "none", "x", "OTHER")], "doc int, id string, text string, status string")
    got = S.seed_batch(table, "doc", "id", "text", "status")
    assert "InPandas" not in got._jdf.queryExecution().optimizedPlan().toString()
    heaps = {}
    for r in table.where("doc IS NOT NULL").withColumn("h", S.hash_order(F.col("id"))).orderBy("h", "id").collect():
        heaps.setdefault(r.doc, {b: [] for b in lengths})[{v: k for k, v in lengths.items()}[len(r.text)]].append(r.id)
    expected = set()
    for d, of in heaps.items():
        for turn, want in enumerate(wanted):
            bucket = next((b for b in (want, *(i for i in instead if i != want)) if of[b]), None)
            if bucket:
                expected.add((d, of[bucket].pop(0), turn, bucket, f"wanted {want}, took {bucket}"))
    assert {(r.doc, r.id, r.turn, r.length_bucket, r.selection_reason) for r in got.collect()} == expected


def test_composition_reaches_python_with_bounded_texts(spark):
    """Only texts that aren't ASCII go to Python, and the result is what it was."""
    import unicodedata

    from clausegrain.functions.text import nfc

    texts = ["plain", "é ä", "", None, "ẛ̣", "done é"] * 700
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1)
    got = {r.i: r.c for r in rows.select("i", nfc(F.col("t")).alias("c")).collect()}
    assert got == {i: t if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    assert "octet_length" in rows.select(nfc(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()


def test_evidence_is_joined_in_the_sessions_partitions(spark):
    """Small rows aren't put together by their bytes into one task, which would sort all of them for each join."""
    from clausegrain.operators.evidence import resolve

    clauses = spark.range(50).select(F.col("id").cast("string").alias("clause_id"))
    records = clauses.selectExpr("clause_id", *(f"'' AS {c}" for c in ("review_file", "human_action", "human_corrected_text", "reviewed", "ai_suggested_action", "ai_confidence", "review_reason")))
    log = clauses.selectExpr("clause_id", "'SUCCESS' AS status", "'KEEP' AS suggested_action", "'0.9' AS confidence", "'2024' AS timestamp")
    got = resolve(clauses, records, log, clauses.limit(5))
    assert got.count() == 50 and got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_only_ids_are_numbered_in_a_run(spark, tmp_path, monkeypatch):
    from clausegrain.operators import runs

    seen, put = [], runs.numbered
    monkeypatch.setattr(runs, "numbered", lambda rows, *rest: seen.append(rows.columns) or put(rows, *rest))
    queue = spark.createDataFrame([("a", "x"), ("b", "y"), (None, "z")], "clause_id string, text string")
    got = runs.run(queue, f"file://{tmp_path}/log", {"m": lambda texts: [(["Purpose"], 0.9, "SUCCESS", "")] * len(texts)}, batch_rows=1)
    assert seen == [["clause_id", "_order"]] and got.recorded == 2
