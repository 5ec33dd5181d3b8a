"""Functions, sources and operators on small tables."""

import json
import lzma
import os

import pytest
from pyspark.sql import functions as F

from clausegrain.functions import labels as L, text as X
from clausegrain.operators import ensemble, metrics, quality, relations, selection, splits, stats
from clausegrain.operators import segment as S
from clausegrain.sources import annotated, files, sinks
from clausegrain.streaming import resume


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("raw", "clean", "extracted"), [
    ("a\t b  c", "a b c", "a b c"), ("  a \n   b  \n\n\n\n c ", "a\nb\n\nc", "a\n b\n\n c"), ("é\x00\x07x", "éx", "éx"), ("", "", ""), (None, None, None), (" a", "a", "a"),
])
def test_cleaning(spark, raw, clean, extracted):
    assert one(spark, raw, X.clean_clause) == clean
    assert one(spark, raw, X.clean_extracted) == extracted


def test_text_helpers(spark):
    assert one(spark, "a_clause_009", lambda c: X.neighbour_id(c, 1)) == "a_clause_010"
    assert one(spark, "x AIzaSy-12 y", X.redact) == "x [REDACTED] y"
    assert one(spark, "429 RESOURCE_EXHAUSTED per day", X.is_daily_quota) is True
    assert one(spark, "429 too many", X.is_daily_quota) is False
    assert [one(spark, x, X.n_lines) for x in ("", "a", "a\nb")] == [0, 1, 2]
    assert [one(spark, x, X.is_upper) for x in ("ABC 1", "AbC", "12")] == [True, False, False]


def test_labels(spark):
    assert one(spark, [" B ", "a", "b", ""], L.normalize, "array<string>") == ["a", "b"]
    assert one(spark, "The recipient shall license the employees", L.by_rules) == ["Employees", "Intellectual Property", "Party Identification"]
    assert one(spark, "xyz", L.by_rules) == ["Additional Information"]
    assert one(spark, '["a", 1]', lambda c: L.parse(c, "strings")) == []
    r = one(spark, '```json\n{"labels": "PURPOSE", "confidence": 3, "reason": "' + "r" * 300 + '"}\n```', L.parse_response)
    assert (r.labels, r.confidence, len(r.reason), r.status) == (["Purpose"], 1.0, 200, "SUCCESS")
    assert one(spark, "sorry", L.parse_response).status == "INVALID_RESPONSE"
    good = {"suggested_action": "KEEP", "confidence": 0.9, "reason": "ok", "needs_context": False}
    for change, ok in (({}, True), ({"confidence": True}, False), ({"confidence": "0.9"}, False), ({"confidence": 2}, False), ({"reason": " "}, False), ({"suggested_action": "NO"}, False), ({"needs_context": "x"}, False)):
        assert one(spark, json.dumps(good | change), L.is_valid_review) is ok, change
    with pytest.raises(ValueError):
        L.parse(F.lit(""), "other")


MARKUP = "head\n[INIT_CLAUSE]One text[INIT_CLASSE]Purpose, NDA Type[END_CLASSE][END_CLAUSE] x [INIT_CLAUSE]no tag[END_CLAUSE][INIT_CLAUSE]t[INIT_CLASSE] , [END_CLASSE][END_CLAUSE][INIT_CLAUSE]  [INIT_CLASSE]Purpose[END_CLASSE][END_CLAUSE][INIT_CLAUSE]a\nb[INIT_CLASSE]Employees[END_CLASSE][END_CLAUSE]tail"


def test_annotated_text(spark):
    docs = spark.createDataFrame([("d", MARKUP), ("e", "nothing"), ("f", " "), ("g", None)], "doc_id string, text string")
    got = {(r.doc_id, r.clause_index): r for r in annotated.parse(docs).collect()}
    assert (got["d", 0].text, got["d", 0].labels) == ("One text", ["Purpose", "NDA Type"])
    assert [got["d", k].warning for k in range(1, 4)] == ["no class tag", "no labels", "empty text"]
    assert (got["d", 4].text, got["d", 4].global_id) == ("a\nb", "d_clause_4")
    assert [got[k, None].warning for k in "efg"] == ["no clause blocks", "empty document", "empty document"]
    assert [r.labels for r in annotated.clean(annotated.parse(docs)).orderBy("clause_index").collect()] == [["nda type", "purpose"], ["employees"]]


@pytest.mark.parametrize(("text", "n"), [("1. First clause with enough text here.\n2. Second clause with enough text here.", 2), ("ARTICLE I Definitions that are long enough here\nText.\nSection 2. More text that is long enough.", 2), ("(a) first point that is long enough for a clause\n(b) second point that is long enough", 2), ("Just one paragraph.", 1), ("", 0), ("  \n ", 0), (None, 0)])
def test_segment_v1(spark, text, n):
    rows = S.segment_v1(spark.createDataFrame([("d", text)], "document_id string, text string")).orderBy("start").collect()
    assert len(rows) == n
    assert [r.clause_id for r in rows] == [f"d_clause_{k:03d}" for k in range(n)]
    assert all(text[r.start : r.end].strip() == r.text for r in rows)


def test_segment_v1_merges_and_breaks(spark):
    text = "1. " + "a" * 40 + "\n2. tiny\n3. " + "b" * 3000 + "\n\n\n" + "c" * 3000
    rows = S.segment_v1(spark.createDataFrame([("d", text)], "document_id string, text string")).orderBy("start").collect()
    assert len(rows) == 3 and "tiny" in rows[0].text and rows[2].text == "c" * 3000 and text[rows[2].start : rows[2].end] == rows[2].text


#: Published segmentations, where there are some: JSON of version -> [folder of texts, folder of segmented documents].
GOLDEN = json.loads(os.environ.get("CLAUSEGRAIN_GOLDEN", "{}"))


@pytest.mark.parametrize("version", sorted(map(int, GOLDEN)))
def test_golden_segmentations(spark, version):
    texts_at, documents_at = GOLDEN[str(version)]
    want = {}
    for name in os.listdir(documents_at):
        with open(f"{documents_at}/{name}", encoding="utf-8") as f:
            doc = json.load(f)
        if "clauses" in doc:
            want[doc["document_id"]] = doc
    texts = []
    for i in want:
        if os.path.exists(f"{texts_at}/{i}.txt"):
            with open(f"{texts_at}/{i}.txt", encoding="utf-8", newline="") as f:
                texts.append((i, f.read()))
    docs = spark.createDataFrame(texts, "document_id string, text string")
    got = {}
    for r in (S.segment_v1(docs) if version == 1 else S.segment(docs, version)).collect():
        got.setdefault(r.document_id, []).append(tuple(r)[1:])
    names = ("clause_id", "text", "start_position", "end_position") if version == 1 else ("clause_id", "text", "start", "end", "segment_type", "is_suspicious")
    assert texts
    for i, _ in texts:
        assert got[i] == [tuple(c[n] for n in names) for c in want[i]["clauses"]]


def test_segmenter_registry():
    assert S.segmenter("baseline") is S.segment_v1
    with pytest.raises(ValueError):
        S.segmenter("llm")


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é".encode())
    (tmp_path / "b.TXT").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.txt").write_bytes(b" \n")
    (tmp_path / "d.md").write_bytes(b"no")
    got = {r.document_id: (r.text, r.warning) for r in files.texts(spark, str(tmp_path)).collect()}
    assert got == {"a": ("é", None), "b": ("é", "decoded as Latin-1"), "c": (" \n", "empty document")}
    assert [r.path.rsplit("/")[-1] for r in files.listing(spark, str(tmp_path), ".txt").collect()] == ["a.txt", "b.TXT", "c.txt"]
    before = files.fingerprints(spark, str(tmp_path)).collect()
    (tmp_path / "d.md").write_bytes(b"yes")
    changed = files.changed_files(spark.createDataFrame(before, "path string, sha256 string"), files.fingerprints(spark, str(tmp_path)))
    assert [r.path.rsplit("/")[-1] for r in changed.collect()] == ["d.md"]
    assert files.manifest_digest(files.fingerprints(spark, str(tmp_path))).count() == 1
    with pytest.raises(ValueError):
        files.annotated(spark, str(tmp_path), (".none",))


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿\na,b\n"x\n\ny",1\nz,\n', encoding="utf-8")
    assert [tuple(r) for r in files.strict_csv(spark, str(tmp_path / "a.csv")).collect()] == [("x\n\ny", "1"), ("z", "")]
    (tmp_path / "b.csv").write_text("a,a\n1,2\n")
    with pytest.raises(ValueError):
        files.strict_csv(spark, str(tmp_path / "b.csv"))
    (tmp_path / "c.csv").write_text("a,b\n1\n")
    with pytest.raises(Exception, match="fields"):
        files.strict_csv(spark, str(tmp_path / "c.csv")).collect()
    assert files.lenient_csv(spark, str(tmp_path / "none.csv"), ("a", "b")).columns == ["a", "b"]
    assert files.lenient_csv(spark, str(tmp_path / "none.csv"), ("a", "b")).count() == 0


def test_other_files(spark, tmp_path):
    (tmp_path / "x.tsv.xz").write_bytes(lzma.compress(b"k1 k2\t1\t2\t3\t4\t5\n"))
    assert files.xz_tsv(spark, str(tmp_path / "x.tsv.xz")).first().keys == ["k1", "k2"]
    (tmp_path / "kv.tsv").write_text("a=1 b=2\n\nc=x=y\n")
    assert {(r.key, r.value) for r in files.key_values(spark, str(tmp_path / "kv.tsv")).collect()} == {("a", "1"), ("b", "2"), ("c", "x=y")}
    (tmp_path / "l.json").write_text(json.dumps({"rows": [{"clause_id": 1, "labels": ["a"]}, {"clause_id": 2, "labels": []}]}))
    audit = {r.path.rsplit("/")[-1]: (r.records, r.candidates) for r in files.label_audit(spark, str(tmp_path)).collect()}
    assert audit["l.json"] == (3, 1)
    doc = {"document_id": "d", "source_file": "d.txt", "num_clauses": 1, "clauses": [{"document_id": "d", "clause_id": "d_clause_000", "text": "t", "start": 0, "end": 1, "segment_type": "fragment", "is_suspicious": True}]}
    seg = tmp_path / "seg"
    seg.mkdir()
    (seg / "d.json").write_text(json.dumps(doc))
    assert files.segmented_checked(spark, str(seg)).first().clause_text == "t"
    (seg / "e.json").write_text(json.dumps(doc | {"num_clauses": 2}))
    with pytest.raises(Exception, match="document's id|number of clauses"):
        files.segmented_checked(spark, str(seg)).collect()
    (tmp_path / "p.pdf").write_bytes(b"one|two")
    (tmp_path / "q.pdf").write_bytes(b"broken")
    pages = lambda content: [f"page {x}" * 10 for x in content.decode().split("|")] if content != b"broken" else 1 / 0
    got = {r.document_id: (r.status, r.page_count) for r in files.pdfs(spark, str(tmp_path), pages).collect()}
    assert got == {"p": ("success", 2), "q": ("failed", 0)}
    assert files.experiments(spark, str(tmp_path / "none*.json")).count() == 0


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("d", "c1", "t|x", ["a", "b"], "train")], "doc_id string, clause_id string, text string, labels array<string>, split string")
    sinks.write_clauses(rows, str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).first().labels == "a, b"
    with pytest.raises(ValueError):
        sinks.write_clauses(rows, str(tmp_path / "c"), "xml")
    assert sinks.write_splits(rows, str(tmp_path / "s")).first().documents == 1
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "s" / "split_documents")).select("doc_id", "split").collect()] == [("d", "train")]
    sinks.replace_table(rows, str(tmp_path / "t"))
    sinks.replace_table(spark.read.parquet(str(tmp_path / "t")).unionByName(rows), str(tmp_path / "t"))
    sinks.append_aligned(rows.drop("text").withColumn("extra", F.lit(1)), str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t"))
    assert back.columns == rows.columns and back.count() == 3
    assert "t\\|x" in sinks.markdown(rows)


def test_confusion_and_macro_mcc(spark):
    rows = [("a", 1, 0.9), ("a", 0, 0.1), ("b", 1, 0.9), ("b", 1, 0.8), ("c", 0, 0.9), ("c", 0, 0.9)]
    per = metrics.per_category(metrics.confusion(spark.createDataFrame(rows, "category string, y_true int, y_prob double")))
    got = metrics.summary(per).first()
    assert got.macro_f1 == pytest.approx(2 / 3) and got.macro_mcc == pytest.approx((1 + 1 + 0) / 3) and got.hamming_loss == pytest.approx(2 / 6)


def test_splits(spark):
    rows = spark.createDataFrame([(f"d{k:02d}", f"c{k}-{j}") for k in range(20) for j in range(k % 5 + 2)], "doc_id string, clause_id string")
    got = {r.doc_id: r.split for r in splits.by_ratio(rows, "doc_id").collect()}
    assert len(got) == 20 and sorted(map(list(got.values()).count, ("train", "validation", "test"))) == [3, 3, 14]
    assert got == {r.doc_id: r.split for r in splits.by_ratio(rows.repartition(7), "doc_id").collect()} != {r.doc_id: r.split for r in splits.by_ratio(rows, "doc_id", seed=99).collect()}
    with pytest.raises(ValueError):
        splits.by_ratio(rows, "doc_id", (0.5, 0.1, 0.1))
    with pytest.raises(ValueError):
        splits.by_ratio(rows.where("doc_id < 'd02'"), "doc_id")
    assert splits.group_folds(rows, "doc_id").select("fold").distinct().count() == 5


def test_ensemble(spark):
    v = [("c", "a", ["x", "y"], 0.9, "SUCCESS"), ("c", "b", ["x"], 0.8, "SUCCESS"), ("c", "z", [], 0.0, "API_ERROR"), ("d", "a", ["p"], 0.5, "SUCCESS"), ("d", "b", ["q"], 0.7, "SUCCESS"), ("d", "z", ["r"], 0.7, "SUCCESS"), ("e", "a", ["k"], 0.4, "SUCCESS"), ("e", "b", [], 0.0, "INVALID_RESPONSE")]
    got = {r.clause_id: r for r in ensemble.combine(spark.createDataFrame(v, "clause_id string, model string, labels array<string>, confidence double, status string")).collect()}
    assert (got["c"].labels, got["c"].agreement_score, got["c"].quality) == (["x"], 0.5, "MEDIUM_CONFIDENCE")
    assert (got["d"].labels, got["d"].quality) == (["q"], "DISAGREEMENT")
    assert (got["e"].labels, got["e"].quality, got["e"].agreement_score) == (["k"], "API_ERROR", 0.0)


def test_scorer_is_tried_again_and_then_left(spark):
    def broken(texts):
        raise RuntimeError("down")

    rows = spark.createDataFrame([(f"c{k}", "t") for k in range(5)], "clause_id string, text string")
    assert {r.status for r in ensemble.score_with(rows, "m", broken, sleep=lambda seconds: None).collect()} == {"API_ERROR"}
    assert {r.labels[0] for r in ensemble.score_with(rows, "m", lambda ts: [(["Purpose"], 1.0, "SUCCESS", "")] * len(ts)).collect()} == {"Purpose"}


def test_quality_suites(spark):
    ref = spark.createDataFrame([("d", "d_1", "text", "d.json"), ("d", "d_2", "more", "d.json")], "document_id string, clause_id string, clause_text string, source string")
    row = lambda **k: {"document_id": "d", "clause_id": "d_1", "clause_text": "text", "source": "d.json", "review_status": "UNREVIEWED", "review_action": "", "confidence": "", "review_reason": ""} | k
    rows = [row(), row(clause_id="d_2", clause_text="edited", confidence="1.5"), row(clause_id="d_3", review_action="DROP")]
    table = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{c} string" for c in rows[0]))
    got = {r.check: (r.status, json.loads(r.ids)) for r in quality.clean_dataset(table, ref, ref).collect()}
    assert got["source_text_integrity"] == ("ERROR", ["d_2"]) and got["confidence_range"] == ("ERROR", ["d_2"]) and got["invalid_review_actions"] == ("ERROR", ["d_3"])
    assert got["inconsistent_document_ids"] == ("ERROR", ["d_3"]) and got["cleaning_coverage"] == ("ERROR", ["d_3"]) and got["duplicate_clause_ids"] == ("PASS", []) and got["label_availability"][0] == "BLOCKED"
    notes = spark.createDataFrame([("d_1", "d", '["Purpose"]', "COMPLETED", "true", "human", "me"), ("d_2", "d", "[", "NEW", "", "", "")], "clause_id string, document_id string, category_labels string, annotation_status string, label_verified string, label_source string, label_reviewer string")
    found = {r.check: r.status for r in quality.annotations(notes, ref).collect()}
    assert found["malformed_labels"] == found["invalid_status"] == "ERROR" and found["missing_reviewer"] == found["unknown_clause"] == "PASS"


def test_plans_are_the_ones_wanted(spark, tmp_path):
    """A filter reaches the scan, a narrow query reads few columns, and a repartitioned input changes nothing."""
    spark.range(100).selectExpr("id AS doc_id", "'a b' AS text", "'x' AS unused").write.parquet(str(tmp_path / "t"))
    t = spark.read.parquet(str(tmp_path / "t"))
    plan = stats.corpus(t.where("doc_id > 5"), "doc_id")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThan(doc_id,5)]" in plan and "unused" not in plan.split("ReadSchema")[1].split("\n")[0]
    rows = t.withColumn("score", F.col("doc_id") % 7)
    a, b = ([tuple(r) for r in selection.capped_top(x, "score", "doc_id", "unused", 5, 20).collect()] for x in (rows, rows.repartition(9)))
    assert a == b and len(a) == 5
    assert relations.pending(t, t.where("doc_id < 90"), "doc_id").count() == 10


def test_resume_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "state")
    make = lambda rows: spark.createDataFrame(rows, "k long, n long, v string").coalesce(1).write.mode("append").parquet(source)
    make([(1, 1, "a"), (2, 1, "b")])
    run = lambda: resume.upsert_stream(spark.readStream.schema("k long, n long, v string").parquet(source), target, str(tmp_path / "cp"), "k", "n").awaitTermination()
    run()
    make([(1, 2, "c"), (3, 1, "d")])
    run()
    run()
    state = resume.state(spark, target, "k", "n")
    assert {tuple(r) for r in state.collect()} == {(1, 2, "c"), (2, 1, "b"), (3, 1, "d")}
    assert [r.k for r in resume.remaining(spark.createDataFrame([(1,), (9,)], "k long"), state.withColumn("status", F.lit("SUCCESS")), "k").collect()] == [9]


def test_resume_stream_compacts_its_log(spark, tmp_path, monkeypatch):
    """Many batches, a snapshot now and then, and a snapshot that was cut off before it was whole."""
    monkeypatch.setattr(resume, "COMPACT", 3)
    source, target = str(tmp_path / "in"), str(tmp_path / "state")
    for n in range(8):
        spark.createDataFrame([(n % 3, n, f"v{n}")], "k long, n long, v string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("k long, n long, v string").option("maxFilesPerTrigger", 1).parquet(source)
    resume.upsert_stream(stream, target, str(tmp_path / "cp"), "k", "n").awaitTermination()
    os.makedirs(f"{target}/snapshots/99")
    assert {tuple(r) for r in resume.state(spark, target, "k", "n").collect()} == {(2, 5, "v5"), (0, 6, "v6"), (1, 7, "v7")}
    assert sorted(os.listdir(f"{target}/snapshots")) == ["5", "99"] and sorted(d for d in os.listdir(f"{target}/batches")) == ["6", "7"]


def test_a_replaced_table_is_restored(spark, tmp_path):
    path = f"{tmp_path}/t"
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.read.parquet(path).union(spark.range(2)), path)
    assert spark.read.parquet(path).count() == 5
    os.rename(path, f"{path}.old-x")  # cut off between its renames
    sinks.restored(spark, path)
    assert spark.read.parquet(path).count() == 5


def test_failed_votes_vote_where_all_three_do(spark):
    v = [("c", "a", ["Purpose"], 0.9, "SUCCESS"), ("c", "b", [], 0.0, "API_ERROR"), ("c", "d", [], 0.0, "API_ERROR")]
    got = ensemble.combine(spark.createDataFrame(v, "clause_id string, model string, labels array<string>, confidence double, status string"), count_failures=True).first()
    assert got.labels == ["Additional Information"] and abs(got.average_confidence - 1.9 / 3) < 1e-9
    usual = ensemble.combine(spark.createDataFrame([*v, ("c", "e", ["Purpose"], 0.8, "SUCCESS")], "clause_id string, model string, labels array<string>, confidence double, status string")).first()
    assert usual.labels == ["Purpose"] and usual.reason.startswith("[2/4 models failed]")


def test_a_scorer_is_waited_for(spark):
    said = []

    def busy(texts):
        said.append(len(texts))
        if len(said) < 3:
            raise RuntimeError("429 RESOURCE_EXHAUSTED retryDelay': '7s'" if len(said) == 1 else "503")
        return [(["Purpose"], 1.0, "SUCCESS", "")] * len(texts)

    waits = []
    answers, status, _ = ensemble.ask(busy, ["t"], 5, None, waits.append)
    assert status == "SUCCESS" and answers and waits == [9.0, 30.0]
    assert ensemble.wait_for("boom", 4) == 3.0 and ensemble.wait_for("429", 9) == 60.0

    def spent(texts):
        raise RuntimeError("429, retry in 500s")

    assert ensemble.ask(spent, ["t"], 5, None, waits.append)[1] == "API_QUOTA_EXHAUSTED" and len(waits) == 2
    import time

    assert ensemble.ask(lambda texts: time.sleep(1), ["t"], 2, 0.05, waits.append)[1] == "API_ERROR" and waits[2:] == [3.0]
    queue = spark.createDataFrame([(f"c{k}", "t") for k in range(6)], "clause_id string, text string")
    log = spark.createDataFrame([("c0", "m", "SUCCESS"), ("c1", "m", "API_ERROR"), ("c2", "other", "SUCCESS")], "clause_id string, model string, status string")
    done = ensemble.score_pending(queue, log, "m", lambda texts: [(["Purpose"], 1.0, "SUCCESS", "")] * len(texts), limit=3).collect()
    assert sorted(r.clause_id for r in done) == ["c1", "c2", "c3"]


def test_baseline_classifier(spark):
    from clausegrain.operators import learning

    rows = spark.createDataFrame([(k, "the recipient shall pay damages" if k % 2 else "the term ends on a date", ["x"] if k % 2 else ["y"]) for k in range(40)], "id long, text string, labels array<string>")
    model, found = learning.train(rows, ["x", "y", "z"])
    assert set(found) == {"x", "y"}
    got = learning.predict(rows, model, found, "id").where("category = 'x'").collect()
    assert all((r.y_prob > 0.5) == bool(r.id % 2) for r in got)


def test_folds_and_rounds(spark, tmp_path):
    from clausegrain.operators import learning, rounds

    rows = [(f"d{k % 12}", f"c{k:03d}", "the recipient shall pay all damages" if k % 2 else "the term ends on a date", ["x"] if k % 2 else ["y"], "ANNOTATED", "human_annotation") for k in range(96)]
    table = spark.createDataFrame(rows, "document_id string, clause_id string, text string, labels array<string>, annotation_status string, label_source string")
    got = learning.cross_validate(table, ["x", "y"], folds=3, sublinear=True).collect()
    assert [r.fold for r in got] == [0, 1, 2] and all(r.macro_f1 == 1.0 for r in got)
    log = str(tmp_path / "log")
    new = spark.createDataFrame([("n1", "n1_1", "damages"), ("n1", "n1_2", "nothing known"), ("n2", "n2_1", "the term ends on a date")], "document_id string, clause_id string, text string")
    done = rounds.run(table, new, ["x", "y"], 1, log, size=2, min_categories=2)
    assert done.summary.first().macro_f1 == 1.0 and {r.clause_id for r in done.scores.collect()} == {"n1_1", "n1_2", "n2_1"} and done.batch.count() == 2 and done.batch.first().clause_id == "n1_2"
    assert rounds.run(table.limit(5), new, ["x", "y"], 2, log).batch is None
    assert [(r["round"], r.ready) for r in spark.read.parquet(log).orderBy("round").collect()] == [(1, True), (2, False)]


def test_sql_can_call_the_segmenter(spark):
    from clausegrain.functions.register import register

    register(spark)
    rows = spark.sql("SELECT p.* FROM VALUES ('1. First part of it is here.\\n\\n2. Second part of it is here.') AS t(x), LATERAL clause_pieces(t.x, 3) AS p").collect()
    assert [r.text for r in rows] == ["1. First part of it is here.", "2. Second part of it is here."]


def test_typed_csv_and_queues(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\nN/A,1.5,x\n3,nan,NULL\nq,2,\n")
    got = files.typed_csv(spark, str(tmp_path / "a.csv"), "a long, b double, c string").collect()
    assert [tuple(r) for r in got] == [(None, 1.5, "x"), (3, None, None), (None, 2.0, None)]
    assert files.header(spark, str(tmp_path / "a.csv")) == ["a", "b", "c"] and files.typed_csv(spark, str(tmp_path / "no.csv"), "a long").count() == 0
    queue = str(tmp_path / "queue")
    spark.range(6).write.parquet(queue)
    sinks.shrink_queue(spark, queue, spark.range(2), "id")
    assert sorted(r.id for r in spark.read.parquet(queue).collect()) == [2, 3, 4, 5]
    made = selection.audited_queue(spark.range(50), F.col("id") < 3, "id", 4).collect()
    assert [r.reason for r in made] == ["priority"] * 3 + ["sample"] * 4 and len({r.id for r in made}) == 7
    sinks.write_frequency(spark.createDataFrame([("a", 1, 10.0, False), ("b", 9, 90.0, True)], "label string, n long, percent double, is_majority boolean"), str(tmp_path / "f"))
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "f"), header=True).collect()] == [("b", "9", "90.0", "majority"), ("a", "1", "10.0", "minority")]
    statuses = spark.createDataFrame([("success",), ("failed",), ("success",)], "status string")
    assert tuple(files.extraction_counts(statuses).first()) == (3, 2, 0, 0, 1)


def profiles(spark, n, seed, most=40):
    import random

    r = random.Random(seed)
    names = [*sorted(splits.RARE), "a", "b", "c", "d", "e", "f", "g"]
    rows = [(k * 7 % 1009, r.choice([1, 1, 2, 3, r.randint(1, most)]), r.sample(names, r.choice([0, 1, 1, 2, 3, 5]))) for k in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, clauses long, categories array<string>").repartition(3)


@pytest.mark.parametrize(("n", "most"), [(300, 40), (25, 60), (3, 5)])
def test_greedy_target_is_that_of_one_document_after_another(spark, n, most):
    import hashlib

    rows, table = profiles(spark, n, n, most)
    targets, total, out = {"test": 0.2, "validation": 0.15}, sum(d[1] for d in rows), {}
    for split in ("test", "validation"):
        target, has, held = targets[split] * total, set(), 0
        while held < target:
            fits = [d for d in rows if d[0] not in out and held + d[1] <= 1.5 * target]
            if not fits:
                break
            best = max(fits, key=lambda d: (len(set(d[2]) - has), hashlib.md5(f"{d[0]}:42".encode()).hexdigest()))
            out[best[0]], has, held = split, has | set(best[2]), held + best[1]
    assert {r.doc_id: r.split for r in splits.greedy_target(table, targets, "doc_id").collect()} == {d[0]: out.get(d[0], "train") for d in rows}


def test_greedy_target_query_splits_every_document(spark):
    from clausegrain.plans import adapters, catalogue

    data = "/root/testdata/sf0.001"
    got = [r.doc_id for r in catalogue.QUERIES["split_greedy_target"](spark, data).collect()]
    assert sorted(got) == sorted(r.doc_id for r in adapters.clause_labels(spark, data).select("doc_id").distinct().collect())


@pytest.mark.parametrize(("n", "most"), [(300, 40), (40, 60), (3, 5)])
def test_greedy_coverage_is_that_of_one_document_after_another(spark, n, most):
    rows, table = profiles(spark, n, n + 1, most)
    total, seen, filled, want = sum(d[1] for d in rows), {s: set() for s in splits.SPLITS}, dict.fromkeys(splits.SPLITS, 0), {}
    for name, size, categories in sorted(((d[0], d[1], set(d[2])) for d in rows), key=lambda d: (len(splits.RARE & d[2]), d[1], d[0]), reverse=True):
        brings = (s for s, room in zip(splits.SPLITS, (0.65, 0.25, 0.25), strict=True) if categories - seen[s] and filled[s] / total < room)
        below = (s for s, room in zip(splits.SPLITS, (0.60, 0.20), strict=False) if filled[s] / total < room)
        want[name] = next(brings, None) or next(below, "test")
        seen[want[name]] |= categories
        filled[want[name]] += size
    assert {r.doc_id: r.split for r in splits.greedy_coverage(table, "doc_id").collect()} == want


@pytest.mark.parametrize("most", [3, 90])
def test_folds_are_those_of_one_document_after_another(spark, most):
    import random

    r = random.Random(most)
    sizes = [(k * 7 % 1009, r.choice([1, 1, 2, r.randint(1, most)])) for k in range(200)]
    table = spark.createDataFrame([(k,) for k, n in sizes for _ in range(n)], "doc_id long").repartition(3)
    load, want = [0] * 5, {}
    for k, n in sorted(sizes, key=lambda d: (-d[1], d[0])):
        want[k] = load.index(min(load))
        load[want[k]] += n
    assert {x.doc_id: x.fold for x in splits.group_folds(table, "doc_id").collect()} == want


def test_splits_refuse_no_number_of_documents(spark):
    many = spark.range(200_001).withColumnRenamed("id", "doc_id")
    assert splits.group_folds(many, "doc_id").count() == 200_001
    table = many.selectExpr("doc_id", "1L AS clauses", "array('a') AS categories")
    assert splits.greedy_coverage(table, "doc_id").count() == 200_001
    assert splits.greedy_target(table, {"test": 0.2, "validation": 0.15}, "doc_id").count() == 200_001
