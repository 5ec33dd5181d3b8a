"""Declarative data-quality suites: rules give offending ids, one aggregation gives a row for each check."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausegrain.functions.labels import ACTIONS
from clausegrain.functions.taxonomy import CATEGORIES, EXCLUDED_QUALITY, VALID_QUALITY, all_categories, label_col
from clausegrain.functions.text import is_blank, strip, truthy
from clausegrain.sources.scratch import free


@dataclass(frozen=True)
class Rule:
    """A check over rows: `bad` marks offenders. severity is the status of a check that finds some; `needs` inverts it: some must be marked."""

    name: str
    bad: Column
    severity: str = "ERROR"
    detail: str = ""
    needs: bool = False


def _found(rows: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    marks = F.array_compact(F.array(*(F.when(F.coalesce(r.bad, F.lit(False)), i) for i, r in enumerate(rules))))
    return rows.select(F.col(key).cast("string").alias("id"), marks.alias("_marks")).select("id", F.explode("_marks").alias("i"))


def offenders(rows: DataFrame, rules: list[Rule], key: str) -> DataFrame:
    """check and id of every row that a rule marks, however many: the whole of what run() counts."""
    found = _found(rows, rules, key)
    names = F.array(*(F.lit(r.name) for r in rules))
    return found.select(F.element_at(names, F.col("i") + 1).alias("check"), "id")


def run(rows: DataFrame, rules: list[Rule], key: str, most_ids: int = 20) -> DataFrame:
    """check, severity, status, count, ids_checksum (the sum of the first 32 bits of all marked ids' MD5), ids (the smallest, as JSON), details. All rules
    are evaluated in one pass; checks without offenders appear too. offenders() has all ids."""
    found = _found(rows, rules, key)
    number = F.conv(F.substring(F.md5(F.coalesce("id", F.lit(""))), 1, 8), 16, 10).cast("long")
    counts = found.groupBy("i").agg(F.count("*").alias("count"), F.sum(number).alias("ids_checksum"))
    shown = found.distinct().withColumn("_r", F.row_number().over(W.partitionBy("i").orderBy("id"))).where(F.col("_r") <= most_ids)  # each task sends so many at most
    ids = shown.groupBy("i").agg(F.to_json(F.array_sort(F.collect_list("id"))).alias("ids"))
    head = rows.sparkSession.createDataFrame([(i, r.name, r.severity, r.needs, r.detail) for i, r in enumerate(rules)], "i int, check string, severity string, needs boolean, details string")
    out = head.join(counts, "i", "left").join(ids, "i", "left")
    n = F.coalesce("count", F.lit(0))
    status = F.when(F.col("needs") == (n > 0), "PASS").otherwise(F.col("severity"))
    return out.select("i", "check", "severity", status.alias("status"), n.alias("count"), F.coalesce("ids_checksum", F.lit(0)).alias("ids_checksum"), F.coalesce("ids", F.lit("[]")).alias("ids"), "details")


def missing_columns(rows: DataFrame, required: tuple[str, ...]) -> list[str]:
    return sorted(set(required) - set(rows.columns))


def overall(checks: DataFrame, blocking: tuple[str, ...] = ("ERROR", "FAIL", "BLOCKED")) -> DataFrame:
    """One row: checks, failures, warnings, and PASS, WARN or BLOCKED."""
    bad, warn = F.count_if(F.col("status").isin(*blocking)), F.count_if(F.col("status") == "WARN")
    return checks.agg(F.count("*").alias("checks"), bad.alias("failures"), warn.alias("warnings"), F.when(bad > 0, "BLOCKED").when(warn > 0, "WARN").otherwise("PASS").alias("status"))


def with_repeats(rows: DataFrame, **keys: Column) -> DataFrame:
    """rows with a boolean column for each named key: whether another row has the same key. Keys are counted and those of two and more
    joined, so no task gets all rows of a busy one; null keys repeat nothing."""
    for name, key in keys.items():
        own = free(rows.columns, "_key")
        keyed = rows.withColumn(own, key)
        several = keyed.where(F.col(own).isNotNull()).groupBy(own).agg(F.count("*").alias("n")).where("n > 1").select(own, F.lit(True).alias(name))
        rows = keyed.join(several, own, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(own)
    return rows


def with_leaks(rows: DataFrame, split: str = "split", **keys: Column) -> DataFrame:
    """rows with a boolean column for each named key: whether rows of the same key lie in two splits or more."""
    for name, key in keys.items():
        own = free(rows.columns, "_key")
        keyed = rows.withColumn(own, key)
        leaking = keyed.where(F.col(own).isNotNull()).groupBy(own).agg(F.min(split).alias("a"), F.max(split).alias("b")).where("a < b").select(own, F.lit(True).alias(name))
        rows = keyed.join(leaking, own, "left").withColumn(name, F.coalesce(name, F.lit(False))).drop(own)
    return rows


# States of a clause's structural review.
STATUSES = ("UNREVIEWED", "PRIORITY_UNREVIEWED", "API_FAILURE", "CONFLICT_REVIEW", "PENDING_MERGE", "PENDING_SPLIT", "PENDING_REVIEW", "PSEUDO_KEEP", "HUMAN_RECORDED_KEEP")
CLEAN_REQUIRED = ("document_id", "clause_id", "clause_text", "source", "review_status", "review_action", "confidence", "review_reason")


def clean_dataset(rows: DataFrame, reference: DataFrame, expected: DataFrame | None = None, most_ids: int = 20) -> DataFrame:
    """The suite of the cleaned clause table against the segmented reference (document_id, clause_id, clause_text, source); all columns are strings."""
    gone = missing_columns(rows, CLEAN_REQUIRED)
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")
    ref = reference.select(F.col("clause_id").alias("_id"), F.col("document_id").alias("_doc"), F.col("clause_text").alias("_text"), F.col("source").alias("_source"))
    flat = F.regexp_replace(F.coalesce("clause_text", F.lit("")), r"(?U)\s+", " ")
    flat = F.trim(flat)
    labels = F.col("category_labels") if "category_labels" in rows.columns else F.lit(None).cast("string")
    parsed = F.from_json(labels, "array<string>")
    labelled = ~is_blank(labels) & (F.size(F.coalesce(parsed, F.array())) > 0)
    column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    verified = truthy(column("label_verified")) & ~is_blank(column("label_source")) & ~is_blank(column("label_reviewer"))
    malformed = ~is_blank(labels) & (parsed.isNull() | (F.size(F.array_except(parsed, all_categories())) > 0) | (F.size(F.array_distinct(parsed)) < F.size(parsed)))
    joined = rows.join(ref, rows["clause_id"] == ref["_id"], "left").withColumn("_flat", flat)
    joined = with_repeats(joined, _same_id=F.col("clause_id"), _same_text=F.when(F.col("_flat") != "", F.md5("_flat")))
    in_ref, text, action, status = F.col("_id").isNotNull(), F.col("clause_text"), F.coalesce("review_action", F.lit("")), F.col("review_status")
    number = F.col("confidence").try_cast("double")
    rules = [
        Rule("missing_clause_ids", is_blank(F.col("clause_id"))), Rule("duplicate_clause_ids", F.col("_same_id")),
        Rule("missing_clause_text", text.isNull() | (text == "")), Rule("empty_clauses", (text != "") & is_blank(text)),
        Rule("duplicate_text", F.col("_same_text"), "WARN"),
        Rule("invalid_review_actions", ~action.isin("", *ACTIONS)), Rule("missing_review_status", is_blank(status)), Rule("invalid_review_status", ~F.coalesce(status, F.lit("")).isin(*STATUSES)),
        Rule("action_status_consistency", (action == "REMOVE_NON_LEGAL") | ((action == "") & ~F.coalesce(status, F.lit("")).isin("UNREVIEWED", "PRIORITY_UNREVIEWED", "API_FAILURE"))),
        Rule("inconsistent_document_ids", ~in_ref | ~F.col("document_id").eqNullSafe(F.col("_doc"))), Rule("source_text_integrity", in_ref & ~text.eqNullSafe(F.col("_text"))), Rule("source_provenance", in_ref & ~F.col("source").eqNullSafe(F.col("_source"))),
        Rule("confidence_range", ~is_blank(F.col("confidence")) & ~F.coalesce(number.between(0, 1), F.lit(False))),
        Rule("multi_label_format", malformed), Rule("label_provenance", labelled & ~malformed & ~verified, "BLOCKED"),
        Rule("label_availability", labelled & ~malformed & verified & in_ref, "BLOCKED", needs=True), Rule("multi_label_availability", labelled & ~malformed & verified & in_ref & (F.size(parsed) > 1), "BLOCKED", needs=True),
    ]
    checks = run(joined, rules, "clause_id", most_ids)
    if expected is not None:
        a, b = rows.select(F.col("clause_id").alias("id")).distinct(), expected.select(F.col("clause_id").alias("id")).distinct()
        odd = a.join(b, "id", "left_anti").unionByName(b.join(a, "id", "left_anti"))
        checks = checks.unionByName(run(odd, [Rule("cleaning_coverage", F.lit(True))], "id", most_ids).withColumn("i", F.lit(len(rules))))
    return checks


# States of an annotation; VERIFIED is one of them, as trainers accept it.
ANNOTATION_STATUSES = ("PENDING", "IN_PROGRESS", "COMPLETED", "VERIFIED", "SKIPPED")


def annotations(rows: DataFrame, clauses: DataFrame, most_ids: int = 20) -> DataFrame:
    """The suite of an annotation table (clause_id, document_id, category_labels JSON, annotation_status, label_verified, label_source, label_reviewer) against the clauses."""
    known = clauses.select(F.col("clause_id").alias("_id"), F.col("document_id").alias("_doc")).distinct()
    parsed = F.from_json("category_labels", "array<string>")
    filled = F.size(F.coalesce(parsed, F.array())) > 0
    done = F.col("annotation_status").isin("COMPLETED", "VERIFIED")
    verified = truthy(F.col("label_verified"), ("true", "1", "yes"))
    rules = [
        Rule("missing_clause_id", is_blank(F.col("clause_id"))), Rule("missing_document_id", is_blank(F.col("document_id"))), Rule("duplicate_clause_id", F.col("_same_id")),
        Rule("unknown_clause", F.col("_id").isNull()), Rule("document_mismatch", F.col("_id").isNotNull() & ~F.col("document_id").eqNullSafe(F.col("_doc"))),
        Rule("malformed_labels", ~is_blank(F.col("category_labels")) & parsed.isNull()), Rule("unknown_category", F.size(F.array_except(parsed, all_categories())) > 0), Rule("repeated_category", F.size(F.array_distinct(parsed)) < F.size(parsed)),
        Rule("invalid_status", ~F.coalesce("annotation_status", F.lit("")).isin(*ANNOTATION_STATUSES)), Rule("done_without_labels", done & ~filled), Rule("labels_without_done", filled & ~done, "WARN"),
        Rule("verified_without_labels", verified & ~filled), Rule("missing_label_source", filled & is_blank(F.col("label_source")), "BLOCKED"), Rule("missing_reviewer", filled & verified & is_blank(F.col("label_reviewer")), "BLOCKED"),
    ]
    return run(with_repeats(rows.join(known, rows["clause_id"] == known["_id"], "left"), _same_id=F.col("clause_id")), rules, "clause_id", most_ids)


def annotation_tables(queue: DataFrame, database: DataFrame, clauses: DataFrame, most_ids: int = 20) -> DataFrame:
    """The suite over both tables of an annotation project, each check with its table: the queue, and the database of what was annotated, whose columns verified, reviewer and
    selection_source stand for label_verified, label_reviewer and label_source. An empty database is one passed check."""
    named = database.withColumnsRenamed({"verified": "label_verified", "reviewer": "label_reviewer", "selection_source": "label_source"})
    both = lambda rows, name: annotations(rows, clauses, most_ids).withColumn("table", F.lit(name))
    checks = both(queue, "queue")
    if named.isEmpty():
        one = Rule("db_empty", F.lit(True), detail="nothing is annotated yet")
        return checks.unionByName(run(named.limit(0), [one], "clause_id").withColumn("table", F.lit("db")))
    return checks.unionByName(both(named, "db"))


def pseudo_labels(rows: DataFrame, most_ids: int = 20) -> DataFrame:
    """The suite of ensemble labels (clause_id, labels array, model confidences, average_confidence, agreement_score, quality)."""
    confidences = [c for c in rows.columns if c.endswith("_confidence")]
    outside = reduce(lambda a, b: a | b, [~F.coalesce(F.col(c).between(0, 1), F.lit(False)) for c in confidences], F.lit(False))
    rules = [
        Rule("missing_clause_id", is_blank(F.col("clause_id").cast("string"))), Rule("duplicate_clause_id", F.col("_same_id")), Rule("no_labels", (F.size("labels") == 0) & F.col("quality").isin(*VALID_QUALITY)),
        Rule("unknown_category", F.size(F.array_except("labels", all_categories())) > 0), Rule("repeated_category", F.size(F.array_distinct("labels")) < F.size("labels")), Rule("confidence_range", outside),
        Rule("agreement_range", ~F.coalesce(F.col("agreement_score").between(0, 1), F.lit(False))), Rule("unknown_quality", ~F.coalesce("quality", F.lit("")).isin(*VALID_QUALITY, "API_ERROR", "API_QUOTA_EXHAUSTED", "INVALID_RESPONSE", "QUOTA_WAITING")),
        Rule("failed_with_agreement", (F.col("quality") == "API_ERROR") & (F.col("agreement_score") > 0), "WARN"), Rule("any_valid", F.col("quality").isin(*VALID_QUALITY), "BLOCKED", needs=True),
    ]
    return run(with_repeats(rows, _same_id=F.col("clause_id")), rules, "clause_id", most_ids)


def splits(rows: DataFrame, most_ids: int = 20) -> DataFrame:
    """The suite of split tables (document_id, clause_id, text, labels, split): leakage of documents, clauses and texts, coverage, emptiness."""
    marked = with_leaks(rows, document_leaks=F.col("document_id"), clause_leaks=F.col("clause_id"), text_leaks=F.md5(F.trim("text")))
    rules = [
        Rule("unknown_split", ~F.coalesce("split", F.lit("")).isin("train", "validation", "test")), Rule("document_leakage", F.col("document_leaks")), Rule("clause_leakage", F.col("clause_leaks")), Rule("text_leakage", F.col("text_leaks"), "WARN"),
        Rule("duplicate_clause", F.col("_same_id")), Rule("empty_text", is_blank(F.col("text"))), Rule("no_labels", F.size("labels") == 0), Rule("unknown_category", F.size(F.array_except("labels", all_categories())) > 0),
        *(Rule(f"{s}_not_empty", F.col("split") == s, "FAIL", needs=True) for s in ("train", "validation", "test")),
    ]
    return run(with_repeats(marked, _same_id=F.col("clause_id")), rules, "clause_id", most_ids)


# ---------------------------------------------------------------- gates: one value a check

SPLITS = ("train", "validation", "test")


def _checks(one: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """check, status, value from a table of one row; checks: a number and a status each."""
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check"), s.alias("status"), v.cast("long").alias("value")) for k, (v, s) in checks.items()))).alias("r")).select("r.*")


def _none(n: Column, otherwise: str = "FAIL") -> Column:
    return F.when(n == 0, "PASS").otherwise(otherwise)


def _overlaps(rows: DataFrame, key: Column, pairs: tuple[tuple[str, str], ...], name: str) -> DataFrame:
    """One row: how many keys lie in both of each pair of splits, summed over pairs."""
    has = rows.select(key.alias("_k"), "split").where("_k is not null").groupBy("_k").agg(*(F.max((F.col("split") == s).cast("int")).alias(s) for s in SPLITS))
    return has.agg(F.coalesce(F.sum(sum((F.col(a) * F.col(b) for a, b in pairs), F.lit(0))), F.lit(0)).alias(name))


def _extra(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """One row: how many rows repeat the key of another."""
    return rows.groupBy(key.alias("_k")).agg(F.count("*").alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias(name))


def _categories(rows: DataFrame, labels: str) -> DataFrame:
    """One row: categories found at all and in each split, and whether every count in train is that of all rows."""
    each = rows.select("split", F.explode(F.array_distinct(labels)).alias("category")).where(F.col("category").isin(*CATEGORIES))
    by = each.groupBy("category").agg(F.count("*").alias("n"), *(F.count_if(F.col("split") == s).alias(s) for s in SPLITS))
    return by.agg(F.count("*").alias("categories"), *(F.count_if(F.col(s) > 0).alias(f"{s}_categories") for s in SPLITS), F.coalesce(F.sum(F.col("n") - F.col("train")), F.lit(0)).alias("beyond_train"))


ALL_PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))
AGREEMENT = ("agreement_score", "model_agreement_score", "llm_agreement_score")


def leakage(rows: DataFrame, labels: str = "labels", quality: str = "quality") -> DataFrame:
    """Nine checks of split tables (document_id, clause_id, clause_text, split, labels, quality, label_source, an agreement score): check, status, value."""
    nulls = F.count_if(F.col("clause_text").isNull()) + F.count_if(F.col("document_id").isNull()) + F.count_if(F.col("clause_id").isNull())
    one = rows.agg(nulls.alias("nulls"), F.count_if(F.col(quality).isin(*EXCLUDED_QUALITY)).alias("quarantined"))
    for more in (
        _overlaps(rows, F.col("document_id"), ALL_PAIRS, "documents"), _extra(rows, F.col("clause_id"), "ids"),
        _overlaps(rows, F.md5("clause_text"), ALL_PAIRS[:2], "texts"), _categories(rows, labels),
    ):
        one = one.crossJoin(F.broadcast(more))  # tables of one row
    lacking = F.lit(len({"label_source", quality} - set(rows.columns)) + (not set(AGREEMENT) & set(rows.columns)))
    least = F.least("validation_categories", "test_categories")
    return _checks(one, {
        "document_disjointness": (F.col("documents"), _none(F.col("documents"))), "clause_id_uniqueness": (F.col("ids"), _none(F.col("ids"))), "text_isolation": (F.col("texts"), _none(F.col("texts"))),
        "completeness": (F.col("nulls"), _none(F.col("nulls"))), "quarantined_rows": (F.col("quarantined"), _none(F.col("quarantined"))), "provenance": (lacking, _none(lacking)),
        "class_weight_safeguard": (F.col("beyond_train"), F.when(F.col("beyond_train") == 0, "FAIL").otherwise("PASS")), "threshold_safeguard": (F.lit(0), F.lit("PASS")),
        "category_coverage": (least, F.when(least < 10, "BLOCKED").otherwise("PASS")),
    })


def readiness(rows: DataFrame, human_sample: bool = False, labels: str = "labels", quality: str = "quality") -> DataFrame:
    """Twelve gates of a benchmark's valid rows (document_id, clause_id, clause_text, split, labels (null if unparseable), quality, label_source): check, status, value."""
    missing = lambda c: F.count_if(F.col(c).isNull())
    one = rows.agg(
        F.count("*").alias("rows"), F.count_distinct("document_id").alias("documents"), missing(labels).alias("unparsed"), F.count_if(F.col(quality).isin("API_ERROR", "API_QUOTA_EXHAUSTED")).alias("errors"),
        missing("clause_text").alias("no_text"), missing("document_id").alias("no_document"), F.count_if(F.col("label_source") == "llm_pseudo_label").alias("known_source"),
    )
    for more in (_overlaps(rows, F.col("document_id"), ALL_PAIRS, "overlaps"), _extra(rows, F.col("clause_id"), "ids"), _categories(rows, labels)):
        one = one.crossJoin(F.broadcast(more))
    lacking = F.lit(len({"label_source", "average_confidence", "agreement_score", quality} - set(rows.columns)))
    n, left = F.col("documents"), F.col("rows") - F.col("known_source")
    return _checks(one, {
        "document_diversity": (n, F.when(n >= 15, "PASS").when(n >= 10, "WARN").otherwise("FAIL")), "document_leakage": (F.col("overlaps"), _none(F.col("overlaps"))),
        "category_coverage": (F.col("categories"), F.when(F.col("categories") == len(CATEGORIES), "PASS").otherwise("FAIL")), "duplicate_records": (F.col("ids"), _none(F.col("ids"))), "invalid_labels": (F.col("unparsed"), _none(F.col("unparsed"))),
        "api_errors": (F.col("errors"), _none(F.col("errors"))), "missing_text": (F.col("no_text"), _none(F.col("no_text"))), "missing_document_ids": (F.col("no_document"), _none(F.col("no_document"))), "metadata": (lacking, _none(lacking)),
        "test_category_coverage": (F.col("test_categories"), F.when(F.col("test_categories") == len(CATEGORIES), "PASS").otherwise("WARN")), "human_verification": (F.lit(int(human_sample)), F.lit("PASS" if human_sample else "WARN")),
        "pseudo_label_provenance": (left, _none(left, "WARN")),
    })


def preflight(train: DataFrame, validation: DataFrame, test: DataFrame) -> DataFrame:
    """Seven checks before training, of split tables (document_id, clause_text, a label column for each category): check, status, value. Values in label columns are 0 or 1."""
    parts = dict(zip(SPLITS, (train, validation, test), strict=True))
    wanted = [label_col(c) for c in CATEGORIES]
    lacking = sum(len(set(wanted) - set(p.columns)) for p in parts.values())
    present = [c for c in wanted if all(c in p.columns for p in parts.values())]
    odd = sum((F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))) for c in present), F.lit(0))
    rows = reduce(DataFrame.unionByName, (p.select("document_id", "clause_text", *present, F.lit(s).alias("split")) for s, p in parts.items()))
    blank = lambda c: F.count_if(is_blank(F.col(c).cast("string")))
    one = rows.agg(blank("clause_text").alias("no_text"), blank("document_id").alias("no_document"), odd.alias("odd")).crossJoin(F.broadcast(_overlaps(rows, F.col("document_id"), ALL_PAIRS, "documents")))
    unlike = len({tuple(p.columns) for p in parts.values()}) - 1
    sizes = len({sum(c in p.columns for c in wanted) for p in parts.values()} | {len(CATEGORIES)}) - 1
    return _checks(one, {
        "labels_exist": (F.lit(lacking), _none(F.lit(lacking))), "columns_match": (F.lit(unlike), _none(F.lit(unlike))), "document_overlap": (F.col("documents"), _none(F.col("documents"))), "missing_text": (F.col("no_text"), _none(F.col("no_text"))),
        "missing_document_ids": (F.col("no_document"), _none(F.col("no_document"))), "label_values": (F.col("odd"), _none(F.col("odd"))), "label_dimensions": (F.lit(sizes), _none(F.lit(sizes))),
    })


def training_preflight(rows: DataFrame, labels: tuple[str, ...] = tuple(CATEGORIES), quality: str = "pseudo_label_quality") -> DataFrame:
    """Five checks before training, of all splits in one table (clause_id, document_id, clause_text, split, quality, label columns): check, status, value."""
    blank = lambda c: F.count_if(is_blank(F.col(c).cast("string")))
    one = rows.agg((blank("clause_text") + blank("document_id")).alias("blank"), F.count_if(F.col(quality).isin(*EXCLUDED_QUALITY)).alias("errors"))
    for more in (_extra(rows, F.col("clause_id"), "ids"), _overlaps(rows, F.col("document_id"), ALL_PAIRS, "documents")):
        one = one.crossJoin(F.broadcast(more))
    lacking = F.lit(len({label_col(c) for c in labels} - set(rows.columns)))
    values = {"duplicate_clause_ids": F.col("ids"), "document_leakage": F.col("documents"), "blank_fields": F.col("blank"), "error_rows": F.col("errors"), "label_columns": lacking}
    return _checks(one, {k: (v, _none(v)) for k, v in values.items()})


def synthetic_preflight(synthetic: DataFrame, train: DataFrame, validation: DataFrame, test: DataFrame, rows: int = 5000) -> DataFrame:
    """Ten checks of synthetic rows (clause_id, clause_text, label columns) that are to join a training table: their number, labels, texts and ids, that the benchmark's
    tables have one schema, and that no synthetic text lies in validation or test. Texts are compared without the white space around them, by their hashes."""
    wanted = {label_col(c) for c in CATEGORIES}
    present = sorted(wanted & set(synthetic.columns))
    own = {c for c in train.columns if c.startswith("label_") and c != "label_source"}
    odd = sum((F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))) for c in present), F.lit(0))
    one = synthetic.agg(F.count("*").alias("rows"), odd.alias("odd"), F.count_if(is_blank(F.col("clause_text"))).alias("blank"))
    hashes = lambda t: t.where("clause_text is not null").select(F.md5(strip(F.col("clause_text"))).alias("h")).distinct()
    shared = lambda t, name: hashes(synthetic).join(hashes(t), "h", "left_semi").agg(F.count("*").alias(name))
    for more in (_extra(synthetic, F.col("clause_id"), "ids"), _extra(synthetic, F.md5("clause_text"), "texts"), shared(validation, "in_validation"), shared(test, "in_test")):
        one = one.crossJoin(F.broadcast(more))
    off = F.abs(F.col("rows") - rows)
    values = {
        "row_count": off, "label_columns": F.lit(len(wanted - set(synthetic.columns))), "label_values": F.col("odd"), "blank_texts": F.col("blank"), "duplicate_clause_ids": F.col("ids"), "duplicate_texts": F.col("texts"),
        "same_label_columns": F.lit(len(wanted ^ own)), "same_schemas": F.lit(len({tuple(t.columns) for t in (train, validation, test)}) - 1), "validation_isolation": F.col("in_validation"), "test_isolation": F.col("in_test"),
    }
    return _checks(one, {k: (v, _none(v)) for k, v in values.items()})


def interface_report(parts: dict[str, DataFrame], required: tuple[str, ...]) -> DataFrame:
    """split, row_count, missing_columns, null_texts, null_docs, binary_labels_valid of each split table, in one pass over each."""
    out = None
    for name, rows in parts.items():
        present = [label_col(c) for c in CATEGORIES if label_col(c) in rows.columns]
        odd = sum((F.count_if(~F.coalesce(F.col(c).isin(0, 1), F.lit(False))) for c in present), F.lit(0))
        null = lambda c, rows=rows: F.count_if(F.col(c).isNull()) if c in rows.columns else F.count("*")
        valid = (odd == 0) & F.lit(len(present) == len(CATEGORIES))
        own = rows.agg(F.count("*").alias("row_count"), null("clause_text").alias("null_texts"), null("document_id").alias("null_docs"), valid.alias("binary_labels_valid"))
        own = own.select(F.lit(name).alias("split"), "row_count", F.lit(len(missing_columns(rows, required))).alias("missing_columns"), "null_texts", "null_docs", "binary_labels_valid")
        out = own if out is None else out.unionByName(own)
    return out
