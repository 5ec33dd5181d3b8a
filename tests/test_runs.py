"""Runs of scorers: where they stop, what they record, and how they go on."""

import pytest

from clausegrain.operators import ensemble, relations, runs


def clauses(spark, n):
    return spark.createDataFrame([(f"c{i:04d}", f"text {i}") for i in range(n)], "clause_id string, text string")


def number(text):
    return int(text.split()[1])


def scorer(dead=(), spent=(), calls=None):
    def ask(texts):
        out = []
        for t in texts:
            k = number(t)
            if k in spent:
                out.append(([], 0.0, "API_ERROR", "429 quota exceeded: requests per day"))
            elif k in dead:
                out.append(([], 0.0, "API_ERROR", "down"))
            else:
                out.append((["Purpose"], 0.9, "SUCCESS", ""))
        return out

    return ask


def state(spark, log):
    return {number("x " + r.clause_id[1:]): r.quality for r in runs.results(spark, log).collect()}


@pytest.mark.parametrize(("parts", "batch"), [(1, 1000), (7, 1000), (4, 7)])
def test_five_failures_in_a_row_end_the_run_whatever_the_partitions(spark, tmp_path, parts, batch):
    n = 24 if batch < 10 else 60
    dead = {3, 4, 5, 6, 8, *range(11, 19), 22}
    log, queue = f"file://{tmp_path}/log", clauses(spark, n).repartition(parts)
    scorers = {m: scorer(dead) for m in ("a", "b", "c")}
    got = runs.run(queue, log, scorers, batch_rows=batch, most_failures=5)
    assert got == runs.Outcome(16, 6, "failures", n - 6)
    assert state(spark, log) == {k: "API_ERROR" if k in dead else "HIGH_CONFIDENCE" for k in range(16)}
    healthy = {m: scorer() for m in ("a", "b", "c")}
    assert runs.run(queue, log, healthy, batch_rows=max(batch, 10)) == runs.Outcome(n - 6, n - 6, "done", 0)
    assert set(state(spark, log).values()) == {"HIGH_CONFIDENCE"} and len(state(spark, log)) == n
    assert runs.run(queue, log, healthy) == runs.Outcome(0, 0, "done", 0)


def test_limits_and_quotas_end_a_run(spark, tmp_path):
    log, queue = f"file://{tmp_path}/log", clauses(spark, 30)
    queue = queue.unionByName(queue.limit(3))  # repeated ids are scored once
    healthy = {m: scorer() for m in ("a", "b")}
    assert runs.run(queue, log, healthy, limit=7, batch_rows=4) == runs.Outcome(7, 7, "limit", 23)
    assert runs.run(queue, log, {"a": scorer(spent={12}), "b": scorer(dead={12})}, batch_rows=10) == runs.Outcome(6, 5, "quota", 18)
    assert state(spark, log)[12] == "API_QUOTA_EXHAUSTED" and max(state(spark, log)) == 12
    assert runs.run(queue.limit(0), log, healthy) == runs.Outcome(0, 0, "done", 0)
    assert runs.results(spark, f"file://{tmp_path}/none") is None


def test_failures_that_others_outvote_do_not_count(spark, tmp_path):
    log = f"file://{tmp_path}/log"
    got = runs.run(clauses(spark, 12), log, {"a": scorer(dead=range(12)), "b": scorer(), "c": scorer()}, batch_rows=5)
    assert got == runs.Outcome(12, 12, "done", 0)
    assert {r.reason for r in runs.results(spark, log).collect()} == {"[1/3 models failed] down"}


def test_nothing_stays_persisted_and_no_column_is_lost(spark):
    rows = spark.createDataFrame([(i % 3, i, i) for i in range(20)], "_k long, _p long, n long")
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = relations.numbered(rows, "n", "n").collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before
    assert sorted((r._k, r._p, r.n, r._rank, r._before) for r in got) == sorted((i % 3, i, i, i, i * (i - 1) // 2) for i in range(20))
    again = relations.duplicates(rows.unionByName(rows.selectExpr("_k", "_p", "n + 100 AS n")), rows._p, "n")
    assert again.columns == ["_k", "_p", "n", "in_group", "is_repeat"]
    assert all(r.in_group and r.is_repeat == (r.n >= 100) for r in again.collect())


def test_combine_tells_why(spark):
    votes = spark.createDataFrame([("c", "a", ["x"], 0.9, "SUCCESS", ""), ("c", "b", [], 0.0, "API_ERROR", "late")], "clause_id string, model string, labels array<string>, confidence double, status string, reason string")
    assert ensemble.combine(votes).first().reason == "[1/2 models failed] late"
