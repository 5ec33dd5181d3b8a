"""Counters of a stream equal those of a batch, whatever comes late or again."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clausegrain.streaming import counters, resume

ACTIONS = {"ok": "accepted", "no": "overridden", "own": "manual"}
SCHEMA = "who string, at timestamp, n long, did string"


def at(hours):
    return datetime(2024, 1, 1) + timedelta(hours=hours)


def add(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def run(spark, folder):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    counters.count_stream(stream, f"{folder}/state", f"{folder}/cp", "who", "at", "n", "did", ACTIONS, "2 hours").awaitTermination()
    return {r.who: r for r in counters.counters(spark, f"{folder}/state", "who", ACTIONS).collect()}


@pytest.mark.parametrize("compact", [16, 2])
def test_late_rows_count_and_are_told(spark, tmp_path, monkeypatch, compact):
    monkeypatch.setattr(resume, "COMPACT", compact)
    folder = str(tmp_path)
    add(spark, f"{folder}/in", [("a", at(0), 1, "ok"), ("a", at(5), 2, "no"), ("b", at(1), 3, "own"), (None, at(1), 4, None)])
    got = run(spark, folder)
    assert got["a"].asDict() == {"who": "a", "reviewed": 2, "accepted": 1, "overridden": 1, "manual": 0, "late": 0, "first_time": at(0), "last_time": at(5), "last_action": "no"}
    assert got[None].reviewed == 1 and got[None].accepted == 0 and got[None].last_action is None
    add(spark, f"{folder}/in", [("a", at(2), 5, "ok"), ("b", at(4), 6, "ok"), ("c", at(2.5), 7, "own")])  # three hours and a half behind the newest, one, two and a half
    got = run(spark, folder)
    assert (got["a"].late, got["b"].late, got["c"].late) == (1, 0, 1)
    assert (got["a"].reviewed, got["a"].accepted, got["a"].last_action, got["a"].last_time) == (3, 2, "no", at(5))
    add(spark, f"{folder}/in", [("b", at(9), 8, "no"), ("b", at(9), 9, "own")])
    got = run(spark, folder)
    assert (got["b"].reviewed, got["b"].last_action, got["b"].overridden, got["b"].manual) == (4, "own", 1, 2)
    whole = counters.reduced(spark.read.parquet(f"{folder}/in"), "who", "at", "n", "did", ACTIONS).drop("late")
    kept = resume.kept(spark, f"{folder}/state", lambda rows: counters.merged(rows, "who", list(ACTIONS.values()))).drop("late")
    assert sorted(map(str, whole.collect())) == sorted(map(str, kept.collect()))


def test_a_batch_that_is_repeated_counts_once(spark, tmp_path):
    folder, merge = f"{tmp_path}/s", lambda rows: counters.merged(rows, "who", list(ACTIONS.values()))
    rows = spark.createDataFrame([("a", at(0), 1, "ok")], SCHEMA)
    for _ in range(2):
        resume.record(counters.reduced(rows, "who", "at", "n", "did", ACTIONS), 0, folder, merge)
    assert counters.counters(spark, folder, "who", ACTIONS).first().reviewed == 1
    totals = spark.createDataFrame([("a", 5), ("z", 2), ("y", 0)], "who string, total long")
    left = {r.who: (r.reviewed, r.unreviewed) for r in counters.counters(spark, folder, "who", ACTIONS, totals).collect()}
    assert left == {"a": (1, 4), "z": (0, 2), "y": (0, 0)}
    assert counters.counters(spark, f"{tmp_path}/none", "who", ACTIONS) is None


def test_events_as_decisions(spark, tmp_path):
    events = spark.createDataFrame([(k % 4, at(k), k, ["click", "error", "view", "signup"][k % 3 if k % 5 else 3]) for k in range(60)], "user_id long, ts timestamp, event_id long, event_type string")
    events.coalesce(1).write.parquet(f"{tmp_path}/events")
    got = counters.of_events(spark, f"{tmp_path}/events", str(tmp_path / "f"))
    want = events.groupBy("user_id").agg(F.expr("count_if(event_type <> 'signup') AS reviewed"), F.expr("count_if(event_type = 'click') AS accepted"), F.expr("greatest(0, 2 * count_if(event_type = 'signup') - count_if(event_type <> 'signup')) AS unreviewed"))
    assert sorted(map(tuple, got.select("user_id", "reviewed", "accepted", "unreviewed").collect())) == sorted(map(tuple, want.collect()))
