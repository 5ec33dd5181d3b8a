"""Every query with SQL gives that SQL's rows."""

import math
import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    sql = duck.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(sql.columns)
    at = [sql.columns.index(c) for c in columns]
    assert sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr) == sorted((tuple(plain(r[i]) for i in at) for r in sql.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 14


def test_greedy_split_gates(spark):
    split = {r.doc_id: r.split for r in entry.queries()["split_greedy"](spark, DATA).collect()}
    assert set(split.values()) == {"train", "validation", "test"}


def test_stream_equals_batch(spark):
    got = {tuple(r) for r in entry.queries()["resume_stream"](spark, DATA).collect()}
    rows = spark.read.parquet(f"{DATA}/events.parquet").collect()
    last = {}
    for r in rows:
        if r.user_id not in last or r.event_id > last[r.user_id].event_id:
            last[r.user_id] = r
    assert got == {(r.user_id, r.event_id, r.event_type, r.value) for r in last.values()}


def test_seed_batch_takes_five_a_document(spark):
    rows = entry.queries()["seed_batch"](spark, DATA).groupBy("doc_id").count().collect()
    assert rows and max(r["count"] for r in rows) == 5
