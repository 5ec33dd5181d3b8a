"""TF-IDF as a relation against a plain count, and regressions of all categories against dense ones and against Spark's."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from clausegrain.operators import learning, linear
from clausegrain.sources.scratch import written

R = random.Random(4)
WORDS = [f"w{i}é" for i in range(40)]
CATEGORIES = ["a", "b", "c", "never"]


def corpus(n):
    out = []
    for i in range(n):
        words = [R.choice(WORDS) for _ in range(R.randint(0, 25))]
        labels = [c for c, marks in (("a", WORDS[:3]), ("b", WORDS[3:5]), ("c", WORDS[20:30])) if set(marks) & set(words) and R.random() < 0.9]
        out.append((i, " ".join(words).upper() + R.choice(["", " x !", "\n"]), labels))
    return [*out, (n, None, []), (n + 1, "", ["a"])]


ROWS = corpus(300)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "id long, text string, labels array<string>").repartition(5)


def vectors(size, sublinear=True):
    counts = {}
    for i, text, _ in ROWS:
        words = re.findall(r"\w\w+", (text or "").lower())
        counts[i] = Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))])
    total, df = Counter(), Counter()
    for c in counts.values():
        total.update(c)
        df.update(c.keys())
    known = sorted(sorted(total, key=lambda t: (-total[t], t))[:size])
    at = {t: k for k, t in enumerate(known)}
    x = np.zeros((len(ROWS), len(known)))
    for i, c in counts.items():
        for t, k in c.items():
            if t in at:
                x[i, at[t]] = ((1 + math.log(k)) if sublinear else k) * (math.log((1 + len(ROWS)) / (1 + df[t])) + 1)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return known, x / np.where(norm == 0, 1, norm)


@pytest.mark.parametrize(("size", "sublinear"), [(60, True), (10_000, False)])
def test_weights_are_those_of_a_plain_count(spark, rows, size, sublinear):
    known, x = vectors(size, sublinear)
    model = linear.fit_vocabulary(rows, "id", size=size, sublinear=sublinear)
    assert [r.term for r in model.known.orderBy("term_id").collect()] == known and model.size == len(known)
    got = np.zeros_like(x)
    for r in model.vectors(rows, "id").collect():
        got[r.id, r.ids] = r.weights
    np.testing.assert_allclose(got, x, atol=1e-12)


def dense(x, y, rounds=50):
    """Newton's steps for |w|^2 / 2 + the balanced losses."""
    z, w = np.hstack([x, np.ones((len(x), 1))]), np.zeros(x.shape[1] + 1)
    s = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    free = np.diag([1.0] * x.shape[1] + [0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(free + z.T @ (z * (s * p * (1 - p))[:, None]), free @ w + z.T @ (s * (p - y)))
    return w


def test_all_categories_reach_their_minimum_in_shared_passes(spark, rows, monkeypatch):
    _, x = vectors(60)
    model, found = learning.train(rows, CATEGORIES, vocabulary=60, most=300)
    assert list(found) == ["a", "b", "c"]
    for c, w in found.items():
        y = np.array([c in labels for _, _, labels in ROWS], float)
        np.testing.assert_allclose(w, dense(x, y), atol=2e-3)
    chances = {(r.id, r.category): r.y_prob for r in learning.predict(rows, model, found, "id").collect()}
    assert len(chances) == 3 * len(ROWS)
    for c, w in found.items():
        np.testing.assert_allclose([chances[i, c] for i in range(len(ROWS))], 1 / (1 + np.exp(-(x @ w[:-1] + w[-1]))), atol=1e-9)


def test_a_pass_serves_every_category(spark, rows):
    model = linear.fit_vocabulary(rows, "id", size=60)
    y = F.array(*(F.array_contains("labels", c).cast("byte") for c in ("a", "b", "c"))).alias("y")
    empty = lambda c, t: F.coalesce(c, F.array().cast(f"array<{t}>")).alias(c)
    data = rows.select("id", y).join(model.vectors(rows, "id"), "id", "left").select(empty("ids", "int"), empty("weights", "double"), "y")
    blocks = written(linear.packed(data, 3), "blocks")
    one = [linear.descend(written(linear.packed(data.withColumn("y", F.slice("y", k + 1, 1)), 1), "one"), model.size, np.ones((2, 1)))[1] for k in range(3)]
    w, passes = linear.descend(blocks, model.size, np.ones((2, 3)))
    assert w.shape == (61, 3) and passes == max(one)


def test_the_same_f1_as_sparks_regressions(spark, rows):
    model, found = learning.train(rows, CATEGORIES, vocabulary=60)
    data = written(rows.join(model.vectors(rows, "id"), "id", "left"), "vectors")
    table = data.select("id", "labels", array_to_vector(F.transform(F.sequence(F.lit(0), F.lit(model.size - 1)), lambda k: F.coalesce(F.try_element_at(F.map_from_arrays("ids", "weights"), k.cast("int")), F.lit(0.0)))).alias("features")).persist()
    ours = {(r.id, r.category): r.y_prob for r in learning.predict(rows, model, found, "id").collect()}

    def f1(chances, truth):
        hit = sum(chances[i] > 0.5 and t for i, t in truth.items())
        return 2 * hit / max(1, sum(p > 0.5 for p in chances.values()) + sum(truth.values()))

    for c in found:
        y = F.array_contains("labels", c)
        n, pos = len(ROWS), sum(c in labels for _, _, labels in ROWS)
        weighted = table.select("id", "features", y.cast("double").alias("label"), F.when(y, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))).alias("weight"))
        total = weighted.agg(F.sum("weight")).first()[0]
        lr = LogisticRegression(weightCol="weight", regParam=1 / total, standardization=False, maxIter=200).fit(weighted)
        theirs = {r.id: r.p for r in lr.transform(weighted).select("id", vector_to_array("probability")[1].alias("p")).collect()}
        truth = {i: c in labels for i, _, labels in ROWS if i in theirs}
        assert abs(f1(theirs, truth) - f1({i: ours[i, c] for i in theirs}, truth)) <= 0.01
    table.unpersist()


def test_terms_are_counted_without_all_pairs(spark, rows, monkeypatch):
    """Only pairs whose words are frequent enough themselves are counted, with ties at the limit, and the vocabulary is that of all pairs."""
    from collections import Counter as C

    rare = [(i, " ".join(f"x{i}y{k}" for k in range(50)) + " one two one two", []) for i in range(40)]
    table = spark.createDataFrame(rare, "id long, text string, labels array<string>")
    total = C()
    for _, text, _ in rare:
        words = text.split()
        total.update([*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))])
    made = []
    monkeypatch.setattr(linear, "written", lambda df, name, put=written: made.append((name, put(df, name))) or made[-1][1])
    monkeypatch.setattr(linear, "dropped", lambda df: None)
    for size in (2, 3, 5, 30):
        model, counted = linear.fit_counted(table, "id", size=size)
        assert sorted(r.term for r in model.known.collect()) == sorted(sorted(total, key=lambda t: (-total[t], t))[:size])
        assert counted.count() <= 40 * 4 + size  # no row for a term outside the vocabulary
    assert {n for n, _ in made} == {"tokens", "words", "terms", "counts", "vocabulary"}


def test_rows_are_scaled_where_they_are_packed(spark, rows):
    """Packed blocks of unscaled vectors are those of scaled ones, no function on arrays does it row by row, and rows without a known term hold nothing."""
    model, counted = linear.fit_counted(rows, "id", size=60)
    raw = model.unscaled(counted, "id")
    assert "lambda" not in raw._jdf.queryExecution().optimizedPlan().toString()
    n, empty, y = 0, 0, F.array(F.lit(1).cast("byte")).alias("y")
    for block in linear.packed(rows.select("id", y).join(raw, "id", "left"), 1).collect():
        of, weights = np.frombuffer(block.rows, "<i4"), np.frombuffer(block.weights, "<f8")
        lengths = np.bincount(of, weights * weights, minlength=block.n)
        n, empty = n + block.n, empty + int((lengths == 0).sum())
        np.testing.assert_allclose(lengths[lengths > 0], 1)
    assert n == len(ROWS) and empty == n - raw.count() > 0
