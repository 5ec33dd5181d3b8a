"""Vector codes, top-k search and importance resampling on small tables, against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from clausegrain.llm import resample, topk, veccodes

NAN, INF = float("nan"), float("inf")


def vectors_of(n, dims, seed=1):
    """Rows with copies, nulls, odd components, short and empty vectors, repeated ids and a null id."""
    r = random.Random(seed)
    rows = [(i, [round(r.gauss(0, 0.3), 3) for _ in range(dims)], r.choice([0, 1, 2, None])) for i in range(n)]
    same = rows[3][1]
    rows += [(1000 + i, same, 1) for i in range(60)]
    rows += [(2001, None, 1), (2002, [0.5] * (dims - 1) + [None], 1), (2003, [NAN] * dims, 2), (2004, [INF] + [0.0] * (dims - 1), 2), (2005, [0.25, -0.25], 3), (2006, [], 3), (2100, [0.0] * dims, None)]
    return [*rows, rows[100], rows[100], rows[5], (None, rows[7][1], 1)]


def table_of(spark, rows):
    return spark.createDataFrame([(*x, "clash", 9) for x in rows], "vec_id long, embedding array<float>, label int, row string, block int").repartition(5)


def kept(rows, dims):
    out = []
    for i, v, label in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(1024 * float(np.float32(x))) for x in v]
            out.append((i, whole + [0] * (dims - len(whole)), label))
    return out


# ---------------------------------------------------------------- top-k


def best(rows, dims, k):
    rows = [r for r in kept(rows, dims) if r[0] is not None]
    out = []
    for i, q, _ in rows:
        if i % 100 == 0:
            scores = sorted(((-int(np.dot(q, c)), j) for j, c, _ in rows if j != i))[:k]
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize(("k", "block", "sample"), [(10, 64, 16), (10, 1 << 16, 4096), (3, 40, 1), (700, 64, 4096)])
def test_search_finds_the_k_best_of_each_query(spark, k, block, sample):
    rows = vectors_of(500, 6)
    got = topk.search(table_of(spark, rows), k=k, block=block, sample=sample)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect())) == best(rows, 6, k)


def test_search_of_few_rows_gives_all_and_of_none_nothing(spark):
    rows = [(0, [1.0, 2.0], 1), (100, [0.5, -1.0], 1), (7, [3.0, 3.0], 1)]
    got = topk.search(table_of(spark, rows)).collect()
    assert sorted(map(tuple, got)) == best(rows, 2, 10) and len(got) == 4
    assert topk.search(table_of(spark, rows).limit(0)).count() == 0


def test_reading_stops_before_the_lists_end():
    r = np.random.default_rng(2)
    rows = np.floor(r.pareto(1.5, (20_000, 3)) * 100).astype(np.int64)
    block = topk.Block(np.arange(20_000), rows)
    query = np.array([5, 3, 0])
    found, seen, _ = block.read(-1, query, 10, None, True)
    scores = rows @ query
    order = np.lexsort((np.arange(20_000), -scores))[:10]
    assert seen is None and found == [(int(scores[i]), int(i)) for i in order]


def test_large_components_are_still_exact():
    rows = np.array([[1 << 40, 1], [1 << 40, 2], [-(1 << 40), 5]], np.int64)
    block = topk.Block(np.arange(3), rows)
    query = np.array([[1 << 20, 1]])
    assert not block.exact(query)
    assert block.answers(np.array([-1]), query, [None], 2) == [[((1 << 60) + 2, 1), ((1 << 60) + 1, 0)]]


# ---------------------------------------------------------------- codes


def coded(rows, dims, parts, entries, rounds):
    rows, width = kept(rows, dims), dims // parts
    first = sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1]))[:entries]
    books = [[r[1][p * width : (p + 1) * width] for r in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = {}
            for _, v, _ in rows:
                x = v[p * width : (p + 1) * width]
                held.setdefault(near(x, books[p])[1], []).append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*held[k], strict=True)] if k in held else c for k, c in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out = []
    for i, v, label in rows:
        found = [near(v[p * width : (p + 1) * width], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    by = Counter()
    for _, _, e, label in out:
        by[label] += e
    return sorted(((i, c, e, by[label], digest) for i, c, e, label in out), key=str)


@pytest.mark.parametrize(("entries", "rounds"), [(16, 4), (256, 2), (5, 0)])
def test_codes_are_those_of_plain_rounds(spark, entries, rounds):
    rows = vectors_of(220, 8)
    got = veccodes.codes(table_of(spark, rows), entries=entries, rounds=rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == coded(rows, 8, 4, entries, rounds)


def test_codes_of_odd_lengths_and_of_no_rows(spark):
    rows = [(2, [0.5, 0.25, -1.0, 2.0, 1.0], 1), (1, [0.5], None), (3, [], None), (None, [9.0], 2)]
    got = veccodes.codes(table_of(spark, rows), entries=2)
    assert sorted(map(tuple, got.collect()), key=str) == coded(rows, 8, 4, 2, 4)
    assert veccodes.codes(table_of(spark, rows).limit(0)).count() == 0


def test_wide_values_keep_their_distances():
    block = np.array([[[1 << 30, -(1 << 30)]]], np.int64)
    codes, errors = veccodes.nearest(block, np.array([[[0], [-(1 << 30)]]], np.int64))
    assert codes.tolist() == [[0, 1]] and errors.tolist() == [[1 << 60, 0]]


# ---------------------------------------------------------------- resampling


def low(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s or "")


def words_of(s):
    plain = "".join(c if c.isascii() and c.isalnum() or ord(c) > 127 else " " for c in low(s))
    return [w for w in plain.split(" ") if w]


def drawn(docs, target, percent, least, longest, seed=2024, buckets=10_000):
    def runs(t):
        w = words_of(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = (Counter(b for x in texts for b in runs(x)) for texts in ([x for _, x in docs], target))
    n_s, n_t = sum(s.values()), sum(t.values())
    out = []
    for k, (i, text) in enumerate(docs):
        f = runs(text)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)), k])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for rank, x in enumerate(able[: percent * len(able) // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=str)


R = random.Random(9)
VOCABULARY = ["".join(R.choice("abcdeéß0") for _ in range(R.randint(1, 5))) for _ in range(60)]
DOCS = [(i, " ".join(R.choice(VOCABULARY) for _ in range(R.randint(0, 60)))) for i in range(300)]
DOCS += [(500, None), (501, ""), (502, " \n--\t "), (503, "word " * 3000), (504, "x" * 5000), (7, DOCS[7][1]), (7, DOCS[7][1]), (7, DOCS[7][1]), (None, "Null ID, but MANY words: " + "a B c " * 20), (505, "É́ ÀB zß " * 30)]
TARGET = [" ".join(R.choice(VOCABULARY[:12]) for _ in range(40)) for _ in range(12)] + [None, ""]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in DOCS], "doc_id long, text string, score string, rank int").repartition(4), spark.createDataFrame([(t,) for t in TARGET], "text string")


@pytest.mark.parametrize(("percent", "least", "longest", "rows", "batch", "run"), [(10, 20, 1, 1 << 18, 512, 1 << 22), (60, 5, 1, 7, 4, 30), (100, 0, 3, 16, 8, 64), (0, 20, 1, 8, 8, 64)])
def test_draws_are_those_of_a_plain_sort(spark, texts, monkeypatch, percent, least, longest, rows, batch, run):
    monkeypatch.setattr(resample, "BATCH_ROWS", batch)
    monkeypatch.setattr(resample, "RUN_ROWS", run)
    monkeypatch.setattr(resample, "PIECE", 100)
    got = resample.resampled(*texts, percent=percent, least_words=least, longest=longest, range_rows=rows)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == drawn(DOCS, TARGET, percent, least, longest)


def test_draws_from_nothing_and_towards_nothing(spark, texts):
    docs, target = texts
    assert resample.resampled(docs.limit(0), target).count() == 0
    assert sorted(map(tuple, resample.resampled(docs, target.limit(0)).collect()), key=str) == drawn(DOCS, [], 10, 20, 1)


def test_ranges_end_where_the_draw_is_full():
    assert resample.ranges([(9, 3), (7, 1), (5, 10), (2, 4)], 5, 4) == [(9, 7, 0), (5, 5, 4)]
    assert resample.ranges([(9, 3), (7, 1)], 0, 4) == []
    assert resample.ranges([(9, 3), (7, 1)], 4, 100) == [(9, 7, 0)]
