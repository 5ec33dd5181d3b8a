"""Boundaries and cuts of long texts: same rows as plain searches, in time linear in the text."""

import random
import re
import time

import pytest

from clausegrain.operators import segment

R = random.Random(3)
TOKENS = ["\n", "\n\n", " ", "  \n", "\t", "(a)", "(iv)", "(IV)", "(12)", "1.", "1.2)", "ARTICLE IV:", "Section 3 ", "SECTION X.", "WHEREAS", "foo", "Bar", "A", "HEADING WORDS HERE", "12 of", "(b) X", "1.2 Y", " "]


@pytest.mark.parametrize("patterns", [segment.V1_BOUNDARIES, segment.V2_BOUNDARIES, segment.V3_BOUNDARIES])
def test_boundaries_are_those_of_plain_searches(patterns):
    found, plain = segment.Boundaries(patterns), [re.compile(p, re.M) for p in patterns]
    for _ in range(5000):
        text = "".join(R.choice(TOKENS) for _ in range(R.randint(0, 14)))
        assert found.of(text) == {m.start() for p in plain for m in p.finditer(text)}, text


def plain_cut(text, least, most):
    """The rule word by word, without care for time."""
    starts = sorted({m.start() for p in segment.V1_BOUNDARIES for m in re.finditer(p, text, re.M)} | {m.start() for m in re.finditer(segment.V1_HEADING, text, re.M) if len(m[0].strip()) >= 8})
    spans = [(a, b) for a, b in zip(starts, [*starts[1:], len(text)])] or [(0, len(text))]
    if starts and starts[0] > 0 and text[: starts[0]].strip():
        spans = [(0, starts[0]), *spans]
    joined = []
    for a, b in spans:
        joined = [*joined[:-1], (joined[-1][0], b)] if joined and len(text[a:b].strip()) < least else [*joined, (a, b)]
    out = []
    for a, b in joined:
        if len(text[a:b].strip()) <= most:
            out.append((a, b))
            continue
        at = a
        for piece in re.split(r"(\n\n+)", text[a:b]):
            if not re.fullmatch(r"\n\n+", piece):
                out.append((at, at + len(piece)))
            at += len(piece)
    return [(a, b) for a, b in out if text[a:b].strip()]


def test_cuts_are_those_of_the_plain_rule():
    for _ in range(3000):
        text = "".join(R.choice(TOKENS) for _ in range(R.randint(0, 30)))
        assert list(segment.cut(text, 6, 25)) == plain_cut(text, 6, 25), text


def test_ten_megabytes_take_seconds():
    clause = "1. Scope of this agreement\n\nThe parties shall keep (a) all information confidential; see (b) below.\n (ii) more words of the clause\nARTICLE IV: HEADING\n"
    began = time.perf_counter()
    n = sum(1 for _ in segment.cut(clause * (10_000_000 // len(clause))))
    assert n > 60_000 and sum(1 for _ in segment.cut("\n" * 2_000_000 + "x" + " \n" * 2_000_000)) == 1
    assert time.perf_counter() - began < 30


def test_clauses_of_a_long_text_leave_in_parts(spark):
    text = "1. A clause that is long enough to stand alone\n" * 12_000
    docs = spark.createDataFrame([("d", text), ("e", None), ("f", " \n"), ("g", "short")], "document_id string, text string")
    rows = segment.segment_v1(docs).collect()
    assert len(rows) == 12_001 and {(r.document_id, r.clause_id) for r in rows} >= {("d", "d_clause_11999"), ("g", "g_clause_000")}
    assert all(r.document_id == "g" or text[r.start : r.end].strip() == r.text for r in rows)


def test_upper_case_by_letter_keeps_lengths(spark):
    from pyspark.sql import functions as F

    from clausegrain.functions.text import upper_by_letter

    rows = spark.createDataFrame([("Zuenschßä stpf sch.",), ("ﬁn ᾳ ŉ",), ("plain É é",), ("",), (None,)], "t string")
    got = [r[0] for r in rows.select(upper_by_letter(F.col("t"))).collect()]
    assert got == ["ZUENSCHẞÄ STPF SCH.", "ﬁN ᾼ ŉ", "PLAIN É É", "", None]
