"""Work that must not explode: long chains of links, and URLs of many tokens."""

import itertools
import random
import time

from clausegrain.llm import simhash, urlrules


def test_a_sorted_chain_takes_few_rounds(spark, monkeypatch):
    rounds, plain = [], simhash.materialize
    monkeypatch.setattr(simhash, "materialize", lambda df, name: (rounds.append(name), plain(df, name))[1])
    chain = spark.range(999).selectExpr("id AS fp", "id + 1 AS hub").unionByName(spark.range(2000, 2005).selectExpr("id AS fp", "2000L AS hub"))
    got = {r.node: r.root for r in simhash.components(chain).collect()}
    assert got == {k: 0 for k in range(1000)} | {k: 2000 for k in range(2000, 2005) if k != 2000} | {2000: 2000}
    assert rounds.count("hooks") <= 24
    rounds.clear()
    star = spark.range(1, 500).selectExpr("id AS fp", "0L AS hub").unionByName(spark.range(600, 999).selectExpr("id AS fp", "999L AS hub"))
    got = {r.node: r.root for r in simhash.components(star).collect()}
    assert got == {k: 0 for k in range(500)} | {k: 600 for k in range(600, 1000)} and rounds.count("hooks") <= 3


def mined(spark, rows, support=0.01, confidence=0.5):
    table = spark.createDataFrame([(list(t), v) for t, v in rows], "tokens array<string>, verdict string")
    return {(tuple(r.tokens), round(r.confidence, 9)) for r in urlrules.mine(table, support, confidence).collect()}


def test_thirty_segments_of_equal_urls_are_one_item(spark):
    r = random.Random(2)
    rows = [({f"path:{r.randrange(40)}", "last:com"}, "allow" if k % 3 else "block") for k in range(300)] + [({f"path:s{i:02d}" for i in range(30)} | {"last:com"}, "block")] * 5
    began = time.perf_counter()
    got = mined(spark, rows)
    assert {(f"path:s{i:02d}",) for i in range(30)} == {t for t, c in got if c == 1.0 and t[0].startswith("path:s")} and time.perf_counter() - began < 60


def test_a_template_of_many_segments_costs_as_much_as_one(spark):
    template = {f"path:t{i:02d}" for i in range(25)}
    rows = [(template | {f"host:{k % 4}"}, "block" if k % 4 == 0 and k % 8 else "allow") for k in range(200)] + [({"host:0", "path:own"}, "allow")] * 10
    got = mined(spark, rows)
    # half of host 0 under the template is bad, and less of host 0 altogether
    assert got == {(tuple(sorted(("host:0", t))), 0.5) for t in template}


def test_rules_are_those_of_all_sets_where_tokens_share_rows(spark):
    r = random.Random(8)
    names = [f"x:{c}" for c in "abcdefg"]
    for _ in range(2):
        rows = []
        for _ in range(120):
            own = {t for t in names if r.random() < 0.4}
            own |= {"x:twin"} if "x:a" in own else set()  # twin lies where a does
            rows.append((own, "block" if len(own & {"x:a", "x:b", "x:c"}) > 1 and r.random() < 0.8 else "allow"))
        hits = {}
        for tokens, verdict in rows:
            for n in range(1, len(tokens) + 1):
                for s in itertools.combinations(sorted(tokens), n):
                    hits.setdefault(frozenset(s), []).append(verdict == "block")
        found = {s: sum(v) / len(v) for s, v in hits.items() if sum(v) >= 0.02 * len(rows) and sum(v) / len(v) >= 0.5}
        want = {(tuple(sorted(s)), round(c, 9)) for s, c in found.items() if not any(found.get(s - {x}, -1) >= c for x in s)}
        assert mined(spark, rows, 0.02) == want


def test_nothing_bad_mines_nothing(spark):
    assert mined(spark, [({"a"}, "allow")]) == set() and mined(spark, [(set(), "block")] * 3) == set()
