"""Records of JSON that comes in pieces are those of a parser that has it whole."""

import json
import random

import pytest

from clausegrain.sources import files, json_records

IDENTITY, LABELS = files.IDENTITY_FIELDS, files.LABEL_FIELDS


def whole(text):
    stack, n, hits = [json.loads(text)], 0, 0
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            names = {k.lower(): v for k, v in x.items()}
            n += 1
            hits += any(names.get(f) for f in IDENTITY) and any(names.get(f) not in (None, "", [], {}) for f in LABELS)
            stack += x.values()
        elif isinstance(x, list):
            stack += x
    return n, hits


def value(r, depth):
    kind = r.randrange(9 if depth else 6)
    if kind < 6:
        return [None, True, False, r.choice([0, -0.0, 1.5, 1e9]), "", r.choice(['x', 'a}b{"\\', "é\n", "}}}", " "])][kind]
    if kind == 6:
        return [value(r, depth - 1) for _ in range(r.randrange(4))]
    return {r.choice(["id", "Labels", "TEXT", "category", "other", "a}", "label\\"]): value(r, depth - 1) for _ in range(r.randrange(5))}


def in_pieces(text, r):
    found = json_records.Records(frozenset(IDENTITY) | frozenset(LABELS), lambda names: any(names.get(f, (0,))[0] for f in IDENTITY) and any(names.get(f, (0, 0))[1] for f in LABELS))
    parts = text.split("}")
    for k, part in enumerate(parts):
        found.feed(part + ("}" if k < len(parts) - 1 else ""))
    found.end()
    return found.records, found.candidates


def test_pieces_give_what_the_whole_gives():
    r = random.Random(3)
    for _ in range(3000):
        text = json.dumps(value(r, 4), ensure_ascii=r.random() < 0.5, indent=r.choice([None, 1]))
        assert in_pieces(text, r) == whole(text), text


def test_what_is_no_json_is_refused():
    for text in ("", " ", "{", "[1,]", '{"a" 1}', '{"a":1,}', "[1 2]", "nul", "{1:2}", '"\n"', '"\\x"', "[}", "1 2", '{"a":1}}', "01", "[1]x", '"open'):
        with pytest.raises(ValueError):
            json.loads(text)
        with pytest.raises(ValueError):
            in_pieces(text, None)


def test_files_of_all_kinds(spark, tmp_path):
    r, want = random.Random(5), {}
    (tmp_path / "deep").mkdir()
    for k in range(12):
        text = json.dumps([value(r, 3) for _ in range(30)])
        (tmp_path / "deep" / f"{k} x.json").write_text(text)
        want[f"{k}%20x.json"] = (*whole(text), False)
    (tmp_path / "bad.json").write_text('[{"id": 1, "label": "x"}')
    (tmp_path / "none.json").write_text("")  # passed over
    (tmp_path / "blank.json").write_text("\n")
    (tmp_path / "bom.JSON").write_text('﻿{"id": 1, "label": "x"}', encoding="utf-8")
    (tmp_path / "l.jsonl").write_text('{"id": 1, "label": "x"}\n\n[{"id": 0, "label": "x"}]\n')
    (tmp_path / "m.jsonl").write_text('{"id": 1, "label": "x"}\n{\n')
    (tmp_path / "t.csv").write_text('ID,Label,x\n1,"a\nb",2\n2,,3\n,a,3\n\n')
    (tmp_path / "t.tsv").write_text("id\tlabel\n1\tx\n2\n")
    (tmp_path / "t.txt").write_text('{"id": 1, "label": "x"}')
    (tmp_path / "t.md").write_text("{}")
    want |= {"bad.json": (0, 0, True), "blank.json": (0, 0, True), "bom.JSON": (1, 1, False), "l.jsonl": (2, 1, False), "m.jsonl": (0, 0, True), "t.csv": (3, 1, False), "t.tsv": (2, 1, False), "t.txt": (0, 0, False)}
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("300", old):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = {x.path.rsplit("/", 1)[1]: (x.records, x.candidates, x.problem is not None) for x in files.label_audit(spark, str(tmp_path)).collect()}
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == want
