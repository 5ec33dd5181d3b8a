"""Strict CSV by byte ranges gives what one reader over the whole file gives."""

import csv
import io
import random

import pytest

from clausegrain.sources import files, strict


@pytest.fixture
def small_ranges(spark):
    """Byte ranges of a few lines, so that files split anywhere."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def field(r):
    kind = r.random()
    body = "".join(r.choice('ab,"\n \r\n;é') for _ in range(r.choice([0, 1, 3, 8, 60])))
    if kind < 0.4:
        return '"' + body.replace('"', '""') + '"'
    plain = "".join(c for c in body if c not in ',"\n\r')
    return plain + r.choice(["", "", '"', '"x"', '""']) if plain else plain  # quotes inside an unquoted field are text


def content(seed, records):
    r = random.Random(seed)
    out = ["﻿" * (seed % 2), "\n" * (seed % 3), "a,b,c\n"]
    for _ in range(records):
        out.append(",".join(field(r) for _ in range(3)) + r.choice(["\n", "\n", "\r\n", "\r"]))
        out.append(r.choice(["", "", "", "\n"]))
    return "".join(out)


def whole(text):
    rows = [x for x in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if x]
    return sorted(map(tuple, rows[1:]))


@pytest.mark.parametrize(("seed", "size"), [(1, 40), (2, 61), (3, 100), (4, 257), (5, 1 << 20)])
def test_ranges_give_the_rows_of_one_reader(spark, tmp_path, small_ranges, seed, size):
    small_ranges(size)
    text = content(seed, 90)
    (tmp_path / "f.csv").write_bytes(text.encode())
    got = files.strict_csv(spark, str(tmp_path / "f.csv"))
    assert got.columns == ["a", "b", "c"]
    assert sorted(map(tuple, got.collect())) == whole(text)


def test_a_state_at_a_lines_end_is_that_of_a_reader():
    r = random.Random(7)
    for _ in range(5000):
        line = "".join(r.choice('a,"\r') for _ in range(r.randint(0, 9)))
        for inside in (False, True):
            text = ('"' if inside else "") + line + "\nMARK"
            last = list(csv.reader(io.StringIO(text, newline="")))[-1]
            assert strict.ends_inside(line, inside) == (last != ["MARK"]), (line, inside)


def test_records_over_many_ranges_and_many_files(spark, tmp_path, small_ranges):
    small_ranges(500)
    long = "\n".join(f'line {i}, "" or so' for i in range(400))
    folder = tmp_path / "many"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.csv").write_text(f'id,text\n{k},"{long}"\n9,"\n""\n"\n')
    got = sorted(map(tuple, files.strict_csv(spark, str(folder)).collect()))
    assert got == sorted([(str(k), long.replace('""', '"')) for k in range(3)] + [("9", '\n"\n')] * 3)
    (folder / "3.csv").write_text("id,other\n1,2\n")
    with pytest.raises(Exception, match="another header"):
        files.strict_csv(spark, str(folder)).collect()


@pytest.mark.parametrize(("body", "said"), [("x,y\n" * 40 + "odd\n" + "x,y\n" * 40, "line 42 has 1 fields"), ("x,y\n" * 40 + '"a\nb\nc",d,e\n' + "x,y\n" * 9, "line 44 has 3 fields"), ('x,"y\n' + "x\n" * 50, "nothing closes")])
@pytest.mark.parametrize("size", [16, 1 << 20])
def test_errors_name_their_line(spark, tmp_path, small_ranges, body, said, size):
    small_ranges(size)
    (tmp_path / "f.csv").write_text("a,b\n" + body)
    with pytest.raises(Exception, match=said):
        files.strict_csv(spark, str(tmp_path / "f.csv")).collect()


def test_empty_files_and_headers_alone(spark, tmp_path):
    (tmp_path / "h.csv").write_text("\na,b\n")
    assert files.strict_csv(spark, str(tmp_path / "h.csv")).count() == 0
    (tmp_path / "e.csv").write_text("\n\n")
    with pytest.raises(ValueError, match="empty"):
        files.strict_csv(spark, str(tmp_path / "e.csv"))
