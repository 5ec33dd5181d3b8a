"""Strict CSV of files of any size: byte ranges of one file are parsed by many tasks.

Spark's text reader deals a file's lines out by byte range. Whether a range begins inside a quoted field depends on all ranges before it, yet a range maps
either way of beginning to a way of ending; so one pass works out that map for each range, and a prefix over the ranges (the last range that ends the same way
however it begins, and the parity of those since that swap the two) says how each begins. A second pass parses each range's records;
records that cross an edge are gathered from their pieces, a group for each, and parsed by themselves. What is broadcast is a row for each range (some hundred bytes for 128 MB of a file).
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

#: Characters of a field at most; a quote that nothing closes ends here at the latest.
LONGEST_FIELD = 1 << 26
#: Lines that are looked at for the header.
HEADER_LINES = 1000
NEXT_FIELD, NEXT_QUOTE = re.compile(r"[,\r]"), re.compile(r'[,\r]"')
LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)")
RANGE = "path string, start long, lines long, out_ends boolean, out_tail long, in_ends boolean, in_tail long"


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted field is open at a line's end, if one is (or none is) at its start."""
    at = 0
    while True:
        if inside:
            at = line.find('"', at) + 1
            if not at:
                return True
            if line.startswith('"', at):
                at += 1
                continue
            found = NEXT_FIELD.search(line, at)  # a closed field goes on to the next delimiter, whatever its quotes
            if not found:
                return False
            at, inside = found.end(), False
        if line.startswith('"', at):
            at, inside = at + 1, True
            continue
        found = NEXT_QUOTE.search(line, at)
        if not found:
            return False
        at, inside = found.end(), True


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, bool]]:
    """Batches cut where another range begins, and whether one begins with it."""
    last = None
    for batch in batches:
        keys = list(zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True))
        at = 0
        while at < len(keys):
            end = len(keys) if keys[-1] == keys[at] else next(i for i in range(at, len(keys)) if keys[i] != keys[at])
            yield batch.slice(at, end - at), keys[at] != last
            last, at = keys[at], end


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A RANGE row for each range: for both ways of beginning, whether it ends inside quotes and the line that begins the record left open (null: none does)."""
    found: list | None = None

    def row() -> pa.RecordBatch:
        path, start, n, (out, out_tail), (into, in_tail) = found
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((path, start, n, out, out_tail, into, in_tail), kinds, strict=True)], ["path", "start", "lines", "out_ends", "out_tail", "in_ends", "in_tail"])

    for batch, begins in by_range(batches):
        if begins:
            if found:
                yield row()
            found = [batch["path"][0].as_py(), batch["start"][0].as_py(), 0, [False, None], [True, None]]
        quoted = pc.indices_nonzero(pc.match_substring(batch["value"], '"'))  # other lines end as they begin
        for i, line in zip(quoted.to_pylist(), batch["value"].take(quoted).to_pylist(), strict=True):
            for way in found[3:]:
                ends = ends_inside(line, way[0])
                if ends and not way[0]:
                    way[1] = found[2] + i
                elif not ends:
                    way[1] = None
                way[0] = ends
        found[2] += batch.num_rows
    if found:
        yield row()


def ranges(lines: DataFrame) -> DataFrame:
    """path, start, inside (it begins in a quoted field), before (lines before it), ends (inside one), tail (its first line of the record left open), owner (the range that began the record it begins in)."""
    upto = Window.partitionBy("path").orderBy("start")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    same, swaps = F.col("out_ends") == F.col("in_ends"), F.col("out_ends") & ~F.col("in_ends")
    each = lines.mapInArrow(_scan, RANGE).withColumn("swaps", F.sum(swaps.cast("int")).over(upto))
    reset = F.last(F.when(same, F.struct("out_ends", "swaps")), ignorenulls=True).over(upto)
    odd = (F.col("swaps") - F.coalesce(reset["swaps"], F.lit(0))) % 2 == 1
    each = each.withColumn("ends", F.coalesce(reset["out_ends"], F.lit(False)) != odd)
    each = each.withColumn("inside", F.coalesce(F.lag("ends").over(upto), F.lit(False))).withColumn("tail", F.when(F.col("ends"), F.when(F.col("inside"), F.col("in_tail")).otherwise(F.col("out_tail"))))
    owner = F.last(F.when(F.col("tail").isNotNull(), F.col("start")), ignorenulls=True).over(before)
    return each.select("path", "start", "inside", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"), "ends", "tail", owner.alias("owner"), F.lead("start").over(upto).isNull().alias("last"))


def physical(lines: list[str]) -> Iterator[str]:
    """Lines with their ends; a carriage return by itself ends one too."""
    for line in lines:
        if "\r" in line:
            yield from LINE.findall(line + "\n")
        else:
            yield line + "\n"


def _table(rows: list[list[str]], header: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], header)


def _checked(rows: Iterator[list[str]], header: list[str], where) -> Iterator[pa.RecordBatch]:
    """Batches of rows; one of another width is an error at the line that where() tells."""
    held: list[list[str]] = []
    for row in rows:
        if not row:
            continue
        if len(row) != len(header):
            raise ValueError(f"{where()} has {len(row)} fields, not {len(header)}")
        held.append(row)
        if len(held) == 10_000:
            yield _table(held, header)
            held = []
    if held:
        yield _table(held, header)


def strict_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV files as strings: a byte-order mark and leading blank lines are passed over, quoted line breaks kept, blank lines between records left out; a repeated column
    name, a file with another header, a row of another width (with its line) and a quote that nothing closes are errors. A header must lie in its file's first range."""
    lines = read_lines(spark, path)
    first = [r[0] for r in lines.limit(HEADER_LINES).select("value").collect()]
    first[:1] = [x.removeprefix("﻿") for x in first[:1]]
    header = next((row for row in csv.reader(physical(first)) if row), None)
    if header is None:
        raise ValueError(f"{path} is empty")
    if len(set(header)) < len(header):
        raise ValueError(f"{path}: a column name twice")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    known = ranges(lines)
    known = known.where(F.when(F.col("last") & F.col("ends"), F.raise_error(F.concat("path", F.lit(": a quote that nothing closes"))).cast("boolean")).otherwise(True))
    met = lines.join(F.broadcast(known), ["path", "start"])

    def stretches(batches: Iterator[pa.RecordBatch], pieces: bool) -> Iterator[tuple[pa.RecordBatch, int, list[str], str]]:
        """Of each range, some lines at a time: one of its rows, the first line's number in the range, the lines, and their kind: head, body, tail."""
        n = inside = 0
        for batch, begins in by_range(batches):
            if begins:
                n, inside = 0, batch["inside"][0].as_py()
            tail, values = batch["tail"][0].as_py(), batch["value"].to_pylist()
            if begins and values and not batch["start"][0].as_py():
                values[0] = values[0].removeprefix("﻿")
            at = 0
            while inside and at < len(values):
                inside = ends_inside(values[at], True)
                at += 1
            if at:
                yield batch, n, values[:at], "head"
            cut = len(values) if tail is None else max(at, min(len(values), tail - n))
            if cut > at and not pieces:
                yield batch, n + at, values[at:cut], "body"
            if cut < len(values):
                yield batch, n + cut, values[cut:], "tail"
            n += len(values)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST_FIELD)
        state = {"line": 0, "path": "", "next": None}
        stream = ((b, n, v) for b, n, v, kind in stretches(batches, False) if kind == "body")

        def of_range() -> Iterator[str]:
            """The lines of one range's body; what follows is kept for the next call."""
            current = state["next"]
            key = current[0]["path"][0].as_py(), current[0]["start"][0].as_py()
            state["path"] = key[0]
            while current is not None and key == (current[0]["path"][0].as_py(), current[0]["start"][0].as_py()):
                for i, line in enumerate(current[2]):
                    state["line"] = current[0]["before"][0].as_py() + current[1] + i + 1
                    yield from physical([line])
                current = state["next"] = next(stream, None)

        state["next"] = next(stream, None)
        while state["next"] is not None:
            starts, of = not state["next"][0]["start"][0].as_py(), state["next"][0]["path"][0].as_py()
            rows = csv.reader(of_range())
            if starts and (own := next((r for r in rows if r), None)) != header:
                raise ValueError(f"{of}: another header, {own}")
            yield from _checked(rows, header, lambda: f"{state['path']}: line {state['line']}")

    def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64())
        held: list | None = None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip((*held[:3], "".join(held[3]), held[4]), kinds, strict=True)], ["path", "owner", "start", "text", "line"])

        for batch, n, values, kind in stretches(batches, True):
            start = batch["start"][0].as_py()
            key = [batch["path"][0].as_py(), batch["owner"][0].as_py() if kind == "head" else start, start]
            if held and held[:3] != key:
                yield row()
                held = None
            held = held or [*key, [], batch["before"][0].as_py() + n + 1, 0]
            held[3] += [v + "\n" for v in values]
            held[5] += sum(map(len, values))
            if held[5] > LONGEST_FIELD:
                raise ValueError(f"{key[0]}: line {held[4]} begins a field of more than {LONGEST_FIELD} characters")
        if held:
            yield row()

    def parse_crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(LONGEST_FIELD)
        for batch in batches:
            for of, line, text in zip(batch["path"].to_pylist(), batch["line"].to_pylist(), batch["text"].to_pylist(), strict=True):
                yield from _checked(csv.reader(physical(text.split("\n")[:-1])), header, lambda of=of, line=line, text=text: f"{of}: line {line + text.count(chr(10)) - 1}")

    parts = met.where("inside OR tail IS NOT NULL").mapInArrow(crossing, "path string, owner long, start long, text string, line long")
    whole = parts.groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p"), F.min("line").alias("line"))
    crossed = whole.select("path", "line", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")).mapInArrow(parse_crossing, schema)
    return met.mapInArrow(parse, schema).unionByName(crossed)
