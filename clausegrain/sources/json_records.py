"""Counting labelled records in files of any size: JSON is read as a stream of pieces, so no file is ever held whole.

Spark's text reader cuts JSON files behind closing braces and CSV files at line ends, and sorts a file's pieces into their order; a task runs over them with
a small state: the open objects' names that matter, and whether a text is open. JSON lines need no order, so all tasks share a file of them.
"""

from __future__ import annotations

import csv
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

COUNTS = "path string, records long, candidates long, problem string"
#: Characters of a name that are kept; no name that matters is longer.
LONGEST_NAME = 100
TOKEN = re.compile(r'[ \t\r\n]+|[{}\[\],:]|"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity')
TEXT = re.compile(r'(?:[^"\\\x00-\x1f]+|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*')


class Records:
    """Counts the objects of a JSON text that is fed piece by piece, and those of them that is_candidate(names) takes: names maps each lower-cased name to (truthy, filled)."""

    def __init__(self, wanted: frozenset[str], is_candidate: Callable[[dict], bool]):
        self.wanted, self.is_candidate = wanted, is_candidate
        self.records = self.candidates = 0
        self.stack: list[list] = []  # [kind, names, name, size]
        self.expects, self.text, self.left, self.begun = "value", None, "", False

    def feed(self, piece: str) -> None:
        if self.text is None and self.left:
            piece, self.left = self.left + piece, ""
        at = 0
        while at < len(piece):
            if self.text is not None:
                end = TEXT.match(piece, at).end()
                self.text = (self.text + piece[at:end])[:LONGEST_NAME]
                if end == len(piece):
                    return
                if piece[end] != '"':
                    raise ValueError("a control character or a wrong escape in a text")
                self._text(self.text)
                self.text, at = None, end + 1
                continue
            m = TOKEN.match(piece, at)
            if not m:
                raise ValueError(f"unexpected {piece[at:at + 20]!r}")
            at = m.end()
            token = m[0]
            if token == '"':
                if self.expects not in ("value", "name", "value or ]", "name or }"):
                    raise ValueError("an unexpected text")
                self.text = ""
            elif token[0] not in " \t\r\n":
                self._token(token)

    def _text(self, text: str) -> None:
        if self.expects in ("name", "name or }"):
            raw = json.loads(f'"{text}"') if len(text) < LONGEST_NAME and "\\" in text else text
            self.stack[-1][2], self.expects = raw.lower(), ":"
        else:
            self._value(text != "", text != "")

    def _value(self, truthy: bool, filled: bool) -> None:
        if self.stack:
            top = self.stack[-1]
            top[3] = True
            if top[0] == "{" and top[2] in self.wanted:
                top[1][top[2]] = truthy, filled
            self.expects = ", or end"
        else:
            self.expects, self.begun = "nothing", True

    def _token(self, token: str) -> None:
        e = self.expects
        if token in "{[" and e in ("value", "value or ]"):
            self.stack.append([token, {}, "", False])
            self.expects = "name or }" if token == "{" else "value or ]"
        elif token == ":" and e == ":":
            self.expects = "value"
        elif token == "," and e == ", or end":
            self.expects = "name" if self.stack[-1][0] == "{" else "value"
        elif token in "}]" and self.stack and self.stack[-1][0] == ("{" if token == "}" else "[") and e in (", or end", "name or }", "value or ]"):
            _, names, _, size = self.stack.pop()
            if token == "}":
                self.records += 1
                self.candidates += self.is_candidate(names)
            self._value(size, size)
        elif token not in "{}[],:" and e in ("value", "value or ]"):
            number = token[-1].isdigit()
            self._value(token not in ("null", "false") and not (number and float(token) == 0), token != "null")
        else:
            raise ValueError(f"unexpected {token!r}")

    def end(self) -> None:
        if self.text is not None or self.stack or not self.begun:
            raise ValueError("the text ends too early")


def _pieces(spark: SparkSession, directory: str, suffixes: str, cut: str) -> DataFrame:
    """path, piece (bytes) of the files of some suffixes, each file's pieces in their order in one partition."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).option("lineSep", cut)
    rows = reader.text(directory).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("piece"))
    return rows.repartition("path").sortWithinPartitions("path", "start", "n").select("path", "piece")


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[bytes]]]:
    """Each file's path and its pieces; the pieces must be used up before the next file is asked for."""
    rows = ((p, x) for b in batches for p, x in zip(b["path"].to_pylist(), b["piece"].to_pylist(), strict=True))
    ahead = next(rows, None)

    def own(path: str) -> Iterator[bytes]:
        nonlocal ahead
        while ahead is not None and ahead[0] == path:
            yield ahead[1]
            ahead = next(rows, None)

    while ahead is not None:
        path = ahead[0]
        yield path, own(path)
        for _ in own(path):  # what an error has left
            pass


def _counted(judge: Callable[[Iterator[bytes]], tuple[int, int]]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, pieces in _by_file(batches):
            try:
                row = (path, *judge(pieces), None)
            except (ValueError, csv.Error) as e:
                row = (path, 0, 0, str(e)[:200])
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], ["path", "records", "candidates", "problem"])

    return run


def label_counts(spark: SparkSession, directory: str, identity: tuple[str, ...], labels: tuple[str, ...]) -> DataFrame:
    """path, records, candidates, problem of each CSV, TSV, JSON, JSONL and text file below a directory: how many records there are (JSON: objects at any depth), and how many have a field of identity
    that isn't false, zero or empty and a label field that isn't empty, names in any case. A file that can't be read has a problem and counts of 0; text files hold no records. Spark's readers pass over files without a byte."""
    wanted = frozenset(identity) | frozenset(labels)

    def fits(names: dict) -> bool:
        return any(names.get(f, (False,))[0] for f in identity) and any(names.get(f, (False, False))[1] for f in labels)

    def has(row: dict) -> bool:
        return fits({n: (bool(v), v not in (None, "", [], {})) for k, v in row.items() if (n := str(k).lower()) in wanted})

    def objects(value) -> Iterator[dict]:
        stack = [value]
        while stack:
            x = stack.pop()
            if isinstance(x, dict):
                yield x
                stack.extend(x.values())
            elif isinstance(x, list):
                stack.extend(x)

    def of_json(pieces: Iterator[bytes]) -> tuple[int, int]:
        found, first = Records(wanted, fits), True
        for piece in pieces:
            if not first:
                found.feed("}")
            found.feed(piece.decode("utf-8", "replace").removeprefix("﻿") if first else piece.decode("utf-8", "replace"))
            first = False
        if found.stack or found.text is not None:  # the reader doesn't tell whether the last piece was cut
            found.feed("}")
        found.end()
        return found.records, found.candidates

    def of_table(delimiter: str) -> Callable:
        def judge(pieces: Iterator[bytes]) -> tuple[int, int]:
            csv.field_size_limit(1 << 26)
            first = [True]

            def lines() -> Iterator[str]:
                for x in pieces:
                    text = x.decode("utf-8", "replace")
                    yield (text.removeprefix("﻿") if first.pop() else text) + "\n"
                    first.append(False)

            n = hits = 0
            for row in csv.DictReader(lines(), delimiter=delimiter):
                n, hits = n + 1, hits + has(row)
            return n, hits

        return judge

    def of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {}
            for path, piece in zip(batch["path"].to_pylist(), batch["piece"].to_pylist(), strict=True):
                row = out.setdefault(path, [0, 0, None])
                text = piece.decode("utf-8", "replace").removeprefix("﻿")
                try:
                    for x in objects(json.loads(text)) if text.strip() else ():
                        row[0], row[1] = row[0] + 1, row[1] + has(x)
                except ValueError as e:
                    row[2] = str(e)[:200]
            rows = [(p, *r) for p, r in out.items()]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "records", "candidates", "problem"])

    low = lambda s: "".join(f"[{c}{c.upper()}]" for c in s)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(directory).select(F.col("_metadata.file_path").alias("path")).where(F.lower("path").rlike(r"\.(csv|json|jsonl|txt|tsv)$"))
    counts = _pieces(spark, directory, f"*.{low('json')}", "}").mapInArrow(_counted(of_json), COUNTS)
    for suffix, delimiter in (("csv", ","), ("tsv", "\t")):
        counts = counts.unionByName(_pieces(spark, directory, f"*.{low(suffix)}", "\n").mapInArrow(_counted(of_table(delimiter)), COUNTS))
    plain = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{low('jsonl')}").option("lineSep", "\n").text(directory).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    parts = plain.mapInArrow(of_lines, COUNTS).groupBy("path").agg(F.sum("records").alias("records"), F.sum("candidates").alias("candidates"), F.min("problem").alias("problem"))
    whole = parts.select("path", *(F.when(F.col("problem").isNull(), F.col(c)).otherwise(0).alias(c) for c in ("records", "candidates")), "problem")
    found = listed.join(counts.unionByName(whole), "path", "left")
    return found.select("path", F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("candidates", F.lit(0)).alias("candidates"), "problem")
