"""Clause segmentation: texts to clauses with exact offsets in code points.

Cutting is a sequential rule: v1 joins short pieces to their predecessor and breaks long ones at blank lines, v2 and v3 fold short
pieces forward and test what has gathered. So texts run through it as Arrow batches, each in time linear in its length (v1) and with
one list of cuts; what pieces are is told by built-in functions. A text never leaves its row: no version shuffles.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from clausegrain.functions.text import clause_id, is_blank, strip

# What begins a clause in version 1.
V1_BOUNDARIES = (
    r"^\s*(?:ARTICLE|Article|SECTION|Section)\s+[IVXLCDM\d]+[\.\:\s]",
    r"^\s*(\d{1,3}(?:\.\d{1,3})*)\s*[\.\)]\s+",
    r"^\s*\([a-z]{1,4}\)\s+",
    r"(?i)^\s*\([ivxlcdm]+\)\s+",
    r"^\s*\(\d{1,3}\)\s+",
)
# A heading of version 1, of eight characters at least.
V1_HEADING = r"^[A-Z][A-Z\s,\-/&]{5,}$"
BLANK_LINES, LINE_START = re.compile(r"\n\n+"), re.compile(r"(?:\A|\n)\s*")


class Boundaries:
    """Where patterns match. For those that begin with a line's start and any white space it's enough to look after each run of white space once, however many
    lines it has: a search would begin anew at each of them, and take time quadratic in the run."""

    def __init__(self, patterns: tuple[str, ...]):
        self.after, self.others = [], []
        for p in patterns:
            flags, rest = re.match(r"((?:\(\?[a-z]+\))*)(.*)", p, re.S).groups()
            if rest.startswith(r"^\s*"):
                self.after.append(re.compile(flags + rest.removeprefix(r"^\s*"), re.M))
            else:
                self.others.append(re.compile(p, re.M))

    def of(self, text: str) -> set[int]:
        found, ends = {m.start() for p in self.others for m in p.finditer(text)}, [0] * len(self.after)
        for run in LINE_START.finditer(text):
            first, at = run.start() + 1 if run.start() else 0, run.end()
            for k, p in enumerate(self.after):
                if m := p.match(text, at):
                    start = first
                    if ends[k] > first:  # the match before took a part of this run; what is left must hold a line's start
                        start = ends[k] if text[ends[k] - 1] == "\n" else text.find("\n", ends[k], at) + 1
                        if not start:
                            continue
                    found.add(start)
                    ends[k] = m.end()
        return found


_V1, _V1_HEADING = Boundaries(V1_BOUNDARIES), re.compile(V1_HEADING, re.M)


def cut(text: str, min_length: int = 30, max_length: int = 5000) -> Iterator[tuple[int, int]]:
    """Start and end of version 1's clauses, in one pass over a list of cuts: a short piece joins the one before it, a long one breaks at blank lines."""
    starts = sorted(_V1.of(text) | {m.start() for m in _V1_HEADING.finditer(text) if len(m[0].strip()) >= 8})
    if not starts or text[: starts[0]].strip():
        starts.insert(0, 0)
    spans: list[list[int]] = []
    for start, end in zip(starts, [*starts[1:], len(text)], strict=True):
        if spans and len(text[start:end].strip()) < min_length:
            spans[-1][1] = end
        else:
            spans.append([start, end])
    for start, end in spans:
        if len(text[start:end].strip()) > max_length:
            edges = [start, *(x for m in BLANK_LINES.finditer(text, start, end) for x in m.span()), end]
        else:
            edges = [start, end]
        yield from ((a, b) for a, b in zip(edges[::2], edges[1::2], strict=True) if text[a:b].strip())


def segment_v1(docs: DataFrame, min_length: int = 30, max_length: int = 5000) -> DataFrame:
    """docs (document_id, text) to document_id, clause_id, text, start, end; blank texts give no clause."""
    each = _cut_by(docs.where(~is_blank(F.col("text"))), lambda text: ((i, a, b) for i, (a, b) in enumerate(cut(text, min_length, max_length))))
    return each.select("document_id", clause_id(F.col("document_id"), F.col("index")).alias("clause_id"), strip(F.col("text")).alias("text"), "start", "end")


def _cut_by(docs: DataFrame, pieces: Callable[[str], Iterator[tuple[int, int, int]]]) -> DataFrame:
    """document_id, index, start, end, text of the pieces (index, start, end) of each text; some thousand pieces leave a task at a time, however long a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = []

            def made(batch=batch, held=held) -> pa.RecordBatch:
                row, index, start, end, text = zip(*held, strict=True)
                return pa.RecordBatch.from_arrays([batch.column("document_id").take(pa.array(row)), pa.array(index, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, pa.string())], ["document_id", "index", "start", "end", "text"])

            for k in range(batch.num_rows):
                text = batch.column("text")[k].as_py() or ""
                for i, a, b in pieces(text):
                    held.append((k, i, a, b, text[a:b]))
                    if len(held) == 5000:
                        yield made()
                        held.clear()
            if held:
                yield made()

    kind = docs.schema["document_id"].dataType.simpleString()
    return docs.select("document_id", "text").mapInArrow(run, f"document_id {kind}, index int, start int, end int, text string")


# ---------------------------------------------------------------- versions 2 and 3

# What begins a clause in versions 2 and 3; after a paragraph break it begins where the match ends.
V2_BOUNDARIES = (
    r"(?m)^\s*(?:ARTICLE|SECTION)\s+[IVXLCDM\d]+[\.\:\s]+[A-Z]",
    r"(?m)^\s*\d{1,2}\.\d{1,2}(?:\.\d{1,2})*\s+[A-Z]",
    r"(?m)^\s*\d{1,2}\.\s+[A-Z]",
    r"(?m)^\s*\([a-z0-9]{1,3}\)\s+[A-Z]",
    r"(?m)^\s*(?:WHEREAS|NOW THEREFORE|IN WITNESS WHEREOF),?",
    r"(?m)^[A-Z\s]{4,50}:(?=\s+[A-Z])",
)
V3_BOUNDARIES = (
    r"(?m)^\s*(?:\d{1,3}(?:\.\d{1,3})*)\s*[\.\)]\s+[A-Z0-9]",
    r"(?m)^\s*\([a-z0-9]{1,4}\)\s+[A-Z0-9]",
    r"(?m)^\s*(?:ARTICLE|Article|SECTION|Section)\s+[IVXLCDM\d]+[\.\:\s]",
    r"(?m)^[A-Z][A-Z\s,\-/&]{10,}$",
    r"(?m)^\s*(?:WHEREAS|NOW THEREFORE|IN WITNESS WHEREOF)",
)
# What parts paragraphs, and what stays by itself however short.
PARAGRAPH = re.compile(r"\n\s*\n")
V2_STAYS = re.compile(r"(?:EX-|EXHIBIT|Page|\d+$)", re.I)
V3_STAYS = re.compile(r"(?:SECTION|ARTICLE|EX-|EXHIBIT)", re.I)
# Words of legal content, patterns of segment types, and marks that are no words.
LEGAL_WORDS = ("shall", "must", "agrees", "acknowledges", "party", "parties", "confidential", "information", "agreement", "obligations", "disclose", "receive", "terminate", "governed", "rights", "duties")
EXHIBIT = r"(?i)^(?:EX-\d+[\w\.\-]*|EXHIBIT\s+\d+[\w\.\-]*|EXHIBIT\s+[A-Z]|EX-\d+.*htm)"
PAGE = r"(?i)^(?:Page\s*\d+(?:\s*of\s*\d+)?|\d+\s*of\s*\d+|-\s*\d+\s*-|\d{1,3})$"
HEADING = r"(?i)^(?:SECTION|ARTICLE|\d+[\.\d]*)\s+[A-Z\s,]{3,%d}$"
MARKS = r".,;:!?\-–—\"'()\[\]{}/*\\&$#@ 0123456789"
_COMPILED = {2: Boundaries(V2_BOUNDARIES), 3: Boundaries(V3_BOUNDARIES)}


def _stays(version: int, said: str, min_length: int) -> bool:
    """Whether a gathered piece stands on its own rather than joining what follows."""
    if version == 2:
        return len(said) >= 25 or bool(V2_STAYS.match(said))
    return len(said) >= min_length or bool(V3_STAYS.match(said)) or (said.isupper() and len(said) > 5)


def fold_forward(text: str, version: int, min_length: int = 20) -> Iterator[tuple[int, int, int]]:
    """Index, start and end of the pieces of a text; blank ones are left out, yet counted."""
    if not text.strip():
        return
    begins = _COMPILED[version].of(text)
    if version == 3:
        begins.update(m.end() for m in PARAGRAPH.finditer(text))
    # A break at the very end leaves an empty last piece, which still takes what gathered before it.
    edges = [*([] if 0 in begins else [0]), *sorted(begins), len(text)]
    index, open_at = 0, edges[0]
    for k, end in enumerate(edges[1:], 2):
        said = text[open_at:end].strip()
        if k < len(edges) and not _stays(version, said, min_length):
            continue
        if said:
            yield index, open_at, end
        index, open_at = index + 1, end


def _rx(c: Column, pattern: str) -> Column:
    """Java's $ also stops before a last line end; so does the other engine's; U makes classes Unicode's."""
    return c.rlike("(?U)" + pattern)


def has_legal_content(text: Column) -> Column:
    low = F.lower(text)
    hits = sum((low.contains(w).cast("int") for w in LEGAL_WORDS), F.lit(0))
    return (F.length(text) >= 50) & ((hits >= 2) | (F.length(text) > 300))


def _upper(t: Column) -> Column:
    return t.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")


def segment_type(text: Column, version: int, min_length: int = 20) -> Column:
    """fragment, header, page_number, section_heading or legal_clause, by rules in order."""
    t, n = strip(text), F.length(strip(text))
    exhibit, page = _rx(t, EXHIBIT), _rx(t, PAGE) & ((_rx(t, r"^\d+$") & (n <= 3)) | F.lower(t).contains("page") | t.contains("-"))
    heading = lambda most, title: (n < most) & _rx(t, HEADING % title) & ~t.endswith(".")
    if version == 2:
        return (
            F.when(t == "", "fragment").when(exhibit, "header").when(page, "page_number").when(heading(80, 60), "section_heading")
            .when((n < 60) & _upper(t) & ~t.endswith("."), "section_heading").when(t.rlike(rf"^[{MARKS}]+\z"), "fragment").when(n < min_length, "fragment").otherwise("legal_clause")
        )
    legal, few_words = has_legal_content(t), F.size(F.split(t, r"(?U)\s+")) < 15
    return (
        F.when(t == "", "fragment").when(t.rlike(rf"^[{MARKS}\n\r]+\z"), "fragment").when(exhibit & legal, "legal_clause").when(exhibit & (n < 300), "header").when(page, "page_number")
        .when(~legal & heading(150, 100), "section_heading").when(~legal & (n < 100) & _upper(t) & ~t.endswith(".") & few_words, "section_heading")
        .when((n < min_length) & ~legal, "fragment").otherwise("legal_clause")
    )


def is_suspicious(text: Column, kind: Column, version: int) -> Column:
    n = F.length(text)
    if version == 2:
        return (n < 20) | kind.isin("fragment", "page_number", "header")
    return (n < 15) | kind.isin("fragment", "page_number") | ((kind == "header") & (n > 500))


def segment(docs: DataFrame, version: int = 3, min_length: int = 20) -> DataFrame:
    """docs (document_id, text) to document_id, clause_id, text, start, end, segment_type, is_suspicious; clause numbers skip blank pieces."""
    if version not in (2, 3):
        raise ValueError(f"unknown version: {version}")

    each = _cut_by(docs, lambda text: fold_forward(text, version, min_length))
    clauses = each.select("document_id", clause_id(F.col("document_id"), F.col("index")).alias("clause_id"), strip(F.col("text")).alias("text"), "start", "end")
    typed = clauses.withColumn("segment_type", segment_type(F.col("text"), version, min_length))
    return typed.withColumn("is_suspicious", is_suspicious(F.col("text"), F.col("segment_type"), version))


def document_status(clauses: DataFrame, docs: DataFrame, version: int = 3) -> DataFrame:
    """document_id, num_clauses, num_legal_clauses, n_suspicious, quality_status of every document, those without clauses too."""
    by_doc = clauses.groupBy("document_id").agg(F.count("*").alias("num_clauses"), F.count_if(F.col("segment_type") == "legal_clause").alias("num_legal_clauses"), F.count_if("is_suspicious").alias("n_suspicious"))
    all_docs = docs.select("document_id").distinct().join(by_doc, "document_id", "left").na.fill(0, ["num_clauses", "num_legal_clauses", "n_suspicious"])
    n, bad = F.col("num_clauses"), F.col("n_suspicious")
    most = 50 if version == 2 else 100
    return all_docs.withColumn("quality_status", F.when((n <= 3) | (10 * bad > 4 * n), "HIGH_RISK").when((bad > 0) | (n > most), "REVIEW").otherwise("OK"))


SEGMENTERS = {"baseline": segment_v1, "v2": lambda docs, **k: segment(docs, 2, **k), "v3": lambda docs, **k: segment(docs, 3, **k)}


def segmenter(strategy: str):
    if strategy not in SEGMENTERS:
        raise ValueError(f"unknown strategy: {strategy}; known: {', '.join(sorted(SEGMENTERS))}")
    return SEGMENTERS[strategy]


def paragraphs(docs: DataFrame, min_length: int = 30) -> DataFrame:
    """document_id, text of each paragraph between blank lines, at least so long: a fallback for texts without structure."""
    each = docs.select("document_id", F.explode(F.split("text", r"\n\s*\n")).alias("text")).withColumn("text", strip(F.col("text")))
    return each.where(F.length("text") >= min_length)


def compare_versions(old: DataFrame, new: DataFrame, document: str = "document_id", text: str = "text", names: tuple[str, str] = ("old", "new")) -> DataFrame:
    """Of each document of the new clauses (text, is_suspicious, segment_type): clauses, suspicious and short ones of both versions, headers and their greatest length, and
    the greatest legal clause; a document that the old version lacks counts 0 there."""
    n = F.length(text)
    by = lambda rows, name: rows.groupBy(document).agg(F.count("*").alias(f"{name}_clauses"), F.count_if("is_suspicious").alias(f"{name}_suspicious"), F.count_if(F.length(strip(F.col(text))) < 20).alias(f"{name}_short"))
    of = lambda kind: F.coalesce(F.max(F.when(F.col("segment_type") == kind, n)), F.lit(0))
    more = new.groupBy(document).agg(F.count_if((F.col("segment_type") == "header") & (n > 500)).alias("large_headers"), of("header").alias("largest_header"), of("legal_clause").alias("largest_legal_clause"))
    return by(new, names[1]).join(by(old, names[0]), document, "left").join(more, document).na.fill(0)


def version_totals(compared: DataFrame, names: tuple[str, str] = ("old", "new"), most: int = 10) -> DataFrame:
    """One row over compare_versions(): totals of both versions, documents whose counts differ by more than `most`, and header figures."""
    each = [f"{v}_{c}" for v in names for c in ("clauses", "suspicious", "short")]
    apart = F.abs(F.col(f"{names[0]}_clauses") - F.col(f"{names[1]}_clauses")) > most
    zero = lambda c: F.coalesce(c, F.lit(0))
    return compared.agg(
        F.count("*").alias("documents"), *(zero(F.sum(c)).alias(c) for c in each), F.count_if(apart).alias("mismatches"), zero(F.sum("large_headers")).alias("large_headers"),
        zero(F.max("largest_header")).alias("largest_header"), zero(F.max("largest_legal_clause")).alias("largest_legal_clause"),
    )
