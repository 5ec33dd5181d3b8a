"""Chat formatting with a grammar round trip.

    conversation := turn*
    turn         := "### " role ": " text "</turn>" newline
    role         := User | Assistant | System | Tool | "@" any other role, escaped

In role and text a backslash makes the next character literal. The parser is deterministic: it reads a header, then
literal text up to the first marker that no backslash makes literal; a header inside a text is an error. Every turn is
rendered plain, parsed again and compared with its source; while they differ, more of the conflicting content is
escaped (markers and backslashes; then every character that a marker could begin with). Rendered turns just follow
one another, so a conversation is never held as a whole: turns are rendered where they lie, sorted by conversation
and turn, and parsed and digested as a stream.

Defined results: null texts and roles are empty; rows of a conversation with the same turn come by role, then text;
a null conv_id is a conversation of its own, a null turn comes first; an empty table gives no rows. A very long text is held as one turn, a conversation never.
Repeated rows are turns of their own. Further columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausegrain.llm.common import sliced

SHOWN = {"user": "User", "assistant": "Assistant", "system": "System", "tool": "Tool"}
NAMED = {v: k for k, v in SHOWN.items()}
END = "</turn>"
#: A literal character, the end of a turn, or a header: what the parser stops at.
TOKEN = re.compile(r"\\(.)|(</turn>)|(### (?:User|Assistant|System|Tool|@(?:[^\\:\n]|\\.)*): )", re.S)
HEADER = re.compile(r"### (?:(User|Assistant|System|Tool)|@((?:[^\\:]|\\.)*)): ", re.S)
#: What each further attempt escapes.
CONFLICTS = (None, re.compile(r"\\|</turn>|### "), re.compile(r"[\\<#@:]"))


class ParseError(ValueError):
    pass


def literal(escaped: str) -> str:
    return re.sub(r"\\(.)", r"\1", escaped, flags=re.S)


def header(role: str) -> str:
    return f"### {SHOWN[role] if role in SHOWN else '@' + re.sub(r'[\\:<#]', lambda m: chr(92) + m[0], role)}: "


def parse_turn(text: str, at: int = 0) -> tuple[str, str, int, int, int]:
    """The turn that begins there: role, text, where its raw text begins and ends, and where the next turn begins."""
    m = HEADER.match(text, at)
    if not m:
        raise ParseError(f"no header at {at}")
    role = NAMED[m[1]] if m[1] else literal(m[2])
    begin = place = m.end()
    parts = []
    while True:
        t = TOKEN.search(text, place)
        if not t or t[3]:
            raise ParseError("a text without an end" if not t else f"a header inside a text at {t.start()}")
        parts.append(text[place : t.start()])
        place = t.end()
        if t[2]:
            break
        parts.append(t[1])
    if text[place : place + 1] != "\n":
        raise ParseError(f"no line end at {place}")
    return role, "".join(parts), begin, t.start(), place + 1


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """Role, text, and the raw text's begin and end of each turn of a rendered conversation."""
    at = 0
    while at < len(text):
        role, said, begin, end, at = parse_turn(text, at)
        yield role, said, begin, end


def render_turn(role: str, text: str) -> str:
    """The turn as it is written: escaped as little as brings it back."""
    for conflict in CONFLICTS:
        body = conflict.sub(lambda m: "\\" + m[0], text) if conflict else text
        made = f"{header(role)}{body}{END}\n"
        try:
            back = parse_turn(made)
        except ParseError:
            continue
        if back[:2] == (role, text) and back[4] == len(made):
            return made
    raise ParseError("a turn that can't be brought back")


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(render_turn(*t) for t in turns)


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, rendered, loss_start, loss_end: the written turns, sorted within partitions that hold whole
    conversations; a loss span, in code points of rendered, covers an assistant's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = [render_turn(r or "", t or "") for r, t in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            spans = [parse_turn(m) for m in made]
            loss = [(s[2], s[3]) if s[0] == "assistant" else (None, None) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), pa.array(made, pa.string()), pa.array([x for x, _ in loss], pa.int32()), pa.array([x for _, x in loss], pa.int32())],
                ["conv_id", "turn", "role", "rendered", "loss_start", "loss_end"],
            )

    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), "text")
    made = rows.mapInArrow(run, "conv_id long, turn long, role string, rendered string, loss_start int, loss_end int")
    # Turns of one role have one header, so this compares their texts; it is worked out for turns that tie only.
    text = F.regexp_replace(F.expr(f"left(rendered, length(rendered) - {len(END) + 1})"), r"(?s)\\(.)", "$1")
    return made.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", text).select("conv_id", "turn", "rendered", "loss_start", "loss_end")


class Digest:
    """What is read back of one conversation, turn after turn."""

    def __init__(self):
        self.turns, self.n, self.loss, self.n_loss, self.chars = hashlib.sha256(), 0, hashlib.sha256(), 0, 0

    def add(self, made: str) -> None:
        self.chars += len(made)
        for role, said, _, _ in parse(made):
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n += 1
            if role == "assistant":
                self.loss.update(said.encode())
                self.n_loss += len(said)

    def row(self) -> tuple:
        return self.n, self.turns.hexdigest(), self.n_loss, self.loss.hexdigest(), self.chars


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation of rendered(), read back as a stream: no conversation is held in memory."""
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

        now, digest, rows = None, None, []
        for batch in batches:
            for conv, made in zip(batch.column("conv_id").to_pylist(), batch.column("rendered").to_pylist(), strict=True):
                if digest is None or conv != now:
                    if digest is not None:
                        rows.append((now, *digest.row()))
                    now, digest = conv, Digest()
                digest.add(made)
            if len(rows) > 10_000:
                yield out(rows)
                rows = []
        if digest is not None:
            rows.append((now, *digest.row()))
        if rows:
            yield out(rows)

    return formatted.select("conv_id", "rendered").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
