"""Spans of a kind within texts: how they are written, joined with a model's, and masked."""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from clausegrain.llm.common import as_bytes, kept_in_worker, map_batches
from clausegrain.llm.crf import Crf, code_points, word_places

Span = tuple[int, int, str]  # bytes: start, end; kind


def written(spans: list[Span], places, kinds: tuple[str, ...]) -> str:
    at = (lambda x: x) if places is None else (lambda x: int(places[x]))
    return ",".join(f"{k}:{at(a)}:{at(b)}" for a, b, k in sorted(spans, key=lambda s: (s[0], kinds.index(s[2]), s[1])))


def apart(spans: list[Span], taken: list[Span]) -> list[Span]:
    """The spans that overlap none that are taken."""
    begins, ends = [], []
    for a, b, _ in sorted(taken):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            begins.append(a)
            ends.append(b)
    at = lambda s: bisect_left(begins, s[1]) - 1
    return [s for s in spans if at(s) < 0 or ends[at(s)] <= s[0]]


class Finder:
    """Base rules, a trained model, and what of a model's span is plausible: accept(text, begin, end, kind) gives the places within it."""

    def __init__(self, kinds: tuple[str, ...], base: Callable[[bytes], list[Span]], model: Crf, model_kinds: tuple[str, ...], accept: Callable[[bytes, int, int, str], list[tuple[int, int]]], describe_file: Callable[[bytes, list[bytes]], tuple] | None = None):
        self.kinds, self.base, self.model, self.model_kinds, self.accept, self.describe_file = kinds, base, model, model_kinds, accept, describe_file

    def find(self, texts: list[bytes]) -> list[tuple[list[Span], list[Span]]]:
        """Of each text the base spans, and those that the model adds."""
        words = [t.split() for t in texts]
        files = [self.describe_file(t, w) for t, w in zip(texts, words, strict=True)] if self.describe_file else None
        out = []
        for text, tagged in zip(texts, self.model.spans(words, files), strict=True):
            base, more = self.base(text), []
            if tagged:
                begin, end = word_places(text)
                for kind, a, b in tagged:
                    name = self.model_kinds[kind]
                    more += [(*place, name) for place in self.accept(text, int(begin[a]), int(end[b - 1]), name)]
            out.append((base, apart(more, sorted(base)) if more else []))
        return out


def table_of(docs: DataFrame, name: str, make: Callable[[], Finder], counted: tuple[str, ...]) -> DataFrame:
    """doc_id, n_<kind> for the base spans of each counted kind, base_sha256, spans; a row for each row of docs."""

    owner = uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        finder = kept_in_worker(name, owner, make)
        texts = as_bytes(batch.column("text"))
        out: dict[str, list] = {f"n_{k}": [] for k in counted} | {"base_sha256": [], "spans": []}
        for text, (base, more) in zip(texts, finder.find(texts), strict=True):
            places = code_points(text) if base or more else None
            for k in counted:
                out[f"n_{k}"].append(sum(s[2] == k for s in base))
            plain = written(base, places, finder.kinds)
            out["base_sha256"].append(hashlib.sha256(plain.encode()).hexdigest())
            out["spans"].append(written(base + more, places, finder.kinds) if more else plain)
        return {"doc_id": batch.column("doc_id")} | out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, " + "".join(f"n_{k} long, " for k in counted) + "base_sha256 string, spans string")


def masked(docs: DataFrame, name: str, make: Callable[[], Finder], mask: Callable[[str], bytes] = lambda kind: f"[{kind.upper()}]".encode()) -> DataFrame:
    """docs in all their columns, each span in text replaced by its kind's mask, and n_chars brought up to date where there is one."""
    names, owner = docs.columns, uuid.uuid4().hex

    def run(batch: pa.RecordBatch) -> dict:
        finder = kept_in_worker(name, owner, make)
        column = batch.column("text")
        texts, null = as_bytes(column), column.is_null().to_pylist()
        done: list[str | None] = []
        for text, gone, (base, more) in zip(texts, null, finder.find(texts), strict=True):
            parts, at = [], 0
            for a, b, kind in sorted(base + more):
                if b > at:  # kinds may overlap; what is left of the later span gets its own mask
                    parts += [text[at:a], mask(kind)]
                    at = b
            done.append(None if gone else b"".join([*parts, text[at:]]).decode())
        out = {c: batch.column(c) for c in names} | {"text": done}
        if "n_chars" in out:
            changed = [None if t is None else len(t) for t in done]
            old = batch.column("n_chars").to_pylist()
            was = column.to_pylist()
            out["n_chars"] = [o if w == t else c for o, w, t, c in zip(old, was, done, changed, strict=True)]
        return out

    return map_batches(docs, run, docs.schema)
