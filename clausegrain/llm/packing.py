"""Best-fit packing of token sequences, after Martello and Toth's dominance reduction.

The instance is a histogram: how many pieces have each length, so at most `capacity` numbers reach the
driver, whatever the corpus. The plan made from it is a list of slots, each a range of ranks within one
length; a piece finds its place by its rank among the pieces of its length. Ranks come from counts by
task and a prefix sum, so no task ever holds all pieces of a length.

Reduction. Let j be the longest piece left and i the longest that fits beside it. If no sum of two or
more remaining lengths lies above i and still fits beside j, then {j, i} dominates every feasible set
with j: whatever the others hold fits in i's place. Such pairs (and pieces that nothing fits beside) are
fixed for good, and the instance shrinks. Best fit by decreasing length packs what remains.

Nulls and empty texts hold just the end token; repeated rows are packed as often as they come; an empty
table gives no rows; rows with a null id are packed as well, with a null doc_id. Very long texts are cut like others (one text at a time is
held whole, with its ids); pieces of equal length take their places by the order of tasks' batches. Further columns of any name are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from bisect import bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from clausegrain.llm.common import kept_in_worker, map_batches, materialize

END_ID = 2
END = END_ID.to_bytes(4, "little")
CAPACITY = 1024
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class OddSpace(Exception):
    """A word that white space other than a lone space parts from its neighbours."""


class Words(dict):
    """The ids of words that follow a space, as little-endian bytes; so many words are remembered, the frequent ones come early."""

    KEPT = 200_000

    def __init__(self, encode, letters):
        super().__init__()
        self.encode, self.letters = encode, letters

    def __missing__(self, word: str) -> bytes:
        if not word or word[0].isspace() or word[-1].isspace():
            raise OddSpace
        if word.isalpha():
            made = self.letters(" " + word)
        elif self.letters is not self.encode and word[-1] in ",.;:!?" and word[:-1].isalpha():  # letters and marks are never merged
            made = self[word[:-1]] + self.encode(word[-1])
        else:
            made = self.encode(" " + word)
        if len(self) < self.KEPT and len(word) < 64:
            self[word] = made
        return made


class Encoder:
    """Ids by a tokenizers file, as little-endian bytes. Byte-level BPE never merges across a lone space between two
    words, so the ids of a text are those of its words, each with its leading space, and frequent words are remembered.

    Where the file's merges come in the order of their ids, as they do in the public byte-level files, tiktoken
    gives the same ids from the same file in a third of the time."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranked = self._ranked()
        plain = ranked.encode_ordinary if ranked else lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        self.plain = lambda text: struct.pack(f"<{len(ids := plain(text))}I", *ids)
        piece = ranked and ranked._core_bpe.encode_single_piece
        self.words = Words(self.plain, (lambda text: struct.pack(f"<{len(ids := piece(text.encode()))}I", *ids)) if ranked else self.plain)

    def _ranked(self):
        spec = json.loads(self.tokenizer.to_str())
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or spec.get("normalizer") or not before.get("use_regex", True):
            return None
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        ids = [model["vocab"][a + b] for a, b in pairs]
        if ids != list(range(256, 256 + len(ids))) or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
            return None
        import public_tokenizers
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level files write other bytes as the characters from 256 on
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        specials = set(self.special)
        ranks = {bytes(byte[c] for c in token): k for token, k in model["vocab"].items() if token not in specials}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, _, rest = text.partition(" ")
        try:
            if first[-1:].isspace() or not first and rest:
                raise OddSpace
            return self.plain(first) + (b"".join(map(self.words.__getitem__, rest.split(" "))) if rest else self.plain(" ") if first != text else b"")
        except OddSpace:
            parts = re.split(r"(?<=\S) (?=\S)", text)
            return self.plain(parts[0]) + b"".join(self.plain(" " + x) for x in parts[1:])


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: only the first may be shorter."""
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


# ---------------------------------------------------------------- planning, on the histogram


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[np.ndarray, int, dict[str, int]]:
    """Slots (length, first rank, bins, copies a bin, first sequence, offset), the number of sequences, and figures.

    The piece of rank first + b * copies + c goes to sequence first_sequence + b at offset + c * length."""
    left = {k: n for k, n in counts.items() if n}
    rank = dict.fromkeys(left, 0)
    slots: list[tuple[int, int, int, int, int, int]] = []
    sequences = fixed = 0

    def take(length: int, bins: int, copies: int, at: int, offset: int) -> None:
        slots.append((length, rank[length], bins, copies, at, offset))
        rank[length] += bins * copies
        left[length] -= bins * copies
        if not left[length]:
            del left[length]

    # reduction
    for j in sorted(left, reverse=True):
        while left.get(j):
            room = capacity - j
            fits = [x for x in left if x <= room and (x != j or left[j] > 1)]
            i = max(fits, default=0)
            if not i:
                n = left[j]
                take(j, n, 1, sequences, 0)
            else:
                if _sums_above(left, i, room):
                    break
                if i == j:
                    n = left[j] // 2
                    take(j, n, 2, sequences, 0)
                else:
                    n = min(left[j], left[i])
                    take(j, n, 1, sequences, 0)
                    take(i, n, 1, sequences, j)
            sequences += n
            fixed += n

    # best fit by decreasing length; free[r]: ranges (first sequence, bins) with room r, filled up to capacity - r
    free: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []

    def give_back(room: int, at: int, bins: int) -> None:
        if room and bins:
            if room not in free:
                free[room] = []
                insort(rooms, room)
            free[room].append((at, bins))

    for length in sorted(left, reverse=True):
        todo = left[length]
        k = bisect_right(rooms, length - 1)
        while todo and k < len(rooms):
            room = rooms[k]
            copies = room // length
            at, bins = free[room].pop()
            if not free[room]:
                del free[room]
                rooms.pop(k)
            full = min(bins, todo // copies)
            if full:
                take(length, full, copies, at, capacity - room)
                todo -= full * copies
                give_back(room - copies * length, at, full)
            if full < bins and todo:
                take(length, 1, todo, at + full, capacity - room)
                give_back(room - todo * length, at + full, 1)
                todo, full = 0, full + 1
            give_back(room, at + full, bins - full)
            k = bisect_right(rooms, length - 1)
        if todo:
            copies = capacity // length
            full, rest = divmod(todo, copies)
            if full:
                take(length, full, copies, sequences, 0)
                give_back(capacity - copies * length, sequences, full)
            if rest:
                take(length, 1, rest, sequences + full, 0)
                give_back(capacity - rest * length, sequences + full, 1)
            sequences += full + bool(rest)
    made = np.array(sorted(slots), dtype=np.int64).reshape(-1, 6)
    return made, sequences, {"fixed": fixed, "sequences": sequences}


def _sums_above(left: dict[int, int], low: int, high: int) -> bool:
    """Whether two or more pieces of these lengths, as often as one likes, may sum to over low and up to high.

    Taking lengths as often as one likes can only keep a pair from being fixed, never fix one wrongly."""
    if low >= high:
        return False
    mask = (1 << (high + 1)) - 1
    one = sum(1 << x for x in left if x <= high)
    reach = more = 0
    grow = one
    while grow:
        step = 0
        rest = grow
        while rest:
            bit = rest & -rest
            step |= (one << (bit.bit_length() - 1)) & mask
            rest ^= bit
        grow = step & ~more
        more |= step
        reach |= step
        if more >> (low + 1):
            return True
    return bool(reach >> (low + 1))


# ---------------------------------------------------------------- on Spark


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Tokenises, ends and cuts each document; chunk and rank tell which piece of its length it is within its task's batch."""
    def run(batch: pa.RecordBatch) -> dict:
        encoder = kept_in_worker("encoder", tokenizer, lambda: Encoder(tokenizer))
        ids_of = batch.column("doc_id").to_pylist()
        texts = [x or "" for x in batch.column("text").to_pylist()]
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32", "chunk", "rank")}
        seen: dict[int, int] = {}
        chunk = uuid.uuid4().int >> 65
        for doc_id, text in zip(ids_of, texts, strict=True):
            raw = encoder.encode(text) + END
            start = 0
            for k, n in enumerate(cut(len(raw) // 4, capacity)):
                rank = seen.get(n, 0)
                seen[n] = rank + 1
                for name, x in zip(out, (doc_id, k, start, n, zlib.crc32(raw[4 * start : 4 * (start + n)]), chunk, rank), strict=True):
                    out[name].append(x)
                start += n
        return out

    return map_batches(docs.select("doc_id", "text"), run, f"{PIECES}, chunk long, rank long", rows=4000)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs documents (doc_id, text) into sequences of at most capacity tokens; a row for each piece."""
    cut_up = materialize(pieces(docs, tokenizer, capacity), "pieces")
    by_chunk = cut_up.groupBy("chunk", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    slots, _, _ = plan(counts, capacity)
    before = W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = by_chunk.select("chunk", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut_up.join(offsets, ["chunk", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("chunk", "before")
    starts = slots[:, 0] * (1 << 50) + slots[:, 1]  # sorted: by length, then rank
    shared = docs.sparkSession.sparkContext.broadcast((starts, slots))  # some thousand slots: each step of plan() adds two ranges at most

    def run(batch: pa.RecordBatch) -> dict:
        starts, slots = shared.value
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        slot = slots[np.searchsorted(starts, length * (1 << 50) + rank, side="right") - 1]
        into = rank - slot[:, 1]
        return {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")} | {"sequence_id": slot[:, 4] + into // slot[:, 3], "offset": slot[:, 5] + into % slot[:, 3] * length}

    return map_batches(ranked, run, f"{PIECES}, sequence_id long, offset long", rows=20_000)
