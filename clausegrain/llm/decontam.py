"""Benchmark decontamination by suffix arrays over the training text.

Each task's batches of documents are shards. A shard's words become numbers of the test vocabulary; a run of such
words is as long as no other word breaks it, and only runs long enough for a window can match at all. The suffixes
of those runs are sorted (prefix doubling, so any length of match is in order), and every test suffix that is long
enough for a window is binary-searched in the array, which gives the range of places that share its window. From each
such place the verbatim match is followed to its end, but only where the words before differ, so every match is
found once, at its beginning, in its full length. Hits, items, the longest match of a document and its places all
come from these matches. Nothing is shuffled.

The test side is read partition by partition and goes to the tasks in blocks of about BLOCK_WORDS words (offsets into one
array of numbers), a broadcast each. The documents are read once: a task takes a batch through one block after another and
holds one at a time, so its memory is bounded whatever the benchmark's size.

Defined results: null and empty texts have no words, hits or items; an item without words has no window; rows
with equal ids are judged one by one; an empty benchmark leaves every document clean; of equally long longest
matches the first place in the document counts, then the smallest item id as a string, then the first place in the item;
further columns of any name stay as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from clausegrain.llm.common import Shared, as_bytes, map_batches

WINDOW = 13
#: A block's arrays and vocabulary take some 200 bytes a word.
BLOCK_WORDS = 500_000
#: Bytes of text in a shard, whose arrays take some 20 times as much at most.
SHARD_BYTES = 8 << 20
#: Pairs of places that are looked at together.
PAIRS = 1 << 20
#: A-Z to lower case; what is neither 0-9, a-z nor beyond ASCII becomes a space.
FOLD = bytes(c if c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class TestBlock:
    """The vocabulary of some test items, their words as numbers in one array, and the suffixes that begin a window."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        self.item_ids = [i for i, _ in items]
        self.names = [str(i) for i in self.item_ids]
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        parts, sizes = [np.full(1, -1, np.int32)], []
        for _, text in items:
            words = words_of(text)
            sizes.append(len(words))
            parts += [np.fromiter(map(number, words), np.int32, len(words)), parts[0]]  # -1 parts items
        self.ids = np.concatenate(parts)
        size = np.array(sizes, np.int64)
        self.start = 1 + np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64) if items else size
        n = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        self.item = np.repeat(np.arange(len(items)), n)
        self.suffix = self.start[self.item] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        self.need = np.minimum(size, window)[self.item]
        self.shortest = int(self.need.min(initial=window))
        self.low, self.high = (self._keys(end) for end in (0, -1))

    def _keys(self, end: int) -> np.ndarray:
        """Each suffix's window, shorter ones filled up with end."""
        rows = np.full((len(self.suffix), self.window), end, np.int64)
        for k in range(self.window):
            inside = self.need > k
            rows[inside, k] = self.ids[self.suffix[inside] + k]
        return keys([rows])


def keys(parts: list[np.ndarray]) -> np.ndarray:
    """Rows of word numbers as byte strings that compare as the rows do; -1 is above every number."""
    rows = np.ascontiguousarray(np.concatenate(parts).astype(">u4"))
    return rows.view(f"S{4 * rows.shape[1]}").ravel() if rows.size else np.zeros(0, f"S{4 * rows.shape[1]}")


class Shard:
    """A suffix array over the runs of test words in some documents."""

    def __init__(self, texts: list[bytes], block: TestBlock):
        self._make([words_of(t) for t in texts], block)

    @classmethod
    def of(cls, split: list[list[bytes]], block: TestBlock) -> Shard:
        made = cls.__new__(cls)
        made._make(split, block)
        return made

    def _make(self, split: list[list[bytes]], block: TestBlock) -> None:
        get = block.vocabulary.get
        ids: list[int] = []
        self.n_words = [len(words) for words in split]
        for words in split:
            ids += [get(w, 0) for w in words]
            ids.append(0)  # no run crosses documents
        self.ids = np.array(ids, np.int64)
        self.first = np.concatenate(([0], np.cumsum(np.array(self.n_words, np.int64) + 1)))
        stop = np.flatnonzero(self.ids == 0)
        begin = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
        keep = stop - begin >= max(1, block.shortest)
        begin, stop = begin[keep], stop[keep]
        length = stop - begin
        self.place = np.repeat(begin - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum()) if len(begin) else np.zeros(0, np.int64)
        self.left = np.repeat(stop, length) - self.place  # words up to the run's end
        self.order = self._sorted()
        self.keys = keys([self._prefix(self.place[self.order], self.left[self.order], block.window)])

    def _prefix(self, place: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((len(place), n), np.int64)
        for k in range(n):
            inside = left > k
            out[inside, k] = self.ids[place[inside] + k]
        return out

    def _sorted(self) -> np.ndarray:
        """Prefix doubling: rank holds the order of the suffixes by their first h words, 0 beyond a run's end."""
        n = len(self.place)
        rank = self.ids[self.place]
        order, h, here = np.arange(n), 1, np.arange(n)
        most = int(self.left.max(initial=0))
        while n:
            inside = self.left > h
            second = np.zeros(n, np.int64)
            second[inside] = rank[here[inside] + h]
            both = rank * (int(rank.max()) + 1) + second
            order = np.argsort(both, kind="stable")
            new = np.concatenate(([1], 1 + np.cumsum(np.diff(both[order]) != 0)))
            rank = np.empty(n, np.int64)
            rank[order] = new
            h *= 2
            if new[-1] == n or h >= most:
                break
        return order

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, place, "right") - 1

    def matches(self, block: TestBlock) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All verbatim matches of a window and more, each from its beginning to its end: number of the test suffix, place of the word it
        begins with, and length, in parts of a bounded size."""
        low, high = np.searchsorted(self.keys, block.low, "left"), np.searchsorted(self.keys, block.high, "right")
        met = np.flatnonzero(high > low)
        if not len(met):
            return
        # Suffixes of one range and one word before them begin matches at the same places.
        alike = np.stack((low[met], high[met], block.ids[block.suffix[met] - 1]), 1)
        groups, member = np.unique(alike, axis=0, return_inverse=True)
        member = member.ravel()
        held = np.argsort(member, kind="stable")
        first = np.searchsorted(member[held], np.arange(len(groups) + 1))
        size = groups[:, 1] - groups[:, 0]
        for group, places in _cut(size, PAIRS):
            place = self.place[self.order[groups[group, 0] + places]]
            begins = self.ids[place - 1] != groups[group, 2]  # the word before the first place is the last separator
            group, place = group[begins], place[begins]
            for k, nth in _cut(first[group + 1] - first[group], PAIRS):
                suffix = met[held[first[group[k]] + nth]]
                yield suffix, place[k], self._length(block, suffix, place[k])

    def _length(self, block: TestBlock, suffix: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How many words from each place are those of the suffix."""
        out = block.need[suffix].copy()
        at, step, going = block.suffix[suffix], np.arange(16), np.arange(len(out))
        while len(going):
            own = block.ids[np.minimum((at + out)[going, None] + step, len(block.ids) - 1)]
            same = own == self.ids[np.minimum((place + out)[going, None] + step, len(self.ids) - 1)]
            more = np.where(same.all(1), len(step), same.argmin(1))
            out[going] += more
            going = going[more == len(step)]
        return out


def _cut(size: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """np.repeat(range(len(size)), size), with each one's number among its likes, in parts of at most so many."""
    upto = np.cumsum(size)
    for at in range(0, int(upto[-1]) if len(upto) else 0, most):
        place = np.arange(at, min(at + most, int(upto[-1])))
        of = np.searchsorted(upto, place, "right")
        yield of, place - (upto - size)[of]


def blocks(benchmark: DataFrame, block_words: int = BLOCK_WORDS, window: int = WINDOW) -> Iterator[TestBlock]:
    """The benchmark (item_id, text) in blocks; it is read partition by partition, and one block is held at a time."""
    held, n = [], 0
    for row in benchmark.select("item_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).toLocalIterator():
        held.append((row[0], bytes(row[1])))
        n += len(row[1]) // 2 + 1
        if n >= block_words:
            yield TestBlock(held, window)
            held, n = [], 0
    if held:
        yield TestBlock(held, window)


def sent(benchmark: DataFrame, block_words: int, window: int) -> list:
    """A broadcast of each block, kept in files, not in the driver's memory."""
    out = []
    for block in blocks(benchmark, block_words, window):
        out.append(Shared(benchmark.sparkSession, block))
    return out


class Found:
    """What is found in a document: its words, its hit words, the items, and its longest match (-length, doc_start, item, item_start)."""

    def __init__(self, n_words: int, n_hit: int, items: set[str], longest: tuple | None):
        self.n_words, self.n_hit, self.items, self.longest = n_words, n_hit, items, longest

    @property
    def contaminated(self) -> bool:
        return self.n_hit > 0 and 20 * self.n_hit >= self.n_words


def judge(texts: list[bytes], held: list) -> list[Found]:
    """What is found in each text, from its verbatim matches with the items of all blocks."""
    split = [words_of(t) for t in texts]
    first = np.concatenate(([0], np.cumsum(np.array([len(w) + 1 for w in split], np.int64))))
    hit = np.zeros(int(first[-1]), bool)
    items: list[set[str]] = [set() for _ in texts]
    longest: list[tuple | None] = [None] * len(texts)
    for each in held:
        block = each.value
        shard = Shard.of(split, block)
        edge = np.zeros(len(hit) + 1, np.int64)
        for suffix, place, length in shard.matches(block):
            np.add.at(edge, place, 1)
            np.add.at(edge, place + length, -1)
            doc, item = shard.document(place), block.item[suffix]
            for d, i in np.unique(np.stack((doc, item), 1), axis=0).tolist():
                items[d].add(block.names[i])
            top = np.full(len(texts), 0)
            np.maximum.at(top, doc, length)
            for k in np.flatnonzero(length == top[doc]).tolist():
                d, i = int(doc[k]), int(item[k])
                new = (-int(length[k]), int(place[k] - first[d]), block.names[i], int(block.suffix[suffix[k]] - block.start[i]))
                longest[d] = new if longest[d] is None else min(longest[d], new)
        hit |= np.cumsum(edge[:-1]) > 0
        if len(held) > 1:
            each.drop()  # a worker holds one block at a time
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[first[1:]] - total[first[:-1]]
    return [Found(len(w), int(n), i, best) for w, n, i, best in zip(split, n_hit.tolist(), items, longest, strict=True)]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and of the longest match longest (its words), longest_item, item_start
    and doc_start (places in words; null without a match): a row for each document."""
    held = sent(benchmark, block_words, window)

    def run(batch: pa.RecordBatch) -> dict:
        found = judge(as_bytes(batch.column("text")), held)
        best = [f.longest or (None, None, None, None) for f in found]
        return {
            "doc_id": batch.column("doc_id"), "n_words": [f.n_words for f in found], "n_hit": [f.n_hit for f in found], "n_items": [len(f.items) for f in found],
            "items_sha256": [hashlib.sha256(",".join(sorted(f.items)).encode()).hexdigest() for f in found], "contaminated": [f.contaminated for f in found],
            "longest": [None if b[0] is None else -b[0] for b in best], "doc_start": [b[1] for b in best], "longest_item": [b[2] for b in best], "item_start": [b[3] for b in best],
        }

    ends = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long, longest_item string, item_start long, doc_start long"
    return map_batches(docs.select("doc_id", "text"), run, ends, most=SHARD_BYTES)


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the contaminated rows, in all their columns."""
    held, names = sent(benchmark, block_words, window), docs.columns

    def run(batch: pa.RecordBatch) -> dict:
        kept = batch.filter(pa.array([not f.contaminated for f in judge(as_bytes(batch.column("text")), held)], pa.bool_()))
        return {c: kept.column(c) for c in names}

    return map_batches(docs, run, docs.schema, most=SHARD_BYTES)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, item_start, doc_start, length: every verbatim match of at least so many words (or of a whole shorter item) that
    can't be made longer at either end; places in words."""
    held = sent(benchmark, block_words, least)

    def run(batch: pa.RecordBatch) -> dict:
        ids = batch.column("doc_id").to_pylist()
        split = [words_of(t) for t in as_bytes(batch.column("text"))]
        out: dict[str, list] = {k: [] for k in ("doc_id", "item_id", "item_start", "doc_start", "length")}
        for each in held:
            block = each.value
            shard = Shard.of(split, block)
            for suffix, place, length in shard.matches(block):
                doc, item = shard.document(place), block.item[suffix]
                out["doc_id"] += [ids[d] for d in doc.tolist()]
                out["item_id"] += [block.item_ids[i] for i in item.tolist()]
                out["item_start"] += (block.suffix[suffix] - block.start[item]).tolist()
                out["doc_start"] += (place - shard.first[doc]).tolist()
                out["length"] += length.tolist()
            if len(held) > 1:
                each.drop()
        return out

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, item_id long, item_start int, doc_start int, length int", most=SHARD_BYTES)
