"""Language-model scores: prediction by partial matching over bytes, beside an add-one unigram baseline.

Counts of byte contexts come from all training documents in one aggregation: the trie of order 5 is a table of grams (five
bytes of context and a symbol) that grows with the corpus, cut into blocks of about BLOCK_GRAMS grams by the context's two nearest
bytes. A symbol unseen in a context costs that context's escape (method C: distinct symbols against all occurrences) and is
sought one level below, where symbols that the longer context has are excluded; below the root all symbols left are alike.

Texts are read once, into units of some UNIT_BYTES, kept in the shared folder. A unit's distinct grams meet the blocks they belong to, a task
for a block and a share of the units, and their costs come back to the unit, where a document's score is the sum over
its bytes. So work and tables grow with the corpus, and no pass over the texts depends on the size of the trie. A block holds all grams of one pair of nearest bytes
at least, so the memory of the task of the commonest pair grows with the distinct grams of that pair.

Baseline counts of frequent words (FREQUENT of them, at most LONGEST bytes each: some 20 MB) travel to the tasks;
all other words are joined with the whole vocabulary, so no word is left out. Words of more than LONGEST bytes go by their SHA-256.

Defined results: null and empty texts have just the end token and score 0; a null id trains; repeated rows are
counted and scored as often as they come; without training text every byte costs log10(256); further columns of any name are not read.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from clausegrain.llm.common import Shared, as_bytes, discard, materialize, sliced

#: The longest context, and grams of a block: a task holds one block, whatever the corpus.
ORDER, BLOCK_GRAMS = 5, 1 << 20
#: Bytes of text in a unit (places within one then fit 22 bits, see _by_text), and of a block's looked-up grams in a task, about.
UNIT_BYTES, TASK_BYTES = 3 << 20, 256 << 20
FREQUENT, LONGEST = 1 << 18, 64
#: Distinct words or grams that a task gathers before it sends them on.
GATHERED = 300_000
#: Bits of a code below its flag.
TOP = 8 * (ORDER + 1)
CODE = (1 << TOP) - 1


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def codes_of(text: bytes, size: np.ndarray) -> np.ndarray:
    """A code for each byte of joined texts: the byte before it in the highest of ORDER + 1 bytes, the next below, itself in the lowest, and above (from bit TOP) how many of the bytes before it its text lacks."""
    raw = np.frombuffer(text, np.uint8)
    out = raw.astype(np.int64)
    for j in range(1, ORDER + 1):
        out[j:] |= raw[:-j].astype(np.int64) << 8 * (ORDER + 1 - j)
    for at, k in _begins(size):
        out[at] = _codes_at(raw, at, k)
    return out


def _begins(size: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """The places of the texts' first bytes, which have fewer than ORDER bytes before them, and how many they have."""
    start = np.cumsum(size) - size
    return [((start + k)[size > k], k) for k in range(ORDER)]


def _codes_at(raw: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The codes of places that have k bytes before them."""
    out = raw[at].astype(np.int64) | (ORDER - k) << TOP
    for j in range(1, k + 1):
        out |= raw[at - j].astype(np.int64) << 8 * (ORDER + 1 - j)
    return out


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes in order, with their summed counts."""
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def packed(codes: np.ndarray) -> bytes:
    """Ascending codes, by their distances."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(codes, prepend=0).tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64))


#: Costs travel as multiples of 2^-18 below 64, three bytes each, so that a text's score is right to some millionths a byte.
COST_STEP = 1 << 18


def packed_costs(costs: np.ndarray) -> bytes:
    whole = np.minimum(np.rint(-costs * COST_STEP), (1 << 24) - 1).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(whole.view(np.uint8).reshape(-1, 4)[:, :3].T.tobytes())


def unpacked_costs(blob: bytes) -> np.ndarray:
    low, middle, high = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(3, -1).astype(np.int64)
    return (low | middle << 8 | high << 16) / -COST_STEP


def key_of(word: bytes) -> bytes:
    return word if len(word) <= LONGEST else b"\0" + hashlib.sha256(word).digest()  # no word holds white space, any may hold a null


MEASURED = "unit binary, doc_id array<long>, held array<boolean>, size array<long>, text binary, codes binary, word binary, gram long, n long"


def measured(docs: DataFrame) -> DataFrame:
    """Rows of three kinds: units (unit, doc_id, held, size, text, codes: the distinct codes of all texts), counted training words
    (word, n), and counted training grams (gram, n), a gram of -1 counting the texts."""
    names = [f.split()[0] for f in MEASURED.split(", ")]
    kinds = dict(zip(names, (pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()), strict=True))

    def out(**columns) -> Iterator[pa.RecordBatch]:
        n = len(next(iter(columns.values())))
        made = pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) if c in columns else pa.nulls(n, kinds[c]) for c in names], names)
        for at in range(0, n, 20_000):
            yield made.slice(at, 20_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=5)
        words: Counter = Counter()
        grams: list[tuple] = []
        texts: list[bytes] = []
        ids: list[int | None] = []
        held: list[bool] = []

        def unit() -> Iterator[pa.RecordBatch]:
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            text = b"".join(texts)
            train = ~np.array(held, bool)
            key = codes_of(text, size) << 1 | np.repeat(train, size)
            key.sort()
            first = np.flatnonzero(np.concatenate(([True], key[1:] >> 1 != key[:-1] >> 1))) if len(key) else np.zeros(0, np.int64)
            codes = key[first] >> 1
            n = np.add.reduceat(key & 1, first) if len(first) else codes
            grams.extend([(codes[n > 0], n[n > 0]), (np.array([-1]), np.array([int(train.sum())]))])
            yield from out(unit=[uuid.uuid4().bytes], doc_id=[ids], held=[held], size=[size], text=[pack.compress(text)], codes=[packed(codes)])
            for x, trains in zip(texts, train, strict=True):
                if trains:
                    words.update(x.split())
                if len(words) > GATHERED:
                    yield from sent()
            if sum(len(c) for c, _ in grams) > 8 * GATHERED:
                grams[:] = [_summed(*map(np.concatenate, zip(*grams, strict=True)))]
                if len(grams[0][0]) > 6 * GATHERED:
                    yield from out(gram=grams[0][0], n=grams[0][1])
                    grams.clear()
            for x in (texts, ids, held):
                x.clear()

        def sent() -> Iterator[pa.RecordBatch]:
            yield from out(word=list(map(key_of, words)), n=list(words.values()))
            words.clear()

        for batch in sliced(batches, 500, UNIT_BYTES // 4):
            lowered = [x.lower() for x in as_bytes(batch.column("text"))]
            texts += lowered
            ids += batch.column("doc_id").to_pylist()
            held += batch.column("held").to_pylist()
            if sum(map(len, texts)) >= UNIT_BYTES:
                yield from unit()
        if texts:
            yield from unit()
        if words:
            yield from sent()
        if grams:
            codes, n = _summed(*map(np.concatenate, zip(*grams, strict=True)))
            yield from out(gram=codes, n=n)

    return docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")).mapInArrow(run, MEASURED)


class Block:
    """Part of the trie: the contexts of a range of two nearest bytes, below them all of one byte and of none.

    The symbols seen in a context are seen in all shorter ones, so what is excluded there depends on the context alone. Of each
    context are kept the log10 of its denominator and escape, as the longest (own) and for one level less, come from it (after)."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, flat: np.ndarray, root: np.ndarray, order: int = ORDER):
        self.order = order
        self.left = math.log10(max(1, 256 - int((root > 0).sum())))
        symbols = np.arange(256)
        at1, s1 = np.nonzero(flat)
        levels = {0: (symbols[root > 0], root[root > 0]), 1: ((at1 << 8) + s1, flat[at1, s1])}
        plain, had = codes & CODE, ORDER - (codes >> TOP)
        for j in range(2, order + 1):
            on = had >= j
            levels[j] = _summed((plain[on] >> 8 * (ORDER + 1 - j) << 8) + (plain[on] & 255), n[on])
        self.keys = {j: k for j, (k, _) in levels.items()}
        self.logs = {j: np.log10(v).astype(np.float32) for j, (_, v) in levels.items()}
        self.contexts, self.own, self.after = {}, {}, {}
        total, distinct = {}, {}
        for j, (key, v) in levels.items():
            above = key >> 8
            start = np.flatnonzero(np.concatenate(([True], above[1:] != above[:-1]))) if len(key) else np.zeros(0, np.int64)
            add = lambda x, start=start: np.add.reduceat(x, start) if len(start) else np.zeros(0, np.int64)
            self.contexts[j] = above[start]
            total[j], distinct[j] = add(v), np.diff(np.append(start, len(key)))
            self.own[j] = _parts(total[j], distinct[j])
            if j:
                below, m = levels[j - 1]
                same = np.searchsorted(below, (key >> 16 << 8) + (key & 255))
                parent = np.searchsorted(self.contexts[j - 1], self.contexts[j] >> 8)
                self.after[j] = _parts(total[j - 1][parent] - add(m[same]), distinct[j - 1][parent] - distinct[j])

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Log10 probability of each code's symbol."""
        plain, had = codes & CODE, ORDER - (codes >> TOP)
        out, spent = np.zeros(len(codes)), np.zeros(len(codes))
        open_, came = np.arange(len(codes)), np.full(len(codes), -1)
        for j in range(self.order, -1, -1):
            on = open_[had[open_] >= j]
            context = plain[on] >> 8 * (ORDER + 1 - j)
            at, there = _found(self.contexts[j], context)
            on, at, context = on[there], at[there], context[there]
            denominator, escape = self.own[j][0][at], self.own[j][1][at]
            up = came[on] >= 0
            if up.any():
                denominator[up], escape[up] = self.after[j + 1][0][came[on[up]]], self.after[j + 1][1][came[on[up]]]
            node, seen = _found(self.keys[j], (context << 8) + (plain[on] & 255))
            out[on[seen]] = spent[on[seen]] + self.logs[j][node[seen]] - denominator[seen]
            spent[on[~seen]] += escape[~seen]
            came[on[~seen]] = at[~seen]
            gone = np.zeros(len(codes), bool)
            gone[on[seen]] = True
            open_ = open_[~gone[open_]]
        out[open_] = spent[open_] - self.left
        return out

def _parts(total: np.ndarray, distinct: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log10 of a context's denominator and of its escape; a context without symbols costs nothing."""
    denominator = np.log10(np.maximum(total + distinct, 1))
    return denominator, np.where(distinct > 0, np.log10(np.maximum(distinct, 1)) - denominator, 0)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Cuts:
    """Where the blocks begin, in pairs of nearest bytes; and the counts of contexts of one byte and of none."""

    def __init__(self, counts: DataFrame, most: int):
        near = counts.groupBy(F.expr(f"shiftright(gram, {TOP - 8}) & 255").alias("c"), F.expr("gram & 255").alias("s"), F.expr(f"gram >= {ORDER << TOP}L").alias("none")).agg(F.sum("n").alias("n")).toArrow()  # 2^17 rows at most
        c, s, n, none = (near.column(k).to_numpy() for k in ("c", "s", "n", "none"))
        self.flat, self.root = np.zeros((256, 256), np.int64), np.zeros(256, np.int64)
        np.add.at(self.root, s, n)
        np.add.at(self.flat, (c[~none], s[~none]), n[~none])
        pairs = counts.groupBy(F.expr(f"IF(gram >= {ORDER - 1 << TOP}L, 0, shiftright(gram, {TOP - 16}) & 65535)").alias("pair")).count().collect()  # 2^16 rows at most
        begin, held = [0], 0
        for pair, k in sorted((r[0], r[1]) for r in pairs):
            if held and held + k > most:
                begin.append(pair)
                held = 0
            held += k
        self.begin = np.array(begin)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The block of each code; those with less than two bytes of context are the first one's."""
        return np.where(codes >> TOP > ORDER - 2, 0, np.searchsorted(self.begin, codes >> TOP - 16 & 0xFFFF, "right") - 1)

    def dealt(self, codes: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """An order of the codes by block, and each block's part of it; no codes (a unit of empty texts) have no part."""
        if not len(codes):
            return np.zeros(0, np.int64), []
        block = self.of(codes).astype(np.uint16)  # 2^16 pairs at most begin one
        order = np.argsort(block, kind="stable")
        edge = np.flatnonzero(np.diff(block[order].astype(np.int32), prepend=-1)).tolist()
        return order, [(int(block[order[a]]), a, b) for a, b in zip(edge, [*edge[1:], len(codes)], strict=True)]


def costs(units: DataFrame, counts: DataFrame, cuts: Cuts, order: int) -> DataFrame:
    """unit, block, costs: for each unit and block, log10 probabilities of the unit's distinct codes in the block, packed, in the order that cuts deals them."""
    held = Shared(units.sparkSession, cuts)
    size = counts.agg(F.count("*")).first()[0]
    looked_up = units.agg(F.coalesce(F.sum("n_codes"), F.lit(0))).first()[0]
    shares = max(1, math.ceil(8 * looked_up / len(cuts.begin) / TASK_BYTES))  # tasks that share a block's look-ups, each with the block's own table
    ends = "block int, share int, unit binary, codes binary, n binary"
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())

    def rows(made: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], ["block", "share", "unit", "codes", "n"])

    def table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def dealt() -> pa.RecordBatch:
            codes, n = map(np.concatenate, zip(*gathered, strict=True))
            gathered.clear()
            by, parts = held.value.dealt(codes)
            return rows([(block, share, None, codes[by[a:b]].tobytes(), n[by[a:b]].tobytes()) for block, a, b in parts for share in range(shares)])

        gathered: list[tuple] = []
        for batch in batches:
            gathered.append((batch.column("gram").to_numpy(), batch.column("n").to_numpy()))
            if sum(len(c) for c, _ in gathered) > 2 * GATHERED:
                yield dealt()
        if sum(len(c) for c, _ in gathered):
            yield dealt()

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 8):
            for unit, blob in zip(batch.column("unit").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                codes = unpacked(blob)
                by, parts = held.value.dealt(codes)
                if parts:
                    yield rows([(block, unit[0] % shares, unit, packed(codes[by[a:b]]), None) for block, a, b in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, now, gathered, trie = held.value, None, [], None
        for batch in batches:
            out = []
            for block, share, unit, codes, n in zip(*(batch.column(c).to_pylist() for c in ("block", "share", "unit", "codes", "n")), strict=True):
                if (block, share) != now:
                    now, gathered, trie = (block, share), [], None
                if unit is None:
                    gathered.append((np.frombuffer(codes, np.int64), np.frombuffer(n, np.int64)))
                    continue
                if trie is None:
                    empty = np.zeros(0, np.int64)
                    trie, gathered = Block(*_summed(*map(np.concatenate, zip(*gathered, (empty, empty), strict=True))), cuts.flat, cuts.root, order), []
                out.append((unit, block, packed_costs(trie.costs(unpacked(codes)))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.binary(), pa.int32(), pa.binary()), strict=True)], ["unit", "block", "costs"])

    both = counts.select("gram", "n").mapInArrow(table, ends).unionByName(units.select("unit", "codes").mapInArrow(wanted, ends))
    parts = max(1, len(cuts.begin) * shares, math.ceil(size / BLOCK_GRAMS))
    met = both.repartition(parts, "block", "share").sortWithinPartitions("block", "share", F.col("unit").asc_nulls_first())
    return met.mapInArrow(run, "unit binary, block int, costs binary")


def scores(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes for each row of docs (doc_id, text)."""
    spark = docs.sparkSession
    if order not in range(1, ORDER + 1):
        raise ValueError(f"orders are 1 to {ORDER}")
    found = materialize(measured(docs), "measured")
    counts = materialize(found.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    vocabulary = materialize(found.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    texts = counts.where("gram = -1").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    train_tokens, distinct = total[0] + texts, total[1] + (texts > 0)
    floor = math.log10(train_tokens + distinct + 1)

    grams = counts.where("gram >= 0")
    cuts = Cuts(grams, BLOCK_GRAMS)
    units = found.where("unit is not null")
    priced = costs(units.select("unit", "codes", F.expr("aggregate(size, 0L, (a, x) -> a + x)").alias("n_codes")), grams, cuts, order)  # bytes: no fewer than codes

    frequent = vocabulary.orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
    known = Shared(spark, (frequent.column("word").to_pylist(), np.log10(frequent.column("n").to_numpy() + 1.0).tolist(), cuts))
    none = lambda kind: F.lit(None).cast(kind)
    texts_of = units.select("unit", F.lit(-1).alias("block"), "doc_id", "held", "size", F.col("text").alias("blob"))
    costs_of = priced.select("unit", "block", none("array<long>").alias("doc_id"), none("array<boolean>").alias("held"), none("array<long>").alias("size"), F.col("costs").alias("blob"))
    met = texts_of.unionByName(costs_of).repartition("unit").sortWithinPartitions("unit", "block")
    schema = "unit binary, k int, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, rare array<struct<word binary, k long>>, score double, n_bytes long"
    out = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, frequent_logs, cuts = known.value
        of = dict(zip(frequent_words, frequent_logs, strict=True))
        ends = zstandard.ZstdDecompressor()
        now: tuple | None = None
        pieces: list[bytes] = []

        def scored() -> Iterator[pa.RecordBatch]:
            unit, ids, held, size, blob = now
            text, size = ends.decompress(blob), np.array(size, np.int64)
            score = _by_text(text, size, cuts, np.concatenate([np.zeros(0), *map(unpacked_costs, pieces)]))
            stop = np.cumsum(size)
            each = [text[a:b].split() for a, b in zip((stop - size).tolist(), stop.tolist(), strict=True)]
            n_words = np.fromiter(map(len, each), np.int64, len(each))
            words = list(chain.from_iterable(each))
            logs = np.fromiter(map(of.get, words, repeat(-1.0)), float, len(words))
            missing = np.flatnonzero(logs < 0)
            lost: dict[bytes, int] = {}
            number = np.fromiter((lost.setdefault(words[i], len(lost)) for i in missing.tolist()), np.int64, len(missing))
            keys = list(map(key_of, lost))
            long = {k: of[key] for k, (w, key) in enumerate(zip(lost, keys, strict=True)) if len(w) > LONGEST and key in of}
            if long:  # frequent, by their hash
                table = np.full(len(lost), -1.0)
                table[list(long)] = list(long.values())
                logs[missing] = table[number]
                missing, number = missing[logs[missing] < 0], number[logs[missing] < 0]
            doc = np.repeat(np.arange(len(each)), n_words)
            pair, times = np.unique(doc[missing] * max(1, len(lost)) + number, return_counts=True)
            of_doc = np.searchsorted(pair // max(1, len(lost)), np.arange(len(each) + 1))
            rare = pa.ListArray.from_arrays(pa.array(of_doc, pa.int32()), pa.StructArray.from_arrays([pa.array(keys, pa.binary()).take(pa.array(pair % max(1, len(lost)))), pa.array(times, pa.int64())], ["word", "k"]))
            known_logs = np.bincount(doc, np.where(logs < 0, 0, logs), len(each))
            rows = {
                "unit": [unit] * len(ids), "k": range(len(ids)), "doc_id": ids, "held_out": held, "n_tokens": n_words + 1, "n_known": n_words - np.bincount(doc[missing], minlength=len(each)) + (texts > 0),
                "logs": known_logs + math.log10(texts + 1), "score": score, "n_bytes": size,
            }
            made = pa.RecordBatch.from_arrays([rare.cast(f.type) if f.name == "rare" else pa.array(rows[f.name], type=f.type) for f in out], schema=out)
            for at in range(0, made.num_rows, 2000):
                yield made.slice(at, 2000)

        for batch in sliced(batches, 64):
            for unit, block, *meta, blob in zip(*(batch.column(c).to_pylist() for c in ("unit", "block", "doc_id", "held", "size", "blob")), strict=True):
                if block >= 0:
                    pieces.append(blob)
                    continue
                if now:
                    yield from scored()
                now, pieces = (unit, *meta, blob), []
        if now:
            yield from scored()

    scored = materialize(met.mapInArrow(run, schema), "scored")
    discard(found)
    discard(counts)
    rare = scored.select("unit", "k", F.explode("rare").alias("r")).select("unit", "k", "r.word", F.col("r.k").alias("times")).join(vocabulary, "word")
    more = rare.groupBy("unit", "k").agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("more_logs"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.drop("rare").join(more, ["unit", "k"], "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + zero("more_logs") - F.col("n_tokens") * F.lit(floor)).alias("base_score"), "score", "n_bytes",
    )


def _by_text(text: bytes, size: np.ndarray, cuts: Cuts, priced: np.ndarray) -> np.ndarray:
    """Of each of the joined texts, the sum of its bytes' costs; priced has those of the distinct codes as cuts deals them."""
    raw = np.frombuffer(text, np.uint8)
    each = np.empty(len(raw))
    begins = _begins(size)
    flagged = [(at, _codes_at(raw, at, k)) for at, k in begins]
    whole = np.ones(len(raw), bool)
    for at, _ in begins:
        whole[at] = False
    seen = np.bincount(raw, minlength=256) > 0
    letter, place_bits = max(1, int(seen.sum() - 1).bit_length()), max(1, len(raw).bit_length())
    if letter * (ORDER + 1) + place_bits <= 64:
        # With the alphabet's own numbers, a code and its place fit a word, and sorting needs no permutation.
        own = (np.cumsum(seen) - 1).astype(np.uint64)[raw]
        key = own << np.uint64(place_bits)
        for j in range(1, ORDER + 1):
            key[j:] |= own[:-j] << np.uint64(letter * (ORDER + 1 - j) + place_bits)
        key = (key | np.arange(len(raw), dtype=np.uint64))[whole]
        key.sort()
        place = (key & np.uint64((1 << place_bits) - 1)).astype(np.int64)
        first = np.flatnonzero(np.diff(key >> np.uint64(place_bits)) != 0) + 1
    else:
        place = np.flatnonzero(whole)
        codes = codes_of(text, size)[place]
        by_code = np.argsort(codes, kind="stable")
        place = place[by_code]
        first = np.flatnonzero(np.diff(codes[by_code])) + 1
    first = np.concatenate(([0], first)) if len(place) else np.zeros(0, np.int64)
    rest = np.unique(np.concatenate([c for _, c in flagged]))
    distinct = np.concatenate((_codes_at(raw, place[first], ORDER), rest))
    by, _ = cuts.dealt(distinct)
    if len(priced) != len(distinct):
        raise ValueError(f"{len(priced)} costs for {len(distinct)} codes")
    cost = np.empty(len(distinct))
    cost[by] = priced
    each[place] = np.repeat(cost[: len(first)], np.diff(np.append(first, len(place))))
    for at, codes in flagged:
        each[at] = cost[len(first) + np.searchsorted(rest, codes)]
    upto = np.concatenate(([0.0], np.cumsum(each)))
    end = np.cumsum(size)
    return upto[end] - upto[end - size]
