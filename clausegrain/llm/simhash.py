"""SimHash near-duplicates, linked by covering locality-sensitive hashing.

Every bit position i gets a nonzero vector m(i) of radius + 1 bits. For each nonzero v of as many bits one table
keys a fingerprint by the positions with <m(i), v> = 1. The vectors of at most radius differing positions can't
span the whole space, so some v is orthogonal to all of them: in that table both fingerprints have the same key.
So no pair within the radius is missed, and 2^(radius + 1) - 1 tables do.

Only distinct fingerprints are hashed, so exact copies cost one row. The members of a small bucket are compared with each other. Those of a
larger one are tied exactly without comparing all pairs of it: two fingerprints at most two bits apart share a point at most one bit from
both, and all fingerprints around one point (65 at most) are within two bits of each other, so each is
linked to the smallest of them. Buckets of any size cost the same per row.

Two bits apart is closer than most edited copies are: a fingerprint of 64 bits puts texts of similarity 0.8 (Jaccard, five-word
shingles) some ten bits apart, and covering ten bits would take 2047 tables. So where near copies of that similarity must go
(`similar_links`, used by `one_of_each`), min-wise hashes find further links: 24 bands of 4 miss a pair of similarity 0.8 three
times in a million, 256 hashes then estimate the pair's similarity with a deviation of 0.025, and whole texts decide near the
limit. They join the same components. Of a band's members, those that are then in its largest component are not compared with each other again,
all others with everyone.

Defined results: null and empty texts have fingerprint zero, linked like any other; rows with equal ids and
texts share a component; a null id counts as no id when the smallest is sought; an empty table gives no rows; further columns of
any name stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from xxhash import xxh64_intdigest

from clausegrain.llm.common import as_bytes, discard, free, join_hot, map_batches, materialize, sliced

SEED = 42
BITS = 64


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles; A-Z count as lower case."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    found = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 65_536):
        ones += np.unpackbits(found[at : at + 65_536].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(found), bitorder="little").view("<u8")[0])


#: Buckets of so many fingerprints at most are compared pair by pair; larger ones are tied by the points their members share.
FEW = 16
#: For links by similarity: bands times rows min-wise hashes choose candidates, all HASHES estimate the similarity.
SIMILAR_SHINGLE, BANDS, ROWS, HASHES = 5, 24, 4, 256
SIMILARITY, DEVIATION = 0.8, 0.025
#: Members of a band, and shingles of theirs, in one part; two parts at a time are compared in a task.
PART_ROWS, PART_SHINGLES = 600, 1 << 19
FACTORS = np.random.default_rng(12).integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)


def minima(text: bytes) -> np.ndarray | None:
    """The min-wise hashes of a text's distinct five-word shingles (one of all words, if fewer); None without words."""
    words = text.lower().split()
    if not words:
        return None
    n = max(1, len(words) - SIMILAR_SHINGLE + 1)
    found = np.array(list({xxh64_intdigest(b" ".join(words[k : k + SIMILAR_SHINGLE])) >> 32 for k in range(n)}), np.uint32)
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(found), 512):
        np.minimum(least, (found[at : at + 512, None] * FACTORS).min(0), out=least)
    return least


def text_key(text: str = "text") -> Column:
    """What tells texts apart: 128 bits of their hash; null for null."""
    return F.unhex(F.md5(F.col(text).cast("binary")))


def signatures(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """fingerprints() with bands (a key each, empty without words), sketch (16 bits of each hash) and size (of the text, in words)."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = as_bytes(batch.column("text"))
        fps = np.array([fingerprint(x, shingle) for x in texts], dtype="<u8").view("<i8")
        bands, sketches = [], []
        for x in texts:
            least = minima(x)
            bands.append([] if least is None else [signed(xxh64_intdigest(least[k * ROWS : (k + 1) * ROWS].tobytes(), k)) for k in range(BANDS)])
            sketches.append(b"" if least is None else least.astype("<u2").tobytes())
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "fp": fps, "bands": bands, "sketch": sketches, "size": [len(x.split()) for x in texts]}

    return map_batches(docs.select("doc_id", text_key().alias("key"), "text"), run, "doc_id long, key binary, fp long, bands array<long>, sketch binary, size long", rows=500)


def shingles(text: bytes) -> frozenset[bytes]:
    words = text.lower().split()
    return frozenset(b" ".join(words[k : k + SIMILAR_SHINGLE]) for k in range(max(1, len(words) - SIMILAR_SHINGLE + 1))) if words else frozenset()


def alike(docs: DataFrame, texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Edges (fp, hub) of those pairs (key, other) of texts that are at least so similar.

    Pairs whose estimate is within four deviations of the limit are compared by their whole texts."""
    own = texts.select("key", F.col("fp").alias("fp"), F.col("sketch").alias("a"))
    theirs = texts.select(F.col("key").alias("other"), F.col("fp").alias("hub"), F.col("sketch").alias("b"))
    met = pairs.join(own, "key").join(theirs, "other").where("fp <> hub").select("key", "other", "fp", "hub", "a", "b")

    def estimate(batch: pa.RecordBatch) -> dict:
        a, b = (np.array([np.frombuffer(x, "<u2") for x in batch.column(c).to_pylist()]) for c in ("a", "b"))
        return {c: batch.column(c) for c in ("key", "other", "fp", "hub")} | {"about": (a == b).mean(1)}

    slack = 4 * DEVIATION
    likely = materialize(map_batches(met, estimate, "key binary, other binary, fp long, hub long, about double").where(F.col("about") >= similarity - slack), "likely")
    near = likely.where(F.col("about") < similarity + slack)
    wanted = materialize(near.select("key").unionByName(near.select(F.col("other").alias("key"))).distinct(), "wanted")
    whole = materialize(docs.select(text_key().alias("key"), "text").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "whole")
    both = near.join(whole, "key").withColumnRenamed("text", "a").join(whole.withColumnsRenamed({"key": "other", "text": "b"}), "other").select("fp", "hub", "a", "b")

    def exact(batch: pa.RecordBatch) -> dict:
        kept = []
        for a, b in zip(as_bytes(batch.column("a")), as_bytes(batch.column("b")), strict=True):
            x, y = shingles(a), shingles(b)
            kept.append(len(x & y) >= similarity * len(x | y) - 1e-9)
        found = batch.filter(pa.array(kept, pa.bool_()))
        return {"fp": found.column("fp"), "hub": found.column("hub")}

    sure = likely.where(F.col("about") >= similarity + slack).select("fp", "hub")
    return materialize(sure.unionByName(map_batches(both, exact, "fp long, hub long", rows=200)).distinct(), "alike")


def similar_links(docs: DataFrame, signed_docs: DataFrame, known: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """known (fp, hub) and more such edges: any two texts that are at least so similar and share a band are in one component of them.
    signed_docs: signatures() of docs.

    First all members of a band are compared with its pivot, the member whose bands are the fullest (an original shares more bands with
    its copies than they do with each other). In bands that then still hold several components, all members outside the
    largest one are compared with all members, within tasks."""
    texts = materialize(signed_docs.select("key", "fp", "bands", "sketch", "size").dropDuplicates(["key"]), "texts")
    keyed = texts.select("key", "fp", "size", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("band", "n")
    full = materialize(keyed.join(shared, "band"), "bands")
    weight = full.groupBy("key").agg(F.sum("n").alias("weight"))
    pivots = full.join(weight, "key").groupBy("band").agg(F.max(F.struct("weight", "key")).getField("key").alias("other"))
    pairs = full.join(pivots, "band").where("key <> other").select("key", "other").distinct()
    found = materialize(known.unionByName(alike(docs, texts, pairs, similarity)).distinct(), "links")
    roots = found.select("fp", F.col("fp").alias("root")).limit(0) if found.isEmpty() else components(found).withColumnRenamed("node", "fp")
    rooted = materialize(full.join(roots, "fp", "left").select("band", "key", "size", F.coalesce("root", "fp").alias("root")), "rooted")
    by_root = rooted.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    several = by_root.groupBy("band").agg(
        F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("all_size"), F.max("n").alias("n_main"), F.max_by("size", F.struct("n", "root")).alias("main_size"), F.count("*").alias("k")
    ).where("k > 1")
    parts = lambda n, size: F.greatest(F.ceil(n / PART_ROWS), F.ceil(size / PART_SHINGLES), F.lit(1))
    sized = several.select("band", "main", parts(F.col("n"), F.col("all_size")).alias("parts"), parts(F.col("n") - F.col("n_main"), F.col("all_size") - F.col("main_size")).alias("loose_parts"))
    left = materialize(rooted.join(sized, "band").select("band", "key", "root", (F.col("root") != F.col("main")).alias("loose"), "parts", "loose_parts"), "left")
    discard(full)
    discard(rooted)
    return found if left.isEmpty() else found.unionByName(closing(docs, left, similarity)).distinct()


def closing(docs: DataFrame, left: DataFrame, similarity: float) -> DataFrame:
    """Edges (fp, hub) between the roots that similar texts in the bands of left (band, key, root, loose, parts, loose_parts) join.

    A band's members are dealt to its parts and its loose members to loose parts, and each two parts meet in a group; a group's
    intersections are counted by matrix products over its shingles, and only a forest over the joined roots leaves the task."""

    def hashed(batch: pa.RecordBatch) -> dict:
        return {"key": batch.column("key"), "shingles": [np.array(sorted({xxh64_intdigest(x) for x in shingles(t)}), "<u8").tobytes() for t in as_bytes(batch.column("text"))]}

    wanted = materialize(left.select("key").distinct(), "wanted")
    whole = docs.select(text_key().alias("key"), "text").join(wanted, "key", "left_semi").dropDuplicates(["key"])
    hashes = materialize(map_batches(whole, hashed, "key binary, shingles binary", rows=500), "shingles")
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    as_member = left.select("band", "key", "root", F.lit(False).alias("loose"), F.pmod(F.xxhash64("key"), "parts").alias("one"), F.explode(every("loose_parts")).alias("two"))
    as_loose = left.where("loose").select("band", "key", "root", "loose", F.explode(every("parts")).alias("one"), F.pmod(F.xxhash64("key"), "loose_parts").alias("two"))
    ready = as_member.unionByName(as_loose).join(hashes, "key").select("band", "one", "two", "loose", "root", "shingles")
    ready = ready.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two")

    def joined(roots: list[int], loose: list[bool], sets: list[bytes]) -> list[tuple[int, int]]:
        if not any(loose) or all(loose) or min(roots) == max(roots):
            return []
        rows, root, loose = [np.frombuffer(x, "<u8") for x in sets], np.array(roots), np.array(loose)
        size = np.array([len(x) for x in rows])
        _, at, often = np.unique(np.concatenate(rows), return_inverse=True, return_counts=True)
        row, keep = np.repeat(np.arange(len(rows)), size), often[at] > 1  # a shingle of one text is in no intersection
        column, row = (np.cumsum(often > 1) - 1)[at[keep]], row[keep]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        place = np.where(loose, np.cumsum(loose), np.cumsum(~loose)) - 1
        both = np.zeros((int((~loose).sum()), int(loose.sum())), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
            a, b = np.searchsorted(column, (start, start + 1024))
            sides = []
            for side in (~loose, loose):
                of = side[row[a:b]]
                x = np.zeros((int(side.sum()), 1024), np.float32)
                x[place[row[a:b][of]], column[a:b][of] - start] = 1
                sides.append(x)
            both += sides[0] @ sides[1].T
        a, b = np.nonzero(both >= similarity * (size[~loose][:, None] + size[loose] - both) - 1e-9)
        pairs = np.unique(np.stack((root[~loose][a], root[loose][b]), 1), axis=0)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for x, y in pairs.tolist():
            x, y = top(x), top(y)
            up[max(x, y)] = min(x, y)
        return [(x, top(x)) for x in list(up) if top(x) != x]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, ([], [], [])
        for batch in sliced(batches, 200, 4 << 20):
            edges = []
            for *g, loose, root, x in zip(*(batch.column(c).to_pylist() for c in ("band", "one", "two", "loose", "root", "shingles")), strict=True):
                if g != group:
                    edges += joined(held[0], held[1], held[2])
                    group, held = g, ([], [], [])
                for to, value in zip(held, (root, loose, x), strict=True):
                    to.append(value)
            if edges:
                yield _edges(edges)
        if edges := joined(held[0], held[1], held[2]):
            yield _edges(edges)

    return ready.mapInArrow(run, "fp long, hub long").distinct()


def _edges(edges: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["fp", "hub"])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, key (a hash of the text, null for null) and fp, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> dict:
        made = np.array([fingerprint(x, shingle) for x in as_bytes(batch.column("text"))], dtype="<u8")
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "fp": made.view("<i8")}

    return map_batches(docs.select("doc_id", text_key().alias("key"), "text"), run, "doc_id long, key binary, fp long")


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The covering masks: any two fingerprints at most radius bits apart agree under one of them."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if ((i % n + 1) & v).bit_count() % 2) for v in range(1, n + 1)]


def _around(fp: Column, mask: int) -> Column:
    """The points that fp shares with fingerprints two bits away that agree with it under the mask: fp itself, and fp with one of the other bits changed."""
    rest = [1 << i for i in range(BITS) if not mask >> i & 1]
    return F.array(fp, *[fp.bitwiseXOR(F.lit(signed(b))) for b in rest])


def links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (fp, hub) among distinct fingerprints: their components are those of all pairs within radius 2."""
    if radius != 2:
        raise ValueError("the points that neighbours share are worked out for radius 2")
    tables = masks(radius)
    keys = distinct.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(signed(m))) for m in tables])).alias("t", "key"))
    shared = keys.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")  # fingerprints are distinct
    met = keys.join(shared, ["t", "key"])
    # In a small bucket the members are compared outright, and only those that are linked leave it.
    few = met.where(F.col("n") <= FEW).groupBy("t", "key").agg(F.collect_list("fp").alias("members"))
    near = lambda a, b: F.bit_count(a.bitwiseXOR(b)) <= radius
    pairs = F.transform("members", lambda a, i: F.transform(F.filter(F.slice("members", i + 2, FEW), lambda b: near(a, b)), lambda b: F.struct(F.greatest(a, b).alias("fp"), F.least(a, b).alias("hub"))))
    direct = few.select(F.inline(F.flatten(pairs)))
    points = None
    for t, m in enumerate(tables):
        around = _around(F.col("fp"), m)
        points = F.when(F.col("t") == t, around) if points is None else points.when(F.col("t") == t, around)
    balls = met.where(F.col("n") > FEW).select("fp", F.explode(points).alias("point")).groupBy("point").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    stars = balls.select(F.explode("members").alias("fp"), F.array_min("members").alias("hub")).where("fp <> hub")
    return direct.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) of every node of edges (a, b). In a round each node hooks onto the smallest of its neighbours and itself,
    and jumps to what that one hooks onto; edges are contracted to those between what the nodes came to, until none is left. Two rounds in three take the smallest id, which ends
    stars, as most components are; the third takes the smallest hash, new each time, which leaves a share of the nodes only whatever the order of the ids, so rounds are logarithmic in the longest way."""
    a, b = edges.columns
    left = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v"), "edges")
    labels = materialize(left.select(F.col("u").alias("node")).unionByName(left.select(F.col("v").alias("node"))).distinct().withColumn("root", F.col("node")), "labels")
    number = 0
    while not left.isEmpty():
        rank = (lambda c, number=number: F.xxhash64(c, F.lit(number))) if number % 3 == 2 else F.col
        ranked = lambda c, rank=rank: F.struct(rank(c).alias("rank"), F.col(c).alias("to"))
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hooked = materialize(both.groupBy("u").agg(F.min(ranked("v")).alias("low")).select(F.col("u").alias("node"), F.least(ranked("u"), F.col("low"))["to"].alias("up")), "hooks")
        up = materialize(hooked.join(hooked.select(F.col("node").alias("up"), F.col("up").alias("above")), "up").select("node", F.col("above").alias("up")), "ups")
        once = left.join(up.withColumnsRenamed({"node": "u", "up": "x"}), "u").select("x", "v")
        new = materialize(once.join(up.withColumnsRenamed({"node": "v", "up": "y"}), "v").where("x <> y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "edges")
        moved = materialize(labels.join(up.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels")
        for old in (left, labels, hooked, up):
            discard(old)
        left, labels, number = new, moved, number + 1
    least = labels.groupBy("root").agg(F.min("node").alias("least"))
    named = materialize(join_hot(labels, least, "root").select("node", F.col("least").alias("root")), "labels")
    discard(left)
    discard(labels)
    return named


def classes(docs: DataFrame, shingle: int = 3, radius: int = 2, similarity: float | None = None) -> DataFrame:
    """doc_id, key, fp, root (its component's smallest fingerprint) and component_id of each row of docs; with a similarity, its links count too."""
    made = materialize(fingerprints(docs, shingle) if similarity is None else signatures(docs, shingle), "fingerprints")
    distinct = made.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = links(distinct.select("fp"), radius)
    edges = materialize(found, "links")
    if similarity is not None:
        edges = materialize(similar_links(docs, made, edges, similarity), "links")
    if edges.isEmpty():
        known = distinct.select("fp", F.col("fp").alias("root"), F.col("first").alias("component_id"))
    else:
        roots = components(edges).withColumnRenamed("node", "fp")
        least = roots.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("least"))
        named = roots.join(least, "root").select("fp", "root", "least")
        known = distinct.join(named, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), F.coalesce("least", "first").alias("component_id"))
    discard(edges)
    return join_hot(made.select("doc_id", "key", "fp"), materialize(known, "known"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest doc_id reachable over links."""
    return classes(docs, shingle, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 2, similarity: float | None = SIMILARITY) -> DataFrame:
    """The row of the smallest doc_id of each component of links by fingerprint and by similarity, in all columns of docs; among rows with equal ids, that of the smallest text hash, once."""
    known = materialize(classes(docs, shingle, radius, similarity).select("doc_id", "key", "root"), "classes")
    least = known.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("m"))
    own, kept_id, kept_key = (free(docs.columns, c) for c in ("text_key", "kept_id", "kept_key"))
    named = lambda d: d.select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key))
    keep = materialize(named(least.select("m.*")), "kept")
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & F.col(own).eqNullSafe(F.col(kept_key))
    kept = docs.withColumn(own, text_key()).join(keep, same, "left_semi")
    repeated = materialize(named(known.groupBy("doc_id", "key").count().where("count > 1")), "repeated")
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_semi").dropDuplicates(["doc_id", own])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.drop(own)
