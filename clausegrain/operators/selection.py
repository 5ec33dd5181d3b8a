"""Ranking, capped picks and samples. Every order ends in a key, and randomness is a hash of a key, so runs repeat."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausegrain.functions.text import hash_order, length_bucket
from clausegrain.operators.relations import numbered
from clausegrain.sources.scratch import free


def _per(document: str, *order: Column | str):
    return W.partitionBy(document).orderBy(*order)


def ranked(rows: DataFrame, score: str, key: str, top: int | None = None) -> DataFrame:
    """With rank by falling score, then key. With top, only the first so many are kept, before any row is numbered; else ranks come from ranges."""
    if top is None:
        return numbered(rows, None, F.col(score).desc(), key).withColumn("rank", (F.col("_rank") + 1).cast("int")).drop("_rank", "_before")
    best = rows.orderBy(F.col(score).desc(), key).limit(top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.col(score).desc(), key)))


def capped_top(rows: DataFrame, order: str, key: str, document: str, per_document: int, most: int) -> DataFrame:
    """Walking in order and passing over full documents: a passed row never frees room, so a rank within its document decides."""
    own = F.row_number().over(_per(document, order, key))
    return rows.withColumn("_own", own).where(F.col("_own") <= per_document).drop("_own").orderBy(order, key).limit(most)


def uncertain_batch(rows: DataFrame, score: str, key: str, document: str, n: int, per_document: int = 3) -> DataFrame:
    """The n most uncertain, at most so many a document out of the first 3n; if these are too few, the rest comes from beyond the pool, uncapped."""
    first = rows.orderBy(F.col(score).desc(), key).limit(4 * n)  # pool and reserve: the reserve fills n rows at most
    numbered = first.withColumn("_r", F.row_number().over(W.orderBy(F.col(score).desc(), key)))  # 4n rows
    pool = numbered.where(F.col("_r") <= 3 * n).withColumn("_own", F.row_number().over(_per(document, "_r"))).where(F.col("_own") <= per_document).drop("_own").withColumn("_stage", F.lit(0))
    reserve = numbered.where(F.col("_r") > 3 * n).withColumn("_stage", F.lit(1))
    return pool.unionByName(reserve).orderBy("_stage", "_r").limit(n).drop("_stage", "_r")


def tier_of(valid: Column) -> Column:
    """0: no labelled clause, 1: fewer than five, 2: more."""
    return F.when(F.coalesce(valid, F.lit(0)) == 0, 0).when(valid < 5, 1).otherwise(2)


def stable_tiers(queue: DataFrame, counts: DataFrame, document: str, position: str) -> DataFrame:
    """The queue by tier of its documents, each tier in the order it had."""
    return queue.join(counts, document, "left").withColumn("tier", tier_of(F.col("valid"))).orderBy("tier", position)


def tiered_expansion(queue: DataFrame, counts: DataFrame, document: str, position: str, per_document: int, most: int) -> DataFrame:
    """Tier after tier, documents by first appearance, at most so many clauses of each, until most are taken."""
    tiered = queue.join(counts, document, "left").withColumn("tier", tier_of(F.col("valid")))
    w = W.partitionBy(document)
    own = tiered.withColumns({"first_position": F.min(position).over(w), "_own": F.row_number().over(w.orderBy(position))})
    return own.where(F.col("_own") <= per_document).drop("_own").orderBy("tier", "first_position", position).limit(most)


def hash_sample(rows: DataFrame, key: str, n: int) -> DataFrame:
    """n rows by the order of their key's MD5; all rows if n is negative."""
    return rows if n < 0 else rows.orderBy(F.md5(F.col(key).cast("string")), key).limit(n)


def audited_queue(rows: DataFrame, priority: Column, key: str, n: int = 20) -> DataFrame:
    """Rows of priority, and after them n others by hash, each with its reason: the order of review is by reason and key."""
    first = rows.where(priority).withColumn("reason", F.lit("priority"))
    return first.unionByName(hash_sample(rows.where(~F.coalesce(priority, F.lit(False))), key, n).withColumn("reason", F.lit("sample"))).orderBy("reason", key)


def document_sample(documents: DataFrame, name: str, n: int | None) -> DataFrame:
    return (documents if n is None or n < 0 else hash_sample(documents, name, n)).orderBy(name)


def stratified_sample(rows: DataFrame, stratum: str, key: str, size: int = 40) -> DataFrame:
    """Of each stratum max(1, its share of size, rounded down) rows by hash order. No quota is above size, so each task sends that many rows of a stratum at most."""
    counts = rows.groupBy(stratum).agg(F.count("*").alias("_s"))
    total = counts.agg(F.sum("_s").alias("_n"))  # one row
    quota = F.greatest(F.lit(1), F.floor(F.col("_s") * F.least(F.lit(size), F.col("_n")) / F.col("_n")))
    quotas = counts.crossJoin(F.broadcast(total)).select(F.col(stratum).alias("_stratum"), quota.alias("_quota"))
    first = F.row_number().over(W.partitionBy(stratum).orderBy(F.md5(F.col(key).cast("string")), key))
    near = rows.withColumn("_r", first).where(F.col("_r") <= max(1, size))
    return near.join(quotas, F.col(stratum).eqNullSafe(F.col("_stratum"))).where("_r <= _quota").drop("_stratum", "_quota", "_r")


WANTED = ("short", "medium", "long", "medium", "long")
INSTEAD = ("medium", "long", "short")


def _picks() -> list[tuple]:
    """length_bucket, _r, how many short, medium and long candidates there are (five of each at most), turn, selection_reason: which candidate each turn takes."""
    out = []
    for counts in itertools.product(range(len(WANTED) + 1), repeat=3):
        left, took = dict(zip(("short", "medium", "long"), counts, strict=True)), dict.fromkeys(INSTEAD, 0)
        for turn, want in enumerate(WANTED):
            bucket = next((b for b in (want, *(i for i in INSTEAD if i != want)) if took[b] < left[b]), None)
            if bucket:
                took[bucket] += 1
                out.append((bucket, took[bucket], *counts, turn, f"wanted {want}, took {bucket}"))
    return out


def seed_batch(rows: DataFrame, document: str, key: str, text: str, status: str) -> DataFrame:
    """Five clauses a document, of wanted lengths in turn; within a length priority rows first, then by hash. A document's picks depend
    on one another, but only through how many candidates of each length it has, so a small table of all such counts says who is picked."""
    p, h, r, n = (free(rows.columns, c) for c in ("_p", "_h", "_r", "_n"))
    bucketed = rows.withColumns({"length_bucket": length_bucket(F.col(text)), p: (F.col(status) != "PRIORITY_UNREVIEWED").cast("int"), h: hash_order(F.col(key))})
    near = bucketed.withColumn(r, F.row_number().over(W.partitionBy(document, "length_bucket").orderBy(p, h, key))).where(F.col(r) <= len(WANTED)).drop(p, h)
    counts = {f"{n}_{b}": F.coalesce(F.max(F.when(F.col("length_bucket") == b, F.col(r))).over(W.partitionBy(document)), F.lit(0)) for b in ("short", "medium", "long")}  # fifteen rows a document at most
    taken = rows.sparkSession.createDataFrame(_picks(), f"length_bucket string, `{r}` int, {', '.join(f'`{c}` int' for c in counts)}, turn int, selection_reason string")
    picked = near.where(F.col(document).isNotNull() & F.col(key).isNotNull()).withColumns(counts).join(F.broadcast(taken), ["length_bucket", r, *counts])
    return picked.select(*rows.columns, "length_bucket", "turn", "selection_reason")


def review_needed(clauses: DataFrame, document: str, text: str, kind: str, suspicious: str, kinds: tuple[str, ...]) -> DataFrame:
    """With needs_review: suspicious, very short or long, of an odd kind, or of a document with few or many clauses."""
    n = F.count("*").over(W.partitionBy(document))
    return clauses.withColumn("needs_review", F.col(suspicious) | (F.length(text) < 20) | (F.length(text) > 3000) | F.col(kind).isin(*kinds) | (n < 5) | (n > 60))


def routing(reviews: DataFrame, key: str, action: str, confidence: str, needs_context: str, audit_percent: int = 10) -> DataFrame:
    """With reasons why a human must look: context, low confidence, risky actions, and an audit share of the sure ones by hash."""
    audit = (F.col(confidence) >= 0.9) & (hash_order(F.col(key)) % 100 < audit_percent)
    reasons = F.array_compact(F.array(F.when(F.col(needs_context), "NEEDS_CONTEXT"), F.when(F.col(confidence) < 0.7, "LOW_CONFIDENCE"), F.when(F.col(action).isin("REVIEW", "SPLIT", "MERGE_WITH_NEXT", "MERGE_WITH_PREVIOUS"), F.col(action)), F.when(audit, "AUDIT")))
    return reviews.withColumns({"reasons": reasons, "to_human": F.size(reasons) > 0})


def legal_or_long(clauses: DataFrame, document: str, kind: str, text: str, least: int = 30) -> DataFrame:
    """Legal clauses of some length; in documents without any, all clauses of that length."""
    long = F.length(text) >= least
    legal = (F.col(kind) == "legal_clause") & long
    return clauses.withColumn("_any", F.max(legal).over(W.partitionBy(document))).where(F.when(F.col("_any"), legal).otherwise(long)).drop("_any")


