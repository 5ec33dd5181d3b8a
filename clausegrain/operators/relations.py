"""Keyed relations: lookups, upserts, integrity, neighbours, duplicates, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausegrain.sources.scratch import free, written


def pending(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the queue whose key isn't done; null keys are pending."""
    return queue.join(done.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")


def completed(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return queue.join(done.select(key).distinct(), key, "left_semi")


def upsert(old: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """New rows replace old ones of their key; columns in keep (such as created_at) stay as they were where there was one."""
    rest = old.join(new.select(key).distinct(), key, "left_anti")
    if keep:
        was = old.select(key, *(F.col(c).alias(f"_old_{c}") for c in keep))
        new = new.join(was, key, "left").withColumns({c: F.coalesce(f"_old_{c}", c) for c in keep}).drop(*(f"_old_{c}" for c in keep))
    return rest.unionByName(new, allowMissingColumns=True)


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by an order; dropDuplicates() would take any."""
    w = W.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def neighbours(rows: DataFrame, document: str, position: str, text: str, missing: str = "N/A") -> DataFrame:
    """With previous_text and next_text: the texts at the position before and after, by arithmetic, not by what row is next."""
    near = rows.select(F.col(document).alias("_d"), F.col(position).alias("_p"), F.col(text).alias("_t"))
    out = rows
    for name, step in (("previous_text", -1), ("next_text", 1)):
        side = near.select("_d", (F.col("_p") - step).alias("_p"), F.col("_t").alias(name))
        out = out.join(side, (F.col(document) == F.col("_d")) & (F.col(position) == F.col("_p")), "left").drop("_d", "_p")
    return out.na.fill(missing, ["previous_text", "next_text"])


def nearest_rows(rows: DataFrame, document: str, position: str, text: str) -> DataFrame:
    """With previous_text and next_text of the nearest rows of the same document that are there."""
    w = W.partitionBy(document).orderBy(position)
    return rows.withColumns({"previous_text": F.lag(text).over(w), "next_text": F.lead(text).over(w)})


def integrity(rows: DataFrame, reference: DataFrame, key: str, value: str) -> DataFrame:
    """key and state (missing, unknown, changed, same) of every key on either side."""
    a = rows.select(F.col(key).alias("_a"), F.col(value).alias("_va"))
    b = reference.select(F.col(key).alias("_b"), F.col(value).alias("_vb"))
    both = a.join(b, F.col("_a") == F.col("_b"), "full_outer")
    state = F.when(F.col("_a").isNull(), "missing").when(F.col("_b").isNull(), "unknown").when(~F.col("_va").eqNullSafe(F.col("_vb")), "changed").otherwise("same")
    return both.select(F.coalesce("_a", "_b").alias(key), state.alias("state"))


def enrich(rows: DataFrame, scores: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Left join with defaults for keys that the scores lack."""
    return rows.join(scores, key, "left").na.fill(defaults)


def by_prefix(rows: DataFrame, prefixes: DataFrame, key: str, prefix: str, length: int = 8) -> DataFrame:
    """Rows whose key begins with one of the prefixes, all of one length: an equality on the key's beginning."""
    return rows.join(prefixes.select(F.col(prefix).alias("_p")).distinct(), F.left(F.col(key), F.lit(length)) == F.col("_p"), "left_semi")


def in_order(rows: DataFrame, order: DataFrame, key: str, ordinal: str) -> DataFrame:
    """Rows of the keys in a list, in the list's order."""
    return rows.join(order.select(key, ordinal), key).orderBy(ordinal)


def ordered_left(rows: DataFrame, other: DataFrame, key: str, ordinal: str = "_position") -> DataFrame:
    """Left join that carries each row's place among the rows, ordered by key, so that its order can be had again."""
    placed = numbered(rows, None, key).withColumnRenamed("_rank", ordinal).drop("_before")
    return placed.join(other, key, "left")


def set_operations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key and side (both, left, right) of every distinct key: intersection, difference and symmetric difference at once."""
    side = lambda df, c: df.select(key).distinct().withColumn(c, F.lit(True))
    both = side(a, "_a").join(side(b, "_b"), key, "full")
    return both.select(key, F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "left").otherwise("right").alias("side"))


def duplicates(rows: DataFrame, key: Column, order: str) -> DataFrame:
    """With in_group (every member of a group of two or more), is_repeat (all but the first by an order that tells rows apart). Groups are counted,
    and those of two and more joined, so that no task sorts the rows of a busy key."""
    own, n, first = (free(rows.columns, c) for c in ("_k", "_n", "_first"))
    keyed = rows.withColumn(own, key)
    several = keyed.groupBy(F.col(own).alias("_" + own)).agg(F.count("*").alias(n), F.min(order).alias(first)).where(F.col(n) > 1)
    out = keyed.join(several, F.col(own).eqNullSafe(F.col("_" + own)), "left")
    return out.withColumns({"in_group": F.col(n).isNotNull(), "is_repeat": F.coalesce(F.col(order) != F.col(first), F.lit(False))}).drop(own, "_" + own, n, first)


def numbered(rows: DataFrame, size: str | None, *order) -> DataFrame:
    """rows with _rank (from 0) and _before, the sum of size over the rows before each in the order; no task sorts all of them. The ranges are written to the
    shared folder once, so that sums and ranks are of the same ranges."""
    part, ahead_s, ahead_k = (free(rows.columns, c) for c in ("_p", "_s", "_k"))
    value = F.col(size) if size else F.lit(1)
    ranged = written(rows.repartitionByRange(*order).withColumn(part, F.spark_partition_id()), "ranged")
    sums = ranged.groupBy(part).agg(F.sum(value).alias("s"), F.count("*").alias("k"))
    ahead = W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    first = sums.select(part, F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias(ahead_s), F.coalesce(F.sum("k").over(ahead), F.lit(0)).alias(ahead_k))  # as many rows as partitions
    own = W.partitionBy(part).orderBy(*order)
    upto = F.coalesce(F.sum(value).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(F.broadcast(first), part).withColumns({"_rank": F.col(ahead_k) + F.row_number().over(own) - 1, "_before": F.col(ahead_s) + upto}).drop(part, ahead_s, ahead_k)


def shared_keys(rows: DataFrame, key: Column, split: str) -> DataFrame:
    """key and splits of keys that lie in more than one split: leakage."""
    found = rows.groupBy(key.alias("key")).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return found.where(F.size("splits") > 1)


def overlap(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def union_filled(a: DataFrame, b: DataFrame, numbers: int = 0, texts: str = "SYNTHETIC") -> DataFrame:
    """Union by name; columns that one side lacks are filled, numbers and texts each with their own value."""
    filled = lambda df, other: df.withColumns({c: F.lit(texts if t == "string" else numbers).cast(t) for c, t in other.dtypes if c not in df.columns})
    return filled(a, b).unionByName(filled(b, a))


def compare(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """key, before, after, delta; a missing side counts 0."""
    both = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key, "full_outer").na.fill(0, ["before", "after"])
    return both.withColumn("delta", F.col("after") - F.col("before")).withColumn("delta_percent", F.when(F.col("before") != 0, 100 * F.col("delta") / F.col("before")))
