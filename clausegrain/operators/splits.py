"""Document-disjoint splits. A split is a table of document and split; rows join it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from clausegrain.functions.taxonomy import CATEGORIES, dimension
from clausegrain.operators.relations import numbered
from clausegrain.sources.scratch import written

SPLITS = ("train", "validation", "test")


def by_ratio(documents: DataFrame, document: str, ratios: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 42) -> DataFrame:
    """document, split: documents in an order by hash, cut at rounded (half to even) shares, each split with one at least.

    Ranks come from counts by hash bucket, so no task sorts all documents."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError(f"ratios sum to {sum(ratios)}, not 1")
    keys = documents.select(document).distinct()
    n = keys.count()
    if n < 3:
        raise ValueError(f"{n} documents can't make three splits")
    a = max(1, min(n - 2, round(n * ratios[0])))
    b = max(1, min(n - a - 1, round(n * ratios[1])))
    hashed = keys.withColumn("_h", F.md5(F.concat_ws(":", F.col(document).cast("string"), F.lit(str(seed))))).withColumn("_b", F.substring("_h", 1, 3))
    sizes = hashed.groupBy("_b").count()
    before = sizes.select("_b", (F.sum("count").over(W.orderBy("_b")) - F.col("count")).alias("_before"))  # 4096 rows
    place = hashed.join(F.broadcast(before), "_b").withColumn("_r", F.col("_before") + F.row_number().over(W.partitionBy("_b").orderBy("_h", document)))
    return place.select(document, F.when(F.col("_r") <= a, "train").when(F.col("_r") <= a + b, "validation").otherwise("test").alias("split"))


def smallest_to_validation(rows: DataFrame, document: str, share: float = 0.2) -> DataFrame:
    """document, n, split: the smallest documents validate, as long as those before them hold fewer rows than the share."""
    sizes = rows.groupBy(document).agg(F.count("*").alias("n"))
    total = sizes.agg(F.floor(share * F.sum("n")).alias("_target"))  # one row
    placed = numbered(sizes, "n", "n", document)
    return placed.crossJoin(F.broadcast(total)).select(document, "n", F.when(F.col("_before") < F.col("_target"), "validation").otherwise("train").alias("split"))


def fixed(spark: SparkSession, assignment: dict, default: str = "test") -> tuple[DataFrame, str]:
    return spark.createDataFrame(list(assignment.items()), "document_id string, split string"), default


def assign(rows: DataFrame, splits: DataFrame, document: str, default: str | None = None) -> DataFrame:
    """Rows with their document's split; rows without one are dropped, or get the default."""
    out = rows.join(splits.select(document, "split"), document, "left")
    return out.na.fill(default, ["split"]) if default else out.where("split is not null")


# Categories that make a document rare.
RARE = frozenset(("Liability for Damages", "Competition Rights", "Governing Law and Jurisdiction", "Intellectual Property", "Term and Termination", "NDA Type", "Non-Confidential Information"))


def greedy_coverage(profile: DataFrame, document: str = "document_id") -> DataFrame:
    """document, split from a profile (document, clauses, categories): documents with most rare categories choose first. One that
    brings new categories goes to the first split that lacks them and has room (65, 25, 25 %), another to the first below 60 and 20 %, else to test."""
    # A set of categories brings something to each split once at most, and never again once it brought nothing: only its first three
    # documents are looked at one by one. The others fill up, so the sum of the clauses before them tells their split.
    rare = F.size(F.array_intersect("categories", F.array(*map(F.lit, sorted(RARE)))))
    docs = written(numbered(profile.select(document, "clauses", F.array_sort(F.array_distinct("categories")).alias("categories"), rare.alias("_rare")), "clauses", F.desc("_rare"), F.desc("clauses"), F.desc(document)), "coverage")
    total = docs.agg(F.sum("clauses")).first()[0] or 1
    nth = F.row_number().over(W.partitionBy("categories").orderBy("_rank"))
    first = docs.withColumn("_nth", nth).where("_nth <= 3").select("_rank", "_before", "clauses", "categories").collect()  # three of each set of categories at most
    seen, filled = {s: set() for s in SPLITS}, dict.fromkeys(SPLITS, 0)
    brought, starts, at = {}, [], 0

    def fill(upto: int) -> None:
        """Fills splits with the documents from the sum at to the sum upto."""
        nonlocal at
        while at < upto:
            split, room = next(((s, room) for s, room in zip(SPLITS, (0.60, 0.20), strict=False) if filled[s] / total < room), ("test", None))
            if not starts or starts[-1][1] != split:
                starts.append((at, split))
            to = upto
            if room is not None:
                need = next(x for x in range(max(0, int(room * total) - 2), total + 3) if x / total >= room)
                if at + need - filled[split] < upto:
                    to = docs.where(F.col("_before") >= at + need - filled[split]).agg(F.min("_before")).first()[0]
                    to = upto if to is None else min(to, upto)
            filled[split] += to - at
            at = to

    for rank, before, n, categories in sorted(first, key=lambda r: r[0]):
        fill(before)
        categories = set(categories)
        split = next((s for s, room in zip(SPLITS, (0.65, 0.25, 0.25), strict=True) if categories - seen[s] and filled[s] / total < room), None)
        if split:
            brought[rank] = split
            seen[split] |= categories
            filled[split] += n
            at = before + n
    fill(total)
    split = F.lit("test")
    for start, name in starts:
        split = F.when(F.col("_before") >= start, name).otherwise(split)
    for name in SPLITS:
        split = F.when(F.col("_rank").isin([r for r, s in brought.items() if s == name]), name).otherwise(split)
    return docs.select(document, split.alias("split"))


def greedy_target(profile: DataFrame, targets: dict[str, float], document: str = "document_id", seed: int = 42) -> DataFrame:
    """document, split: test, then validation take documents that add most missing categories (by hash among equals), up to 1.5 times their target share; the rest trains."""
    # At most a category's worth of picks add something; then all that fit follow in the order of hashes, by sums over those before them.
    key, n = F.col(document), F.col("clauses")
    docs = written(profile.select(document, "clauses", "categories", F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))).alias("_h")), "target")
    total = docs.agg(F.sum("clauses")).first()[0] or 1
    assigned = docs.withColumn("split", F.lit(None).cast("string"))
    for split in ("test", "validation"):
        target, has, held, picks, best = targets[split] * total, set(), 0, [], None
        free = assigned.where("split is null").drop("split")
        while held < target:
            new = F.size(F.array_except(F.array_distinct("categories"), F.array(*map(F.lit, sorted(has))).cast("array<string>")))
            best = free.where(~key.isin(picks) & (held + n <= 1.5 * target)).orderBy(new.desc(), F.desc("_h")).select(document, "clauses", "categories", new.alias("_new")).first()
            if best is None or not best[3]:
                break
            picks.append(best[0])
            has |= set(best[2])
            held += best[1]
        taken = free.where(F.lit(False)).select(document)
        if held < target and best is not None:
            rest = free.where(~key.isin(picks))
            small, before = rest.where(n <= 0.5 * target), F.lit(held)  # small ones fit as long as the target isn't reached
            large = rest.where(n > 0.5 * target).orderBy(F.desc("_h")).select(document, "clauses", "_h").collect()  # 2 / share at most
            for name, size, h in large:
                ahead = held + (small.where(F.col("_h") > h).agg(F.sum("clauses")).first()[0] or 0)
                if ahead >= target:
                    break
                if ahead + size <= 1.5 * target:
                    picks.append(name)
                    held += size
                    before = before + F.when(F.col("_h") < h, size).otherwise(0)
            taken = numbered(small, "clauses", F.desc("_h")).where(before + F.col("_before") < target).select(document)
        chosen = taken.withColumn("_taken", F.lit(True))
        assigned = written(assigned.join(chosen, document, "left").withColumn("split", F.coalesce("split", F.when(F.col("_taken") | key.isin(picks), split))).drop("_taken"), "assigned")
    return assigned.select(document, F.coalesce("split", F.lit("train")).alias("split"))


def group_folds(rows: DataFrame, document: str, folds: int = 5) -> DataFrame:
    """document, fold: the largest documents first, each to the smallest fold so far."""
    sizes = written(numbered(rows.groupBy(document).agg(F.count("*").alias("n")), "n", F.desc("n"), document), "sizes")
    groups = sorted(((r[0], r[1]) for r in sizes.groupBy("n").count().collect()), reverse=True)  # as many as sizes
    load = [0] * min(folds, max(1, sum(k for _, k in groups)))
    runs, rank = [], 0
    for n, k in groups:
        for start, turn in _turns(load, n, k):
            runs.append((n, rank + start, turn))
        rank += k
    dealt = rows.sparkSession.createDataFrame(runs, "n long, start long, turn array<int>").groupBy("n").agg(F.array_sort(F.collect_list(F.struct("start", "turn"))).alias("runs"))
    run = F.element_at(F.filter("runs", lambda x: x["start"] <= F.col("_rank")), -1)
    placed = sizes.join(dealt, "n").withColumn("_run", run)
    return placed.select(document, F.expr("_run.turn[int((_rank - _run.start) % size(_run.turn))]").alias("fold"))


def _turns(load: list[int], n: int, k: int) -> list[tuple[int, list[int]]]:
    """Where runs of k documents of size n start and the folds that take turns in each, as each goes to the smallest fold; load is brought up to date."""
    out, at = [], 0
    while at < k:
        order = sorted(range(len(load)), key=lambda f: (load[f], f))
        turn = [f for f in order if (load[f], f) <= (load[order[0]] + n, order[0])]
        cycles = (k - at) // len(turn) + 1
        if len(turn) < len(order):  # until the next fold is the smaller one
            last, new = turn[-1], order[len(turn)]
            cycles = min(cycles, (load[new] - load[last] - (last > new)) // n + 1)
        out.append((at, turn))
        count = min(k - at, cycles * len(turn))
        for j, f in enumerate(turn):
            load[f] += n * (count // len(turn) + (j < count % len(turn)))
        at += count
    return out


def ranked_profile(rows: DataFrame, document: str = "document_id", labels: str = "labels") -> DataFrame:
    """document, clauses, counts (clauses of each category, in their order), n_categories, size_rank (the largest first) and category_rank (most categories first), from 0, ties by document."""
    n = [F.count_if(F.array_contains(labels, c)) for c in CATEGORIES]
    profile = rows.groupBy(document).agg(F.count("*").alias("clauses"), F.array(*n).alias("counts")).withColumn("n_categories", F.size(F.filter("counts", lambda x: x > 0)))
    by_size = numbered(profile, None, F.desc("clauses"), document).withColumnRenamed("_rank", "size_rank").drop("_before")
    return numbered(by_size, None, F.desc("n_categories"), F.desc("clauses"), document).withColumnRenamed("_rank", "category_rank").drop("_before")


def judged(profile: DataFrame, strategies: dict[str, Column], document: str = "document_id") -> DataFrame:
    """strategy and for each split its documents, clauses, categories and the categories it lacks, and unassigned documents, of many assignments in one pass: strategies names a
    column over the profile (ranked_profile() has ranks) that tells a document's split, or null. Each document becomes a row for each strategy within its task, and is summed before it is shuffled."""
    each = profile.select("clauses", "counts", F.inline(F.array(*(F.struct(F.lit(k).alias("strategy"), c.alias("split")) for k, c in strategies.items()))))
    sums = each.groupBy("strategy", "split").agg(F.count("*").alias("documents"), F.sum("clauses").alias("clauses"), *(F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(len(CATEGORIES))))
    names = F.array(*(F.when(F.coalesce(F.col(f"c{i}"), F.lit(0)) == 0, c) for i, c in enumerate(CATEGORIES)))
    short = sums.select("strategy", "split", "documents", "clauses", F.array_compact(names).alias("lacks"))  # some splits of some strategies
    of = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    columns = []
    for s in SPLITS:
        lacks = F.coalesce(of(s, "lacks"), F.array(*map(F.lit, CATEGORIES)))
        columns += [zero(of(s, "documents")).alias(f"{s}_documents"), zero(of(s, "clauses")).alias(f"{s}_clauses"), (len(CATEGORIES) - F.size(lacks)).alias(f"{s}_categories"), lacks.alias(f"{s}_lacks")]
    return short.groupBy("strategy").agg(*columns, zero(F.max(F.when(F.col("split").isNull(), F.col("documents")))).alias("unassigned"))


# Categories whose documents the audit counts by themselves.
AUDITED = {"liability": "Liability for Damages", "competition": "Competition Rights", "intellectual_property": "Intellectual Property", "governing_law": "Governing Law and Jurisdiction"}


def audit(rows: DataFrame, document: str = "document_id", labels: str = "labels") -> DataFrame:
    """One row over rows with split: counts, twelve gates (booleans), reasons and status: READY, CONDITIONALLY_READY (validation or test lacks
    categories) or BLOCKED (few documents, a category in fewer than three of them, leakage, or train lacks categories)."""
    k = F.col("k")
    leaks = rows.groupBy(document).agg(F.count_distinct("split").alias("k")).agg(F.count("*").alias("documents"), F.count_if(k > 1).alias("leaking_documents"), F.coalesce(F.sum((k * (k - 1) / 2).cast("long")), F.lit(0)).alias("shared_documents"))
    each = rows.select(document, "split", F.explode(F.array_distinct(labels)).alias("category")).groupBy("category").agg(F.count_distinct(document).alias("docs"), *(F.count_if(F.col("split") == s).alias(s) for s in SPLITS))
    full = dimension(rows.sparkSession).select("category").join(each, "category", "left").na.fill(0)  # fourteen rows
    cover = full.agg(
        F.count_if(F.col("docs") > 0).alias("categories"), F.min("docs").alias("least_documents"), *(F.count_if(F.col(s) > 0).alias(f"{s}_categories") for s in SPLITS),
        *(F.max(F.when(F.col("category") == c, F.col("docs"))).alias(f"{name}_documents") for name, c in AUDITED.items()),
    )
    counts = rows.agg(F.count("*").alias("rows"), *(F.count_if(F.col("split") == s).alias(f"{s}_rows") for s in SPLITS))
    one = counts.crossJoin(leaks).crossJoin(cover)  # three tables of one row
    all_of = lambda s: F.col(f"{s}_categories") == len(CATEGORIES)
    gates = {"documents": F.col("documents") >= 14} | {name: F.col(f"{name}_documents") >= 3 for name in AUDITED} | {
        "category_documents": F.col("least_documents") >= 3, "leakage": F.col("shared_documents") == 0, "train_coverage": all_of("train"), "validation_coverage": all_of("validation"), "test_coverage": all_of("test"),
    }
    g = lambda name: F.col(f"gate_{name}")
    out = one.withColumns({f"gate_{name}": c for name, c in gates.items()}).withColumn("gate_split_coverage", g("train_coverage") & g("validation_coverage") & g("test_coverage"))
    out = out.withColumn("gate_final", g("documents") & g("category_documents") & g("leakage") & g("train_coverage"))
    reasons = {"documents": "fewer than 14 documents", "category_documents": "categories in fewer than 3 documents", "leakage": "documents leak", "train_coverage": "train lacks categories", "validation_coverage": "validation lacks categories", "test_coverage": "test lacks categories"}
    out = out.withColumn("reasons", F.array_join(F.array_compact(F.array(*(F.when(~g(k), v) for k, v in reasons.items()))), "; "))
    return out.withColumn("status", F.when(~g("final"), "BLOCKED").when(g("validation_coverage") & g("test_coverage"), "READY").otherwise("CONDITIONALLY_READY"))
