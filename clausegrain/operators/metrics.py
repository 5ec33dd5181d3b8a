"""Multi-label metrics from rows of (id, category, y_true, y_prob): one aggregation to confusion counts, and columns above it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from clausegrain.operators.filters import is_sure


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / b)


def confusion(predictions: DataFrame, threshold: float = 0.5, keys: tuple[str, ...] = ("category",)) -> DataFrame:
    """tp, fp, fn, tn by category; a threshold column in predictions takes the parameter's place."""
    limit = F.col("threshold") if "threshold" in predictions.columns else F.lit(threshold)
    yes, pred = F.col("y_true") == 1, F.col("y_prob") >= limit
    return predictions.groupBy(*keys).agg(F.count_if(yes & pred).alias("tp"), F.count_if(~yes & pred).alias("fp"), F.count_if(yes & ~pred).alias("fn"), F.count_if(~yes & ~pred).alias("tn"))


def per_category(counts: DataFrame) -> DataFrame:
    """counts with precision, recall, f1, mcc, support, predicted; 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    below = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns({
        "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "mcc": ratio(tp * tn - fp * fn, below),
        "support": F.col("tp") + F.col("fn"), "predicted": F.col("tp") + F.col("fp"),
    })


def macro_mcc_term() -> Column:
    """A category's share in the macro MCC: where truth and prediction are both constant, 1 if they agree, else 0."""
    constant = ((F.col("tp") + F.col("fn") == 0) | (F.col("fp") + F.col("tn") == 0)) & ((F.col("tp") + F.col("fp") == 0) | (F.col("fn") + F.col("tn") == 0))
    return F.when(constant, F.when(F.col("fp") + F.col("fn") == 0, 1.0).otherwise(0.0)).otherwise(F.col("mcc"))


def summary(categories: DataFrame, minority: DataFrame | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """macro, micro and weighted F1, macro and micro precision and recall, Hamming loss, macro MCC, minority F1."""
    rows = categories
    if minority is not None:
        rows = rows.join(F.broadcast(minority.select("category", F.lit(True).alias("_minor"))), "category", "left")  # fourteen rows at most
    minor = F.avg(F.when(F.col("_minor"), F.col("f1"))) if minority is not None else F.lit(None).cast("double")
    tp, fp, fn, tn = (F.sum(c) for c in ("tp", "fp", "fn", "tn"))
    return rows.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"), ratio(2 * tp, 2 * tp + fp + fn).alias("micro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("weighted_f1"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), ratio(tp, tp + fp).alias("micro_precision"), ratio(tp, tp + fn).alias("micro_recall"),
        ratio(fp + fn, tp + fp + fn + tn).alias("hamming_loss"), F.avg(macro_mcc_term()).alias("macro_mcc"), F.coalesce(minor, F.avg("f1")).alias("minority_f1"),
    )


def minority(train_counts: DataFrame, count: str = "n") -> DataFrame:
    """Categories with fewer training rows than 15 or the median, whichever is more; the five smallest if none."""
    middle = train_counts.agg(F.greatest(F.lit(15.0), F.median(count)).alias("_limit"))  # one row
    ranked = train_counts.withColumn("_r", F.row_number().over(W.orderBy(count, "category")))  # as many rows as categories
    marked = ranked.crossJoin(F.broadcast(middle)).withColumn("_in", F.col(count) < F.col("_limit"))
    some = F.max("_in").over(W.partitionBy())
    return marked.withColumn("_some", some).where(F.when(F.col("_some"), F.col("_in")).otherwise(F.col("_r") <= 5)).select("category", count)


def class_weights(train_counts: DataFrame, rows: int | Column, count: str = "n", cap: float | None = None) -> DataFrame:
    """(rows - positives) / positives, at most cap; a category without positives counts one."""
    w = ((F.lit(rows) if isinstance(rows, int) else rows) - F.col(count)) / F.greatest(F.col(count), F.lit(1))
    return train_counts.withColumn("weight", F.least(w, F.lit(cap)) if cap else w.cast("double"))


GRID = tuple(round(0.30 + 0.05 * k, 2) for k in range(9))


def sweep(predictions: DataFrame, grid: tuple[float, ...] = GRID, minor: DataFrame | None = None) -> DataFrame:
    """summary() at each threshold, in one pass: every row is counted under all thresholds within its task."""
    at = predictions.withColumn("threshold", F.explode(F.array(*map(F.lit, grid))))
    return summary(per_category(confusion(at, keys=("threshold", "category"))), minor, ("threshold",))


def best_threshold(swept: DataFrame, by: str = "macro_f1", digits: int | None = 4, ties: tuple[str, ...] = ()) -> DataFrame:
    """The row with the greatest metric (rounded, if digits are given); among equals the greatest of the metrics in ties, then the lowest threshold."""
    value = F.round(by, digits) if digits is not None else F.col(by)
    return swept.orderBy(value.desc(), *(F.col(c).desc() for c in ties), "threshold").limit(1)


def ablation(predictions: DataFrame, quality: str = "quality") -> DataFrame:
    """summary() over all rows, over those of high and medium and over those of high confidence, in one pass."""
    q = F.col(quality)
    subsets = F.array_compact(F.array(F.lit("ALL"), F.when(is_sure(q, "MEDIUM_CONFIDENCE"), "HIGH_MEDIUM"), F.when(is_sure(q), "HIGH")))
    return summary(per_category(confusion(predictions.withColumn("subset", F.explode(subsets)), keys=("subset", "category"))), None, ("subset",))


def cooccurrence(labelled: DataFrame, labels: str = "labels") -> DataFrame:
    """category_a, category_b (a <= b), n: rows that have both. Pairs are made within a row's own array, fourteen categories at most, and shuffled as counts."""
    pairs = labelled.select(F.explode(F.array_sort(F.array_distinct(labels))).alias("category_a"), labels).select("category_a", F.explode(F.array_distinct(labels)).alias("category_b")).where("category_a <= category_b")
    return pairs.groupBy("category_a", "category_b").agg(F.count("*").alias("n"))


def error_pattern(fp: Column, fn: Column, factor: float = 1.5) -> Column:
    """The factor is inferred from published rows; any in (1.31, 2.17] gives them."""
    return F.when(fp >= factor * fn, "FP_DOMINATED").when(fn >= factor * fp, "FN_DOMINATED").otherwise("MIXED")


def correlations(rows: DataFrame, a: str, b: str) -> DataFrame:
    """pearson and spearman (by average ranks) of two columns."""
    def rank(c: str) -> Column:
        return F.rank().over(W.orderBy(c)) + (F.count("*").over(W.partitionBy(c)) - 1) / 2.0

    ranked = rows.withColumns({"_ra": rank(a), "_rb": rank(b)})  # as many rows as categories
    return ranked.agg(F.corr(a, b).alias("pearson"), F.corr("_ra", "_rb").alias("spearman"))


def rank_models(results: DataFrame) -> DataFrame:
    order = [F.col(c).desc() for c in ("macro_f1", "minority_f1", "macro_mcc", "weighted_f1")]
    return results.withColumn("rank", F.row_number().over(W.orderBy(*order, "model")))  # as many rows as experiments


def best_of_each(results: DataFrame, key: str, metric: str = "macro_f1") -> DataFrame:
    return results.groupBy(key).agg(F.max(metric).alias(metric))


def early_stopping(log: DataFrame, group: str, epoch: str, metric: str, patience: int = 3) -> DataFrame:
    """With best_before, is_best (a strict new maximum), since_best, stops (the first epoch whose patience is out) for each group of epochs."""
    w = W.partitionBy(group).orderBy(epoch)
    best = log.withColumn("best_before", F.max(metric).over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("is_best", F.col("best_before").isNull() | (F.col(metric) > F.col("best_before")))
    place = best.withColumn("_n", F.row_number().over(w)).withColumn("_last", F.max(F.when(F.col("is_best"), F.col("_n"))).over(w.rowsBetween(W.unboundedPreceding, 0)))
    since = place.withColumn("since_best", F.col("_n") - F.col("_last"))
    out = F.count_if(F.col("since_best") >= patience).over(w.rowsBetween(W.unboundedPreceding, 0))
    return since.withColumn("stops", (F.col("since_best") >= patience) & (out == 1)).drop("_n", "_last")
