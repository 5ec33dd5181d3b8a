"""Which labelled rows count: by quality bucket, by reason, by annotation status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clausegrain.functions.taxonomy import EXCLUDED_QUALITY, VALID_QUALITY
from clausegrain.functions.text import strip

# A reason that rules wrote, one that old failures left, and the states and source of annotations that train.
RULES_REASON = "Multi-model rule ensemble consensus"
FAILED_REASON = "API call failed"
TRAINABLE, HUMAN = ("ANNOTATED", "VERIFIED"), "human_annotation"


def is_valid(quality: Column) -> Column:
    """In a bucket that counts as labelled; null doesn't."""
    return F.coalesce(quality.isin(*VALID_QUALITY), F.lit(False))


def not_quarantined(quality: Column) -> Column:
    """In no bucket of failures: unknown buckets and null pass."""
    return ~F.coalesce(quality.isin(*EXCLUDED_QUALITY), F.lit(False))


def is_sure(quality: Column, least: str = "HIGH_CONFIDENCE") -> Column:
    """Of high confidence, or, with MEDIUM_CONFIDENCE as the least, of high or medium."""
    buckets = {"HIGH_CONFIDENCE": ("HIGH_CONFIDENCE",), "MEDIUM_CONFIDENCE": ("HIGH_CONFIDENCE", "MEDIUM_CONFIDENCE")}[least]
    return F.coalesce(quality.isin(*buckets), F.lit(False))


def sure_training(rows: DataFrame, least: str = "HIGH_CONFIDENCE", quality: str = "quality", split: str = "split") -> DataFrame:
    """Training rows of enough confidence, with all rows of the other splits."""
    return rows.where((F.col(split) != "train") | is_sure(F.col(quality), least))


def is_retryable(quality: Column, reason: Column) -> Column:
    return F.coalesce(quality.isin("API_ERROR", "INVALID_RESPONSE"), F.lit(False)) | F.coalesce(reason.contains(FAILED_REASON), F.lit(False))


def is_genuine(quality: Column, reason: Column) -> Column:
    """Labelled by models, not by rules; a null reason is no rules' reason."""
    return is_valid(quality) & ~F.coalesce(reason == RULES_REASON, F.lit(False))


def is_trainable(status: Column, source: Column, labels: Column) -> Column:
    return F.coalesce(status.isin(*TRAINABLE) & (strip(source) == HUMAN) & (F.size(labels) > 0), F.lit(False))


def training_gate(rows: DataFrame, labels: str = "labels", min_examples: int = 50, min_categories: int = 5) -> DataFrame:
    """One row over trainable rows: examples, categories, ready, reason."""
    n = rows.agg(F.count("*").alias("examples")).crossJoin(rows.select(F.explode(labels).alias("c")).agg(F.count_distinct("c").alias("categories")))  # two tables of one row
    reason = F.when(F.col("examples") == 0, "no valid annotations").when(F.col("examples") < min_examples, "too few annotations").when(F.col("categories") < min_categories, "too few categories").otherwise("")
    return n.withColumn("reason", reason).withColumn("ready", F.col("reason") == "")


def is_done(status: Column) -> Column:
    """Anything but pending or nothing."""
    return ~F.coalesce(strip(status), F.lit("")).isin("", "PENDING")
