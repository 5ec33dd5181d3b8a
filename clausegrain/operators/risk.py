"""Risk of clauses and documents from their categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clausegrain.functions.taxonomy import dimension

TIERS = ("LOW", "MEDIUM", "HIGH")


def clause_risk(labelled: DataFrame, clause: str = "clause_id", labels: str = "labels") -> DataFrame:
    """labelled with risk_level: the highest tier of its categories. Tiers are looked up in a map of fourteen entries, so nothing is joined."""
    from clausegrain.functions.taxonomy import RISK

    tier = F.create_map(*(x for c, (_, t) in RISK.items() for x in (F.lit(c), F.lit(TIERS.index(t)))))
    level = F.coalesce(F.array_max(F.transform(labels, lambda c: F.coalesce(tier[c], F.lit(0)))), F.lit(0))
    return labelled.withColumn("risk_level", F.element_at(F.array(*map(F.lit, TIERS)), level + 1))


def document_risk(labelled: DataFrame, document: str = "document_id", clause: str = "clause_id", labels: str = "labels") -> DataFrame:
    """document, score (weights of its distinct categories, 100 at most), high_clauses, medium_clauses, risk."""
    levels = clause_risk(labelled, clause, labels).groupBy(document).agg(F.count_if(F.col("risk_level") == "HIGH").alias("high_clauses"), F.count_if(F.col("risk_level") == "MEDIUM").alias("medium_clauses"))
    distinct = labelled.select(document, F.explode(labels).alias("category")).distinct()
    weights = F.broadcast(dimension(labelled.sparkSession).select("category", "risk_weight"))  # fourteen rows
    scores = distinct.join(weights, "category").groupBy(document).agg(F.least(F.sum("risk_weight"), F.lit(100)).alias("score"))
    both = levels.join(scores, document, "left").na.fill(0, ["score"])
    risk = F.when((F.col("score") >= 65) | (F.col("high_clauses") >= 2), "HIGH").when((F.col("score") >= 35) | (F.col("medium_clauses") >= 2), "MEDIUM").otherwise("LOW")
    return both.select(document, F.col("score").cast("long").alias("score"), "high_clauses", "medium_clauses", risk.alias("risk"))
