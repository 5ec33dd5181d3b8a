"""What is made of a run's labels once it has ended: the review queue, the distribution, a sample for verification, what must be verified, and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clausegrain.functions.labels import review_priority
from clausegrain.functions.taxonomy import dimension
from clausegrain.operators.selection import stratified_sample
from clausegrain.sources.scratch import dropped, written
from clausegrain.sources.sinks import WHOLE, markdown

# Results that a human must verify.
TO_VERIFY = ("DISAGREEMENT", "LOW_CONFIDENCE", "API_ERROR", "INVALID_RESPONSE")


def made(rows: DataFrame, clause: str = "clause_id", sample: int = 40) -> dict[str, DataFrame]:
    """From a run's rows (clause, text, labels, quality, average_confidence, agreement_score):

    queue: all rows by review priority, the highest first, ties by the clause; distribution: count of each of the fourteen categories; sample: a stratified
    sample by quality; to_verify: rows that a human must see; figures: one row of counts and of confidence's least, greatest, mean and deviation."""
    priority = review_priority(F.col("agreement_score"), F.col("average_confidence"), F.col("quality"), F.col("text"))
    counts = rows.select(F.explode("labels").alias("category")).groupBy("category").agg(F.count("*").alias("count"))
    valid = F.col("quality").isin("HIGH_CONFIDENCE", "MEDIUM_CONFIDENCE", "LOW_CONFIDENCE")
    c = F.col("average_confidence")
    figures = rows.agg(
        F.count("*").alias("rows"), F.count_distinct(clause).alias("clauses"), F.count_if(valid).alias("agreements"), F.count_if(F.col("quality") == "DISAGREEMENT").alias("disagreements"), F.count_if(~valid & (F.col("quality") != "DISAGREEMENT")).alias("failures"),
        F.round(F.coalesce(F.min(c), F.lit(0.0)), 4).alias("min_confidence"), F.round(F.coalesce(F.max(c), F.lit(0.0)), 4).alias("max_confidence"), F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias("mean_confidence"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 4).alias("std_confidence"),
    )
    return {
        "queue": rows.withColumn("priority", priority).orderBy(F.desc("priority"), clause), "distribution": dimension(rows.sparkSession).select("category").join(counts, "category", "left").na.fill(0),
        "sample": stratified_sample(rows, "quality", clause, sample), "to_verify": rows.where(F.col("quality").isin(*TO_VERIFY)), "figures": figures.withColumn("duplicates", F.col("rows") - F.col("clauses")),
    }


def write(rows: DataFrame, path: str, clause: str = "clause_id", sample: int = 40) -> dict[str, str]:
    """made() as CSV folders below a path, labels as JSON, and the figures as Markdown too; where each lies. The queue keeps its order from file to file.
    The rows are worked out once, into the shared folder, and read from there for each artefact."""
    out, spark = {}, rows.sparkSession
    own = written(rows, "rows")
    tables = made(own, clause, sample)
    tables["figures"] = spark.createDataFrame(tables["figures"].collect(), tables["figures"].schema)  # one row
    for name, df in tables.items():
        out[name] = f"{path}/{name}"
        flat = df.withColumn("labels", F.to_json("labels")) if "labels" in df.columns else df
        flat.write.mode("overwrite").options(**WHOLE).csv(out[name], header=True)
    report = markdown(tables["figures"])
    out["report"] = f"{path}/report"
    dropped(own)
    spark.createDataFrame([(report,)], "value string").coalesce(1).write.mode("overwrite").text(out["report"])
    return out
