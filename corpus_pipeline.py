"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents. Between stages the rows are written as Parquet into the shared folder, so a lost
executor costs one stage's lost tasks, never the stages before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausegrain.llm import decontam, packing, pii, quality, simhash
from clausegrain.llm.common import discard, materialize, table
from clausegrain.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filtered(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.cleaned(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.masked(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality rules", quality_rules), ("SimHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("PII", personal_data), ("best-fit packing", best_fit_packing)]

#: The field and the sketches of the stages have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage{k}")
            if before is not None:
                discard(before)  # the stage's rows are written, so nothing reads its input any more
            before = docs
    return docs
