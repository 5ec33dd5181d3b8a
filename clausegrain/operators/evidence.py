"""Structural review: what the sources say of a clause, resolved to one state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from clausegrain.functions.labels import ACTIONS
from clausegrain.functions.text import is_blank, truthy


#: Why a state needs a human, where the state alone doesn't say it.
REASONS = {
    "CONFLICT_REVIEW": "evidence conflicts, is incomplete, or holds a corrected text", "EXCLUDED_NON_LEGAL": "a structural exclusion, no category", "PENDING_MERGE": "the merge isn't applied", "PENDING_SPLIT": "the split isn't applied",
    "API_FAILURE": "no suggestion, as the service failed", "PRIORITY_UNREVIEWED": "not reviewed, and of priority", "UNREVIEWED": "not reviewed",
}


def resolve(clauses: DataFrame, records: DataFrame, log: DataFrame, priority: DataFrame, suggestions: str = "suggestions", queue: str = "queue") -> DataFrame:
    """A row for each clause (clause_id, ...) with review_status, review_action, confidence, confidence_basis, review_timestamp, llm_status,
    review_reason, human_actions, human_review_records (JSON), review_sources, is_priority, needs_human_review, unresolved_merge, unresolved_split.

    records: clause_id, review_file, human_action, human_corrected_text, reviewed, ai_suggested_action, ai_confidence, review_reason (strings). log: clause_id,
    status, suggested_action, confidence, timestamp. priority: clause_id. The order of states: conflict, removal, merge, split, review, keep, failure, none.
    review_file names a record's table: suggestions of a model, the queue of a human, or another.
    A clause has a few records, gathered by partial aggregates; nothing is gathered as rows. The joins keep the session's number of shuffle partitions: put together
    by their bytes, which are few for a row, a task would sort millions of rows for each of the joins at once."""
    n = int(clauses.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    clauses, records = clauses.repartition(n, "clause_id"), records.repartition(n, "clause_id")
    done = log.where("status = 'SUCCESS'").groupBy("clause_id").agg(
        F.max_by(F.struct("suggested_action", "confidence", "timestamp"), "timestamp").alias("said"), (F.count_distinct("suggested_action", "confidence") > 1).alias("two_answers")
    )
    failed = log.groupBy("clause_id").agg((F.count_if(F.col("status") == "ERROR") > 0).alias("failed"))
    human = truthy(F.col("reviewed")) & ~is_blank(F.col("human_action"))
    joined = records.join(done, "clause_id", "left")
    ai_file = F.col("review_file").isin(suggestions, queue)
    backs = ai_file & (F.col("ai_suggested_action") == F.col("said.suggested_action")) & (F.col("ai_confidence").try_cast("double") == F.col("said.confidence").try_cast("double"))
    queued = (F.col("review_file") == queue) & ~truthy(F.col("reviewed")) & ((F.coalesce("review_reason", F.lit("")) != "API_FAILURE") | F.col("said").isNull())
    facts = joined.groupBy("clause_id").agg(
        F.array_sort(F.collect_set(F.when(human, F.col("human_action")))).alias("human_actions"), F.count_if(human & ~is_blank(F.col("human_corrected_text"))).alias("corrected"),
        F.count_if(F.coalesce(backs, F.lit(False))).alias("backing"), F.count_if(queued).alias("queued"),
        F.array_sort(F.collect_set(F.when(~is_blank(F.col("human_action")) | F.coalesce(backs, F.lit(False)), F.col("review_file")))).alias("sources"), F.array_sort(F.collect_set(F.when(~is_blank(F.col("review_reason")), F.col("review_reason")))).alias("queue_reasons"),
        F.to_json(F.array_sort(F.collect_list(F.when(human, F.struct("review_file", "human_action", "human_corrected_text"))))).alias("human_records"),
    )
    first = priority.select("clause_id").distinct().withColumn("is_priority", F.lit(True))
    all_ = clauses.join(facts, "clause_id", "left").join(done, "clause_id", "left").join(failed, "clause_id", "left").join(first, "clause_id", "left")
    humans = F.coalesce("human_actions", F.array().cast("array<string>"))
    said = F.col("said.suggested_action")
    known, zero = F.array(*map(F.lit, ACTIONS)), lambda c: F.coalesce(c, F.lit(0))
    conflict = (
        F.coalesce("two_answers", F.lit(False)) | (said.isNotNull() & (zero("backing") == 0)) | (F.size(humans) > 1) | (F.size(F.array_except(humans, known)) > 0)
        | (said.isNotNull() & (F.size(F.array_except(humans, F.array(said))) > 0)) | (zero("corrected") > 0)
    )
    action = F.coalesce(said, F.when(F.size(humans) == 1, humans[0]), F.lit(""))
    any_of = lambda *names: action.isin(*names) | F.exists(humans, lambda a: a.isin(*names))
    merge, split = any_of("MERGE_WITH_NEXT", "MERGE_WITH_PREVIOUS"), any_of("SPLIT")
    status = (
        F.when(conflict, "CONFLICT_REVIEW").when(action == "REMOVE_NON_LEGAL", "EXCLUDED_NON_LEGAL").when(merge, "PENDING_MERGE").when(split, "PENDING_SPLIT").when(action == "REVIEW", "PENDING_REVIEW")
        .when((action == "KEEP") & said.isNotNull(), "PSEUDO_KEEP").when(action == "KEEP", "HUMAN_RECORDED_KEEP").when(F.coalesce("failed", F.lit(False)) & said.isNull(), "API_FAILURE")
        .when(F.coalesce("is_priority", F.lit(False)), "PRIORITY_UNREVIEWED").otherwise("UNREVIEWED")
    )
    shown = F.when(F.col("review_status") == "CONFLICT_REVIEW", "REVIEW").when(F.col("review_status").isin("API_FAILURE", "PRIORITY_UNREVIEWED", "UNREVIEWED"), "").otherwise(action)
    none, empty = F.array().cast("array<string>"), F.lit("")
    why = reduce(lambda acc, kv: acc.when(F.col("review_status") == kv[0], kv[1]), list(REASONS.items())[1:], F.when(F.col("review_status") == "CONFLICT_REVIEW", REASONS["CONFLICT_REVIEW"]))
    reasons = F.concat(F.array_compact(F.array(why)), F.coalesce("queue_reasons", none), F.transform(humans, lambda a: F.concat(F.lit("a human said "), a)))
    answered = F.when(said.isNotNull(), "SUCCESS").when(F.coalesce("failed", F.lit(False)), "ERROR").otherwise("NOT_REVIEWED")
    return all_.withColumn("review_status", status).select(
        *clauses.columns, "review_status", shown.alias("review_action"), F.col("said.confidence").alias("confidence"), F.when(said.isNotNull(), "LLM_SUGGESTION").otherwise("").alias("confidence_basis"), F.coalesce("said.timestamp", empty).alias("review_timestamp"),
        answered.alias("llm_status"), F.array_join(reasons, "; ").alias("review_reason"), F.array_join(humans, "; ").alias("human_actions"), F.coalesce("human_records", F.lit("[]")).alias("human_review_records"), F.array_join(F.coalesce("sources", none), ", ").alias("review_sources"),
        F.coalesce("is_priority", F.lit(False)).alias("is_priority"),
        ((F.col("review_status") != "EXCLUDED_NON_LEGAL") | (zero("queued") > 0)).alias("needs_human_review"), merge.alias("unresolved_merge"), split.alias("unresolved_split"),
    )


def partition(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Retained and removed clauses."""
    return resolved.where("review_status <> 'EXCLUDED_NON_LEGAL'"), resolved.where("review_status = 'EXCLUDED_NON_LEGAL'")


def review_statistics(reviews: DataFrame, action: str = "suggested_action", confidence: str = "confidence") -> DataFrame:
    """action, n, percent, and how many are HIGH, MEDIUM and LOW."""
    total = reviews.agg(F.count("*").alias("_n"))  # one row
    c = F.col(confidence)
    by = reviews.groupBy(action).agg(F.count("*").alias("n"), F.count_if(c >= 0.9).alias("high"), F.count_if((c >= 0.7) & (c < 0.9)).alias("medium"), F.count_if(c < 0.7).alias("low"))
    return by.crossJoin(F.broadcast(total)).withColumn("percent", 100 * F.col("n") / F.col("_n")).drop("_n")
