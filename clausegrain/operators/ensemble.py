"""Several scorers' labels of a clause, combined: agreement, majority vote, confidence tier."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from clausegrain.functions.labels import by_rules, jaccard, quality_tier
from clausegrain.functions.taxonomy import FALLBACK
from clausegrain.operators.relations import pending


# What a failed vote counts as where failures vote.
FAILED_VOTE = ((FALLBACK,), 0.5)


def combine(votes: DataFrame, clause: str = "clause_id", least: int = 2, count_failures: bool = False) -> DataFrame:
    """votes (clause, model, labels, confidence, status, reason if there) to a row for each clause.

    Only SUCCESS votes count; fewer than least make API_ERROR (API_QUOTA_EXHAUSTED, if a failure says so) with the first success's labels, and where some fail
    the reason begins with how many. A label needs more than half of the votes, two at least; without one, the labels of the first surest model stand. Labels
    are sorted. With count_failures a failed vote counts too, as FAILED_VOTE, and two votes always do."""
    ok = F.col("status") == "SUCCESS"
    labels, confidence = F.array_sort(F.array_distinct("labels")), F.col("confidence")
    if count_failures:
        labels, confidence = F.when(ok, labels).otherwise(F.array(*map(F.lit, FAILED_VOTE[0]))), F.when(ok, confidence).otherwise(FAILED_VOTE[1])
    reason = F.col("reason") if "reason" in votes.columns else F.lit("")
    vote = F.struct("model", labels.alias("labels"), confidence.alias("confidence"), "status", F.coalesce(reason, F.lit("")).alias("reason"))
    rows = votes.groupBy(clause).agg(F.array_sort(F.collect_list(vote)).alias("all"))  # as many votes as there are models
    failed = F.filter("all", lambda v: v["status"] != "SUCCESS")
    rows = rows.withColumn("good", F.col("all") if count_failures else F.filter("all", lambda v: v["status"] == "SUCCESS")).withColumn("failed", failed).withColumn("n", F.size("good"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    rows = rows.withColumn("pairs", F.flatten(F.transform("good", lambda a, i: F.transform(F.slice("good", i + 2, F.size("good")), lambda b: jaccard(a["labels"], b["labels"])))))
    rows = rows.withColumns({
        "agreement": F.when(F.size("pairs") > 0, total(F.col("pairs")) / F.size("pairs")).otherwise(1.0),
        "mean": F.when(F.col("n") > 0, total(F.transform("good", lambda v: v["confidence"])) / F.col("n")).otherwise(0.0),
        "every": F.flatten(F.transform("good", lambda v: v["labels"])), "first": F.get("good", F.lit(0)),
        "need": F.lit(2) if count_failures else F.when(F.col("n") < 2, 1).otherwise(F.greatest(F.lit(2), F.floor(F.col("n") / 2) + 1)),
    })
    rows = rows.withColumns({
        "major": F.filter(F.array_distinct("every"), lambda x: F.size(F.filter("every", lambda y: y == x)) >= F.col("need")),
        "surest": F.aggregate("good", F.col("first"), lambda acc, v: F.when(v["confidence"] > acc["confidence"], v).otherwise(acc)),
    })
    enough = F.col("n") >= least
    said = F.left(F.array_join(F.filter(F.transform("all", lambda v: v["reason"]), lambda r: r != ""), " | "), F.lit(250))
    tag = F.when((F.size("failed") > 0) & ~F.lit(count_failures), F.format_string("[%d/%d models failed] ", F.size("failed"), F.size("all"))).otherwise("")
    lost = F.when(F.exists("failed", lambda v: v["status"] == "API_QUOTA_EXHAUSTED"), "API_QUOTA_EXHAUSTED").otherwise("API_ERROR")
    return rows.select(
        clause, F.size("all").alias("models"), F.col("n").alias("successes"),
        F.array_sort(F.when(enough, F.when(F.size("major") > 0, F.col("major")).otherwise(F.col("surest.labels"))).otherwise(F.coalesce("first.labels", F.array().cast("array<string>")))).alias("labels"),
        F.when(enough, F.col("mean")).otherwise(F.coalesce("first.confidence", F.lit(0.0))).alias("average_confidence"),
        F.when(enough, F.col("agreement")).otherwise(0.0).alias("agreement_score"), (enough & F.exists("good", lambda v: v["labels"] != F.col("first.labels"))).alias("label_disagreement"),
        F.when(enough, quality_tier(F.col("agreement"), F.col("mean"))).otherwise(lost).alias("quality"), F.concat(tag, said).alias("reason"),
    )


#: A scorer gets texts and gives (labels, confidence, status, reason) for each.
Scorer = Callable[[list[str]], list[tuple[list[str], float, str, str]]]


class QuotaExhausted(Exception):
    """A service that won't answer before some far moment; asking again is no use."""


#: Seconds: a delay that a service asks for beyond this means that its quota is spent; the longest wait of our own.
LONGEST_DELAY, LONGEST_WAIT = 120.0, 60.0


def wait_for(error: str, attempt: int) -> float:
    """Seconds to wait after a failed attempt (from 1): what the service asks for and two more, where it is busy longer each time, else three."""
    asked = re.search(r"retryDelay['\"]?:\s*['\"]?(\d+(?:\.\d+)?)s", error) or re.search(r"retry in (\d+(?:\.\d+)?)s", error)
    if asked:
        return float(asked[1]) + 2
    return min(LONGEST_WAIT, 15.0 * attempt) if re.search("RESOURCE_EXHAUSTED|429|503", error) else 3.0


def ask(scorer: Scorer, texts: list[str], attempts: int, timeout: float | None, sleep: Callable[[float], None]) -> tuple[list | None, str, str]:
    """A scorer's answers, or None with status and error: tries again after waits, gives up a call after the timeout, and at once where the quota is spent."""
    error = ""
    for attempt in range(1, attempts + 1):
        pool = ThreadPoolExecutor(1)
        try:
            return pool.submit(scorer, texts).result(timeout), "SUCCESS", ""
        except QuotaExhausted as e:
            return None, "API_QUOTA_EXHAUSTED", str(e)[:200]
        except TimeoutError:
            error = f"no answer in {timeout} s"
        except Exception as e:  # noqa: BLE001  whatever a service raises counts as its failure
            error = f"{type(e).__name__}: {e}"[:200]
        finally:
            pool.shutdown(wait=False)
        wait = wait_for(error, attempt)
        if wait > LONGEST_DELAY:
            return None, "API_QUOTA_EXHAUSTED", error
        if attempt < attempts:
            sleep(wait)
    return None, "API_ERROR", error


def score_with(clauses: DataFrame, model: str, scorer: Scorer, clause: str = "clause_id", text: str = "text", attempts: int = 3, most_failed_batches: int = 3, timeout: float | None = None, batch_rows: int = 100, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """Votes of an outside scorer, a batch at a time. A batch that fails is tried again after a wait; a failed one gives API_ERROR or API_QUOTA_EXHAUSTED votes, and
    after some failed batches in a row the task asks no more and marks the rest, so that a dead service costs little."""
    kind = dict(clauses.dtypes)[clause]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        failed = 0
        for whole in batches:
            for at in range(0, len(whole), batch_rows):
                batch = whole.iloc[at : at + batch_rows]
                answers, status, error = None, "API_ERROR", "not asked: the service fails"
                if failed < most_failed_batches:
                    answers, status, error = ask(scorer, list(batch[text]), attempts, timeout, sleep)
                failed = 0 if answers is not None else failed + 1
                rows = answers if answers is not None else [([], 0.0, status, error)] * len(batch)
                yield pd.DataFrame({clause: batch[clause], "model": model, "labels": [r[0] for r in rows], "confidence": [r[1] for r in rows], "status": [r[2] for r in rows], "reason": [r[3] for r in rows]})

    return clauses.select(clause, text).mapInPandas(run, f"{clause} {kind}, model string, labels array<string>, confidence double, status string, reason string")


def score_pending(queue: DataFrame, log: DataFrame, model: str, scorer: Scorer, clause: str = "clause_id", limit: int | None = None, **options) -> DataFrame:
    """score_with() of what the log (clause, model, status) has no success of by this model, the first `limit` by id: a run that goes on where one was stopped."""
    done = log.where((F.col("model") == model) & (F.col("status") == "SUCCESS"))
    left = pending(queue, done, clause)
    return score_with(left.orderBy(clause).limit(limit) if limit is not None else left, model, scorer, clause, **options)


def score_by_rules(clauses: DataFrame, clause: str = "clause_id", text: Column | None = None) -> DataFrame:
    """Votes of the rule classifier, the scorer that needs no service."""
    return clauses.select(clause, F.lit("rules").alias("model"), by_rules(text if text is not None else F.col("text")).alias("labels"), F.lit(1.0).alias("confidence"), F.lit("SUCCESS").alias("status"), F.lit("").alias("reason"))
