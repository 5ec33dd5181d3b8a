"""Labels and scores of clauses as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from clausegrain.functions.taxonomy import CATEGORIES, FALLBACK, TERMS, all_categories, label_col
from clausegrain.functions.text import let, n_words, strip


def normalize(labels: Column) -> Column:
    """Trimmed, lower-cased, non-empty, distinct, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, lambda x: F.lower(strip(x))), lambda x: x != "")))


def multi_hot(labels: Column) -> list[Column]:
    return [F.coalesce(F.array_contains(labels, c), F.lit(False)).cast("int").alias(label_col(c)) for c in CATEGORIES]


def unapproved(labels: Column) -> Column:
    """The labels that are no known category."""
    return F.array_except(labels, all_categories())


def parse(json: Column, policy: str = "empty") -> Column:
    """Labels from a JSON text. Policies for what isn't a list: empty (and only known categories stay), null, scalar
    (a bare string is a list of one), split (on semicolons), fallback (the fallback category), strings (only string elements stay)."""
    listed = F.from_json(json, "array<string>")
    known = F.filter(listed, lambda x: F.array_contains(all_categories(), x))
    bare = F.when(json.rlike(r'^\s*"'), F.array(F.from_json(F.concat(F.lit("["), json, F.lit("]")), "array<string>")[0]))
    none = F.array().cast("array<string>")
    if policy == "empty":
        return F.coalesce(known, none)
    if policy == "null":
        return listed
    if policy == "scalar":
        return F.coalesce(listed, bare, none)
    if policy == "split":
        return F.coalesce(listed, F.filter(F.transform(F.split(json, ";"), strip), lambda x: x != ""), none)
    if policy == "fallback":
        return F.coalesce(listed, F.array(F.lit(FALLBACK)))
    if policy == "strings":
        all_strings = json.rlike(r'^\s*\[\s*("(?:[^"\\]|\\.)*"\s*(,\s*"(?:[^"\\]|\\.)*"\s*)*)?\]\s*$')
        return F.when(all_strings, listed).otherwise(none)
    raise ValueError(f"unknown policy: {policy}")


def by_rules(text: Column, terms: dict[str, str] = TERMS) -> Column:
    """Categories whose terms a text holds as whole words; the fallback if none. Sorted."""
    t = F.lower(text)
    found = F.array_compact(F.array(*[F.when(t.rlike(rf"(?U)\b({words})\b"), F.lit(c)) for c, words in terms.items()]))
    return let(found, lambda x: F.array_sort(F.when(F.size(x) == 0, F.array(F.lit(FALLBACK))).otherwise(x)))


def parse_response(raw: Column, default_confidence: float = 0.5) -> Column:
    """A model's answer as a struct: labels (known categories in any case), confidence within 0 and 1, reason of at most
    200 characters, status SUCCESS or INVALID_RESPONSE. Code fences around the JSON are dropped."""
    body = strip(F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?", ""), r"```$", ""))
    one = F.from_json(F.regexp_replace(body, r'("labels?"\s*:\s*)("(?:[^"\\]|\\.)*")', r"$1[$2]"), "labels array<string>, label array<string>, confidence string, reason string")
    said = F.coalesce(one["labels"], one["label"], F.array().cast("array<string>"))
    canonical = F.map_from_arrays(F.transform(all_categories(), F.lower), all_categories())
    known = F.filter(F.transform(said, lambda x: canonical[F.lower(strip(x))]), lambda x: x.isNotNull())
    ok = body.rlike(r"(?s)^\{.*\}$") & one.isNotNull()
    confidence = F.least(F.greatest(F.coalesce(one["confidence"].try_cast("double"), F.lit(default_confidence)), F.lit(0.0)), F.lit(1.0))
    labels = F.when(F.size(known) == 0, F.array(F.lit(FALLBACK))).otherwise(known)
    return F.when(ok, F.struct(labels.alias("labels"), confidence.alias("confidence"), F.left(F.coalesce(one["reason"], F.lit("")), F.lit(200)).alias("reason"), F.lit("SUCCESS").alias("status"))).otherwise(
        F.struct(F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("confidence"), F.lit("").alias("reason"), F.lit("INVALID_RESPONSE").alias("status"))
    )


# Actions that a structural review may suggest.
ACTIONS = ("KEEP", "REMOVE_NON_LEGAL", "MERGE_WITH_NEXT", "MERGE_WITH_PREVIOUS", "SPLIT", "REVIEW")


def is_valid_review(raw: Column) -> Column:
    """An object with a known action, a numeric confidence within 0 and 1, a reason, and a boolean needs_context."""
    o = F.from_json(raw, "suggested_action string, action string, confidence string, reason string, needs_context string")
    quoted = raw.rlike(r'"confidence"\s*:\s*"') | raw.rlike(r'"needs_context"\s*:\s*"')
    return F.coalesce(
        F.coalesce(o["suggested_action"], o["action"]).isin(*ACTIONS) & o["confidence"].try_cast("double").between(0, 1) & (strip(o["reason"]) != "") & o["needs_context"].isin("true", "false") & ~quoted, F.lit(False)
    )


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def quality_tier(agreement: Column, confidence: Column) -> Column:
    return (
        F.when((agreement >= 0.8) & (confidence >= 0.8), "HIGH_CONFIDENCE")
        .when((agreement >= 0.5) & (confidence >= 0.6), "MEDIUM_CONFIDENCE")
        .when(agreement < 0.5, "DISAGREEMENT")
        .otherwise("LOW_CONFIDENCE")
    )


def review_tier(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, "HIGH").when(confidence >= 0.7, "MEDIUM").otherwise("LOW")


def uncertainty(probabilities: Column) -> Column:
    """One minus the mean distance from a half; 1 without probabilities."""
    n = F.size(probabilities)
    total = F.aggregate(probabilities, F.lit(0.0), lambda acc, x: acc + F.abs(x - 0.5))
    return F.when(n > 0, 1 - total / n).otherwise(1.0)


# What each quality bucket adds to the priority of a human's review.
REVIEW_WEIGHT = {"API_ERROR": 1.0, "INVALID_RESPONSE": 1.0, "DISAGREEMENT": 0.9, "LOW_CONFIDENCE": 0.7, "MEDIUM_CONFIDENCE": 0.4, "HIGH_CONFIDENCE": 0.1}


def review_priority(agreement: Column, confidence: Column, quality: Column, text: Column) -> Column:
    weight = F.coalesce(reduce(lambda acc, kv: acc.when(quality == kv[0], F.lit(kv[1])), list(REVIEW_WEIGHT.items())[1:], F.when(quality == "API_ERROR", F.lit(1.0))), F.lit(0.5))
    return (1 - agreement) + 0.5 * (1 - confidence) + weight + F.least(F.length(text) / 1000.0, F.lit(0.5))


def signal_counts(text: Column, signals: dict[str, str]) -> list[Column]:
    """How often each category's terms occur."""
    return [F.regexp_count(F.lower(text), F.lit("(?U)" + p)) for p in signals.values()]


def heuristic_score(text: Column, unseen: Column, signals: dict[str, str]) -> Column:
    counts = signal_counts(text, signals)
    distinct = sum(((c > 0).cast("int") for c in counts), F.lit(0))
    matches = sum(counts, F.lit(0))
    return F.when(unseen, 30.0).otherwise(0.0) + 15.0 * distinct + F.least(F.lit(20.0), 2.0 * matches) + F.least(F.lit(10.0), 0.05 * n_words(text))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def bce(p: Column, y: Column, weight: Column | float = 1.0) -> Column:
    """Cross-entropy of one cell; weight multiplies the positive part."""
    p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    return -(weight * y * F.log(p) + (1 - y) * F.log(1 - p))


def focal(p: Column, y: Column, gamma: float = 2.0, alpha: float = 0.25) -> Column:
    """Focal loss of one cell: (1 - p_t)^gamma times its cross-entropy, weighted alpha if positive and 1 - alpha if negative."""
    p_t = F.when(y == 1, p).otherwise(1 - p)
    return F.when(y == 1, alpha).otherwise(1 - alpha) * F.pow(1 - p_t, F.lit(gamma)) * bce(p, y)


def human_validity(action: Column) -> Column:
    return F.when(action.isin("KEEP", "MERGE_WITH_NEXT", "MERGE_WITH_PREVIOUS", "SPLIT"), "true").when(action == "REMOVE_NON_LEGAL", "false").otherwise("")


def pos_neg_ratio(positive: Column, negative: Column) -> Column:
    return F.when(positive > 0, F.format_string("1:%.1f", negative / positive)).otherwise("N/A")


def impact(delta: Column, least: float = 0.02) -> Column:
    return F.when(delta > least, "IMPROVED").when(delta < -least, "DEGRADED").otherwise("NEUTRAL")


def holds_any(text: Column, words: list[str]) -> Column:
    """Whether a text matches one of some patterns in any case; null holds none."""
    return F.coalesce(text.rlike("(?iU)" + "|".join(f"(?:{w})" for w in words)), F.lit(False))
