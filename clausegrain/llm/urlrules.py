"""URL filters: a fixed rule list, and association rules that Spark's FP-growth mines from labelled URLs.

A URL is a set of tokens (the host's last label, its other labels, the path's segments and ending, query names). The
number that ends a URL's path names the document shown there; where that document has a label, so has the URL: bad if
the quality is 0 or the text toxic. Frequent token sets that are bad in at least `confidence` of their labelled URLs
become blocking rules, minus those that a shorter rule of no less confidence covers. Rules are matched by an inverted index: each rule hangs on its rarest token, so a URL meets only the rules of
its own tokens, and matches those whose tokens it all has. The surest rule wins; without any, a URL is
allowed.

All of it is DataFrame operations and Spark's own FPGrowth. The rules are at most what the support allows; the index
joins by token, so its size needs no bound.

Defined results: a null URL, or one without ://, has empty host and path, no tokens, no rule, and is allowed;
repeated rows are judged alike; without labelled URLs nothing is mined; a document with several labels is bad if one is; among mined rules of equal confidence that of more tokens, then
of the greater id, is told; a very long URL is one row with its tokens; further columns of any name are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from clausegrain.llm.common import join_hot, materialize

#: Host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: A token set must be in this share of the labelled URLs, and go with its verdict this often.
SUPPORT, CONFIDENCE = 0.004, 0.5


def host(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed(rules=RULES) -> Column:
    """The longest rule that fits columns host and path, as a struct of rule and verdict, or null."""
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
    longest = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in longest])


def tokens() -> Column:
    """The token set of columns host, path and url; numbers are left out, as each is rare."""
    named = lambda kind, items: F.transform(items, lambda x: F.concat(F.lit(kind + ":"), x))
    labels = F.split("host", r"\.")
    last = F.slice(labels, F.size(labels), 1)
    others = F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0)))
    segments = F.regexp_extract_all(F.regexp_replace("path", r"\.[A-Za-z]+$", ""), F.lit(r"/([^/]+)"), 1)
    ending = F.regexp_extract_all("path", F.lit(r"\.([A-Za-z]+)$"), 1)
    query = F.regexp_extract_all(F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    every = F.concat(named("last", last), named("host", others), named("path", segments), named("ending", ending), named("query", query))
    return F.array_distinct(F.filter(every, lambda x: ~x.rlike(r":\d*$")))


def labelled(read: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens and verdict of each row of read (path, tokens) whose document has a label (doc_id, quality, toxic)."""
    bad = F.max((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad")
    each = labels.where("quality is not null or toxic is not null").groupBy("doc_id").agg(bad)
    number = F.expr("try_cast(regexp_extract(path, '/([0-9]{1,18})(/|[.][A-Za-z]+)?$', 1) as bigint)")
    found = read.select("tokens", number.alias("doc_id")).where("doc_id is not null").join(each, "doc_id")
    return found.select("tokens", F.when(F.coalesce("bad", F.lit(False)), "block").otherwise("allow").alias("verdict"))


def alike(rows: DataFrame) -> DataFrame:
    """token, same: each token of rows (tokens, number), and the smallest token that lies in exactly the same rows. Candidates agree in their counts and in sums of hashes
    of their rows' numbers; those that then aren't together in every one of their rows stand alone."""
    each = rows.select(F.explode("tokens").alias("token"), "number")
    mark = lambda seed: F.sum(F.xxhash64("number", F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFF))).alias(f"s{seed}")
    signed = each.groupBy("token").agg(F.count("*").alias("n"), mark(1), mark(2))
    groups = signed.groupBy("n", "s1", "s2").agg(F.min("token").alias("same"))
    named = materialize(signed.join(groups, ["n", "s1", "s2"]).select("token", "same", "n"), "alike")
    others = named.where("token <> same")
    both = rows.select("tokens", F.explode("tokens").alias("token")).join(others, "token").where(F.array_contains("tokens", F.col("same"))).groupBy("token").agg(F.count("*").alias("both"))
    return named.join(both, "token", "left").select("token", F.when(F.col("both") == F.col("n"), F.col("same")).otherwise(F.col("token")).alias("same"))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """id, tokens (of a rule), verdict, confidence, support from labelled rows (tokens, verdict).

    What FP-growth is given are only tokens that can be in a longer rule: those of too few bad rows are in none, and one whose rows are all bad is a rule by itself, which nothing
    longer betters. Tokens of the same rows are mined as one (a set of two of them does no better than one of them) and come back as a rule each.
    So a template's tokens, however many, cost as much as one."""
    rows = materialize(labelled.select("tokens", "verdict", F.monotonically_increasing_id().alias("number")), "labelled")
    bad = F.col("verdict") == "block"
    total, n_bad = rows.agg(F.count("*"), F.count_if(bad)).first()
    if not n_bad:
        return rows.limit(0).select("tokens", "verdict", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support"), F.col("number").alias("id"))
    least = max(1, math.ceil(support * total - 1e-9))
    counts = rows.select(F.explode("tokens").alias("token"), bad.cast("int").alias("bad")).groupBy("token").agg(F.count("*").alias("n"), F.sum("bad").alias("n_bad")).where(F.col("n_bad") >= least)
    counts = materialize(counts, "tokens")
    alone = counts.where("n = n_bad").select(F.array("token").alias("tokens"), F.lit("block").alias("verdict"), F.lit(1.0).alias("confidence"), (F.col("n_bad") / total).alias("support"))
    open_ = counts.where("n > n_bad").select("token")
    narrow = rows.select("number", F.explode("tokens").alias("token")).join(open_, "token").groupBy("number").agg(F.collect_set("token").alias("tokens"))  # the tokens of one URL
    same = materialize(alike(narrow), "same")
    once = narrow.select("number", F.explode("tokens").alias("token")).join(same.where("token = same"), "token").groupBy("number").agg(F.collect_set("token").alias("kept"))
    kept = F.coalesce("kept", F.array().cast("array<string>"))
    items = rows.join(once, "number", "left").select(F.concat(kept, F.array(F.concat(F.lit("verdict:"), F.col("verdict")))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(F.col("consequent")[0] == "verdict:block")
    made = rules.select(F.array_sort("antecedent").alias("tokens"), F.lit("block").alias("verdict"), "confidence", "support").where(~F.exists("tokens", lambda x: x.startswith("verdict:")))
    # A rule goes if one token less does as well: every set of a frequent set is frequent, so shorter rules are all there.
    less = made.select("verdict", F.col("tokens").alias("whole"), F.col("confidence").alias("own"), F.explode("tokens").alias("without")).withColumn("tokens", F.expr("filter(whole, x -> x <> without)"))
    covered = less.join(made.select("tokens", "verdict", F.col("confidence").alias("shorter")), ["tokens", "verdict"]).where("shorter >= own").select(F.col("whole").alias("tokens"), "verdict").distinct()
    short = materialize(made.join(covered, ["tokens", "verdict"], "left_anti"), "rules")
    longest = short.agg(F.coalesce(F.max(F.size("tokens")), F.lit(0))).first()[0]
    full = short
    for place in range(longest):  # each token by each that lies in the same rows; a rule has a few tokens
        at = full.withColumn("of", F.get("tokens", F.lit(place)))
        full = at.join(same.select(F.col("same").alias("of"), "token"), "of", "left").select(F.when(F.col("of").isNull(), F.col("tokens")).otherwise(F.concat(F.slice("tokens", 1, place), F.array("token"), F.slice("tokens", place + 2, longest))).alias("tokens"), "verdict", "confidence", "support")
    every = full.withColumn("tokens", F.array_sort("tokens")).distinct().unionByName(alone)
    return every.withColumn("id", F.xxhash64("tokens", "verdict"))


def index(rules: DataFrame, labelled: DataFrame) -> DataFrame:
    """token, id, rule_tokens, verdict, confidence: each rule under its rarest token among the labelled URLs."""
    often = labelled.select(F.explode("tokens").alias("token")).groupBy("token").count()
    each = rules.select("id", F.col("tokens").alias("rule_tokens"), "verdict", "confidence", F.explode("tokens").alias("token")).join(often, "token")
    rarest = each.groupBy("id").agg(F.min_by("token", F.struct("count", "token")).alias("token"), *(F.first(c).alias(c) for c in ("rule_tokens", "verdict", "confidence")))
    return rarest.select("token", "id", "rule_tokens", "verdict", "confidence")


def matched(urls: DataFrame, indexed: DataFrame) -> DataFrame:
    """tokens, mined (verdict, confidence, id of the surest matching rule) of each distinct token set that some rule matches."""
    sets = urls.select("tokens").distinct()
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(indexed, "token").where(F.size(F.array_except("rule_tokens", "tokens")) == 0)
    return met.groupBy("tokens").agg(F.max(F.struct("confidence", F.size("rule_tokens").alias("size"), "verdict", "id")).alias("mined"))


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence (null unless a mined rule decided) for each row of pages (page_id, url)."""
    parts = pages.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    read = materialize(parts.select("page_id", "host", "path", listed(rules).alias("listed"), tokens().alias("tokens")), "read")
    known = materialize(labelled(read, labels), "known")
    mined = matched(read.where("listed is null"), index(mine(known, support, confidence), known))
    both = join_hot(read, materialize(mined, "mined"), "tokens", "left")
    free = F.col("listed").isNull()
    return both.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce("listed.verdict", "mined.verdict", F.lit("allow")).alias("verdict"),
        F.when(free, F.col("mined.confidence")).alias("mined_confidence"),
    )

