"""The fourteen clause categories, with the values that go with each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Names and order of the categories.
CATEGORIES = (
    "Party Identification",
    "Purpose",
    "NDA Type",
    "Definition of Confidential Information",
    "Confidentiality Obligations",
    "Authorized Disclosure",
    "Non-Confidential Information",
    "Liability for Damages",
    "Competition Rights",
    "Term and Termination",
    "Intellectual Property",
    "Employees",
    "Governing Law and Jurisdiction",
    "Additional Information",
)
FALLBACK = "Additional Information"

# Risk weight and tier by category; others weigh 0 and are LOW.
RISK = {
    "Liability for Damages": (35, "HIGH"),
    "Competition Rights": (35, "HIGH"),
    "Intellectual Property": (30, "HIGH"),
    "Term and Termination": (25, "HIGH"),
    "Definition of Confidential Information": (15, "MEDIUM"),
    "Employees": (15, "MEDIUM"),
    "Governing Law and Jurisdiction": (15, "MEDIUM"),
    "Confidentiality Obligations": (5, "LOW"),
}

# Terms by which the rule classifier knows a category, matched as whole words in lower case.
TERMS = {
    "Party Identification": "by and between|disclosing party|receiving party|recipient|parties|corporation|company|effective date|agreement is made",
    "Purpose": "purpose|evaluating|evaluation|transaction|business relationship|discussions|contemplated",
    "NDA Type": "non-disclosure|confidentiality agreement|nda|execution version|mutual non-disclosure",
    "Definition of Confidential Information": "confidential information means|shall include|proprietary|trade secrets|technical data|know-how|financial statements|business plans",
    "Confidentiality Obligations": "hold in confidence|keep confidential|agree not to disclose|maintain secrecy|standard of care|use solely|protect from",
    "Authorized Disclosure": "permitted disclosure|representatives|advisors|compelled|court order|subpoena|required by law|governmental authority",
    "Non-Confidential Information": "shall not include|does not include|publicly known|public domain|prior knowledge|independently developed|third party",
    "Liability for Damages": "injunctive relief|irreparable harm|indemnify|hold harmless|limitation of liability|damages|breach|remedies",
    "Competition Rights": "non-solicit|non-compete|solicit|solicitation|hire|interfere",
    "Term and Termination": "term|terminate|termination|effective date|expire|expiration|survive|survival",
    "Intellectual Property": "intellectual property|license|patent|trademark|copyright|ownership",
    "Employees": "employee|employees|personnel|staff|contractor|consultant",
    "Governing Law and Jurisdiction": "governed by|laws of|jurisdiction|courts|governing law|venue|arbitration",
}

# Signals of categories that are rare among labelled clauses, matched anywhere after a word's start.
SIGNALS = {
    "Liability for Damages": r"\b(?:damage|liabil|indemn|loss|breach|penalty|remedy|remedies)",
    "Competition Rights": r"\b(?:compet|solicit|rival|exclusive|entic)",
    "Intellectual Property": r"\b(?:patent|copyright|trademark|trade secret|invention|intellectual property|proprietary|ownership|license)",
    "Governing Law and Jurisdiction": r"\b(?:govern|jurisdiction|venue|arbitrat|court|laws of|state of)",
}

# Quality buckets of an ensemble that count as labelled.
VALID_QUALITY = ("HIGH_CONFIDENCE", "MEDIUM_CONFIDENCE", "LOW_CONFIDENCE", "DISAGREEMENT")
EXCLUDED_QUALITY = ("API_ERROR", "API_QUOTA_EXHAUSTED", "INVALID_RESPONSE", "QUOTA_WAITING")


def label_col(category: str) -> str:
    return "label_" + category.lower().replace(" ", "_")


def dimension(spark: SparkSession) -> DataFrame:
    """cat_idx, category, label_col, risk_weight, risk_tier: fourteen rows, always small enough to broadcast."""
    rows = [(i, c, label_col(c), *RISK.get(c, (0, "LOW"))) for i, c in enumerate(CATEGORIES)]
    return spark.createDataFrame(rows, "cat_idx int, category string, label_col string, risk_weight int, risk_tier string")


def all_categories() -> Column:
    return F.array(*map(F.lit, CATEGORIES))
