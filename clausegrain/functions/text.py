"""Text as Column expressions. White space means Unicode white space throughout, as in (?U)\\s."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, functions as F, types as T

BLANKS = r"(?U)^\s+|\s+\z"


def let(value: Column, use) -> Column:
    """use(value) with the value computed once: Catalyst would copy its expression to each place that reads it."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, BLANKS, "")


def rstrip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+\z", "")


def is_blank(c: Column) -> Column:
    """Missing in any form: null, empty, or white space alone."""
    return c.isNull() | (strip(c) == "")


def by_line(c: Column, change) -> Column:
    return F.array_join(F.transform(F.split(c, "\n", -1), change), "\n")


def collapse_spaces(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, "\t", " "), r"(?U)[^\S\n]+", " ")


def limit_newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def normalize_whitespace(c: Column) -> Column:
    """One space between words, at most one blank line, no space at either side of a line."""
    return strip(by_line(limit_newlines(collapse_spaces(c)), strip))


def drop_controls(c: Column) -> Column:
    """Without control characters; tabs, newlines and carriage returns stay."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


@F.arrow_udf(T.StringType())
def _composed(texts: pa.Array) -> pa.Array:
    made = [pa.array([t if t is None else unicodedata.normalize("NFC", t) for t in texts.slice(at, 200).to_pylist()], pa.string()) for at in range(0, len(texts), 200)]
    return pa.concat_arrays(made) if made else texts


def nfc(c: Column) -> Column:
    """Unicode's composed form, which Spark has no function for. Only texts that aren't ASCII go to Python, which holds some of them as objects at a time."""
    return F.coalesce(_composed(F.when(F.length(c) < F.octet_length(c), c)), c)


def clean_clause(c: Column, compose: bool = True, whitespace: bool = True) -> Column:
    """Cleaning of clause texts: controls, then composition, then white space."""
    out = drop_controls(c)
    out = nfc(out) if compose else out
    return normalize_whitespace(out) if whitespace else out


def clean_extracted(c: Column, compose: bool = True) -> Column:
    """Cleaning of text from PDF pages: composition first, and lines keep their indent."""
    out = collapse_spaces(drop_controls(nfc(c) if compose else c))
    return strip(limit_newlines(by_line(out, rstrip)))


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def n_words(c: Column) -> Column:
    return F.size(words(c))


def n_lines(c: Column) -> Column:
    return F.when(c == "", 0).otherwise(F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1)


def clause_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s_clause_%03d", document_id.cast("string"), index.cast("int"))


def neighbour_id(clause: Column, step: int) -> Column:
    """The id of the clause so many places on, by arithmetic on the id's number."""
    number = F.regexp_extract(clause, r"_(\d+)$", 1).cast("int") + step
    return F.concat(F.regexp_replace(clause, r"_\d+$", "_"), F.format_string("%03d", number))


def is_upper(c: Column) -> Column:
    """Some upper-case letter and no lower-case one."""
    return c.rlike(r"^[^\p{Ll}]*\p{Lu}[^\p{Ll}]*$")


# Letters whose upper case is several letters in full, and one (or none, so that they stay) by itself.
SEVERAL = "".join(x for x in map(chr, range(0xDF, 0xFB18)) if len(x.upper()) > 1)
ALONE = "".join("\u1E9E" if x == "\xDF" else x.title() if len(x.title()) == 1 else x for x in SEVERAL)


def upper_by_letter(c: Column) -> Column:
    """Upper case that keeps a text's length: each letter by itself, so that sharp s is one letter too, where F.upper() makes two of it."""
    each = F.transform(F.split(c, ""), lambda x: F.when(F.length(F.upper(x)) == F.length(x), F.upper(x)).otherwise(F.translate(x, SEVERAL, ALONE)))
    return F.when(F.length(F.upper(c)) == F.length(c), F.upper(c)).otherwise(F.array_join(each, ""))


def length_bucket(c: Column) -> Column:
    n = F.length(c)
    return F.when(n < 100, "short").when(n < 400, "medium").otherwise("long")


def hash_order(key: Column, digits: int = 4) -> Column:
    """A number from a key's MD5: an order that is random yet the same in every run."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, digits), 16, 10).cast("long")


def truthy(c: Column, vocabulary: tuple[str, ...] = ("true", "1")) -> Column:
    return F.coalesce(F.lower(strip(c.cast("string"))).isin(*vocabulary), F.lit(False))


def redact(c: Column, key: str | None = None) -> Column:
    """Without a known key value, and without anything shaped like a provider's key."""
    out = F.replace(c, F.lit(key), F.lit("[REDACTED]")) if key else c
    return F.regexp_replace(out, r"AIza[\w-]+", "[REDACTED]")


def is_daily_quota(message: Column) -> Column:
    """An error that a retry won't mend before the next day."""
    m = F.lower(message)
    return m.rlike(r"per[ _-]?day|daily|requests/day|tokens/day") & m.rlike("429|resource_exhausted|quota|exhausted")
