"""Text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .geo import col


def normalize(value) -> Column:
    """Lower case, everything but letters and digits to one space."""
    return F.trim(F.regexp_replace(F.lower(col(value)), "[^a-z0-9]+", " "))


def compact(value) -> Column:
    return F.regexp_replace(F.lower(col(value)), "[^a-z0-9]+", "")


def contains_phrase(text, term) -> Column:
    """Token-bounded phrase test on already normalised columns."""
    text, term = col(text), col(term)
    return (term != "") & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), term, F.lit(" ")))


def landmark(name) -> Column:
    """Stop names without the words that only place them beside something."""
    name = col(name)
    bare = F.trim(F.regexp_replace(name, r"^(?i)(?:before|after|opposite|opp|bef|aft)\.?\s+", ""))
    return F.when(bare != "", bare).otherwise(name)


RAW_ID = r"(?i)(?:\s*[·-]\s*)?\w*:?(?:node|way|relation)/\d+"


def safe_label(value, fallback: str) -> Column:
    bare = F.regexp_replace(F.coalesce(col(value), F.lit("")), RAW_ID, "")
    bare = F.regexp_replace(bare, r"^[ ·\-—]+|[ ·\-—]+$", "")
    return F.when(bare != "", bare).otherwise(F.lit(fallback))


def similarity(left, right) -> Column:
    """Edit-distance ratio on compact texts."""
    left, right = col(left), col(right)
    longest = F.greatest(F.length(left), F.length(right))
    return F.when(longest > 0, 1 - F.levenshtein(left, right) / longest).otherwise(0.0)


def tokens(value) -> Column:
    return F.filter(F.split(normalize(value), " "), lambda t: t != "")
