"""Lossy-text casts that yield null instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The accepted truth words.
TRUE_WORDS = ["true", "1", "1.0", "vrai", "oui", "yes", "t", "v", "o", "y"]
FALSE_WORDS = ["false", "0", "0.0", "faux", "non", "no", "f", "n"]


def to_boolean(c: Column) -> Column:
    word = F.lower(F.trim(c.cast("string")))
    return F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False)


def number_text(c: Column) -> Column:
    """Drop all spaces (also non-breaking), a trailing percent sign, and turn a decimal comma into a point."""
    text = F.regexp_replace(c.cast("string"), "[\\s\\u00a0\\u202f]+", "")
    return F.regexp_replace(F.regexp_replace(text, "%$", ""), "(?<=[0-9]),(?=[0-9])", ".")


def to_number(c: Column, whole: bool = False) -> Column:
    text = number_text(c)
    # Java also reads "1d" or "2f" as numbers; only plain decimal notation counts
    plain = text.rlike("^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$")
    value = F.when(plain, text).try_cast("double")
    return F.rint(value).cast("bigint") if whole else value
