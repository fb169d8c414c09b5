"""Coercions with a stated result for blank, unknown and out-of-domain values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What people write for yes and no, and for the three credibility classes.
TRUE_WORDS = ("1", "1.0", "true", "t", "yes", "y", "evet")
FALSE_WORDS = ("0", "0.0", "false", "f", "no", "n", "hayır", "hayir")
CREDIBILITY = {
    "dogrulanmis": "dogrulanmis", "doğrulanmış": "dogrulanmis", "verified": "dogrulanmis", "true": "dogrulanmis",
    "supheli": "supheli", "şüpheli": "supheli", "suspicious": "supheli", "unverified": "supheli",
    "asilsiz": "asilsiz", "asılsız": "asilsiz", "false": "asilsiz", "fake": "asilsiz",
}


def blank(c: Column) -> Column:
    """Trimmed text, null as empty."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def number(c: Column) -> Column:
    return F.trim(c.cast("string")).try_cast("double")


def lenient_binary(c: Column) -> Column:
    """Integer value with blank and unparseable as 0; no domain check."""
    return F.coalesce(number(c).cast("int"), F.lit(0))


def binary_violation(c: Column) -> Column:
    """Whether strict coercion would fail: a number other than 0 and 1."""
    return ~lenient_binary(c).isin(0, 1)


def strict_binary(c: Column) -> Column:
    """As lenient_binary, but a value outside 0 and 1 raises."""
    x = lenient_binary(c)
    return F.when(x.isin(0, 1), x).otherwise(F.raise_error(F.concat(F.lit("not 0 or 1: "), x.cast("string"))).cast("int"))


def boolean_word(c: Column, blank_as_zero: bool = False) -> Column:
    """1, 0 or null from the words people write; a blank is 0 on request."""
    w = F.lower(blank(c))
    found = F.when(w.isin(*TRUE_WORDS), 1).when(w.isin(*FALSE_WORDS), 0)
    return found.when(w == "", 0) if blank_as_zero else found


def ordinal(c: Column, top: int = 3, invalid: int | None = None) -> Column:
    x = number(c)
    return F.when(x.isin(*range(top + 1)), x.cast("int")).otherwise(F.lit(invalid).cast("int"))


def credibility(c: Column) -> Column:
    """One of three classes by synonym; an unknown word stays as written in lower case, a blank is empty."""
    w = F.lower(blank(c))
    table = F.create_map(*(F.lit(x) for pair in CREDIBILITY.items() for x in pair))
    return F.coalesce(F.try_element_at(table, w), w)


def int_or(c: Column, default: int = 0) -> Column:
    return F.coalesce(number(c).cast("bigint"), F.lit(default))


def safe_number(c: Column) -> Column:
    """A number as text: without a fraction where it is integral, null where it is none."""
    x = number(c)
    return F.when(x.isNull(), None).when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
