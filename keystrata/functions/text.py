"""Scalar text functions as built-in column expressions (no Python in the row path)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the Unicode property White_Space; runs are entered only at their first character, so long runs stay linear.
_OUTER = r"(?U)\A\s++|(?<!\s)\s++\z"


def trim_unicode(c: Column) -> Column:
    """`c` without leading and trailing Unicode white space."""
    return F.regexp_replace(c, _OUTER, "")


def blank_to_null(c: Column) -> Column:
    """Trimmed `c`, null where nothing is left."""
    return F.nullif(trim_unicode(c), F.lit(""))


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only."""
    return F.coalesce(trim_unicode(c) == "", F.lit(True))


def letters_digits(c: Column) -> Column:
    """Only the Unicode letters and numbers of `c`, lower-cased."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]++", ""))


def balanced(c: Column, opening: str, closing: str) -> Column:
    """True if every closing sign of `c` follows its own opening one and none stays open."""
    only = F.regexp_replace(c, rf"[^\{opening}\{closing}]++", "")
    depth = F.aggregate(
        F.split(only, ""),
        F.lit(0),
        lambda d, x: F.when(d < 0, d).when(x == opening, d + 1).when(x == closing, d - 1).otherwise(d),
    )
    return depth == 0
