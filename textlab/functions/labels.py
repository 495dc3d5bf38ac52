"""Label and id expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import NA_STRINGS, POSITIVE_FROM


def _c(col):
    return F.col(col) if isinstance(col, str) else col


def binarise(col: Column | str, positive_from: int = POSITIVE_FROM) -> Column:
    """``label >= 2`` as 0/1; a null label counts as class 0."""
    return F.coalesce(_c(col) >= positive_from, F.lit(False)).cast("int")


def parse_multilabel(col: Column | str) -> Column:
    """1 when any digit run in the label string is > 0, else 0 (null -> 0).

    A run of ASCII digits is > 0 exactly when it holds a non-zero digit, so
    one regex test replaces "find all numbers, any > 0".
    """
    return F.coalesce(_c(col).rlike("[1-9]"), F.lit(False)).cast("int")


#: A number as pandas reads one: digits with an optional point and exponent, nothing after them.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def coerce_id(col: Column | str) -> Column:
    """Lenient numeric id: ``"12"`` and ``"12.0"`` -> 12, junk -> null.

    Whole numbers are cast as such, so ids above 2^53 keep every digit; only
    other number formats go through a double.
    """
    c = F.trim(_c(col))
    by_double = F.when(c.rlike(NUMBER_PATTERN), c.try_cast("double")).try_cast("bigint")
    return F.coalesce(F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("bigint")), by_double)


def strict_cast(col: Column | str, to: str = "bigint") -> Column:
    """Failing cast (ANSI): a bad value raises instead of becoming null."""
    c = _c(col)
    return F.when(c.isNull(), F.lit(None).cast(to)).otherwise(
        F.coalesce(c.try_cast(to),
                   F.raise_error(F.concat(F.lit("cannot cast value: "), c.cast("string")))
                   .cast(to)))


def na_to_null(col: Column | str) -> Column:
    """pandas NA strings -> null."""
    c = _c(col)
    return F.when(c.isin(*NA_STRINGS), F.lit(None).cast("string")).otherwise(c)
