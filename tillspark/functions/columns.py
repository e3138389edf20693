"""Scalar and aggregate column expressions (all native, no Python functions)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONEY = "decimal(18,4)"


def known(column: Column) -> Column:
    """A number as double, with NaN as NULL: both stand for a missing value."""
    return F.nanvl(column.cast("double"), F.lit(None).cast("double"))


def clean_text(c: Column) -> Column:
    """Collapse any Unicode whitespace to one blank, then strip."""
    return F.trim(F.regexp_replace(c.cast("string"), r"(?U)\s+", " "))


def without_suffix(c: Column) -> Column:
    """Text without a spreadsheet `.0` at its end; the text must hold no line feed, which marks the end here.

    `c` is named once, so a filter on the result says it once too, and no pattern is searched.
    """
    return F.replace(F.replace(F.concat(c, F.lit("\n")), F.lit(".0\n"), F.lit("")), F.lit("\n"), F.lit(""))


def clean_id(c: Column) -> Column:
    """Text clean-up plus removal of a spreadsheet `.0` suffix; leading zeros stay."""
    return without_suffix(clean_text(c))


def number(c: Column) -> Column:
    """Tolerant number: unparsable text and NaN become NULL, infinities stay."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def timestamp(c: Column) -> Column:
    """Tolerant zone-free timestamp."""
    return c.try_cast("timestamp_ntz")


def is_nonfinite(c: Column) -> Column:
    """True for NULL, NaN and infinities."""
    return c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))


def money(c: Column | str) -> Column:
    """Exact decimal of a monetary double, so that sums do not depend on row order."""
    c = F.col(c) if isinstance(c, str) else c
    return c.cast(MONEY)


def total(c: Column | str) -> Column:
    """Order-independent money sum returned as a double."""
    return F.sum(money(c)).cast("double")


def mean(c: Column | str) -> Column:
    """Order-independent money mean."""
    return total(c) / F.nullif(F.count(c), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero."""
    return F.try_divide(a, b)


def flag(c: Column) -> Column:
    """0/1 integer of a condition, NULL counting as false."""
    return F.coalesce(c.cast("int"), F.lit(0))


def count_if(c: Column) -> Column:
    """Number of rows for which the condition holds; 0 (not NULL) on empty input."""
    return F.coalesce(F.sum(flag(c)), F.lit(0)).cast("bigint")


def same(left: DataFrame, right: DataFrame, pairs: dict[str, str]) -> Column:
    """NULL-safe equality over several column pairs."""
    return reduce(
        lambda a, b: a & b, [left[x].eqNullSafe(right[y]) for x, y in pairs.items()]
    )


def sample_skewness(c: Column | str) -> Column:
    """Bias-corrected skewness (G1); NULL below three values or without spread."""
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column | str) -> Column:
    """Bias-corrected excess kurtosis (G2); NULL below four values or without spread."""
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    scale = F.try_divide(n - 1, (n - 2) * (n - 3))
    return F.when(n >= 4, scale * ((n + 1) * g2 + 6))
