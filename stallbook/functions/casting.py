"""Strict casts. Spark's casts accept '12f', '2026-6-9' or '1d'; these do not."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
MONEY = "decimal(18,2)"
FINE_MONEY = "decimal(18,6)"


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def strict_double(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def strict_int(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(INTEGER), text.try_cast("int"))


def strict_date(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text.rlike(ISO_DATE), text.try_cast("date"))


def date_prefix(c: Column) -> Column:
    """Date from the first ten characters of a text (timestamps included)."""
    return strict_date(F.left(c, F.lit(10)))


def no_nan(c: Column) -> Column:
    """NaN means missing; Spark would let it poison averages and pass ``> x``."""
    return F.when(~F.isnan(c), c)


def money(c: Column) -> Column:
    """Cent-exact value, so sums do not depend on the order of the rows; NULL beyond the type's range."""
    return c.try_cast(MONEY)


def plain_number(c: Column) -> Column:
    """Number as text without an exponent: 150.0, 12500000.5."""
    long_form = F.regexp_replace(
        F.regexp_replace(c.cast("decimal(38,6)").cast("string"), "0+$", ""), r"\.$", ".0"
    )
    return F.when(F.abs(c) < 1e7, c.cast("string")).otherwise(long_form)


def half_even_text(c: Column) -> Column:
    """Number as whole-number text, ties to even."""
    return F.bround(c, 0).try_cast("bigint").cast("string")
