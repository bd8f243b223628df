"""Exact money arithmetic.

Money is summed as whole cents in BIGINT, so a total does not depend on how rows are
spread over tasks, stays in generated code, and fails loudly rather than wraps if it ever
overflows. Only quotients of totals use DECIMAL: they round half away from zero on the
exact value. Results leave the operators as doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Operand types that leave twelve digits after the point in a quotient.
NUMERATOR = "decimal(26,2)"
DENOMINATOR = "decimal(22,2)"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cents(c: str | Column) -> Column:
    """A two-decimal amount as whole cents."""
    return F.rint(_col(c).cast("double") * 100).cast("long")


def amount(c: str | Column) -> Column:
    """Whole cents as a double amount."""
    return _col(c) / F.lit(100)


def total(c: str | Column) -> Column:
    """Exact sum of whole cents as a double amount."""
    return amount(F.sum(_col(c)))


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """Exact quotient rounded half up; null when the denominator is zero."""
    quotient = numerator.cast(NUMERATOR) / F.nullif(denominator.cast(DENOMINATOR), F.lit(0))
    return F.round(quotient, digits).cast("double")


def mean(sum_of_cents: Column, count: Column, digits: int = 2) -> Column:
    """Mean amount from a sum of cents and a count."""
    return ratio(sum_of_cents, count * 100, digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return ratio(part.cast(NUMERATOR) * F.lit(100), whole, digits)


def currency(c: str | Column) -> Column:
    """``R$1,234`` display text."""
    return F.concat(F.lit("R$"), F.format_number(_col(c), 0))


def clip_low(c: Column) -> Column:
    """Negative values become 0 and null stays null, unlike ``greatest``."""
    return F.when(c < 0, F.lit(0)).otherwise(c)
