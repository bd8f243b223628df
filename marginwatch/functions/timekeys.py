"""Calendar keys and day counts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def year_month(ts: str | Column) -> Column:
    """``YYYY-MM`` text key."""
    return F.date_format(ts, "yyyy-MM")


def week_number(ts: str | Column) -> Column:
    """Week of year, weeks starting on Monday; days before the first Monday are week 0.

    This is the C library's ``%W``, which Spark's date patterns do not offer.
    """
    return ((F.dayofyear(ts) + 6 - F.weekday(ts)) / 7).cast("int")


def year_week(ts: str | Column) -> Column:
    """``YYYY-Www`` text key; sorts in time order."""
    return F.concat(F.year(ts).cast("string"), F.lit("-W"), F.lpad(week_number(ts).cast("string"), 2, "0"))


def iso_week(ts: str | Column) -> Column:
    """ISO 8601 week number, used only to choose the weeks of a planted refund spike."""
    return F.weekofyear(ts)


def month_start(key: str | Column) -> Column:
    """First day of a ``YYYY-MM`` key as a date."""
    return F.to_date(key, "yyyy-MM")


def whole_days(later: Column, earlier: Column) -> Column:
    """Elapsed whole days, truncated toward zero."""
    return F.extract(F.lit("DAY"), later - earlier)
