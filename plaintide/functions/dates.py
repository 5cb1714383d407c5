"""Date and time columns of a complaint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plaintide.functions.numbers import flag

MICROS_PER_DAY = 86_400_000_000.0


def utc_timestamp(text: Column) -> Column:
    """ISO-8601 text with any offset to a timestamp; null when unparseable."""
    return F.try_to_timestamp(text)


def year_month(day: Column) -> Column:
    """``YYYY-MM`` text, whose lexical order is time order."""
    month = F.month(day)
    gap = F.when(month < 10, "-0").otherwise("-")
    return F.concat(F.year(day).cast("string"), gap, month.cast("string"))


def month_start(year_month_text: Column) -> Column:
    """First day of a ``YYYY-MM`` month."""
    return F.to_date(F.concat(year_month_text, F.lit("-01")))


def days_between(start: Column, end: Column) -> Column:
    """Fractional days from ``start`` to ``end`` to three places."""
    gap = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.round(gap / F.lit(MICROS_PER_DAY), 3)


def after_window(day: Column, window_end: str) -> Column:
    """True for rows in the partial last period; false for an unknown date."""
    return flag(day > F.lit(window_end).cast("date"))
