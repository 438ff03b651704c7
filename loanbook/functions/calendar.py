"""Calendar arithmetic on dates, independent of the session time zone."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, functions as F


def as_date(day: dt.date | Column) -> Column:
    return F.lit(day).cast("date") if isinstance(day, dt.date) else day


def full_months(start: Column, end: Column) -> Column:
    """Completed calendar months from ``start`` to ``end``.

    A month counts once its day of month is reached; month ends get no special
    treatment (31 January to 29 February is no full month).
    """
    # With room for every day of a month, whole months are what is left of the
    # difference after a division towards zero, whichever date comes first.
    return F.call_function("div", _day_number(end) - _day_number(start), F.lit(32)).cast("int")


def _day_number(day: Column) -> Column:
    return (F.year(day) * 12 + F.month(day)) * 32 + F.day(day)


def month_start(day: Column) -> Column:
    return F.trunc(day, "MM")


def midnight(day: Column, plus_days: int = 0) -> Column:
    """Timestamp at the start of a date, optionally some days later."""
    return F.date_add(day, plus_days).cast("timestamp")
