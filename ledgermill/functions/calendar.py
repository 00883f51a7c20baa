"""Business-day arithmetic in closed form (Monday to Friday, no holidays)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# a Monday; floor division keeps the count right on both sides of it
_EPOCH_MONDAY = "1970-01-05"


def _weekdays_before(day: Column) -> Column:
    n = F.datediff(day, F.lit(_EPOCH_MONDAY).cast("date"))
    return F.floor(n / F.lit(7)) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))


def business_days_between(start: Column, end: Column) -> Column:
    """Weekdays in ``[start, end)``; 0 when the end is not later; null when a side is."""
    days = _weekdays_before(end.cast("date")) - _weekdays_before(start.cast("date"))
    return F.when(start.isNotNull() & end.isNotNull(), F.greatest(days, F.lit(0)).cast("int"))


def is_late_deposit(pay: Column, deposit: Column, threshold_days: int = 3) -> Column:
    return business_days_between(pay, deposit) > threshold_days


def add_business_days(start: Column, days: int) -> Column:
    """The weekday reached after ``days`` business days: weeks plus a weekend-aware rest."""
    day = start.cast("date")
    weekday = F.weekday(day)  # Monday = 0
    # a weekend start counts from the Friday before it
    friday = F.when(weekday > 4, F.date_sub(day, weekday - 4)).otherwise(day)
    from_monday = F.least(weekday, F.lit(4)) + days
    return F.date_add(friday, (days + 2 * F.floor(from_monday / 5)).cast("int"))
