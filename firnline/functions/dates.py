"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def inclusive_range(date_from: Column, date_to: Column) -> Column:
    """One row per day, both ends included (a generator expression)."""
    return F.explode(F.sequence(date_from.cast("date"), date_to.cast("date")))


def month_day(date: Column) -> Column:
    return F.date_format(date, "MM-dd")


def late_september(date: Column) -> Column:
    """Scenes after 10 September (of September only)."""
    return (F.month(date) == 9) & (F.dayofmonth(date) > 10)


def until_season_end(date: Column, last: str = "09-10") -> Column:
    """MM-dd comparison: drops every later month too."""
    return month_day(date) <= last
