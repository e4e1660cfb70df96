"""Broadcast hints for tables whose size has a bound that does not grow with the pixels.

Without a hint the planner estimates such a table from the size of the table it was derived from
and may shuffle all pixels to join it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 1_000_000
ROWS_PER_TASK = 250_000


def tasks_for(rows: int) -> int:
    """Tasks of a shuffle of pixels, so that the memory of one stays the same as the table grows; the
    engine sizes them by compressed bytes and caps their number by the session's setting."""
    return 1 + rows // ROWS_PER_TASK


def shuffled(df: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    """Rows of equal keys together, in ``tasks`` tasks; without a number the engine chooses."""
    return df.repartition(*keys) if tasks is None else df.repartition(tasks, *keys)


def per_date(df: DataFrame) -> DataFrame:
    """A table grouped by date: at most one row for each of the 3.65 million calendar dates of
    the years 1 to 9999 (some 60 MB); an archive has a few thousand."""
    return F.broadcast(df)


def dates_of(df: DataFrame) -> DataFrame:
    """The distinct dates of a table."""
    return per_date(df.select("date").distinct())


def of_pixel_size(df: DataFrame) -> DataFrame:
    """A layer with a row for each (date, cell): never broadcast, however small the table it was exploded
    from is; the planner does not count the rows that ``explode`` adds."""
    return df.hint("merge")


def at_most(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast if the given bound on the rows is small enough, else leave it to the engine."""
    return F.broadcast(df) if rows <= MAX_ROWS else df
