"""Grid ranks and values of earlier scenes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.grid import Grid
from firnline.operators.bounded import at_most, per_date, shuffled
from firnline.operators.ranks import merged_values, rank_merged


def grid_ranks(df: DataFrame, grid: Grid | None = None) -> DataFrame:
    """0-based ``col`` by ascending x and ``row`` by descending y.

    With a grid contract this is arithmetic. Otherwise the distinct coordinates of each axis are
    ranked in ranges and joined back; the axis is broadcast if it has been counted as small.
    """
    if grid is not None:
        return df.withColumns({"col": grid.col(F.col("x")), "row": grid.row(F.col("y"))})

    def axis(name: str, rank: str, ascending: bool) -> DataFrame:
        distinct = merged_values(df, name).select("v", F.lit(1).cast("long").alias("n"))
        size = distinct.count()
        position = F.col("lo") - 1 if ascending else F.lit(size) - F.col("lo")
        ranked = rank_merged(distinct)
        return at_most(ranked.select(F.col("v").alias(name), position.cast("int").alias(rank)), size)

    return df.join(axis("x", "col", True), "x").join(axis("y", "row", False), "y")


def scene_calendar(dates: DataFrame) -> DataFrame:
    """For each date within a week after a scene: is there a scene the day before, and on how
    many of the seven days before. One small row per date, no ordered global window."""
    scenes = dates.select("date").distinct()
    ahead = scenes.select("date", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("k"))
    return ahead.groupBy(F.date_add("date", F.col("k")).alias("date")).agg(
        F.max(F.col("k") == 1).alias("has_yesterday"), F.count("*").alias("n_week")
    )


def earlier_values(
    pixels: DataFrame,
    value: str = "mw_value",
    yesterday: str = "mw_value_yesterday",
    week: str = "mw_value_7_day_average",
    scenes: DataFrame | None = None,
    tasks: int | None = None,
    cell: Sequence[str] = ("x", "y"),
) -> DataFrame:
    """Value of the day before, and mean of the seven days before.

    Without a scene on the day before, today's value stands in; the mean also needs all seven
    scenes. Missing pixels inside existing scenes are skipped by the mean. ``scenes`` may give
    the dates (e.g. from the partition listing) so that the pixels are not scanned for them; ``tasks``
    the number of tasks of the shuffle by ``cell``, whose columns are integers then (the engine shuffles
    once more for windows by floating-point keys).
    """
    calendar = scene_calendar(pixels if scenes is None else scenes)
    day = F.datediff("date", F.lit("1970-01-01").cast("date"))
    history = W.partitionBy(*cell).orderBy(day)
    today = F.col(value).cast("double")
    columns = pixels.columns
    by_cell = pixels if tasks is None else shuffled(pixels, tasks, *cell)
    return (
        by_cell.join(per_date(calendar), "date", "left")
        .select(
            "*",
            F.max(today).over(history.rangeBetween(-1, -1)).alias("_before"),
            F.avg(today).over(history.rangeBetween(-7, -1)).alias("_week"),
        )
        .select(
            *columns,
            F.when(F.col("has_yesterday"), F.col("_before")).otherwise(today).alias(yesterday),
            F.when(F.col("has_yesterday") & (F.col("n_week") == 7), F.col("_week"))
            .otherwise(today)
            .alias(week),
        )
    )
