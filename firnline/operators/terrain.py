"""Slope and aspect of an elevation layer, and shore cells.

The stencil is a stated choice: central differences, one-sided at the layer's edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_neighbours(cells: DataFrame, value: str) -> DataFrame:
    """Add the four neighbours ``_w _e _n _s``; NULL beyond the edge."""
    line, column = W.partitionBy("row").orderBy("col"), W.partitionBy("col").orderBy("row")

    def at(spec, k: int) -> Column:
        return F.max(value).over(spec.rangeBetween(k, k))

    return cells.select(
        "*",
        at(line, -1).alias("_w"),
        at(line, 1).alias("_e"),
        at(column, -1).alias("_n"),
        at(column, 1).alias("_s"),
    )


def _difference(before: Column, here: Column, after: Column, step: float) -> Column:
    return (
        F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * step))
        .when(after.isNotNull(), (after - here) / step)
        .when(before.isNotNull(), (here - before) / step)
    )


def slope_and_aspect(cells: DataFrame, value: str = "elevation_data", step: float = 1000.0) -> DataFrame:
    """``slope_data`` in degrees (0 flat) and ``aspect_data``, the cosine of the compass
    direction of steepest descent (1 north, -1 south, NULL where flat)."""
    here = F.col(value)
    gx = _difference(F.col("_w"), here, F.col("_e"), step)
    gy = _difference(F.col("_s"), here, F.col("_n"), step)
    around = with_neighbours(cells, value).select(*cells.columns, gx.alias("_gx"), gy.alias("_gy"))
    east, north = F.col("_gx"), F.col("_gy")
    steep = F.sqrt(east * east + north * north)
    return around.select(
        *cells.columns,
        F.degrees(F.atan(steep)).alias("slope_data"),
        F.when(steep > 0, F.cos(F.atan2(-east, -north))).alias("aspect_data"),
    )


def shore_cells(cells: DataFrame, is_water: str = "is_water") -> DataFrame:
    """Water cells with an ice cell to the north, south, west or east."""
    flagged = cells.withColumn("_ice", (~F.col(is_water)).cast("int"))
    touching = F.greatest(*[F.coalesce(c, F.lit(0)) for c in ("_w", "_e", "_n", "_s")])
    return (
        with_neighbours(flagged, "_ice")
        .where(F.col(is_water) & (touching == 1))
        .select(*cells.columns)
    )
