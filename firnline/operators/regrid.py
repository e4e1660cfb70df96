"""Change of grid between a coarse and a fine regular raster of the same projection.

Both directions are generated from the coarse side: every coarse cell lists the fine cells it
covers by arithmetic. No join and no shuffle of the fine raster takes place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.grid import Grid


def _indices(lo: Column, hi: Column) -> Column:
    """lo..hi, empty (instead of descending) when hi < lo."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def nearest(
    scenes: DataFrame,
    value: str,
    coarse: Grid,
    fine: Grid,
    keys: Sequence[str] = ("date",),
    trim: tuple[int, int] = (0, 0),
) -> DataFrame:
    """Nearest-neighbour values on the fine grid; input has columns ``ccol, crow``.

    Half-way ties go to the smaller index. Fine cells outside the hull of the coarse centres are
    NULL. ``trim`` cuts (rows, columns) from the far end of the fine grid.
    """

    def covered(index: str, n: int, start_offset: float, n_fine: int) -> Column:
        # fine index f lies at t = (f * fine.step - start_offset) / coarse.step on the coarse axis
        i = F.col(index)
        lo = F.floor(((i - 0.5) * coarse.step + start_offset) / fine.step) + 1
        hi = F.floor(((i + 0.5) * coarse.step + start_offset) / fine.step)
        lo = F.when(i == 0, F.lit(0)).otherwise(F.greatest(lo, F.lit(0)))
        hi = F.when(i == n - 1, F.lit(n_fine - 1)).otherwise(F.least(hi, F.lit(n_fine - 1)))
        return _indices(lo.cast("bigint"), hi.cast("bigint"))

    nrows, ncols = fine.nrows - trim[0], fine.ncols - trim[1]
    lines = scenes.select(
        *keys, "ccol", value, F.explode(covered("crow", coarse.nrows, fine.y0 - coarse.y0, nrows)).alias("row")
    )
    full = lines.select(
        *keys, value, "row", F.explode(covered("ccol", coarse.ncols, coarse.x0 - fine.x0, ncols)).alias("col")
    )
    x, y = fine.x(F.col("col")), fine.y(F.col("row"))
    inside = x.between(coarse.x0, coarse.x_last) & y.between(coarse.y_last, coarse.y0)
    return full.select(
        *keys,
        F.col("col").cast("int"),
        F.col("row").cast("int"),
        x.alias("x"),
        y.alias("y"),
        F.when(inside, F.col(value)).alias(value),
    )


def bilinear(
    scenes: DataFrame, value: str, coarse: Grid, fine: Grid, keys: Sequence[str] = ("date",)
) -> DataFrame:
    """Bilinear values at the fine centres inside the hull of the coarse centres.

    The 2 x 2 neighbourhood is assembled on the (small) coarse raster with windows; each patch
    then lists its fine centres. Missing corners are left out and the weights renormalised.
    """
    line = W.partitionBy(*keys, "crow").orderBy("ccol")
    column = W.partitionBy(*keys, "ccol").orderBy("crow")

    def after(spec, name: str) -> Column:
        return F.max(name).over(spec.rangeBetween(1, 1))

    patch = scenes.select(*keys, "ccol", "crow", F.col(value).cast("double").alias("v00"))
    patch = patch.select("*", after(line, "v00").alias("v01"))
    patch = patch.select("*", after(column, "v00").alias("v10"), after(column, "v01").alias("v11"))

    def owned(index: str, n: int, start_offset: float, n_fine: int) -> Column:
        # fine centres in [i, i + 1) of the coarse axis; the last index owns only its own centre
        i = F.col(index)
        lo = F.greatest(F.ceil((i * coarse.step + start_offset) / fine.step), F.lit(0))
        end = F.when(i == n - 1, F.floor((i * coarse.step + start_offset) / fine.step)).otherwise(
            F.ceil(((i + 1) * coarse.step + start_offset) / fine.step) - 1
        )
        return _indices(lo.cast("bigint"), F.least(end, F.lit(n_fine - 1)).cast("bigint"))

    y_off, x_off = fine.y0 - coarse.y0, coarse.x0 - fine.x0
    lines = patch.select("*", F.explode(owned("crow", coarse.nrows, y_off, fine.nrows)).alias("row"))
    full = lines.select("*", F.explode(owned("ccol", coarse.ncols, x_off, fine.ncols)).alias("col"))
    fx = (F.col("col") * fine.step - x_off) / coarse.step - F.col("ccol")
    fy = (F.col("row") * fine.step - y_off) / coarse.step - F.col("crow")
    corners = (
        ("v00", (1 - fx) * (1 - fy)),
        ("v01", fx * (1 - fy)),
        ("v10", (1 - fx) * fy),
        ("v11", fx * fy),
    )
    top, weight = F.lit(0.0), F.lit(0.0)
    for name, w in corners:
        top = top + F.when(F.col(name).isNotNull(), w * F.col(name)).otherwise(0.0)
        weight = weight + F.when(F.col(name).isNotNull(), w).otherwise(0.0)
    return full.select(
        *keys,
        F.col("col").cast("int"),
        F.col("row").cast("int"),
        fine.x(F.col("col")).alias("x"),
        fine.y(F.col("row")).alias("y"),
        F.when(weight > 0, top / weight).alias(value),
    )


def cell_lookup(points: DataFrame, scenes: DataFrame, value: str, coarse: Grid, keys: Sequence[str] = ("date",)) -> DataFrame:
    """Value of the coarse cell that contains each point (equi join on the affine index).

    The upper left corner of the raster is half a step outside the first centre.
    """
    ccol = F.floor((F.col("x") - (coarse.x0 - coarse.step / 2)) / coarse.step).cast("int")
    crow = F.floor(((coarse.y0 + coarse.step / 2) - F.col("y")) / coarse.step).cast("int")
    located = points.withColumns({"ccol": ccol, "crow": crow})
    return located.join(scenes.select(*keys, "ccol", "crow", value), [*keys, "ccol", "crow"], "left")


def shift_half_cell(df: DataFrame, dx: float = 500.0, dy: float = -500.0) -> DataFrame:
    """Move corner coordinates to cell centres (or back)."""
    return df.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
