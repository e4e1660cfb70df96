"""Dense rasters <-> long pixel tables.

The dense form is one row per raster line, an array of ``ncols`` values, so that a scene is never
a single value in a single task. Whole scenes (arrays of lines) are accepted on input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.grid import Grid
from firnline.operators.bounded import shuffled


def _no_nan(v: Column) -> Column:
    return F.when(~F.isnan(v.cast("double")), v)


def scene_to_lines(scenes: DataFrame, band: str) -> DataFrame:
    """``(..., band ARRAY<ARRAY>)`` to ``(..., row, line)``; no shuffle."""
    keep = [c for c in scenes.columns if c != band]
    return scenes.select(*keep, F.posexplode(band).alias("row", "line"))


def lines_to_long(lines: DataFrame, value: str, grid: Grid) -> DataFrame:
    """``(..., row, line)`` to one row per pixel with coordinates; NaN becomes NULL. No shuffle."""
    keep = [c for c in lines.columns if c not in ("row", "line")]
    cells = lines.select(*keep, "row", F.posexplode("line").alias("col", "_v"))
    return cells.select(
        *keep,
        grid.x(F.col("col")).alias("x"),
        grid.y(F.col("row")).alias("y"),
        "row",
        "col",
        _no_nan(F.col("_v")).alias(value),
    )


def long_to_lines(
    cells: DataFrame,
    value: str,
    grid: Grid,
    keys: Sequence[str] = ("date",),
    version: str | None = None,
    outside: str = "error",
    tasks: int | None = None,
) -> DataFrame:
    """Dense raster lines for every row of the grid, NULL where a cell is absent.

    Duplicates of a cell are resolved by the highest ``version`` (or the highest value). A line is built
    from its sorted cells by filling the gaps between them, so the work is linear in the line. Cells
    outside the grid are counted first and raise ``ValueError``; ``outside="drop"`` leaves them out. Cells
    are shuffled once, by line, in ``tasks`` tasks.
    """
    inside = F.col("row").between(0, grid.nrows - 1) & F.col("col").between(0, grid.ncols - 1)
    if outside == "error":
        lost = cells.where(~F.coalesce(inside, F.lit(False))).count()
        if lost:
            raise ValueError(f"{lost} cells are outside the grid of {grid.nrows} x {grid.ncols}")
    by_line = shuffled(cells.where(inside).select(*keys, "row", "col", *dict.fromkeys([value, version or value])), tasks, *keys, "row")
    one = by_line.groupBy(*keys, "row", "col").agg(F.max_by(value, version or value).alias("_v"))
    lines = one.groupBy(*keys, "row").agg(
        F.sort_array(F.collect_list(F.struct(F.col("col").cast("int").alias("c"), "_v"))).alias("_m")
    )
    rows = F.explode(F.sequence(F.lit(0), F.lit(grid.nrows - 1))).alias("row")
    domain = cells.select(*keys).distinct().select(*keys, rows) if keys else cells.sparkSession.range(1).select(rows)
    none = F.lit(None).cast(cells.schema[value].dataType)
    before = F.concat(F.array(F.lit(-1)), F.slice(F.col("_m")["c"], F.lit(1), F.size("_m") - 1))
    filled = F.zip_with(
        before, "_m", lambda p, e: F.concat(F.array_repeat(none, e["c"] - p - 1), F.array(e["_v"]))
    )
    rest = F.array_repeat(none, grid.ncols - 1 - F.element_at("_m", -1)["c"])
    dense = F.concat(F.flatten(filled), rest)
    return domain.join(lines, [*keys, "row"], "left").select(
        *keys, "row", F.coalesce(dense, F.array_repeat(none, grid.ncols)).alias("line")
    )


def pivot_by_date(df: DataFrame, value: str, dates: Sequence[str], prefix: str = "") -> DataFrame:
    """One column per listed date; the dates are given, so no extra pass finds them."""
    named = df.withColumn("_d", F.date_format("date", "yyyy-MM-dd"))
    wide = named.groupBy("x", "y").pivot("_d", list(dates)).agg(F.first(value, ignorenulls=True))
    return wide.select("x", "y", *[F.col(f"`{d}`").alias(prefix + d.replace("-", "_")) for d in dates])
