"""Moving-window statistics on daily rasters.

A k x k window is separable: a sliding frame along each raster line, then one along each column.
Rows are shuffled once, by day and band of lines; the few lines next to a band edge are sent to
both bands, so both passes run inside the same partition. A band is the unit of work, and
therefore neither a day nor a column has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.operators.bounded import shuffled

STATISTICS = ("mean", "sum", "count", "min", "max")


def focal(
    pixels: DataFrame,
    value: Column,
    outputs: Mapping[str, tuple[int, str]],
    scene: str = "date",
    band_lines: int = 64,
    tasks: int | None = None,
) -> DataFrame:
    """Add focal statistics of ``value`` (missing = NULL).

    ``outputs`` maps a new column to (odd window size, statistic). Cells outside the raster and
    missing cells do not count; a window without any value gives NULL (``count`` gives 0). ``tasks``
    is the number of tasks of the shuffle.
    """
    for name, (size, stat) in outputs.items():
        if size % 2 == 0 or stat not in STATISTICS:
            raise ValueError(f"{name}: odd window size and one of {STATISTICS} expected")
    reach = max(size // 2 for size, _ in outputs.values())
    band_lines = max(band_lines, reach + 1)
    row = F.col("row")
    bands = F.sequence(
        F.greatest(F.floor((row - reach) / band_lines), F.lit(0)), F.floor((row + reach) / band_lines)
    )
    own = F.floor(row / band_lines)
    banded = pixels.select("*", value.alias("_v"), F.explode(bands).alias("_band"))
    spread = shuffled(banded.withColumn("_own", F.col("_band") == own), tasks, scene, "_band")

    parts: dict[str, tuple[int, str]] = {}
    for size, stat in outputs.values():
        for part in ("sum", "count") if stat in ("mean", "sum") else (stat,):
            parts[f"_{part}_{size // 2}"] = (size // 2, part)

    along = W.partitionBy(scene, "_band", "row").orderBy("col")
    down = W.partitionBy(scene, "_band", "col").orderBy("row")
    first = {
        n: getattr(F, p)("_v").over(along.rangeBetween(-h, h)) for n, (h, p) in parts.items()
    }
    second = {
        n: (F.sum(n) if p in ("sum", "count") else getattr(F, p)(n)).over(down.rangeBetween(-h, h))
        for n, (h, p) in parts.items()
    }
    passed = spread.select("*", *[c.alias(n) for n, c in first.items()])
    passed = passed.select(
        *pixels.columns, "_own", *[c.alias(n) for n, c in second.items()]
    ).where("_own")

    def result(size: int, stat: str) -> Column:
        h = size // 2
        if stat == "mean":
            return F.when(F.col(f"_count_{h}") > 0, F.col(f"_sum_{h}") / F.col(f"_count_{h}"))
        if stat == "sum":
            return F.when(F.col(f"_count_{h}") > 0, F.col(f"_sum_{h}"))
        return F.col(f"_{stat}_{h}")

    return passed.select(*pixels.columns, *[result(*spec).alias(n) for n, spec in outputs.items()])


def melt_for_windows(value: Column) -> Column:
    """Melt flag with water and missing cells as NULL."""
    return F.when(value != -1, value.cast("long"))
