"""Feature build: from plain pixels and static cells to the extended pixel table.

Two shuffles of the pixels in total: by (day, band of lines) for the focal windows and by cell
for the history windows. The static layer is joined after the second one, on the same key and in
the same order, so only the static layer moves. Daylight is arithmetic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.daylight import hours_of_daylight
from firnline.functions.projection import latitude
from firnline.functions.scalars import cap
from firnline.operators.distance import distance_to_margin
from firnline.operators.filters import without_water
from firnline.operators.focal import focal, melt_for_windows
from firnline.operators.temporal import earlier_values
from firnline.operators.terrain import slope_and_aspect

FOCAL_FEATURES = {"mean_3": (3, "mean"), "mean_9": (9, "mean"), "sum_5": (5, "sum")}
EXTENDED = [
    "x",
    "y",
    "mw_value",
    "opt_value",
    "date",
    "col",
    "row",
    "mean_3",
    "mean_9",
    "sum_5",
    "mw_value_yesterday",
    "mw_value_7_day_average",
    "hours_of_daylight",
    "elevation_data",
    "slope_data",
    "aspect_data",
    "distance_to_margin",
]


def static_layer(cells: DataFrame, step: float = 1000.0) -> DataFrame:
    """Terrain and distance per cell; depends on no scene, so it is computed once per run."""
    terrain = slope_and_aspect(cells, step=step)
    distance = distance_to_margin(cells)
    return terrain.join(distance, ["row", "col"]).select(
        "x", "y", "col", "row", "elevation_data", "slope_data", "aspect_data", "distance_to_margin"
    )


def dynamic_features(
    pixels: DataFrame,
    scenes: DataFrame | None = None,
    daylight: str = "reference",
    only: Sequence | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Focal, history and daylight features of the ice pixels.

    ``only`` limits the output to some dates; history is then taken first, over all given
    pixels, and the focal windows run on the wanted dates alone.
    """
    capped = pixels.select(
        "x", "y", "date", "col", "row", "mw_value", cap(F.col("opt_value")).alias("opt_value")
    )
    melt = melt_for_windows(F.col("mw_value"))
    cell = ("x", "y") if tasks is None else ("col", "row")
    calendar = pixels if scenes is None else scenes
    if only is None:
        around = without_water(focal(capped, melt, FOCAL_FEATURES, tasks=tasks))
        out = earlier_values(around, scenes=calendar, tasks=tasks, cell=cell)
    else:
        wanted = earlier_values(capped, scenes=calendar, tasks=tasks, cell=cell).where(F.col("date").isin(list(only)))
        out = without_water(focal(wanted, melt, FOCAL_FEATURES, tasks=tasks))
    return out.withColumn(
        "hours_of_daylight",
        hours_of_daylight(latitude(F.col("x"), F.col("y")), F.dayofyear("date"), daylight),
    )


def build_features(
    pixels: DataFrame,
    static: DataFrame,
    scenes: DataFrame | None = None,
    daylight: str = "reference",
    only: Sequence | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """The extended pixel table; ``tasks`` is the number of tasks of each shuffle of the pixels."""
    dynamic = dynamic_features(pixels, scenes, daylight, only, tasks)
    on, other = (["x", "y"], ["col", "row"]) if tasks is None else (["col", "row"], ["x", "y"])
    return dynamic.join(static.drop(*other), on, "left").select(EXTENDED)
