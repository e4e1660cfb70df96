"""Melt masks: cells that never melt or melt on few days, and their use as filters.

All masks come from one aggregation per (cell, year); no join chain over days is needed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from firnline.operators.bounded import per_date

CELL = ["x", "y"]


def never_melting(pixels: DataFrame, per: Sequence[str] = ()) -> DataFrame:
    """Cells that are neither -1 nor 1 on any scene (of each group ``per``).

    A cell must be present on every scene of the group, as an inner join over days requires;
    the number of scenes enters through a join with the small (group, count) table.
    """
    days = pixels.select(*per, "date").distinct().groupBy(*per).agg(F.count("*").alias("n_days"))
    quiet = pixels.groupBy(*per, *CELL).agg(
        F.count_if(~F.coalesce("mw_value", F.lit(0)).isin(-1, 1)).alias("n_quiet")
    )
    if per:
        # scenes per group: never more rows than there are scene dates
        return quiet.join(per_date(days), list(per)).where("n_quiet = n_days").select(*per, *CELL)
    return quiet.where(F.col("n_quiet") == days.select("n_days").scalar()).select(*CELL)


def never_melting_by_year(pixels: DataFrame) -> DataFrame:
    """Separate mode: the never-melting cells of each year."""
    return never_melting(pixels.withColumn("year", F.year("date")), ["year"])


def never_melting_cumulative(pixels: DataFrame) -> DataFrame:
    """Year k keeps the cells that never melt in any year up to k.

    A cell qualifies in year k if it qualified in as many years <= k as there are such years.
    """
    yearly = never_melting_by_year(pixels)
    years = pixels.select(F.year("date").alias("year")).distinct()
    ranks = years.select(
        "year", F.array_position(years.agg(F.array_sort(F.collect_list("year"))).scalar(), F.col("year")).alias("k")
    )
    so_far = W.partitionBy(*CELL).orderBy("year").rowsBetween(W.unboundedPreceding, 0)
    return (
        yearly.withColumn("hits", F.count("*").over(so_far))
        .join(per_date(ranks), "year")
        .where("hits = k")
        .select("year", *CELL)
    )


def melt_days(pixels: DataFrame) -> DataFrame:
    """Melt days per cell and year."""
    return (
        pixels.where("mw_value = 1")
        .groupBy(*CELL, F.year("date").alias("year"))
        .agg(F.count("*").alias("counts"))
    )


def melt_days_rollup(pixels: DataFrame) -> DataFrame:
    """Per (cell, year) and per cell in one pass; year is NULL on the totals."""
    year = pixels.where("mw_value = 1").select(*CELL, F.year("date").alias("year"))
    return year.groupingSets(
        [[F.col("x"), F.col("y"), F.col("year")], [F.col("x"), F.col("y")]],
        F.col("x"),
        F.col("y"),
        F.col("year"),
    ).agg(F.count("*").alias("counts"))


def total_melt_days(counts: DataFrame) -> DataFrame:
    return counts.groupBy(*CELL).agg(F.sum("counts").alias("counts"))


def membership_mask(cells: DataFrame, subset: DataFrame) -> DataFrame:
    """melt = 0 for cells in the set, 1 for the others."""
    flag = subset.select(*CELL).distinct().withColumn("_in", F.lit(1))
    return cells.select(*CELL).join(flag, CELL, "left").select(
        *CELL, F.when(F.col("_in").isNull(), 1).otherwise(0).alias("melt")
    )


def inverse_set(cells: DataFrame, subset: DataFrame) -> DataFrame:
    return cells.select(*CELL).join(subset, CELL, "left_anti")


def combined_mask(pixels: DataFrame, few: Sequence[int] = (2, 3), cell: Sequence[str] = CELL) -> DataFrame:
    """Both masks in one aggregation over the ice pixels: melt = 0 for cells that never melt or
    melt on ``few`` days in total, else 1."""
    ice = pixels.where("mw_value <> -1")
    days = F.count_if(F.col("mw_value") == 1)
    counted = ice.groupBy(*cell).agg(days.alias("n"))
    return counted.select(*cell, F.when(F.col("n").isin(0, *few), 0).otherwise(1).alias("melt"))


def apply_masks(
    df: DataFrame,
    no_melt: DataFrame | None = None,
    little_melt: DataFrame | None = None,
    drop_clouds: bool = True,
    cell: Sequence[str] = CELL,
) -> DataFrame:
    """Keep pixels whose cell has melt = 1 in every given mask.

    One combined mask is joined once on ``cell``. Where the per-cell windows used the same columns, rows
    keep that partitioning, so the join costs no shuffle of the pixels; a mask small enough is broadcast by
    the engine after it has measured it.
    """
    if drop_clouds:
        df = df.where(F.col("opt_value").isNotNull())
    on = list(cell)
    masks = [m.where("melt = 1").select(*on) for m in (no_melt, little_melt) if m is not None]
    if not masks:
        return df
    keep = masks[0] if len(masks) == 1 else masks[0].join(masks[1], on, "left_semi")
    return df.join(keep, on, "left_semi")


def counts_with_never(no_melt: DataFrame, counts: DataFrame, at_most: int | None = 3) -> DataFrame:
    """Full outer join of the never-melting set with the counts; a missing count is 0."""
    both = no_melt.select(*CELL).join(counts.select(*CELL, "counts"), CELL, "full_outer")
    both = both.select(*CELL, F.coalesce("counts", F.lit(0)).alias("counts"))
    return both if at_most is None else both.where(F.col("counts") <= at_most)
