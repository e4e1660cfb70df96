"""Aggregations over pixel tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.ranks import exact_quantiles, in_ranges, merged_values, quantiles_of, rank_in_ranges
from firnline.session import checkpointed


def share(condition: Column) -> Column:
    """Fraction of rows that meet a condition (NULL counts as not met)."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def missing_share(df: DataFrame, value: str = "opt_value", by: str = "date") -> DataFrame:
    return df.groupBy(by).agg(
        ((F.count("*") - F.count(value)) / F.count("*")).alias("missing_share")
    )


def bad_dates(
    missing: DataFrame, threshold: float, keep: Column, manual: Sequence[str] = ()
) -> DataFrame:
    """Dates with too large a missing share (while ``keep`` holds) and dates named by hand."""
    found = missing.where((F.col("missing_share") > threshold) & keep).select("date")
    if manual:
        named = found.sparkSession.range(1).select(
            F.explode(F.array(*[F.lit(d).cast("date") for d in manual])).alias("date")
        )
        found = found.union(named)
    return found.distinct()


def describe(df: DataFrame, value: str) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact quartiles."""
    quartiles = exact_quantiles(df, value, (0.25, 0.5, 0.75)).select("q").scalar()
    return df.agg(
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    ).select(
        "*", quartiles[0].alias("q25"), quartiles[1].alias("q50"), quartiles[2].alias("q75")
    )


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def majority(df: DataFrame, value: str) -> Column:
    """Most frequent value; ties go to the smallest. Counts are aggregated first."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"))
    return counts.agg(F.max_by(value, F.struct("n", (-F.col(value)).alias("v")))).scalar()


def daily_mean(series: DataFrame, value: str = "value", by: Sequence[str] = ()) -> DataFrame:
    return series.groupBy(*by, F.to_date("ts").alias("date")).agg(F.avg(value).alias(value))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each key, counted through the groups."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates")
    )


def correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson coefficients of all pairs in one pass, each on its complete rows; long form."""
    pairs = list(combinations(columns, 2))
    one = df.agg(*[F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(
        *[
            F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"))
            for i, (a, b) in enumerate(pairs)
        ]
    )
    return one.select(F.inline(rows))


def scene_metadata(df: DataFrame, value: str) -> DataFrame:
    """Shape, extent, resolution and value summary of each scene."""
    return df.groupBy("date").agg(
        F.countDistinct("x").alias("width"),
        F.countDistinct("y").alias("height"),
        F.min("x").alias("xmin"),
        F.max("x").alias("xmax"),
        F.min("y").alias("ymin"),
        F.max("y").alias("ymax"),
        F.sum(value).alias("total"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    ).withColumn("resolution", (F.col("xmax") - F.col("xmin")) / (F.col("width") - 1))


def scenes_off_contract(metadata: DataFrame, **expected: float) -> DataFrame:
    """Scenes whose shape or extent differs from the expected values."""
    off = reduce(
        lambda a, b: a | b, [~F.col(k).eqNullSafe(F.lit(v)) for k, v in expected.items()]
    )
    return metadata.where(off)


def box_plot(df: DataFrame, value: str, by: str) -> DataFrame:
    """Quartiles and whiskers: the most extreme values within 1.5 interquartile ranges.

    Any number of categories, of any size: quartiles come from the distributed ranking, and the limits go
    to the values by (category, range), so neither a hot category nor a list of all meets one task.
    """
    cut, offsets = in_ranges(merged_values(df, value, by), by)
    boxes = checkpointed(quantiles_of(rank_in_ranges(cut, offsets, by), (0.25, 0.5, 0.75), by))
    q1, q3 = F.col("q")[0], F.col("q")[2]
    fence = 1.5 * (q3 - q1)
    limits = offsets.select(by, "_range").join(
        boxes.select(by, (q1 - fence).alias("_lo"), (q3 + fence).alias("_hi")), by
    )
    v = F.col("v")
    whiskers = (
        cut.join(limits, [by, "_range"])
        .groupBy(by)
        .agg(
            F.min(F.when(v >= F.col("_lo"), v)).alias("whisker_low"),
            F.max(F.when(v <= F.col("_hi"), v)).alias("whisker_high"),
        )
    )
    return boxes.join(whiskers, by).select(
        by,
        F.col("n").alias("n_values"),
        F.col("q")[0].alias("q1"),
        F.col("q")[1].alias("median"),
        F.col("q")[2].alias("q3"),
        "whisker_low",
        "whisker_high",
    )
