"""Scaling, recoding and error expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published bounds of the features, (low, high).
FEATURE_BOUNDS: dict[str, tuple[float, float]] = {
    "x": (-636500.0, 824500.0),
    "y": (-3324500.0, -662500.0),
    "mean_3": (0.0, 1.0),
    "mean_9": (0.0, 1.0),
    "sum_5": (0.0, 25.0),
    "mw_value_7_day_average": (0.0, 1.0),
    "hours_of_daylight": (0.0, 24.0),
    "slope_data": (0.0, 90.0),
    "aspect_data": (-1.0, 1.0),
    "elevation_data": (0.0, 3694.0),
    "distance_to_margin": (1.0, 500.0),
}
# Optical melt threshold, outlier cap and half-grid boundary.
MELT_THRESHOLD = 0.64
OUTLIER_CAP = 5.0
BOUNDARY_Y = -2000000.0
NORTH_ROWS = 1338


def scale(feature: str) -> Column:
    low, high = FEATURE_BOUNDS[feature]
    return (F.col(feature) - low) / (high - low)


def unscale(value: Column, feature: str) -> Column:
    low, high = FEATURE_BOUNDS[feature]
    return value * (high - low) + low


def normalise(df: DataFrame, target: str | None = "opt_value") -> DataFrame:
    """Fixed-bounds scaling of the known features and ``ln(1 + target)``, in one projection."""
    out = []
    for c in df.columns:
        if c in FEATURE_BOUNDS:
            out.append(scale(c).alias(c))
        elif c == target:
            out.append(F.log1p(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def scaled_y(y: float) -> float:
    low, high = FEATURE_BOUNDS["y"]
    return (y - low) / (high - low)


def cap(value: Column, limit: float = OUTLIER_CAP) -> Column:
    """Values above the limit become the limit; NULL stays NULL (``least`` would not)."""
    return F.when(value > limit, F.lit(float(limit))).otherwise(value)


def melt_label(value: Column, threshold: float = MELT_THRESHOLD) -> Column:
    return F.when(value >= threshold, 1).otherwise(0)


def z_scores(df: DataFrame, value: str) -> DataFrame:
    """Raw and log standard scores with the sample deviation, as two new columns."""
    log = F.log1p(value)
    stats = df.agg(
        F.struct(
            F.avg(value).alias("m"),
            F.stddev_samp(value).alias("s"),
            F.avg(log).alias("lm"),
            F.stddev_samp(log).alias("ls"),
        )
    ).scalar()
    return df.select(
        "*",
        ((F.col(value) - stats["m"]) / stats["s"]).alias("z"),
        ((log - stats["lm"]) / stats["ls"]).alias("z_log"),
    )


def mask_at_most(value: Column, limit: float) -> Column:
    """NULL where value <= limit."""
    return F.when(value > limit, value)


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(predicted - actual)


def residual(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def euclidean(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.sqrt((x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2))
