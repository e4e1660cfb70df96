"""Binned error statistics and histograms. Bin numbers are arithmetic on scalar bounds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.bounded import at_most


def _range(df: DataFrame, *values: str) -> Column:
    lows = [F.min(v) for v in values]
    highs = [F.max(v) for v in values]
    lo = lows[0] if len(values) == 1 else F.least(*lows)
    hi = highs[0] if len(values) == 1 else F.greatest(*highs)
    return df.agg(F.struct(lo.alias("lo"), hi.alias("hi")).alias("r")).scalar()


def right_closed(value: Column, lo: Column, width: Column) -> Column:
    """Bin number for intervals (lo + i w, lo + (i + 1) w]; the minimum itself is NULL."""
    return F.when(value > lo, (F.ceil((value - lo) / width) - 1).cast("int"))


def last_closed(value: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Bin number for ``bins`` equal left-closed bins, the last one closed on both sides."""
    i = F.floor((value - lo) / (hi - lo) * bins)
    return F.when(value.between(lo, hi), F.least(i, F.lit(bins - 1)).cast("int"))


def error_by_value(df: DataFrame, value: str, error: str, width: float = 0.1) -> DataFrame:
    """Mean error and count per right-closed bin of the real value; empty bins stay visible."""
    r = _range(df, value)
    binned = (
        df.where(F.col(value).isNotNull())
        .groupBy(right_closed(F.col(value), r["lo"], F.lit(width)).alias("bin"))
        .agg(F.avg(error).alias("mean_error"), F.count("*").alias("n"))
    )
    last = (F.ceil((r["hi"] - r["lo"]) / width) - 1).cast("int")
    labels = df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(0), last)).alias("bin"))
    return labels.join(binned, "bin", "left").select(
        "bin",
        (F.lit(width / 2) + F.col("bin") * width).alias("label"),
        "mean_error",
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def error_grid(df: DataFrame, value: str, predicted: str, error: str, bins: int = 100) -> DataFrame:
    """Mean error per cell of a bins x bins grid whose edges both axes share."""
    r = _range(df, value, predicted)
    width = (r["hi"] - r["lo"]) / bins
    return (
        df.where((F.col(value) > r["lo"]) & (F.col(predicted) > r["lo"]))
        .select(
            F.least(right_closed(F.col(value), r["lo"], width), F.lit(bins - 1)).alias("real_bin"),
            F.least(right_closed(F.col(predicted), r["lo"], width), F.lit(bins - 1)).alias("pred_bin"),
            F.col(error).alias("_e"),
        )
        .groupBy("real_bin", "pred_bin")
        .agg(F.avg("_e").alias("mean_error"), F.count("*").alias("n"))
    )


def fixed_mean(value: str, digits: int = 6) -> Column:
    """The mean of values of at most ``digits`` decimals, exact and then rounded half up to as many: integers
    are summed and divided, so neither the order of the rows nor a tie between two digits matters."""
    scale = 10**digits
    total, n = F.sum(F.round(F.col(value) * scale).cast("long")), F.count(value)
    twice, whole = 2 * total + n, 2 * n
    return ((twice - F.pmod(twice, whole)) / whole) / F.lit(float(scale))


def prediction_by_value(
    df: DataFrame, value: str, predicted: str, width: float = 0.25, digits: int | None = None
) -> DataFrame:
    """Average prediction per left-closed bin of the real value; with ``digits`` the exact mean of
    predictions that are rounded to as many decimals."""
    r = _range(df, value)
    mean = F.avg(predicted) if digits is None else fixed_mean(predicted, digits)
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(F.floor((F.col(value) - r["lo"]) / width).cast("int").alias("bin"))
        .agg(mean.alias("mean_prediction"), F.count("*").alias("n"))
    )


def density(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Per row the two-dimensional density of its bin (counts / (n * bin area)).

    Equal (x-bin, y-bin) rows are counted first; the counts, at most bins^2 rows, are joined back.
    """
    rx, ry = _range(df, x), _range(df, y)
    binned = df.select(
        "*",
        last_closed(F.col(x), rx["lo"], rx["hi"], bins).alias("bin_x"),
        last_closed(F.col(y), ry["lo"], ry["hi"], bins).alias("bin_y"),
    )
    counts = binned.groupBy("bin_x", "bin_y").agg(F.count("*").alias("_n"))
    area = (rx["hi"] - rx["lo"]) / bins * ((ry["hi"] - ry["lo"]) / bins)
    total = df.agg(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1))).scalar()
    return binned.join(at_most(counts, bins * bins), ["bin_x", "bin_y"]).select(
        *df.columns, "bin_x", "bin_y", (F.col("_n") / (total * area)).alias("density")
    )


def unpivot(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value) rows of several columns in one pass, missing values dropped."""
    doubles = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    long = doubles.unpivot([], list(columns), "feature", "value")
    return long.where(F.col("value").isNotNull())


def histograms(df: DataFrame, columns: Sequence[str], bins: int = 100) -> DataFrame:
    """Equal-width histograms of several columns: one pass for all bounds, one for all counts."""
    fields = [F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns]
    limits = df.agg(F.struct(*fields)).scalar()
    long = unpivot(df, columns)
    lo, hi = F.lit(None).cast("double"), F.lit(None).cast("double")
    for c in columns:
        lo = F.when(F.col("feature") == c, limits[c]["lo"]).otherwise(lo)
        hi = F.when(F.col("feature") == c, limits[c]["hi"]).otherwise(hi)
    bounded = long.select("feature", "value", lo.alias("lo"), hi.alias("hi"))
    return (
        bounded.groupBy(
            "feature", last_closed(F.col("value"), F.col("lo"), F.col("hi"), bins).alias("bin"), "lo", "hi"
        )
        .agg(F.count("*").alias("n"))
        .select(
            "feature",
            "bin",
            (F.col("lo") + F.col("bin") * (F.col("hi") - F.col("lo")) / bins).alias("left_edge"),
            ((F.col("hi") - F.col("lo")) / bins).alias("width"),
            "n",
        )
    )


def with_density(hist: DataFrame) -> DataFrame:
    """Histogram normalised to area one per feature (one total per listed column)."""
    totals = hist.groupBy("feature").agg(F.sum("n").alias("_t"))
    return hist.join(F.broadcast(totals), "feature").select(
        *hist.columns, (F.col("n") / (F.col("_t") * F.col("width"))).alias("density")
    )


def log_spaced_histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in bins with log-spaced edges; positive values inside [low, high] only."""
    from math import log10

    span = log10(high) - log10(low)
    v = F.col(value)
    i = F.floor((F.log10(v) - log10(low)) / span * bins)
    return (
        df.where(v.between(low, high))
        .groupBy(F.least(i, F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count("*").alias("n"))
    )
