"""Statistics that need the whole sample in order, without one ordered global window.

Equal values are merged into (value, count). The merged rows are range-partitioned, by category first where there
is one, so a category that holds most rows is cut into many ranges and many small ones share a range. A window
ranks inside a (category, range), and the size of the category's earlier ranges is joined by the same two keys: one
row for each of them, never collected. The result does not depend on where the cuts fall.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.functions import normal
from firnline.operators.bounded import tasks_for
from firnline.session import checkpointed

CHUNK = 1 << 16  # rows one value is expanded to at once
RANGE_ROWS = 1_000_000
LEAST_RANGES = 8


@dataclass(frozen=True)
class Moments:
    n: int
    mean: float
    std: float  # sample deviation
    low: float
    high: float


def merged_values(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """``v, n`` (and the category): every distinct value once, with its count. Rows without a
    value or a category are left out.

    Written to the checkpoint directory: the steps below read it several times, and what comes
    before it may be a long pipeline.
    """
    keys = [by] if by else []
    return checkpointed(
        df.dropna(subset=[value, *keys])
        .groupBy(*keys, F.col(value).cast("double").alias("v"))
        .agg(F.count("*").alias("n"))
    )


def moments(merged: DataFrame) -> Moments:
    """Size, mean, deviation and range from merged values (deviations around the mean)."""
    one = merged.agg(
        F.sum("n").alias("n"),
        (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"),
        F.min("v").alias("low"),
        F.max("v").alias("high"),
    ).first()
    d = F.col("v") - F.lit(one["mean"])
    squares = merged.agg(F.sum(d * d * F.col("n"))).first()[0]
    return Moments(one["n"], one["mean"], (squares / (one["n"] - 1)) ** 0.5, one["low"], one["high"])


def value_ranks(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """One row per distinct value: ``v``, ``n`` and its 1-based ranks ``lo..hi``.

    ``by`` names a categorical column, of any number of values; ranks then count within each category.
    """
    return rank_merged(merged_values(df, value, by), by)


def in_ranges(merged: DataFrame, by: str | None = None, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Merged values with the ``_range`` they are in, and for each (category and) range ``_offset``, the size
    of the earlier ones, and ``_total``, that of all. The number of ranges follows the number of values.
    Both are checkpointed: every use and every retried task sees the same ranges."""
    keys = [by] if by else []
    ranges = int(max(LEAST_RANGES, merged.count() // range_rows))
    cut = checkpointed(merged.repartitionByRange(ranges, *keys, "v").withColumn("_range", F.spark_partition_id()))
    sizes = cut.groupBy(*keys, "_range").agg(F.sum("n").alias("_m"))
    whole = W.partitionBy(*keys)
    earlier = whole.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *keys,
        "_range",
        F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_m").over(whole).alias("_total"),
    )
    return cut, checkpointed(offsets)


def rank_in_ranges(cut: DataFrame, offsets: DataFrame, by: str | None = None) -> DataFrame:
    """``v, n, lo, hi`` and ``_total``, the size of the whole category."""
    keys = [by] if by else []
    inside = W.partitionBy(*keys, "_range").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    counted = cut.withColumn("_upto", F.sum("n").over(inside)).join(offsets, [*keys, "_range"])
    hi = F.col("_upto") + F.col("_offset")
    return counted.select(*keys, "v", "n", (hi - F.col("n") + 1).alias("lo"), hi.alias("hi"), "_total")


def rank_merged(merged: DataFrame, by: str | None = None, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Ranks of merged values: cut, rank inside each range, add the size of the earlier ranges."""
    return rank_in_ranges(*in_ranges(merged, by, range_rows), by).drop("_total")


def exact_quantiles(
    df: DataFrame, value: str, fractions: Sequence[float], by: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation as an array ``q``, and the count ``n``.

    ``percentile`` would keep every distinct value of a group in one task; here only the values
    at the wanted ranks survive the distributed ranking.
    """
    return quantiles_of(rank_in_ranges(*in_ranges(merged_values(df, value, by), by), by), fractions, by)


def quantiles_of(placed: DataFrame, fractions: Sequence[float], by: str | None = None) -> DataFrame:
    """The quantiles of values ranked by ``rank_in_ranges``."""
    keys = [by] if by else []
    wanted = []
    for k, p in enumerate(fractions):
        at = (F.col("_total") - 1) * F.lit(float(p))
        for name, rank in ((f"_l{k}", F.floor(at) + 1), (f"_u{k}", F.ceil(at) + 1)):
            wanted.append(F.max(F.when(rank.between(F.col("lo"), F.col("hi")), F.col("v"))).alias(name))
    one = placed.groupBy(*keys).agg(F.max("_total").alias("n"), *wanted)
    q = []
    for k, p in enumerate(fractions):
        at = (F.col("n") - 1) * F.lit(float(p))
        low, high = F.col(f"_l{k}"), F.col(f"_u{k}")
        q.append(low + (high - low) * (at - F.floor(at)))
    return one.select(*keys, "n", F.array(*q).alias("q"))


def ordered_sample(ranked: DataFrame, rows: int | None = None) -> DataFrame:
    """The order statistics ``(i, v)``, ``rows`` of them (counted if not given). A value that repeats many times is expanded in chunks
    that are spread over tasks, so a hot value is no hot task. The number of tasks is given: the engine would
    join them into one by the few bytes that the chunks have before they are expanded."""
    if rows is None:
        rows = ranked.agg(F.sum("n")).first()[0] or 0
    chunks = ranked.select(
        "v", "lo", "hi", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / CHUNK))).alias("k")
    )
    spread = chunks.repartition(tasks_for(rows), "v", "k")
    start = F.col("lo") + F.col("k") * CHUNK
    return spread.select(
        "v", F.explode(F.sequence(start, F.least(start + (CHUNK - 1), F.col("hi")))).alias("i")
    )


def filliben_share(i: Column, n: Column) -> Column:
    """Probability of the i-th order statistic of n."""
    last = F.pow(F.lit(0.5), 1.0 / n)
    return F.when(i == n, last).when(i == 1, 1.0 - last).otherwise((i - 0.3175) / (n + 0.365))


def qq_points(df: DataFrame, value: str) -> DataFrame:
    """Normal Q-Q points: rank, theoretical quantile, ordered value."""
    merged = merged_values(df, value)
    n = merged.agg(F.sum("n")).first()[0]
    placed = ordered_sample(rank_merged(merged), n or 0).withColumn("p", filliben_share(F.col("i"), F.lit(n)))
    return normal.with_inverse(placed, "p", "theoretical").select("i", "theoretical", F.col("v").alias("ordered"))


def qq_fit(df: DataFrame, value: str) -> DataFrame:
    """Least-squares line through the Q-Q points and their correlation."""
    return qq_points(df, value).agg(
        F.regr_slope("ordered", "theoretical").alias("slope"),
        F.regr_intercept("ordered", "theoretical").alias("intercept"),
        F.corr("ordered", "theoretical").alias("r"),
        F.count("*").alias("n"),
    )


def anderson_darling(df: DataFrame, value: str) -> DataFrame:
    """Anderson-Darling statistic for a normal law with estimated mean and deviation.

    The sums over equal values are closed forms of their rank range, so no value is expanded.
    """
    merged = merged_values(df, value)
    stats = moments(merged)
    n = F.lit(float(stats.n))
    z = (F.col("v") - stats.mean) / stats.std
    count, span = F.col("n").cast("double"), (F.col("lo") + F.col("hi")).cast("double")
    up = span * count - count
    down = (2 * n + 1) * count - span * count
    term = up * normal.log_cdf(z) + down * normal.log_cdf(-z)
    total = rank_merged(merged).agg(F.sum(term).alias("t"), F.sum("n").alias("n"))
    size = F.col("n").cast("double")
    return total.select("n", (-size - F.col("t") / size).alias("statistic"))


def kernel_density(df: DataFrame, value: str, points: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on an even grid with Scott's bandwidth.

    Bandwidth and range come from the merged values; then every task adds up the
    kernels of its own batches and only its ``points`` partial sums are shuffled.
    """
    merged = merged_values(df, value)
    s = moments(merged)
    width = s.std * s.n**-0.2
    low, high = s.low - cut * width, s.high + cut * width
    step = (high - low) / (points - 1)
    grid = low + step * np.arange(points)
    norm = 1.0 / (s.n * width * np.sqrt(2 * np.pi))

    def partial(batches):
        total = np.zeros(points)
        for batch in batches:
            v, c = batch["v"].to_numpy(), batch["n"].to_numpy(float)
            for lo in range(0, len(v), 2048):
                part = (grid[:, None] - v[None, lo : lo + 2048]) / width
                total += np.exp(-0.5 * part * part) @ c[lo : lo + 2048]
        yield pd.DataFrame({"i": np.arange(points, dtype="int32"), "part": total})

    sums = merged.mapInPandas(partial, "i int, part double").groupBy("i").agg(F.sum("part").alias("t"))
    return sums.select(
        (F.lit(float(low)) + F.col("i") * float(step)).alias("point"), (F.col("t") * float(norm)).alias("density")
    )
