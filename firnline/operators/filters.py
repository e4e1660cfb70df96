"""Row and column selection on pixel tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.functions.scalars import BOUNDARY_Y, NORTH_ROWS, scaled_y
from firnline.operators.bounded import dates_of

FORBIDDEN_FEATURES = ("row", "col", "date", "opt_value")


def feature_columns(columns: Iterable[str], target: str = "opt_value", with_xy: bool = True) -> list[str]:
    drop = {target} | (set() if with_xy else {"x", "y"})
    return [c for c in columns if c not in drop]


def check_features(columns: Iterable[str]) -> list[str]:
    """Reject identifiers and the target as features before anything is planned."""
    columns = list(columns)
    bad = [c for c in columns if c in FORBIDDEN_FEATURES]
    if bad:
        raise ValueError(f"not allowed as features: {', '.join(bad)}")
    return columns


def without_clouds(df: DataFrame, value: str = "opt_value") -> DataFrame:
    return df.where(F.col(value).isNotNull())


def without_water(df: DataFrame, value: str = "mw_value") -> DataFrame:
    return df.where(F.col(value) != -1)


def upper_half(df: DataFrame, scaled: bool = False) -> DataFrame:
    """North of the training boundary, for raw metres or for the scaled y."""
    return df.where(F.col("y") > (scaled_y(BOUNDARY_Y) if scaled else BOUNDARY_Y))


def with_region(df: DataFrame, boundary: int = NORTH_ROWS) -> DataFrame:
    return df.withColumn("region", F.when(F.col("row") < boundary, "North").otherwise("South"))


def bounds(df: DataFrame) -> Column:
    """Extent of a layer as a scalar (one row, computed once, no join)."""
    return df.agg(
        F.struct(
            F.min("x").alias("xmin"),
            F.max("x").alias("xmax"),
            F.min("y").alias("ymin"),
            F.max("y").alias("ymax"),
        )
    ).scalar()


def crop_to(df: DataFrame, other: DataFrame) -> DataFrame:
    """Drop what lies east or south of the other layer."""
    box = bounds(other)
    return df.where((F.col("x") <= box["xmax"]) & (F.col("y") >= box["ymin"]))


def overlap(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both layers cut to their common rectangle."""
    a, b = bounds(left), bounds(right)
    inside = (
        F.col("x").between(F.greatest(a["xmin"], b["xmin"]), F.least(a["xmax"], b["xmax"]))
        & F.col("y").between(F.greatest(a["ymin"], b["ymin"]), F.least(a["ymax"], b["ymax"]))
    )
    return left.where(inside), right.where(inside)


def window_slice(df: DataFrame, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """Half-open row and column ranges, as in array slicing."""
    r, c = F.col("row"), F.col("col")
    return df.where((r >= rows[0]) & (r < rows[1]) & (c >= cols[0]) & (c < cols[1]))


def keyed_sample(df: DataFrame, keys: Sequence[str], fraction: float, seed: int = 1) -> DataFrame:
    """Rows whose key hash falls below the fraction: the same rows for any partitioning."""
    text = F.concat_ws(",", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    bucket = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return df.where(bucket < int(fraction * 2**32))


def days_per_month(df: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """All pixels of k existing days per calendar month, days picked by hash order.

    The days are ranked on the distinct dates only; pixels are kept by a semi join.
    """
    month = F.date_format("date", "yyyy-MM")
    pick = F.md5(F.concat_ws(",", F.lit(str(seed)), F.date_format("date", "yyyy-MM-dd")))
    days = df.select("date").distinct().select("date", month.alias("month"), pick.alias("pick"))
    chosen = days.groupBy("month").agg(F.sort_array(F.collect_list(F.struct("pick", "date"))).alias("d"))
    dates = chosen.select(F.explode(F.slice("d", 1, k)["date"]).alias("date"))
    return df.join(dates_of(dates), "date", "left_semi")


def static_and_dynamic(
    df: DataFrame, static: Sequence[str], dynamic: Sequence[str], day: str, date_from: str, date_to: str
) -> tuple[DataFrame, DataFrame]:
    """Static columns of a single day, dynamic columns of a range of days."""
    one = df.where(F.col("date") == F.lit(day).cast("date")).select("x", "y", *static)
    many = df.where(
        F.col("date").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))
    ).select("x", "y", "date", *dynamic)
    return one, many
