"""Pixel tables on storage: partitioned by date, pruned by date, one file pair per day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PLAIN_SCHEMA = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("mw_value", T.ByteType()),
        T.StructField("opt_value", T.DoubleType()),
        T.StructField("date", T.DateType()),
    ]
)

EXTENDED_SCHEMA = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("mw_value", T.ByteType()),
        T.StructField("opt_value", T.DoubleType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("mean_3", T.DoubleType()),
        T.StructField("mean_9", T.DoubleType()),
        T.StructField("sum_5", T.LongType()),
        T.StructField("mw_value_yesterday", T.DoubleType()),
        T.StructField("mw_value_7_day_average", T.DoubleType()),
        T.StructField("hours_of_daylight", T.DoubleType()),
        T.StructField("elevation_data", T.DoubleType()),
        T.StructField("slope_data", T.DoubleType()),
        T.StructField("aspect_data", T.DoubleType()),
        T.StructField("distance_to_margin", T.DoubleType()),
        T.StructField("date", T.DateType()),
    ]
)


def missing_to_null(value: Column, sentinel: float = -1.0) -> Column:
    """NaN and the sentinel become NULL."""
    v = value.cast("double")
    return F.when(~F.isnan(v) & (v != sentinel), v)


def null_to_sentinel(value: Column, sentinel: float = -1.0) -> Column:
    """NULL and NaN become the sentinel."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit(float(sentinel))).otherwise(v)


def write_by_date(df: DataFrame, root: str, mode: str = "overwrite") -> None:
    """One directory per day. Rows of a day are spread over as many files as they need: the
    shuffle is by day *and* row band, so a large day never becomes one task."""
    band = F.floor(F.col("row") / 256) if "row" in df.columns else F.floor(F.col("y") / 256000)
    df.repartition("date", band).write.mode(mode).partitionBy("date").parquet(root)


def read_days(
    spark: SparkSession,
    root: str,
    date_from: str,
    date_to: str,
    schema: T.StructType | None = None,
) -> DataFrame:
    """Every day of an inclusive range that exists; only those directories are listed and read."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(root).where(
        F.col("date").between(F.lit(date_from).cast("date"), F.lit(date_to).cast("date"))
    )


def slice_cube(
    cube: DataFrame, dates: Sequence[str] | None = None, between: tuple[str, str] | None = None
) -> DataFrame:
    """Days of a cube by list or range, missing melt values as -1."""
    day = F.col("date")
    if dates is not None:
        cube = cube.where(day.isin([F.lit(d).cast("date") for d in dates]))
    if between is not None:
        lo, hi = between
        cube = cube.where(day.between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))
    return cube.withColumn("melt", null_to_sentinel(F.col("melt")).cast("tinyint"))


def pair_catalogues(optical: DataFrame, microwave: DataFrame, path: str = "path") -> DataFrame:
    """File pairs of the same day; the day is read from the file name."""
    day = date_in_name(F.col(path))
    left = optical.select(day.alias("date"), F.col(path).alias("opt_path"))
    right = microwave.select(day.alias("date"), F.col(path).alias("mw_path"))
    return left.join(right, "date")


def date_in_name(name: Column) -> Column:
    """The yyyy-MM-dd in the last path component."""
    base = F.element_at(F.split(name, "/"), -1)
    return F.to_date(F.regexp_extract(base, r"(\d{4}-\d{2}-\d{2})", 1))


def read_with_date(reader: DataFrame) -> DataFrame:
    """Add the day in the file name to rows of files that do not carry it."""
    return reader.withColumn("date", date_in_name(F.input_file_name()))


def read_numeric_csv(spark: SparkSession, path: str, column: str) -> DataFrame:
    schema = T.StructType([T.StructField(column, T.DoubleType())])
    return spark.read.csv(path, schema=schema, header=True)


def write_numeric_csv(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").csv(path, header=True)


def station_window(series: DataFrame, start: str, end: str, level: int | None = None) -> DataFrame:
    """Readings with start <= ts < end and, if given, of one level."""
    kept = series.where(
        (F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
        & (F.col("ts") < F.lit(end).cast("timestamp_ntz"))
    )
    return kept if level is None else kept.where(F.col("level") == level)
