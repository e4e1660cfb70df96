"""Pixel tables derived from the TPC-H style tables of a test directory.

``part`` fixes the size of the grid (so that the work grows with the tables), ``lineitem`` fills
it, ``events`` plays the weather station. The same definitions exist as SQL in
``firnline.catalog.prelude``.
"""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.grid import Grid
from firnline.operators.bounded import tasks_for

FIRST_YEAR, N_SEASONS, SEASON_DAYS = 2017, 5, 28


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid_of(spark: SparkSession, sf_dir: str) -> Grid:
    """24 x 20 cells for 2000 parts, growing in proportion to the number of parts."""
    scale = math.sqrt(table(spark, sf_dir, "part").count() / 2000.0)
    return Grid(
        x0=-636500.0,
        y0=-662500.0,
        step=1000.0,
        ncols=max(24, math.floor(24 * scale)),
        nrows=max(20, math.floor(20 * scale)),
    )


def tasks_of(grid: Grid) -> int:
    """Tasks of a shuffle of all pixels."""
    return tasks_for(grid.n_cells * N_SEASONS * SEASON_DAYS)


def observations(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """One row per observed (date, col, row): summed and largest quantity."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date"))
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            (F.col("l_partkey") % grid.ncols).cast("int").alias("col"),
            (F.col("l_suppkey") % grid.nrows).cast("int").alias("row"),
            F.date_add(
                F.make_date(F.lit(FIRST_YEAR) + F.floor(day / 500).cast("int"), F.lit(6), F.lit(1)),
                day % SEASON_DAYS,
            ).alias("date"),
            "l_quantity",
        )
        .repartition(tasks_of(grid), "date", "col", "row")
        .groupBy("date", "col", "row")
        .agg((F.sum("l_quantity") / 10).alias("opt_raw"), F.max("l_quantity").alias("mq"))
    )


def cells(spark: SparkSession, sf_dir: str, grid: Grid | None = None) -> DataFrame:
    """The static layer: one row per cell; water flag and elevation follow the sizes of its parts."""
    grid = grid or grid_of(spark, sf_dir)
    base = spark.range(grid.n_cells).select(
        (F.col("id") % grid.ncols).cast("int").alias("col"),
        F.floor(F.col("id") / grid.ncols).cast("int").alias("row"),
    )
    sizes = (
        table(spark, sf_dir, "part")
        .groupBy(
            (F.col("p_partkey") % grid.ncols).cast("int").alias("col"),
            (F.floor(F.col("p_partkey") / grid.ncols) % grid.nrows).cast("int").alias("row"),
        )
        .agg(F.sum("p_size").alias("sizes"))
    )
    base = base.join(sizes, ["col", "row"], "left")
    col, row, size = F.col("col"), F.col("row"), F.coalesce("sizes", F.lit(0))
    dx = col * 24.0 / grid.ncols - 12.0
    dy = row * 20.0 / grid.nrows - 10.0
    return base.select(
        grid.x(col).alias("x"),
        grid.y(row).alias("y"),
        "col",
        "row",
        (
            col.isin(0, grid.ncols - 1)
            | row.isin(0, grid.nrows - 1)
            | ((col * 7 + row * 13 + size) % 23 < 2)
        ).alias("is_water"),
        (3000.0 - 2.0 * (dx * dx + 5.0 * (dy * dy)) + 0.125 * size).alias("elevation_data"),
    )


def scene_dates() -> Column:
    """All scene dates as one array literal."""
    days = [
        dt.date(FIRST_YEAR + s, 6, 1 + k) for s in range(N_SEASONS) for k in range(SEASON_DAYS)
    ]
    return F.array(*[F.lit(day) for day in days])


def domain(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """Every cell on every scene date."""
    return cells(spark, sf_dir, grid).drop("elevation_data").withColumn("date", F.explode(scene_dates()))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense pixel table: every cell on every scene date, NULL where nothing was observed."""
    grid = grid_of(spark, sf_dir)
    dense = domain(spark, sf_dir, grid)
    dense = dense.repartition(tasks_of(grid), "date", "col", "row")
    joined = dense.join(observations(spark, sf_dir, grid), ["date", "col", "row"], "left")
    row20 = F.floor(F.col("row") * 20 / grid.nrows)
    limit = F.when(row20 < 7, 50).otherwise(46 - row20)
    melting = (row20 >= 3) & (F.coalesce("mq", F.lit(0.0)) >= limit)
    raw = F.when(~F.col("is_water"), F.col("opt_raw"))
    return joined.select(
        "date",
        "col",
        "row",
        "x",
        "y",
        "is_water",
        F.when(F.col("is_water"), -1)
        .otherwise(melting.cast("int"))
        .cast("tinyint")
        .alias("mw_value"),
        raw.alias("opt_raw"),
        F.when(raw > 5, 5.0).otherwise(raw).alias("opt_value"),
    )


def gap_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels without the scenes of 10 June, for the missing-scene branches."""
    return pixels(spark, sf_dir).where(F.date_format("date", "MM-dd") != "06-10")


def coarse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Grid]:
    """4 km cells (maximum of the fine cells); centres lie between fine centres."""
    fine = grid_of(spark, sf_dir)
    grid = Grid(
        x0=fine.x0 + 1.5 * fine.step,
        y0=fine.y0 - 1.5 * fine.step,
        step=4 * fine.step,
        ncols=-(-fine.ncols // 4),
        nrows=-(-fine.nrows // 4),
    )
    ccol, crow = F.floor(F.col("col") / 4).cast("int"), F.floor(F.col("row") / 4).cast("int")
    frame = (
        pixels(spark, sf_dir)
        .select("date", ccol.alias("ccol"), crow.alias("crow"), "mw_value")
        .groupBy("date", "ccol", "crow")
        .agg(F.max("mw_value").cast("int").alias("melt"))
    )
    return frame, grid


def station(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station-like readings: ``ts, level, value``."""
    return table(spark, sf_dir, "events").select(
        F.col("ts"), (F.col("user_id") % 3).cast("int").alias("level"), "value"
    )


def albedo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second optical layer on the even days only (odd days have no scene)."""
    day = F.dayofmonth("date")
    return (
        domain(spark, sf_dir, grid_of(spark, sf_dir))
        .where(day % 2 == 0)
        .select(
            "date",
            "x",
            "y",
            (((F.col("col") * 31 + F.col("row") * 17 + day) % 100) / 100).alias("albedo"),
        )
    )
