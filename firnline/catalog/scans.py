"""S: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog import prelude as p
from firnline.catalog.registry import plain, query
from firnline.session import shared_folder
from firnline.sources import driver_grid as g
from firnline.sources import rasters, tables

PLAIN = ["x", "y", "mw_value", "opt_value", "date"]


@query(
    "s01_scan_date_range",
    p.sql(
        f"SELECT {p.d()}, x, y, CAST(mw_value AS INTEGER) AS mw_value, {p.r('opt_value', 'opt_value')} "
        "FROM px WHERE date BETWEEN DATE '2018-06-05' AND DATE '2019-06-03'"
    ),
)
def scan_date_range(spark, sf):
    root = shared_folder(spark)
    tables.write_by_date(g.pixels(spark, sf).select(*PLAIN), root)
    return plain(tables.read_days(spark, root, "2018-06-05", "2019-06-03", tables.PLAIN_SCHEMA))


@query(
    "s02_write_read_training_table",
    p.sql(
        "SELECT count(*) AS n, CAST(sum(mw_value) AS BIGINT) AS melt, "
        f"{p.r('sum(opt_value)', 'opt')}, count(DISTINCT date) AS n_dates "
        "FROM px WHERE opt_value IS NOT NULL"
    ),
)
def write_read_training_table(spark, sf):
    root = shared_folder(spark)
    rows = g.pixels(spark, sf).where("opt_value IS NOT NULL").select(*PLAIN)
    tables.write_by_date(rows, root)
    back = spark.read.schema(tables.PLAIN_SCHEMA).parquet(root)
    return plain(
        back.agg(
            F.count("*").alias("n"),
            F.sum("mw_value").alias("melt"),
            F.sum("opt_value").alias("opt"),
            F.countDistinct("date").alias("n_dates"),
        )
    )


@query(
    "s03_slice_cube_by_day",
    p.sql(
        f"SELECT {p.d()}, x, y, CAST(CASE WHEN col % 5 = 0 THEN -1 ELSE mw_value END AS INTEGER) AS melt "
        "FROM px WHERE date IN (DATE '2017-06-04', DATE '2018-06-09', DATE '2021-06-28')"
    ),
)
def slice_cube_by_day(spark, sf):
    cube = g.pixels(spark, sf).select(
        "date", "x", "y", F.when(F.col("col") % 5 != 0, F.col("mw_value").cast("double")).alias("melt")
    )
    return plain(tables.slice_cube(cube, ["2017-06-04", "2018-06-09", "2021-06-28"]))


@query(
    "s03_slice_cube_by_range",
    p.sql(
        f"SELECT {p.d()}, x, y, CAST(mw_value AS INTEGER) AS melt "
        "FROM px WHERE date BETWEEN DATE '2019-06-02' AND DATE '2019-06-05'"
    ),
)
def slice_cube_by_range(spark, sf):
    cube = g.pixels(spark, sf).select("date", "x", "y", F.col("mw_value").alias("melt"))
    return plain(tables.slice_cube(cube, between=("2019-06-02", "2019-06-05")))


@query(
    "s04_dense_raster_to_long",
    p.sql(
        f"SELECT {p.d()}, x, y, col, \"row\", {p.r('opt_raw', 'opt_raw')} "
        "FROM px"
    ),
)
def dense_raster_to_long(spark, sf):
    grid = g.grid_of(spark, sf)
    lines = rasters.long_to_lines(g.pixels(spark, sf), "opt_raw", grid, tasks=g.tasks_of(grid))
    return plain(rasters.lines_to_long(lines, "opt_raw", grid))


@query(
    "s05_long_to_dense_lines",
    p.sql(
        f"SELECT {p.d()}, \"row\", string_agg(coalesce(CAST(CAST(round(opt_raw*10) AS BIGINT) AS VARCHAR), 'nan'), ',' ORDER BY col) AS line "
        "FROM px GROUP BY date, \"row\""
    ),
)
def long_to_dense_lines(spark, sf):
    grid = g.grid_of(spark, sf)
    present = g.pixels(spark, sf).where("opt_raw IS NOT NULL")
    values = present.withColumn("tenths", F.round(F.col("opt_raw") * 10).cast("long"))
    twice = values.unionByName(values)  # duplicates must not change the matrix
    lines = rasters.long_to_lines(twice, "tenths", grid, tasks=2 * g.tasks_of(grid))
    text = F.transform("line", lambda v: F.coalesce(v.cast("string"), F.lit("nan")))
    return plain(lines.select("date", "row", F.array_join(text, ",").alias("line")))


@query(
    "s06_csv_round_trip",
    p.sql(f"SELECT {p.r('opt_value', 'optical_values')} FROM px WHERE opt_value IS NOT NULL"),
)
def csv_round_trip(spark, sf):
    path = shared_folder(spark)
    sample = g.pixels(spark, sf).where("opt_value IS NOT NULL").select(F.col("opt_value").alias("optical_values"))
    tables.write_numeric_csv(sample, path, "optical_values")
    return plain(tables.read_numeric_csv(spark, path, "optical_values"))


@query(
    "s07_pair_catalogues_by_date",
    p.sql(
        f"SELECT {p.d()}, 'opt/' || strftime(date, '%Y-%m-%d') || '_grain_diameter.tif' AS opt_path, "
        "'mw/' || strftime(date, '%Y-%m-%d') || '_mw.tif' AS mw_path "
        "FROM (SELECT DISTINCT date FROM px WHERE opt_raw > 2 AND day(date) % 3 <> 0)"
    ),
)
def pair_catalogues_by_date(spark, sf):
    days = g.pixels(spark, sf).where("opt_raw > 2").select("date").distinct()
    iso = F.date_format("date", "yyyy-MM-dd")
    mw = days.select(F.concat(F.lit("mw/"), iso, F.lit("_mw.tif")).alias("path"))
    opt = days.where(F.dayofmonth("date") % 3 != 0).select(
        F.concat(F.lit("opt/"), iso, F.lit("_grain_diameter.tif")).alias("path")
    )
    return plain(tables.pair_catalogues(opt, mw))


@query(
    "s08_station_window_and_level",
    p.sql(
        f"SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, level, {p.r('value', 'value')} FROM station "
        "WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND level = 1",
        p.STATION,
    ),
)
def station_window_and_level(spark, sf):
    kept = tables.station_window(g.station(spark, sf), "2024-01-05 00:00:00", "2024-01-20 00:00:00", 1)
    return plain(kept.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))


@query(
    "s10_pivot_by_date",
    p.sql(
        "SELECT x, y, "
        + ", ".join(
            p.r(f"max(CASE WHEN date = DATE '2019-06-{k}' THEN opt_value END)", f"opt_2019_06_{k}")
            for k in ("03", "07", "21")
        )
        + " FROM px GROUP BY x, y"
    ),
)
def pivot_by_date(spark, sf):
    days = ["2019-06-03", "2019-06-07", "2019-06-21"]
    return plain(rasters.pivot_by_date(g.pixels(spark, sf), "opt_value", days, "opt_"))
