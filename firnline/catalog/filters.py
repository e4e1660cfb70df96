"""P: projections and filters; O: sorts and top-k; U: set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.catalog import prelude as p
from firnline.catalog.registry import plain, query
from firnline.functions import dates as fd
from firnline.functions import scalars as fs
from firnline.functions.labels import spatial_area
from firnline.operators import filters as f
from firnline.operators import masks as m
from firnline.sources import driver_grid as g
from firnline.sources.tables import null_to_sentinel

PX = f"{p.d()}, x, y, CAST(mw_value AS INTEGER) AS mw_value, {p.r('opt_value', 'opt_value')}"
PX_COLUMNS = ["date", "x", "y", "mw_value", "opt_value"]


def px(spark, sf):
    return g.pixels(spark, sf).select(*PX_COLUMNS)


@query(
    "p01_feature_columns",
    p.sql(f"SELECT CAST(mw_value AS INTEGER) AS mw_value, {p.r('opt_raw', 'opt_raw')} FROM px"),
)
def feature_columns(spark, sf):
    rows = g.pixels(spark, sf).drop("row", "col", "date", "is_water")
    return plain(rows.select(*f.feature_columns(rows.columns, with_xy=False)))


@query("p02_without_clouds", p.sql(f"SELECT {PX} FROM px WHERE opt_value IS NOT NULL"))
def without_clouds(spark, sf):
    return plain(f.without_clouds(px(spark, sf)))


@query("p03_without_water", p.sql(f"SELECT {PX} FROM px WHERE mw_value <> -1"))
def without_water(spark, sf):
    return plain(f.without_water(px(spark, sf)))


# The derived grid is smaller than the analysis grid, so its y is stretched over the whole range.
STRETCH = "-662500.0::DOUBLE - 2662000.0::DOUBLE * \"row\" / (ny - 1)"


def stretched(spark, sf):
    grid = g.grid_of(spark, sf)
    y = F.lit(-662500.0) - F.lit(2662000.0) * F.col("row") / (grid.nrows - 1)
    return g.pixels(spark, sf).withColumn("y", y)


@query(
    "p04_upper_half",
    p.sql(
        f"SELECT 'raw' AS form, count(*) AS n FROM px, spec WHERE {STRETCH} > -2000000 UNION ALL "
        f"SELECT 'scaled', count(*) FROM px, spec WHERE ({STRETCH} + 3324500) / 2662000 > 0.49755822689706986"
    ),
)
def upper_half(spark, sf):
    raw = stretched(spark, sf)
    scaled = raw.withColumn("y", fs.scale("y"))
    return (
        f.upper_half(raw)
        .agg(F.count("*").alias("n"))
        .select(F.lit("raw").alias("form"), "n")
        .union(f.upper_half(scaled, scaled=True).agg(F.count("*").alias("n")).select(F.lit("scaled"), "n"))
    )


@query(
    "p05_region_split",
    p.sql(
        f"SELECT CASE WHEN \"row\" < ny // 2 THEN 'North' ELSE 'South' END AS region, count(*) AS n, "
        f"{p.r('avg(opt_value)', 'mean_opt')} FROM px, spec GROUP BY ALL"
    ),
)
def region_split(spark, sf):
    half = g.grid_of(spark, sf).nrows // 2
    return plain(
        f.with_region(g.pixels(spark, sf), half)
        .groupBy("region")
        .agg(F.count("*").alias("n"), F.avg("opt_value").alias("mean_opt"))
    )


@query(
    "p06_crop_to_layer",
    p.sql(
        f"SELECT {PX} FROM px, (SELECT max(x) AS mx, min(y) AS my FROM cells WHERE is_water AND col < 12 AND \"row\" < 9) b "
        "WHERE x <= mx AND y >= my"
    ),
)
def crop_to_layer(spark, sf):
    other = g.cells(spark, sf).where(F.col("is_water") & (F.col("col") < 12) & (F.col("row") < 9))
    return plain(f.crop_to(px(spark, sf), other))


SEASON = "date + CAST(95 AS INTEGER)"


@query(
    "p07_season_cutoff",
    p.sql(
        f"SELECT {p.d(f'CAST({SEASON} AS DATE)')}, "
        f"(month({SEASON}) = 9 AND day({SEASON}) > 10) AS late, "
        f"(strftime({SEASON}, '%m-%d') <= '09-10') AS in_season FROM (SELECT DISTINCT date FROM px WHERE opt_raw > 2)"
    ),
)
def season_cutoff(spark, sf):
    shifted = g.pixels(spark, sf).where("opt_raw > 2").select(F.date_add("date", 95).alias("date")).distinct()
    return plain(
        shifted.select(
            "date",
            fd.late_september(F.col("date")).alias("late"),
            fd.until_season_end(F.col("date")).alias("in_season"),
        )
    )


@query(
    "p08_value_predicates",
    p.sql(
        "SELECT count(*) FILTER (WHERE mw_value = 1) AS melting, "
        "count(*) FILTER (WHERE opt_raw >= 2) AS large, "
        "count(*) FILTER (WHERE opt_raw < 10) AS below_ten, "
        "count(*) FILTER (WHERE mw_value NOT IN (-1, 1)) AS quiet FROM px"
    ),
)
def value_predicates(spark, sf):
    return g.pixels(spark, sf).agg(
        F.count_if(F.col("mw_value") == 1).alias("melting"),
        F.count_if(F.col("opt_raw") >= 2).alias("large"),
        F.count_if(F.col("opt_raw") < 10).alias("below_ten"),
        F.count_if(~F.col("mw_value").isin(-1, 1)).alias("quiet"),
    )


@query(
    "p09_window_slice",
    p.sql(f"SELECT {PX}, col, \"row\" FROM px WHERE \"row\" < 7 AND col BETWEEN 2 AND 10"),
)
def window_slice(spark, sf):
    return plain(f.window_slice(g.pixels(spark, sf).select(*PX_COLUMNS, "col", "row"), (0, 7), (2, 11)))


@query(
    "p10_fill_missing",
    p.sql(f"SELECT {p.d()}, x, y, {p.r('coalesce(opt_value, -1)', 'opt_value')} FROM px"),
)
def fill_missing(spark, sf):
    filled = px(spark, sf).withColumn("opt_value", null_to_sentinel(F.col("opt_value")))
    return plain(filled.drop("mw_value"))


@query(
    "p11_cap_outliers",
    p.sql(
        f"SELECT {p.d()}, x, y, {p.r('CASE WHEN opt_raw > 5 THEN 5.0 ELSE opt_raw END', 'capped')} FROM px"
    ),
)
def cap_outliers(spark, sf):
    return plain(g.pixels(spark, sf).select("date", "x", "y", fs.cap(F.col("opt_raw")).alias("capped")))


@query("p12_feature_guard", p.sql("SELECT count(*) AS n, 4 AS n_rejected FROM px"))
def feature_guard(spark, sf):
    rejected = 0
    for name in f.FORBIDDEN_FEATURES:
        try:
            f.check_features(["x", name])
        except ValueError:
            rejected += 1
    rows = g.pixels(spark, sf).select(*f.check_features(["x", "y", "mw_value"]))
    return rows.agg(F.count("*").alias("n"), F.lit(rejected).alias("n_rejected"))


@query(
    "p13_keyed_sample",
    p.sql(
        f"SELECT {PX} FROM px WHERE CAST(('0x' || substr(md5('1,' || strftime(date, '%Y-%m-%d') || ',' || col || ',' || \"row\"), 1, 8)) AS BIGINT) < 214748364"
    ),
)
def keyed_sample(spark, sf):
    kept = f.keyed_sample(g.pixels(spark, sf), ["date", "col", "row"], 0.05)
    return plain(kept.select(*PX_COLUMNS))


@query(
    "p14_days_per_month",
    p.sql(
        f"SELECT {p.d()}, count(*) AS n, {p.r('avg(opt_value)', 'mean_opt')} FROM px JOIN picked USING (date) GROUP BY date",
        "picked AS (SELECT date FROM (SELECT date, row_number() OVER (PARTITION BY strftime(date, '%Y-%m') "
        "ORDER BY md5('1,' || strftime(date, '%Y-%m-%d'))) AS k FROM (SELECT DISTINCT date FROM px)) WHERE k <= 4)",
    ),
)
def days_per_month(spark, sf):
    kept = f.days_per_month(px(spark, sf), 4)
    return plain(kept.groupBy("date").agg(F.count("*").alias("n"), F.avg("opt_value").alias("mean_opt")))


@query(
    "p15_static_and_dynamic",
    p.sql(
        f"SELECT a.x, a.y, a.col, a.\"row\", b.n, {p.r('b.m', 'mean_melt')} "
        "FROM (SELECT * FROM px WHERE date = DATE '2019-06-08') a JOIN "
        "(SELECT x, y, count(*) AS n, avg(mw_value) AS m FROM px WHERE date BETWEEN DATE '2019-06-01' AND DATE '2019-06-20' GROUP BY x, y) b "
        "ON a.x = b.x AND a.y = b.y"
    ),
)
def static_and_dynamic(spark, sf):
    one, many = f.static_and_dynamic(
        g.pixels(spark, sf), ["col", "row"], ["mw_value"], "2019-06-08", "2019-06-01", "2019-06-20"
    )
    per_cell = many.groupBy("x", "y").agg(F.count("*").alias("n"), F.avg("mw_value").alias("mean_melt"))
    return plain(one.join(per_cell, ["x", "y"]))


AREA = """CASE WHEN y < -2398000 THEN 5 WHEN x <= 142500 AND y >= -1412000 THEN 1
 WHEN x > 142500 AND y >= -1660500 THEN 2 WHEN x <= 142500 THEN 3 ELSE 4 END"""
SPREAD_CELLS = """wide AS (SELECT col, "row", -636500.0::DOUBLE + 1461000.0::DOUBLE*col/(nx-1) AS x,
  -662500.0::DOUBLE - 2662000.0::DOUBLE*"row"/(ny-1) AS y FROM cells, spec)"""


def spread_cells(spark, sf):
    """Cells stretched over the extent of the analysis grid, so that every area occurs."""
    grid = g.grid_of(spark, sf)
    return g.cells(spark, sf, grid).select(
        "col",
        "row",
        (F.lit(-636500.0) + F.lit(1461000.0) * F.col("col") / (grid.ncols - 1)).alias("x"),
        (F.lit(-662500.0) - F.lit(2662000.0) * F.col("row") / (grid.nrows - 1)).alias("y"),
    )


@query(
    "o01_sort_by_area_and_y",
    p.sql(f"SELECT col, \"row\", {AREA} AS area FROM wide ORDER BY area, y, x", SPREAD_CELLS),
)
def sort_by_area_and_y(spark, sf):
    rows = spread_cells(spark, sf).withColumn("area", spatial_area(F.col("x"), F.col("y")))
    return rows.orderBy("area", "y", "x").select("col", "row", "area")


@query(
    "o05_sorted_dates",
    p.sql(f"SELECT {p.d()} FROM (SELECT DISTINCT date FROM px WHERE mw_value = 1) ORDER BY date"),
)
def sorted_dates(spark, sf):
    return plain(px(spark, sf).where("mw_value = 1").select("date").distinct().orderBy("date"))


@query(
    "u01_union_all_years",
    p.sql(
        " UNION ALL ".join(f"SELECT {PX} FROM px WHERE year(date) = {y}" for y in range(2017, 2022))
    ),
)
def union_all_years(spark, sf):
    rows = px(spark, sf)
    years = [rows.where(F.year("date") == y) for y in range(2017, 2022)]
    return plain(reduce(DataFrame.unionByName, years))


@query(
    "u02_union_distinct_dates",
    p.sql(
        f"SELECT {p.d()} FROM (SELECT date FROM px WHERE mw_value = 1 AND opt_raw > 20 UNION SELECT date FROM px WHERE day(date) > 25)"
    ),
)
def union_distinct_dates(spark, sf):
    rows = g.pixels(spark, sf)
    melting = rows.where("mw_value = 1 AND opt_raw > 20").select("date").distinct()
    late = rows.where(F.dayofmonth("date") > 25).select("date").distinct()
    return plain(melting.union(late).distinct())


CELLS_MELTING = "SELECT DISTINCT x, y FROM px WHERE mw_value = 1 AND year(date) = {}"


@query(
    "u03_intersect_cells",
    p.sql(f"{CELLS_MELTING.format(2017)} INTERSECT {CELLS_MELTING.format(2018)}"),
)
def intersect_cells(spark, sf):
    melting = g.pixels(spark, sf).where("mw_value = 1")
    return (
        melting.where(F.year("date") == 2017)
        .select("x", "y")
        .intersect(melting.where(F.year("date") == 2018).select("x", "y"))
    )


@query(
    "u04_except_cells",
    p.sql(f"{CELLS_MELTING.format(2017)} EXCEPT {CELLS_MELTING.format(2018)}"),
)
def except_cells(spark, sf):
    melting = g.pixels(spark, sf).where("mw_value = 1")
    a = melting.where(F.year("date") == 2017).select("x", "y").distinct()
    return m.inverse_set(a, melting.where(F.year("date") == 2018).select("x", "y"))
