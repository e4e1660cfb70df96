"""F: scalar expressions on pixels and cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog import prelude as p
from firnline.catalog.filters import AREA, SPREAD_CELLS, spread_cells
from firnline.catalog.joins import EXTENDED_CTE, daylight_sql, extended, latitude_sql
from firnline.catalog.registry import plain, query
from firnline.functions import dates as fd
from firnline.functions import labels as fl
from firnline.functions import scalars as fs
from firnline.functions.daylight import hours_of_daylight
from firnline.functions.projection import latitude
from firnline.operators.bounded import of_pixel_size
from firnline.operators.regrid import shift_half_cell
from firnline.sources import driver_grid as g
from firnline.sources.tables import date_in_name

SCALED = ", ".join(
    f"round((e.{c} - ({lo}))/({hi} - ({lo}))::DOUBLE, 6) + 0.0 AS {c}" for c, (lo, hi) in fs.FEATURE_BOUNDS.items()
)


@query(
    "f01_fixed_min_max",
    p.sql(
        f"SELECT {p.d()}, \"row\", col, mw_value, {p.r('mw_value_yesterday', 'mw_value_yesterday')}, "
        f"{p.r('ln(1 + opt_value)', 'opt_value')}, {SCALED} FROM ext e",
        EXTENDED_CTE,
    ),
)
def fixed_min_max(spark, sf):
    return plain(fs.normalise(extended(spark, sf)))


@query(
    "f02_log_and_inverse",
    p.sql(
        f"SELECT {p.d()}, x, y, {p.r('ln(1 + opt_raw)', 'log_value')}, {p.r('exp(ln(1 + opt_raw)) - 1', 'back')} FROM px"
    ),
)
def log_and_inverse(spark, sf):
    rows = g.pixels(spark, sf).select("date", "x", "y", F.log1p("opt_raw").alias("log_value"))
    return plain(rows.withColumn("back", F.expm1("log_value")))


@query(
    "f03_inverse_min_max",
    p.sql(
        f"SELECT x, y, {p.r('0.0442::DOUBLE*(90 - 0) + 0', 'slope')}, "
        f"{p.r('elevation_data/3694*(3694 - 0) + 0', 'elevation')} FROM cells"
    ),
)
def inverse_min_max(spark, sf):
    cells = g.cells(spark, sf)
    return plain(
        cells.select(
            "x",
            "y",
            fs.unscale(F.lit(0.0442), "slope_data").alias("slope"),
            fs.unscale(fs.scale("elevation_data"), "elevation_data").alias("elevation"),
        )
    )


@query(
    "f04_z_scores",
    p.sql(
        f"SELECT {p.d()}, x, y, {p.r('(opt_raw - m)/s', 'z')}, {p.r('(ln(1 + opt_raw) - lm)/ls', 'z_log')} FROM px, "
        "(SELECT avg(opt_raw) m, stddev_samp(opt_raw) s, avg(ln(1 + opt_raw)) lm, stddev_samp(ln(1 + opt_raw)) ls FROM px)"
    ),
)
def z_scores(spark, sf):
    return plain(fs.z_scores(g.pixels(spark, sf).select("date", "x", "y", "opt_raw"), "opt_raw").drop("opt_raw"))


@query(
    "f05_hours_of_daylight",
    p.sql(
        f"SELECT {p.d()}, col, \"row\", {p.r(daylight_sql('lat', 'dayofyear(date)'), 'as_coded')}, "
        f"{p.r(daylight_sql('lat', 'dayofyear(date)', 'paper'), 'paper')} FROM (SELECT px.*, {latitude_sql('w.x', 'w.y')} AS lat FROM px "
        "JOIN wide w ON w.col = px.col AND w.\"row\" = px.\"row\")",
        SPREAD_CELLS,
    ),
)
def daylight(spark, sf):
    wide = spread_cells(spark, sf).withColumn("lat", latitude(F.col("x"), F.col("y"))).drop("x", "y")
    rows = g.pixels(spark, sf).select("date", "col", "row").join(wide, ["col", "row"])
    doy = F.dayofyear("date")
    return plain(
        rows.select(
            "date",
            "col",
            "row",
            hours_of_daylight(F.col("lat"), doy).alias("as_coded"),
            hours_of_daylight(F.col("lat"), doy, "paper").alias("paper"),
        )
    )


@query("f06_latitude", p.sql(f"SELECT col, \"row\", {p.r(latitude_sql(), 'lat')} FROM wide", SPREAD_CELLS))
def latitude_of_cells(spark, sf):
    wide = spread_cells(spark, sf)
    return plain(wide.select("col", "row", latitude(F.col("x"), F.col("y")).alias("lat")))


@query(
    "f07_binary_label",
    p.sql(
        f"SELECT {p.d()}, x, y, CASE WHEN opt_value/4 >= 0.64 THEN 1 ELSE 0 END AS label FROM px WHERE opt_value IS NOT NULL"
    ),
)
def binary_label(spark, sf):
    rows = g.pixels(spark, sf).where("opt_value IS NOT NULL")
    return plain(rows.select("date", "x", "y", fs.melt_label(F.col("opt_value") / 4).alias("label")))


def bin_sql(v: str, edges) -> str:
    out = f"CASE WHEN {v} <= {edges[0]!r} THEN NULL"
    for i, e in enumerate(edges[1:]):
        out += f" WHEN {v} <= {e!r} THEN {i}"
    return out + " END"


@query(
    "f08_class_bins",
    p.sql(
        f"SELECT {p.d()}, x, y, bin, CAST(CASE WHEN bin IS NOT NULL THEN dense_rank() OVER (PARTITION BY bin IS NULL ORDER BY bin) - 1 END AS INTEGER) AS code "
        f"FROM (SELECT date, x, y, CAST({bin_sql('round(opt_raw/4, 6)', fl.CLASS_EDGES)} AS INTEGER) AS bin FROM px "
        "WHERE opt_raw IS NOT NULL AND opt_raw/4 NOT BETWEEN 0.8 AND 1.1)"
    ),
)
def class_bins(spark, sf):
    rows = g.pixels(spark, sf).where("opt_raw IS NOT NULL AND NOT opt_raw / 4 BETWEEN 0.8 AND 1.1")
    binned = rows.select(
        "date", "x", "y", fl.right_closed_bin(F.round(F.col("opt_raw") / 4, 6), fl.CLASS_EDGES).alias("bin")
    )
    return plain(fl.observed_codes(binned, "bin", "code"))


@query(
    "f09_zero_inclusive_bins",
    p.sql(
        f"SELECT {p.d()}, x, y, CAST({bin_sql('v', fl.ZERO_INCLUSIVE_EDGES)} AS INTEGER) AS opt_bin, "
        f"CAST({bin_sql('mw_value', fl.ZERO_INCLUSIVE_EDGES)} AS INTEGER) AS mw_bin "
        "FROM (SELECT *, round(coalesce(opt_raw, 0)/4, 6) AS v FROM px WHERE mw_value <> -1)"
    ),
)
def zero_inclusive_bins(spark, sf):
    rows = g.pixels(spark, sf).where("mw_value <> -1")
    value = F.round(F.coalesce("opt_raw", F.lit(0.0)) / 4, 6)
    return plain(
        rows.select(
            "date",
            "x",
            "y",
            fl.right_closed_bin(value, fl.ZERO_INCLUSIVE_EDGES).alias("opt_bin"),
            fl.right_closed_bin(F.col("mw_value"), fl.ZERO_INCLUSIVE_EDGES).alias("mw_bin"),
        )
    )


@query(
    "f10_spatial_areas",
    p.sql(
        f"SELECT col, \"row\", {AREA} AS area, (y > -1000000 AND x < -300000) AS corner FROM wide", SPREAD_CELLS
    ),
)
def spatial_areas(spark, sf):
    x, y = F.col("x"), F.col("y")
    return spread_cells(spark, sf).select(
        "col", "row", fl.spatial_area(x, y).alias("area"), fl.in_corner(x, y).alias("corner")
    )


@query(
    "f11_composite_area",
    p.sql(
        f"SELECT col, \"row\", CASE WHEN area = 0 THEN 99 ELSE CAST(CAST(area AS VARCHAR) || CAST((col + \"row\") % 3 AS VARCHAR) AS INTEGER) END AS code "
        f"FROM (SELECT *, CASE WHEN y > -1000000 AND x < -300000 THEN 0 ELSE {AREA} END AS area FROM wide)",
        SPREAD_CELLS,
    ),
)
def composite_area(spark, sf):
    x, y = F.col("x"), F.col("y")
    area = F.when(fl.in_corner(x, y), 0).otherwise(fl.spatial_area(x, y))
    sub = (F.col("col") + F.col("row")) % 3
    return spread_cells(spark, sf).select("col", "row", fl.composite_area(area, sub, 99).alias("code"))


@query(
    "f12_date_functions",
    p.sql(
        f"SELECT {p.d('d')}, CAST(dayofyear(d) AS INTEGER) AS doy, CAST(month(d) AS INTEGER) AS \"month\", "
        "CAST(year(d) AS INTEGER) AS \"year\", strftime(d, '%m-%d') AS month_day, (p.date IS NOT NULL) AS has_scene FROM "
        "(SELECT CAST(unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS d FROM "
        "(SELECT min(date) AS lo, max(date) AS hi FROM px WHERE opt_raw > 2)) r LEFT JOIN (SELECT DISTINCT date FROM px WHERE opt_raw > 2) p ON p.date = r.d"
    ),
)
def date_functions(spark, sf):
    scenes = g.pixels(spark, sf).where("opt_raw > 2").select("date").distinct()
    ends = scenes.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = ends.select(fd.inclusive_range(F.col("lo"), F.col("hi")).alias("date"))
    return plain(
        days.join(scenes.withColumn("_s", F.lit(True)), "date", "left").select(
            "date",
            F.dayofyear("date").alias("doy"),
            F.month("date").alias("month"),
            F.year("date").alias("year"),
            fd.month_day(F.col("date")).alias("month_day"),
            F.col("_s").isNotNull().alias("has_scene"),
        )
    )


@query(
    "f13_date_from_file_name",
    p.sql(
        "SELECT 'in/melt_' || strftime(date, '%Y-%m-%d') || '_extended.parquet.gzip' AS path, "
        f"{p.d()} FROM (SELECT DISTINCT date FROM px WHERE opt_raw > 2)"
    ),
)
def date_from_file_name(spark, sf):
    days = g.pixels(spark, sf).where("opt_raw > 2").select("date").distinct()
    iso = F.date_format("date", "yyyy-MM-dd")
    named = days.select(F.concat(F.lit("in/melt_"), iso, F.lit("_extended.parquet.gzip")).alias("path"))
    return plain(named.select("path", date_in_name(F.col("path")).alias("date")))


@query(
    "f14_recode",
    p.sql(
        f"SELECT {p.d('px.date')}, px.x, px.y, {p.r('CASE WHEN albedo > 0.565 THEN albedo END', 'masked')}, "
        "CAST(CASE WHEN mw_value = 1 THEN 0 ELSE mw_value END AS INTEGER) AS cleared, "
        "CAST(mw_value = 1 AS INTEGER) AS flag, "
        f"{p.r('coalesce(opt_value, 0)', 'zero_filled')} FROM px JOIN alb ON alb.date = px.date AND alb.x = px.x AND alb.y = px.y",
        p.ALBEDO,
    ),
)
def recode(spark, sf):
    rows = g.pixels(spark, sf).join(of_pixel_size(g.albedo(spark, sf)), ["date", "x", "y"])
    melting = F.col("mw_value") == 1
    return plain(
        rows.select(
            "date",
            "x",
            "y",
            fs.mask_at_most(F.col("albedo"), 0.565).alias("masked"),
            F.when(melting, 0).otherwise(F.col("mw_value")).cast("int").alias("cleared"),
            melting.cast("int").alias("flag"),
            F.coalesce("opt_value", F.lit(0.0)).alias("zero_filled"),
        )
    )


@query("f15_half_cell_shift", p.sql("SELECT col, \"row\", x + 500 AS x, y - 500 AS y FROM cells"))
def half_cell_shift(spark, sf):
    return shift_half_cell(g.cells(spark, sf).select("col", "row", "x", "y"))


@query(
    "f16_error_expressions",
    p.sql(
        f"SELECT {p.d()}, col, \"row\", {p.r('abs(mq - opt_raw)', 'absolute')}, {p.r('opt_raw - mq', 'residual')}, "
        f"{p.r('sqrt(power(col - opt_raw, 2) + power(\"row\" - mq, 2))', 'euclid')} FROM obs"
    ),
)
def error_expressions(spark, sf):
    rows = g.observations(spark, sf, g.grid_of(spark, sf))
    actual, predicted = F.col("opt_raw"), F.col("mq")
    return plain(
        rows.select(
            "date",
            "col",
            "row",
            fs.absolute_error(actual, predicted).alias("absolute"),
            fs.residual(actual, predicted).alias("residual"),
            fs.euclidean(F.col("col"), F.col("row"), actual, predicted).alias("euclid"),
        )
    )
