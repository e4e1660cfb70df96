"""J: joins between layers, masks, regridding and gap filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog import prelude as p
from firnline.catalog.registry import plain, query
from firnline.functions.scalars import MELT_THRESHOLD
from firnline.grid import Grid
from firnline.operators import filters as f
from firnline.operators import joins as j
from firnline.operators import masks as m
from firnline.operators import regrid
from firnline.operators.aggregates import daily_mean
from firnline.plans.features import build_features, static_layer
from firnline.sources import driver_grid as g

OPT_DAYS = "CAST(strftime(date, '%d') AS INTEGER) % 4 <> 0"


def mw(spark, sf):
    return g.pixels(spark, sf).select("date", "x", "y", "mw_value")


def opt(spark, sf):
    return g.pixels(spark, sf).where("opt_value IS NOT NULL").select("date", "x", "y", "opt_value")


@query(
    "j01_microwave_with_optical",
    p.sql(
        f"SELECT {p.d('a.date')}, a.x, a.y, CAST(a.mw_value AS INTEGER) AS mw_value, {p.r('b.opt_value', 'opt_value')} "
        f"FROM px a LEFT JOIN (SELECT * FROM px WHERE opt_value IS NOT NULL AND {OPT_DAYS}) b "
        "ON a.date = b.date AND a.x = b.x AND a.y = b.y"
    ),
)
def microwave_with_optical(spark, sf):
    some = opt(spark, sf).where(F.dayofmonth("date") % 4 != 0)
    return plain(j.microwave_with_optical(mw(spark, sf), some))


def melt_masks(spark, sf):
    """Never-melt and little-melt masks of the derived pixels."""
    pixels = g.pixels(spark, sf)
    ice = g.cells(spark, sf).where("NOT is_water").select("x", "y")
    never = m.membership_mask(ice, m.never_melting(pixels))
    few = m.total_melt_days(m.melt_days(pixels)).where(F.col("counts").isin(2, 3))
    return never, m.membership_mask(ice, few)


def _mask_sql(where: str) -> str:
    return p.sql(
        f"SELECT {p.d('px.date')}, px.x, px.y, {p.r('opt_value', 'opt_value')} FROM px "
        "LEFT JOIN nomelt n ON px.x = n.x AND px.y = n.y LEFT JOIN littlemelt l ON px.x = l.x AND px.y = l.y "
        f"WHERE opt_value IS NOT NULL AND {where}",
        p.MASKS,
    )


@query("j02_mask_filter_both", _mask_sql("n.melt = 1 AND l.melt = 1"))
def mask_filter_both(spark, sf):
    never, little = melt_masks(spark, sf)
    return plain(m.apply_masks(opt(spark, sf), never, little))


@query("j02_mask_filter_never", _mask_sql("n.melt = 1"))
def mask_filter_never(spark, sf):
    never, _ = melt_masks(spark, sf)
    return plain(m.apply_masks(opt(spark, sf), never))


@query("j02_mask_filter_little", _mask_sql("l.melt = 1"))
def mask_filter_little(spark, sf):
    _, little = melt_masks(spark, sf)
    return plain(m.apply_masks(opt(spark, sf), None, little))


@query("j02_mask_filter_combined", _mask_sql("n.melt = 1 AND l.melt = 1"))
def mask_filter_combined(spark, sf):
    return plain(m.apply_masks(opt(spark, sf), m.combined_mask(g.pixels(spark, sf))))


NEVER = (
    "never AS (SELECT year(date) AS year, x, y FROM px GROUP BY ALL "
    "HAVING bool_and(mw_value NOT IN (-1, 1)))"
)


@query(
    "j03_never_melting_in_season",
    p.sql(
        "SELECT x, y FROM px WHERE year(date) = 2018 GROUP BY x, y HAVING bool_and(mw_value NOT IN (-1, 1)) "
        "AND count(*) = (SELECT count(DISTINCT date) FROM px WHERE year(date) = 2018)"
    ),
)
def never_melting_in_season(spark, sf):
    return m.never_melting(g.pixels(spark, sf).where(F.year("date") == 2018))


@query("j04_never_melting_by_year", p.sql("SELECT CAST(year AS INTEGER) AS year, x, y FROM never", NEVER))
def never_melting_by_year(spark, sf):
    return m.never_melting_by_year(g.pixels(spark, sf))


@query(
    "j04_never_melting_cumulative",
    p.sql(
        "SELECT CAST(k.year AS INTEGER) AS year, n.x, n.y FROM (SELECT DISTINCT year(date) AS year FROM px) k "
        "JOIN never n ON n.year <= k.year GROUP BY k.year, n.x, n.y HAVING count(*) = k.year - 2016",
        NEVER,
    ),
)
def never_melting_cumulative(spark, sf):
    return m.never_melting_cumulative(g.pixels(spark, sf))


@query("j05_membership_mask", p.sql("SELECT x, y, melt FROM nomelt", p.MASKS))
def membership_mask(spark, sf):
    return melt_masks(spark, sf)[0]


@query("j05_inverse_set", p.sql("SELECT x, y FROM nomelt WHERE melt = 1", p.MASKS))
def inverse_set(spark, sf):
    ice = g.cells(spark, sf).where("NOT is_water").select("x", "y")
    return m.inverse_set(ice, m.never_melting(g.pixels(spark, sf)))


@query(
    "j06_full_outer_counts",
    p.sql(
        "SELECT g.x, g.y, b.counts FROM (SELECT x, y FROM cells) g FULL OUTER JOIN "
        "(SELECT coalesce(n.x, c.x) AS x, coalesce(n.y, c.y) AS y, coalesce(c.melt_days, 0) AS counts "
        " FROM (SELECT x, y FROM nomelt WHERE melt = 0) n FULL OUTER JOIN (SELECT * FROM melt_days WHERE melt_days > 0) c "
        " ON n.x = c.x AND n.y = c.y WHERE coalesce(c.melt_days, 0) <= 3) b ON g.x = b.x AND g.y = b.y",
        p.MASKS,
    ),
)
def full_outer_counts(spark, sf):
    pixels = g.pixels(spark, sf)
    counts = m.total_melt_days(m.melt_days(pixels))
    removed = m.counts_with_never(m.never_melting(pixels), counts)
    return g.cells(spark, sf).select("x", "y").join(removed, ["x", "y"], "full_outer")


# Extended table: brute-force statements, independent of the window formulation.
AROUND = """around AS (
  SELECT a.date, a.col, a."row",
    avg(b.v) FILTER (WHERE abs(a.col-b.col) <= 1 AND abs(a."row"-b."row") <= 1) AS mean_3,
    sum(b.v) FILTER (WHERE abs(a.col-b.col) <= 2 AND abs(a."row"-b."row") <= 2) AS sum_5,
    avg(b.v) AS mean_9
  FROM px a JOIN (SELECT date, col, "row", mw_value AS v FROM px WHERE mw_value <> -1) b
    ON a.date = b.date AND b.col BETWEEN a.col - 4 AND a.col + 4 AND b."row" BETWEEN a."row" - 4 AND a."row" + 4
  WHERE a.mw_value <> -1 GROUP BY a.date, a.col, a."row")"""


def history_cte(source: str) -> str:
    return f"""cal AS (SELECT a.date, count(*) AS n_week, bool_or(b.date = a.date - 1) AS has_yesterday
  FROM (SELECT DISTINCT date FROM {source}) a JOIN (SELECT DISTINCT date FROM {source}) b
  ON b.date BETWEEN a.date - 7 AND a.date - 1 GROUP BY a.date),
hist AS (SELECT a.date, a.col, a."row",
    CASE WHEN cal.has_yesterday THEN max(b.mw_value) FILTER (WHERE b.date = a.date - 1) ELSE a.mw_value END AS mw_value_yesterday,
    CASE WHEN cal.has_yesterday AND cal.n_week = 7 THEN avg(b.mw_value) ELSE a.mw_value END AS mw_value_7_day_average
  FROM {source} a LEFT JOIN cal ON cal.date = a.date
  LEFT JOIN {source} b ON b.col = a.col AND b."row" = a."row" AND b.date BETWEEN a.date - 7 AND a.date - 1
  WHERE a.mw_value <> -1 GROUP BY a.date, a.col, a."row", a.mw_value, cal.has_yesterday, cal.n_week)"""


TERRAIN = """sides AS (SELECT c.*, w.elevation_data AS ew, e.elevation_data AS ee, n.elevation_data AS en, s.elevation_data AS es
  FROM cells c LEFT JOIN cells w ON w.col = c.col - 1 AND w."row" = c."row" LEFT JOIN cells e ON e.col = c.col + 1 AND e."row" = c."row"
  LEFT JOIN cells n ON n.col = c.col AND n."row" = c."row" - 1 LEFT JOIN cells s ON s.col = c.col AND s."row" = c."row" + 1),
grad AS (SELECT *, CASE WHEN ew IS NULL THEN (ee - elevation_data)/1000 WHEN ee IS NULL THEN (elevation_data - ew)/1000 ELSE (ee - ew)/2000 END AS gx,
  CASE WHEN es IS NULL THEN (en - elevation_data)/1000 WHEN en IS NULL THEN (elevation_data - es)/1000 ELSE (en - es)/2000 END AS gy FROM sides),
terrain AS (SELECT x, y, col, "row", is_water, elevation_data, degrees(atan(sqrt(gx*gx + gy*gy))) AS slope_data,
  CASE WHEN gx*gx + gy*gy > 0 THEN cos(atan2(-gx, -gy)) END AS aspect_data FROM grad)"""

MARGIN = """margin AS (SELECT a.col, a."row", min(sqrt((a.col-b.col)*(a.col-b.col) + (a."row"-b."row")*(a."row"-b."row"))) AS distance_to_margin
  FROM cells a, (SELECT col, "row" FROM cells WHERE is_water) b GROUP BY a.col, a."row")"""


def latitude_sql(x: str = "x", y: str = "y") -> str:
    from firnline.functions.projection import inverse_constants

    k, series = inverse_constants()
    chi = f"(pi()/2 - 2*atan(sqrt({x}*{x} + {y}*{y})*{k!r}::DOUBLE))"
    terms = "".join(f" + {c!r}::DOUBLE*sin({2 * i}*{chi})" for i, c in enumerate(series, start=1))
    return f"degrees({chi}{terms})"


def daylight_sql(lat: str, doy: str, variant: str = "reference") -> str:
    theta = f"(0.2163108::DOUBLE + 2*atan(0.9671396::DOUBLE*tan(0.00860::DOUBLE*({doy} - 186))))"
    decl = f"asin(0.39795::DOUBLE*cos({theta}))"
    rad, h = f"({lat})*pi()/180", "(0.8333::DOUBLE*pi()/180)"
    product = f"sin({rad})*sin({decl})"
    top = f"sin({h} + {product})" if variant == "reference" else f"(sin({h}) + {product})"
    ratio = f"({top}/(cos({rad})*cos({decl})))"
    return (
        f"CASE WHEN {ratio} >= 1 THEN 24.0 WHEN {ratio} <= -1 THEN 0.0 "
        f"ELSE 24.0 - 24.0/pi()*acos({ratio}) END"
    )


EXTENDED_FROM = (
    f"FROM (SELECT *, {latitude_sql()} AS lat FROM px WHERE mw_value <> -1) px "
    "LEFT JOIN around r ON r.date = px.date AND r.col = px.col AND r.\"row\" = px.\"row\" "
    "LEFT JOIN hist h ON h.date = px.date AND h.col = px.col AND h.\"row\" = px.\"row\" "
    "LEFT JOIN terrain t ON t.col = px.col AND t.\"row\" = px.\"row\" "
    "LEFT JOIN margin m ON m.col = px.col AND m.\"row\" = px.\"row\""
)
EXTENDED_VALUES = {
    "opt_value": "px.opt_value",
    "mean_3": "r.mean_3",
    "mean_9": "r.mean_9",
    "sum_5": "CAST(r.sum_5 AS BIGINT)",
    "mw_value_yesterday": "CAST(h.mw_value_yesterday AS DOUBLE)",
    "mw_value_7_day_average": "h.mw_value_7_day_average",
    "hours_of_daylight": daylight_sql("lat", "dayofyear(px.date)"),
    "elevation_data": "t.elevation_data",
    "slope_data": "t.slope_data",
    "aspect_data": "t.aspect_data",
    "distance_to_margin": "m.distance_to_margin",
}
EXTENDED_CTE = (
    f"{AROUND},\n{history_cte('px')},\n{TERRAIN},\n{MARGIN},\n"
    "ext AS (SELECT px.date, px.x, px.y, px.col, px.\"row\", CAST(px.mw_value AS INTEGER) AS mw_value, "
    + ", ".join(f"{e} AS {a}" for a, e in EXTENDED_VALUES.items())
    + f" {EXTENDED_FROM})"
)
EXTENDED_SQL = p.sql(
    f"SELECT {p.d()}, x, y, col, \"row\", mw_value, "
    + ", ".join(c if c == "sum_5" else p.r(c, c) for c in EXTENDED_VALUES)
    + " FROM ext",
    EXTENDED_CTE,
)


def extended(spark, sf):
    static = static_layer(g.cells(spark, sf))
    return build_features(g.pixels(spark, sf), static, tasks=g.tasks_of(g.grid_of(spark, sf)))


@query("j07_extended_feature_table", EXTENDED_SQL)
def extended_feature_table(spark, sf):
    return plain(extended(spark, sf))


@query(
    "j08_yesterday_by_join",
    p.sql(
        f"SELECT {p.d('a.date')}, a.x, a.y, CAST(b.mw_value AS INTEGER) AS mw_value_yesterday FROM gap a "
        "LEFT JOIN gap b ON b.x = a.x AND b.y = a.y AND b.date = a.date - 1",
        p.GAP,
    ),
)
def yesterday_by_join(spark, sf):
    rows = g.gap_pixels(spark, sf).select("date", "x", "y", "mw_value")
    return plain(j.value_on_previous_day(rows, "mw_value", "mw_value_yesterday").drop("mw_value"))


def station_by_scene_day(spark, sf, level, name):
    """Daily station means moved from January 2024 to the days of the first season."""
    daily = daily_mean(g.station(spark, sf).where(F.col("level") == level))
    shift = F.datediff(F.lit("2017-06-01").cast("date"), F.lit("2024-01-01").cast("date"))
    return daily.select(F.date_add("date", shift).alias("date"), F.col("value").alias(name))


@query(
    "j09_station_on_pixels",
    p.sql(
        f"SELECT {p.d('px.date')}, px.x, px.y, {p.r('s0.v', 'meltflux')}, {p.r('s1.v', 'slwc')} FROM px "
        "LEFT JOIN sday s0 ON s0.date = px.date AND s0.level = 0 LEFT JOIN sday s1 ON s1.date = px.date AND s1.level = 1",
        p.STATION,
        "sday AS (SELECT level, CAST(DATE '2017-06-01' + CAST(CAST(ts AS DATE) - DATE '2024-01-01' AS INTEGER) AS DATE) AS date, avg(value) AS v FROM station GROUP BY ALL)",
    ),
)
def station_on_pixels(spark, sf):
    rows = g.pixels(spark, sf).select("date", "x", "y")
    return plain(
        j.attach_station(
            rows,
            station_by_scene_day(spark, sf, 0, "meltflux"),
            station_by_scene_day(spark, sf, 1, "slwc"),
        )
    )


@query(
    "j10_drop_by_albedo",
    p.sql(
        f"SELECT {p.d('px.date')}, px.x, px.y, {p.r('opt_value', 'opt_value')} FROM px "
        "WHERE opt_value IS NOT NULL AND EXISTS (SELECT 1 FROM alb WHERE alb.date = px.date) "
        "AND NOT EXISTS (SELECT 1 FROM alb WHERE alb.date = px.date AND alb.x = px.x AND alb.y = px.y AND albedo > 0.565)",
        p.ALBEDO,
    ),
)
def drop_by_albedo(spark, sf):
    return plain(j.drop_by_layer(opt(spark, sf), g.albedo(spark, sf), F.col("albedo") > 0.565))


COARSE_XY = (
    "cxy AS (SELECT date, ccol, crow, melt, -636500.0::DOUBLE + 1500 + 4000.0::DOUBLE*ccol AS cx, "
    "-662500.0::DOUBLE - 1500 - 4000.0::DOUBLE*crow AS cy FROM coarse)"
)


@query(
    "j11_nearest_regrid",
    p.sql(
        f"SELECT {p.d('f.date')}, f.x, f.y, f.col, f.\"row\", CAST(CASE WHEN f.x BETWEEN b.x0 AND b.x1 AND f.y BETWEEN b.y0 AND b.y1 THEN c.melt END AS INTEGER) AS melt "
        "FROM (SELECT px.*, nx, ny FROM px, spec WHERE \"row\" < ny - 2 AND col < nx - 1) f "
        "JOIN (SELECT min(cx) x0, max(cx) x1, min(cy) y0, max(cy) y1 FROM cxy) b ON true "
        "JOIN cxy c ON c.date = f.date AND c.ccol = least(greatest(ceil((f.x - b.x0)/4000 - 0.5), 0), (nx + 3)//4 - 1) "
        "AND c.crow = least(greatest(ceil((b.y1 - f.y)/4000 - 0.5), 0), (ny + 3)//4 - 1)",
        p.COARSE,
        COARSE_XY,
    ),
)
def nearest_regrid(spark, sf):
    scenes, coarse_grid = g.coarse(spark, sf)
    out = regrid.nearest(scenes, "melt", coarse_grid, g.grid_of(spark, sf), trim=(2, 1))
    return plain(out)


@query(
    "j12_bilinear_regrid",
    p.sql(
        f"SELECT {p.d()}, x, y, col, \"row\", {p.r('sum(w*melt)/sum(w)', 'melt')} FROM ("
        "SELECT f.date, f.x, f.y, f.col, f.\"row\", c.melt, (1 - abs(f.x - c.cx)/4000)*(1 - abs(f.y - c.cy)/4000) AS w "
        "FROM px f, (SELECT min(cx) x0, max(cx) x1, min(cy) y0, max(cy) y1 FROM cxy) b, cxy c "
        "WHERE c.date = f.date AND abs(f.x - c.cx) < 4000 AND abs(f.y - c.cy) < 4000 "
        "AND f.x BETWEEN b.x0 AND b.x1 AND f.y BETWEEN b.y0 AND b.y1) GROUP BY ALL",
        p.COARSE,
        COARSE_XY,
    ),
)
def bilinear_regrid(spark, sf):
    scenes, coarse_grid = g.coarse(spark, sf)
    return plain(regrid.bilinear(scenes, "melt", coarse_grid, g.grid_of(spark, sf)))


@query(
    "j12_bilinear_upsample_25",
    p.sql(
        f"SELECT {p.d()}, \"row\", count(*) AS n, {p.r('sum(melt)', 'total')}, {p.r('sum(melt*(col + 1))', 'moment')} FROM ("
        f"SELECT date, fc.i AS col, fr.i AS \"row\", {p.r('sum(w*melt)/sum(w)', 'melt')} FROM (SELECT date, ccol, crow, melt FROM coarse) c, "
        "LATERAL (SELECT CAST(unnest(range(25*ccol - 24, 25*ccol + 25)) AS INTEGER) AS i) fc, "
        "LATERAL (SELECT CAST(unnest(range(25*crow - 24, 25*crow + 25)) AS INTEGER) AS i) fr, "
        "LATERAL (SELECT (1 - abs(fc.i/25.0::DOUBLE - ccol))*(1 - abs(fr.i/25.0::DOUBLE - crow)) AS w) ww, spec "
        "WHERE fc.i BETWEEN 0 AND 25*((nx + 3)//4 - 1) AND fr.i BETWEEN 0 AND 25*((ny + 3)//4 - 1) GROUP BY date, fc.i, fr.i) GROUP BY date, \"row\"",
        p.COARSE,
    ),
)
def bilinear_upsample_25(spark, sf):
    """All scenes, 25 times finer; per raster line the cells, their sum and their moment along the line."""
    scenes, coarse_grid = g.coarse(spark, sf)
    fine = Grid(
        coarse_grid.x0,
        coarse_grid.y0,
        coarse_grid.step / 25,
        coarse_grid.ncols * 25,
        coarse_grid.nrows * 25,
    )
    up = regrid.bilinear(scenes, "melt", coarse_grid, fine).withColumn("melt", F.round("melt", 6))
    return plain(
        up.groupBy("date", "row").agg(
            F.count("*").alias("n"),
            F.sum("melt").alias("total"),
            F.sum(F.col("melt") * (F.col("col") + 1)).alias("moment"),
        )
    )


@query(
    "j13_cell_lookup",
    p.sql(
        f"SELECT {p.d('px.date')}, px.x, px.y, CAST(c.melt AS INTEGER) AS melt FROM px LEFT JOIN coarse c "
        "ON c.date = px.date AND c.ccol = px.col//4 AND c.crow = px.\"row\"//4 WHERE px.mw_value = 1",
        p.COARSE,
    ),
)
def cell_lookup(spark, sf):
    scenes, coarse_grid = g.coarse(spark, sf)
    points = g.pixels(spark, sf).where("mw_value = 1").select("date", "x", "y")
    out = regrid.cell_lookup(points, scenes, "melt", coarse_grid)
    return plain(out.select("date", "x", "y", "melt"))


POINT = (-627100.0, -668300.0)


@query(
    "j14_series_at_nearest_cell",
    p.sql(
        f"SELECT {p.d()}, x, y, CAST(mw_value AS INTEGER) AS mw_value, {p.r('opt_value', 'opt_value')} FROM px "
        f"WHERE (x, y) = (SELECT (x, y) FROM cells ORDER BY abs(x - {POINT[0]}) + abs(y - {POINT[1]}), x, y LIMIT 1)"
    ),
)
def series_at_nearest_cell(spark, sf):
    rows = g.pixels(spark, sf).select("date", "x", "y", "mw_value", "opt_value")
    return plain(j.series_at(rows, g.cells(spark, sf), *POINT))


@query(
    "j15_align_on_coordinates",
    p.sql(
        f"SELECT {p.d('a.date')}, a.x, a.y, {p.r('a.opt_value', 'opt_value')} FROM px a "
        "WHERE a.opt_value IS NOT NULL AND (a.x, a.y) IN (SELECT (x, y) FROM px WHERE mw_value = 1 AND year(date) = 2018)"
    ),
)
def align_on_coordinates(spark, sf):
    other = g.pixels(spark, sf).where((F.col("mw_value") == 1) & (F.year("date") == 2018))
    return plain(j.align(opt(spark, sf), other))


@query(
    "j16_gap_fill",
    p.sql(
        f"SELECT {p.d('a.date')}, a.x, a.y, {p.r('coalesce(a.opt_value, p.v)', 'filled')}, "
        f"{p.r('CASE WHEN a.opt_value IS NULL THEN p.v END', 'gap_only')} FROM px a LEFT JOIN "
        "(SELECT x, y, avg(opt_value) AS v FROM px GROUP BY x, y) p ON p.x = a.x AND p.y = a.y WHERE NOT a.is_water"
    ),
)
def gap_fill(spark, sf):
    ice = g.pixels(spark, sf).where("NOT is_water").select("date", "x", "y", "opt_value")
    per_cell = ice.groupBy("x", "y").agg(F.avg("opt_value").alias("prediction"))
    out = j.gap_fill(ice, per_cell, "opt_value", "prediction", on=("x", "y"))
    return plain(out.select("date", "x", "y", "filled", "gap_only"))


def _two_days(spark, sf):
    rows = g.pixels(spark, sf).where("NOT is_water")
    return (
        rows.where("date = '2019-06-08'").select("x", "y", "mw_value", "opt_raw"),
        rows.where("date = '2019-06-09'").select("x", "y", "mw_value", "opt_raw"),
    )


TWO_DAYS = (
    "FROM (SELECT * FROM px WHERE NOT is_water AND date = DATE '2019-06-08') a JOIN "
    "(SELECT * FROM px WHERE NOT is_water AND date = DATE '2019-06-09') b ON a.x = b.x AND a.y = b.y"
)


@query(
    "j17_layer_sum", p.sql(f"SELECT a.x, a.y, {p.r('a.opt_raw + b.opt_raw', 'total')} {TWO_DAYS}")
)
def layer_sum(spark, sf):
    return plain(j.layer_sum(*_two_days(spark, sf), "opt_raw"))


@query(
    "j17_layer_agreement",
    p.sql(
        f"SELECT 'mw_value' AS layer, count(*) AS n_cells, count(*) FILTER (WHERE a.mw_value = b.mw_value) AS n_equal {TWO_DAYS} "
        f"UNION ALL SELECT 'opt_raw', count(*), count(*) FILTER (WHERE a.opt_raw = b.opt_raw) {TWO_DAYS}"
    ),
)
def layer_agreement(spark, sf):
    a, b = _two_days(spark, sf)
    parts = [
        j.agreement(a, b, v).select(F.lit(v).alias("layer"), "n_cells", "n_equal") for v in ("mw_value", "opt_raw")
    ]
    return parts[0].union(parts[1])


@query(
    "j18_overlap_window",
    p.sql(
        "SELECT c.x, c.y FROM cells c, (SELECT max(x0) x0, min(x1) x1, max(y0) y0, min(y1) y1 FROM "
        "(SELECT min(x) x0, max(x) x1, min(y) y0, max(y) y1 FROM cells WHERE col >= 3 AND \"row\" >= 2 UNION ALL "
        " SELECT min(x), max(x), min(y), max(y) FROM cells WHERE col <= 18 AND \"row\" <= 15)) b "
        "WHERE c.col >= 3 AND c.\"row\" >= 2 AND c.x BETWEEN x0 AND x1 AND c.y BETWEEN y0 AND y1"
    ),
)
def overlap_window(spark, sf):
    cells = g.cells(spark, sf)
    a, b = cells.where("col >= 3 AND row >= 2"), cells.where("col <= 18 AND row <= 15")
    return f.overlap(a.select("x", "y"), b.select("x", "y"))[0]


@query(
    "j19_melt_contingency",
    p.sql(
        "SELECT CAST(mw_value AS INTEGER) AS mw_melt, (opt_value/4 >= 0.64) AS opt_melt, count(*) AS n "
        "FROM px WHERE opt_value IS NOT NULL GROUP BY ALL"
    ),
)
def melt_contingency(spark, sf):
    rows = g.pixels(spark, sf).where("opt_value IS NOT NULL")
    return plain(
        j.contingency(
            rows, F.col("mw_value"), F.col("opt_value") / 4 >= MELT_THRESHOLD, ("mw_melt", "opt_melt")
        )
    )
