"""W: ranks, history windows, focal windows, terrain and distance; and the flagship query."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog import prelude as p
from firnline.catalog.joins import MARGIN, TERRAIN, history_cte
from firnline.catalog.registry import plain, query
from firnline.operators import distance as dist
from firnline.operators import terrain as t
from firnline.operators.filters import with_region, without_water
from firnline.operators.focal import focal, melt_for_windows
from firnline.operators.temporal import earlier_values, grid_ranks
from firnline.sources import driver_grid as g


@query(
    "flagship_daily_region_summary",
    p.sql(
        f"""SELECT {p.d('date')}, region, count(*) AS n, {p.r('avg(mean_3)', 'mean_focal')},
        {p.r('avg(week)', 'mean_week')}, {p.r('avg(ln(1 + opt_value))', 'mean_log_opt')}
        FROM (SELECT a.date, a.mw_value, a.opt_value, CASE WHEN a."row" < ny // 2 THEN 'North' ELSE 'South' END AS region,
          r.mean_3, h.mw_value_7_day_average AS week FROM (SELECT px.*, ny FROM px, spec) a
          JOIN hist h ON h.date = a.date AND h.col = a.col AND h."row" = a."row"
          JOIN (SELECT a.date, a.col, a."row", avg(b.mw_value) AS mean_3 FROM px a JOIN px b ON b.date = a.date
            AND abs(b.col - a.col) <= 1 AND abs(b."row" - a."row") <= 1 AND b.mw_value <> -1 GROUP BY ALL) r
          ON r.date = a.date AND r.col = a.col AND r."row" = a."row" WHERE a.mw_value <> -1)
        GROUP BY date, region""",
        history_cte("px"),
    ),
)
def daily_region_summary(spark, sf):
    grid = g.grid_of(spark, sf)
    pixels = g.pixels(spark, sf).drop("opt_raw", "is_water")
    around = without_water(focal(pixels, melt_for_windows(F.col("mw_value")), {"mean_3": (3, "mean")}, tasks=g.tasks_of(grid)))
    scenes = spark.range(1).select(F.explode(g.scene_dates()).alias("date"))
    history = earlier_values(around, scenes=scenes, tasks=g.tasks_of(grid), cell=("col", "row"))
    return plain(
        with_region(history, grid.nrows // 2)
        .groupBy("date", "region")
        .agg(
            F.count("*").alias("n"),
            F.avg("mean_3").alias("mean_focal"),
            F.avg("mw_value_7_day_average").alias("mean_week"),
            F.avg(F.log1p("opt_value")).alias("mean_log_opt"),
        )
    )


@query(
    "w01_grid_ranks",
    p.sql(
        "SELECT x, y, CAST(dense_rank() OVER (ORDER BY x) - 1 AS INTEGER) AS col, "
        "CAST(dense_rank() OVER (ORDER BY y DESC) - 1 AS INTEGER) AS \"row\" FROM (SELECT x, y FROM cells WHERE (col + \"row\") % 3 <> 0)"
    ),
)
def grid_ranks_by_rank(spark, sf):
    cells = g.cells(spark, sf).where((F.col("col") + F.col("row")) % 3 != 0).select("x", "y")
    return grid_ranks(cells).select("x", "y", "col", "row")


@query("w01_grid_ranks_by_contract", p.sql("SELECT x, y, col, \"row\" FROM cells"))
def grid_ranks_by_contract(spark, sf):
    return grid_ranks(g.cells(spark, sf).select("x", "y"), g.grid_of(spark, sf))


HISTORY_OUT = (
    f"SELECT {p.d()}, col, \"row\", {p.r('mw_value_yesterday', 'mw_value_yesterday')}, "
    f"{p.r('mw_value_7_day_average', 'mw_value_7_day_average')} FROM hist"
)


def _history(pixels):
    out = earlier_values(without_water(pixels))
    return plain(out.select("date", "col", "row", "mw_value_yesterday", "mw_value_7_day_average"))


@query("w02_w03_yesterday_and_week", p.sql(HISTORY_OUT, history_cte("px")))
def yesterday_and_week(spark, sf):
    return _history(g.pixels(spark, sf))


@query("w02_w03_with_missing_scenes", p.sql(HISTORY_OUT, p.GAP, history_cte("gap")))
def with_missing_scenes(spark, sf):
    return _history(g.gap_pixels(spark, sf))


def _brute(size: int, agg: str, name: str) -> str:
    h = size // 2
    return p.sql(
        f"SELECT {p.d('a.date')}, a.col, a.\"row\", {agg} AS {name} FROM px a LEFT JOIN px b ON b.date = a.date "
        f"AND b.col BETWEEN a.col - {h} AND a.col + {h} AND b.\"row\" BETWEEN a.\"row\" - {h} AND a.\"row\" + {h} "
        "AND b.mw_value <> -1 GROUP BY a.date, a.col, a.\"row\""
    )


def _focal(spark, sf, size, stat, name):
    out = focal(
        g.pixels(spark, sf).select("date", "col", "row", "mw_value"),
        melt_for_windows(F.col("mw_value")),
        {name: (size, stat)},
        band_lines=8,
        tasks=2 * g.tasks_of(g.grid_of(spark, sf)),  # bands of 8 lines share up to as many with others
    )
    return plain(out.select("date", "col", "row", name))


@query("w04_focal_mean_3", _brute(3, "round(avg(b.mw_value), 6) + 0.0", "mean_3"))
def focal_mean_3(spark, sf):
    return _focal(spark, sf, 3, "mean", "mean_3")


@query("w04_focal_mean_9", _brute(9, "round(avg(b.mw_value), 6) + 0.0", "mean_9"))
def focal_mean_9(spark, sf):
    return _focal(spark, sf, 9, "mean", "mean_9")


@query("w05_focal_sum_5", _brute(5, "CAST(sum(b.mw_value) AS BIGINT)", "sum_5"))
def focal_sum_5(spark, sf):
    return _focal(spark, sf, 5, "sum", "sum_5")


@query("w06_focal_max_3", _brute(3, "CAST(max(b.mw_value) AS BIGINT)", "max_3"))
def focal_max_3(spark, sf):
    return _focal(spark, sf, 3, "max", "max_3")


@query("w06_focal_min_5", _brute(5, "CAST(min(b.mw_value) AS BIGINT)", "min_5"))
def focal_min_5(spark, sf):
    return _focal(spark, sf, 5, "min", "min_5")


@query("w07_slope", p.sql(f"SELECT col, \"row\", {p.r('slope_data', 'slope_data')} FROM terrain", TERRAIN))
def slope(spark, sf):
    return plain(t.slope_and_aspect(g.cells(spark, sf)).select("col", "row", "slope_data"))


@query("w08_aspect_cosine", p.sql(f"SELECT col, \"row\", {p.r('aspect_data', 'aspect_data')} FROM terrain", TERRAIN))
def aspect_cosine(spark, sf):
    return plain(t.slope_and_aspect(g.cells(spark, sf)).select("col", "row", "aspect_data"))


@query(
    "w09_distance_to_margin",
    p.sql(f"SELECT col, \"row\", {p.r('distance_to_margin', 'distance_to_margin')} FROM margin", MARGIN),
)
def distance_to_margin(spark, sf):
    return plain(dist.distance_to_margin(g.cells(spark, sf)))


@query(
    "w10_nearest_water_cell",
    p.sql(
        f"SELECT col, \"row\", CAST(near.nr AS INTEGER) AS near_row, CAST(near.nc AS INTEGER) AS near_col, {p.r('1000*sqrt(near.sq)', 'metres')} FROM "
        "(SELECT a.col, a.\"row\", min({'sq': (a.col-b.col)*(a.col-b.col) + (a.\"row\"-b.\"row\")*(a.\"row\"-b.\"row\"), 'nr': b.\"row\", 'nc': b.col}) AS near "
        "FROM cells a, (SELECT col, \"row\" FROM cells WHERE is_water) b GROUP BY a.col, a.\"row\")"
    ),
)
def nearest_water_cell(spark, sf):
    return plain(dist.metric_distance(g.cells(spark, sf), "is_water"))


SHORE = """shore AS (SELECT c.col, c."row" FROM cells c WHERE c.is_water AND EXISTS (SELECT 1 FROM cells i
  WHERE NOT i.is_water AND abs(i.col - c.col) + abs(i."row" - c."row") = 1))"""


@query("w11_shore_cells", p.sql("SELECT col, \"row\" FROM shore", SHORE))
def shore_cells(spark, sf):
    return t.shore_cells(g.cells(spark, sf)).select("col", "row")


@query(
    "w12_shore_distance",
    p.sql(
        f"SELECT a.col, a.\"row\", {p.r('min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y)))', 'metres')} "
        "FROM (SELECT * FROM cells WHERE NOT is_water) a, (SELECT c.* FROM cells c JOIN shore s ON s.col = c.col AND s.\"row\" = c.\"row\") b "
        "GROUP BY a.col, a.\"row\"",
        SHORE,
    ),
)
def shore_distance(spark, sf):
    cells = g.cells(spark, sf)
    shore = t.shore_cells(cells).select("row", "col", F.lit(True).alias("on_shore"))
    flagged = cells.join(shore, ["row", "col"], "left").withColumn("on_shore", F.coalesce("on_shore", F.lit(False)))
    metres = dist.metric_distance(flagged, "on_shore").select("row", "col", "metres")
    ice = cells.where("NOT is_water").select("row", "col")
    return plain(ice.join(metres, ["row", "col"]))
