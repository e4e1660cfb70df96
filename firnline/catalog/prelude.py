"""The derived tables of ``firnline.sources.driver_grid`` as SQL common table expressions."""

from __future__ import annotations

SPEC = """spec AS (
  SELECT CAST(greatest(24, floor(24*sqrt(count(*)/2000.0))) AS BIGINT) AS nx,
         CAST(greatest(20, floor(20*sqrt(count(*)/2000.0))) AS BIGINT) AS ny FROM part)"""

OBS = """obs AS (
  SELECT CAST(l_partkey % nx AS INTEGER) AS col, CAST(l_suppkey % ny AS INTEGER) AS "row",
         CAST(make_date(CAST(2017 + d // 500 AS INTEGER), 6, 1) + CAST(d % 28 AS INTEGER) AS DATE) AS date,
         sum(l_quantity)/10 AS opt_raw, max(l_quantity) AS mq
  FROM (SELECT l_partkey, l_suppkey, l_quantity,
               date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) AS d FROM lineitem), spec
  GROUP BY ALL)"""

CELLS = """cells AS (
  SELECT -636500.0::DOUBLE + 1000.0::DOUBLE*col AS x, -662500.0::DOUBLE - 1000.0::DOUBLE*"row" AS y,
         CAST(col AS INTEGER) AS col, CAST("row" AS INTEGER) AS "row",
         (col IN (0, nx-1) OR "row" IN (0, ny-1) OR (col*7 + "row"*13 + coalesce(sizes, 0)) % 23 < 2) AS is_water,
         3000.0::DOUBLE - 2.0::DOUBLE*(power(col*24.0::DOUBLE/nx - 12.0, 2) + 5.0::DOUBLE*power("row"*20.0::DOUBLE/ny - 10.0, 2)) + 0.125::DOUBLE*coalesce(sizes, 0) AS elevation_data
  FROM (SELECT id % nx AS col, id // nx AS "row", nx, ny
        FROM (SELECT unnest(range(nx*ny)) AS id, nx, ny FROM spec))
  LEFT JOIN (SELECT p_partkey % nx AS col, (p_partkey // nx) % ny AS "row", CAST(sum(p_size) AS BIGINT) AS sizes
             FROM part, spec GROUP BY ALL) USING (col, "row"))"""

SCENES = """scenes AS (
  SELECT CAST(make_date(CAST(2017 + s AS INTEGER), 6, 1) + CAST(k AS INTEGER) AS DATE) AS date
  FROM range(5) a(s), range(28) b(k))"""

PX = """px AS (
  SELECT date, col, "row", x, y, is_water,
         CASE WHEN is_water THEN -1
              WHEN r20 >= 3 AND coalesce(mq, 0) >= (CASE WHEN r20 < 7 THEN 50 ELSE 46 - r20 END) THEN 1
              ELSE 0 END AS mw_value,
         CASE WHEN NOT is_water THEN opt_raw END AS opt_raw,
         CASE WHEN NOT is_water THEN (CASE WHEN opt_raw > 5 THEN 5.0 ELSE opt_raw END) END AS opt_value
  FROM (SELECT d.date, d.col, d."row", d.x, d.y, d.is_water, o.opt_raw, o.mq, d."row"*20 // ny AS r20
        FROM (SELECT c.*, s.date, spec.ny FROM cells c, scenes s, spec) d
        LEFT JOIN obs o ON d.date = o.date AND d.col = o.col AND d."row" = o."row"))"""

BASE = "WITH " + ",\n".join([SPEC, OBS, CELLS, SCENES, PX])

GAP = "gap AS (SELECT * FROM px WHERE strftime(date, '%m-%d') <> '06-10')"

STATION = "station AS (SELECT ts, CAST(user_id % 3 AS INTEGER) AS level, value FROM events)"

ALBEDO = """alb AS (
  SELECT date, x, y, ((col*31 + "row"*17 + day(date)) % 100) / 100.0::DOUBLE AS albedo
  FROM px WHERE day(date) % 2 = 0)"""

COARSE = """coarse AS (
  SELECT date, col//4 AS ccol, "row"//4 AS crow, max(mw_value) AS melt
  FROM px GROUP BY ALL)"""

MASKS = """melt_days AS (
  SELECT x, y, count(*) FILTER (WHERE mw_value = 1) AS melt_days FROM px WHERE mw_value <> -1 GROUP BY x, y),
nomelt AS (SELECT x, y, CASE WHEN melt_days = 0 THEN 0 ELSE 1 END AS melt FROM melt_days),
littlemelt AS (SELECT x, y, CASE WHEN melt_days IN (2, 3) THEN 0 ELSE 1 END AS melt FROM melt_days)"""


def sql(body: str, *extra: str) -> str:
    """A statement over the derived tables; ``extra`` are further CTEs."""
    return BASE + "".join(",\n" + e for e in extra) + "\n" + body


def r(expr: str, alias: str | None = None) -> str:
    """Six decimals, without a negative zero."""
    text = f"round(CAST({expr} AS DOUBLE), 6) + 0.0"
    return f"{text} AS {alias}" if alias else text


def d(expr: str = "date", alias: str = "date") -> str:
    return f"strftime({expr}, '%Y-%m-%d') AS {alias}"
