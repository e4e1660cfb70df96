"""A: aggregations, binned error statistics, distributions and scores."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from firnline.catalog import prelude as p
from firnline.catalog.registry import plain, query
from firnline.functions import normal
from firnline.functions.scalars import MELT_THRESHOLD
from firnline.ml import metrics
from firnline.ml.ensemble import ensemble_statistics
from firnline.operators import aggregates as a
from firnline.operators import binning as b
from firnline.operators import masks as m
from firnline.operators import ranks
from firnline.operators.filters import keyed_sample, with_region
from firnline.plans.quality import dates_to_remove, without_bad_dates
from firnline.session import checkpointed
from firnline.sources import driver_grid as g

YEARS = range(g.FIRST_YEAR, g.FIRST_YEAR + g.N_SEASONS)


@query(
    "a01_melt_days_per_year",
    p.sql("SELECT x, y, CAST(year(date) AS INTEGER) AS year, count(*) AS counts FROM px WHERE mw_value = 1 GROUP BY ALL"),
)
def melt_days_per_year(spark, sf):
    return m.melt_days(g.pixels(spark, sf))


@query(
    "a02_total_melt_days",
    p.sql("SELECT x, y, count(*) AS counts FROM px WHERE mw_value = 1 GROUP BY x, y"),
)
def total_melt_days(spark, sf):
    return m.total_melt_days(m.melt_days(g.pixels(spark, sf)))


@query(
    "a02_melt_days_rollup",
    p.sql(
        "SELECT x, y, CAST(year(date) AS INTEGER) AS year, count(*) AS counts FROM px WHERE mw_value = 1 "
        "GROUP BY GROUPING SETS ((x, y, year(date)), (x, y))"
    ),
)
def melt_days_rollup(spark, sf):
    return m.melt_days_rollup(g.pixels(spark, sf))


@query(
    "a03_little_melt_share",
    p.sql(
        f"SELECT count(*) FILTER (WHERE melt_days IN (2, 3)) AS n_little, "
        f"{p.r('avg(CASE WHEN melt_days IN (2, 3) THEN 1.0 ELSE 0.0 END)', 'share')}, "
        f"round(100.0 * count(*) FILTER (WHERE melt_days IN (2, 3)) / (SELECT count(*) FROM cells), 2) AS percent_of_area "
        "FROM melt_days WHERE melt_days > 0",
        p.MASKS,
    ),
)
def little_melt_share(spark, sf):
    totals = m.total_melt_days(m.melt_days(g.pixels(spark, sf)))
    n_cells = g.cells(spark, sf).agg(F.count("*")).scalar()
    few = F.col("counts").isin(2, 3)
    return plain(
        totals.agg(F.count_if(few).alias("n_little"), a.share(few).alias("share")).select(
            "n_little", "share", F.round(100.0 * F.col("n_little") / n_cells, 2).alias("percent_of_area")
        )
    )


@query(
    "a04_missing_share_per_date",
    p.sql(
        f"SELECT {p.d()}, {p.r('(count(*) - count(opt_value)) / count(*)', 'missing_share')} FROM px GROUP BY date"
    ),
)
def missing_share_per_date(spark, sf):
    return plain(a.missing_share(g.pixels(spark, sf)))


MANUAL = ("2017-06-30", "2018-06-07", "2019-06-26")
LIMIT = 0.57
BAD = (
    "bad AS (SELECT date FROM px GROUP BY date HAVING (count(*) - count(opt_value)) / count(*) > 0.57 "
    "AND strftime(date, '%m-%d') <= '09-10' UNION SELECT unnest([DATE '2017-06-30', DATE '2018-06-07', DATE '2019-06-26']))"
)


@query("a05_bad_dates", p.sql(f"SELECT {p.d()} FROM bad ORDER BY date", BAD))
def bad_dates(spark, sf):
    return plain(dates_to_remove(g.pixels(spark, sf), LIMIT, MANUAL).orderBy("date"))


@query(
    "a05_without_bad_dates",
    p.sql(
        f"SELECT {p.d()}, count(*) AS n, count(opt_value) AS n_opt FROM px WHERE date NOT IN (SELECT date FROM bad) GROUP BY date",
        BAD,
    ),
)
def pixels_without_bad_dates(spark, sf):
    pixels = g.pixels(spark, sf)
    good = without_bad_dates(pixels, dates_to_remove(pixels, LIMIT, MANUAL))
    return plain(good.groupBy("date").agg(F.count("*").alias("n"), F.count("opt_value").alias("n_opt")))


@query(
    "a06_describe",
    p.sql(
        "SELECT count(opt_raw) AS n, "
        + ", ".join(
            p.r(e, n)
            for e, n in (
                ("avg(opt_raw)", "mean"),
                ("stddev_samp(opt_raw)", "std"),
                ("min(opt_raw)", "min"),
                ("max(opt_raw)", "max"),
                ("quantile_cont(opt_raw, 0.25)", "q25"),
                ("quantile_cont(opt_raw, 0.5)", "q50"),
                ("quantile_cont(opt_raw, 0.75)", "q75"),
            )
        )
        + " FROM px"
    ),
)
def describe(spark, sf):
    return plain(a.describe(g.pixels(spark, sf), "opt_raw"))


@query(
    "a06_first_and_last_date",
    p.sql(f"SELECT {p.d('min(date)', 'first_date')}, {p.d('max(date)', 'last_date')} FROM px WHERE mw_value = 1"),
)
def first_and_last_date(spark, sf):
    rows = g.pixels(spark, sf).where("mw_value = 1")
    return plain(rows.agg(F.min("date").alias("first_date"), F.max("date").alias("last_date")))


@query(
    "a07_exact_quantile",
    p.sql(
        f"SELECT {p.r('quantile_cont(opt_raw, 0.01)', 'q01')}, {p.r('quantile_cont(opt_raw, 0.99)', 'q99')} FROM px"
    ),
)
def exact_quantile(spark, sf):
    q = ranks.exact_quantiles(g.pixels(spark, sf), "opt_raw", (0.01, 0.99))
    return plain(q.select(F.col("q")[0].alias("q01"), F.col("q")[1].alias("q99")))


@query(
    "a08_value_counts",
    p.sql(
        "SELECT CAST(mw_value AS INTEGER) AS mw_value, count(*) AS n, "
        "CAST((SELECT mw_value FROM px GROUP BY mw_value ORDER BY count(*) DESC, mw_value LIMIT 1) AS INTEGER) AS majority "
        "FROM px GROUP BY mw_value"
    ),
)
def value_counts(spark, sf):
    pixels = g.pixels(spark, sf)
    return plain(
        a.value_counts(pixels, "mw_value").withColumn("majority", a.majority(pixels, "mw_value").cast("int"))
    )


@query(
    "a09_daily_station_mean",
    p.sql(
        f"SELECT {p.d('CAST(ts AS DATE)')}, level, {p.r('avg(value)', 'value')} FROM station GROUP BY CAST(ts AS DATE), level",
        p.STATION,
    ),
)
def daily_station_mean(spark, sf):
    return plain(a.daily_mean(g.station(spark, sf), "value", ["level"]))


# Predictions: five models, each the mean log value of the cell over the other four seasons.
def predictions(spark, sf):
    """Ice pixels with an observed value, its log and the five leave-one-season-out predictions."""
    rows = g.pixels(spark, sf).where("opt_value IS NOT NULL").withColumn("season", F.year("date"))
    log = F.log1p("opt_value")
    per_cell = rows.groupBy("x", "y").agg(
        *[F.avg(F.when(F.col("season") != k, log)).alias(f"p{i}") for i, k in enumerate(YEARS)]
    )
    per_cell = per_cell.select("x", "y", *[F.round(f"p{i}", 6).alias(f"p{i}") for i in range(5)])
    return rows.withColumn("log_value", log).join(per_cell, ["x", "y"])


PREDICTIONS = (
    "cellmeans AS (SELECT x, y, "
    + ", ".join(
        f"round(avg(ln(1 + opt_value)) FILTER (WHERE year(date) <> {k}), 6) AS p{i}" for i, k in enumerate(YEARS)
    )
    + " FROM px WHERE opt_value IS NOT NULL GROUP BY x, y),\n"
    "pred AS (SELECT px.*, year(date) AS season, ln(1 + opt_value) AS log_value, p0, p1, p2, p3, p4 "
    "FROM px JOIN cellmeans c ON c.x = px.x AND c.y = px.y WHERE opt_value IS NOT NULL)"
)
BACK = [f"(exp(p{i}) - 1)" for i in range(5)]
MEAN_SQL = "(" + " + ".join(BACK) + ")/5"
ENSEMBLE = (
    PREDICTIONS
    + f",\nens0 AS (SELECT *, {MEAN_SQL} AS mp FROM pred),\n"
    + "ens AS (SELECT *, round(mp, 6) AS mean_prediction, sqrt(("
    + " + ".join(f"power({e} - mp, 2)" for e in BACK)
    + ")/5) AS std_prediction, abs(mp - opt_value) AS error_prediction, opt_value - mp AS residual_prediction FROM ens0)"
)


def ensemble(spark, sf):
    """Ensemble statistics, the mean rounded so that both engines bin the same numbers."""
    out = ensemble_statistics(
        predictions(spark, sf), [f"p{i}" for i in range(5)], "log_value", ("date", "row", "col", "opt_value")
    )
    return out.withColumn("mean_prediction", F.round("mean_prediction", 6))


@query(
    "a10_mean_error_per_bin",
    p.sql(
        "SELECT CAST(l.bin AS INTEGER) AS bin, round(0.05 + l.bin*0.1::DOUBLE, 6) + 0.0 AS label, "
        f"{p.r('avg(e.error_prediction)', 'mean_error')}, count(e.opt_value) AS n "
        "FROM (SELECT unnest(range(CAST(ceil((max(opt_value) - min(opt_value))/0.1::DOUBLE) AS BIGINT))) AS bin FROM ens) l "
        "LEFT JOIN (SELECT e.*, ceil((opt_value - lo)/0.1::DOUBLE) - 1 AS bin FROM ens e, (SELECT min(opt_value) AS lo FROM ens)) e ON e.bin = l.bin "
        "GROUP BY l.bin",
        ENSEMBLE,
    ),
)
def mean_error_per_bin(spark, sf):
    return plain(b.error_by_value(ensemble(spark, sf), "opt_value", "error_prediction"))


@query(
    "a11_error_grid",
    p.sql(
        "SELECT CAST(least(ceil((opt_value - lo)/w) - 1, 99) AS INTEGER) AS real_bin, "
        "CAST(least(ceil((mean_prediction - lo)/w) - 1, 99) AS INTEGER) AS pred_bin, "
        f"{p.r('avg(error_prediction)', 'mean_error')}, count(*) AS n "
        "FROM ens, (SELECT least(min(opt_value), min(mean_prediction)) AS lo, "
        "(greatest(max(opt_value), max(mean_prediction)) - least(min(opt_value), min(mean_prediction)))/100 AS w FROM ens) "
        "WHERE opt_value > lo AND mean_prediction > lo GROUP BY ALL",
        ENSEMBLE,
    ),
)
def error_grid(spark, sf):
    return plain(b.error_grid(ensemble(spark, sf), "opt_value", "mean_prediction", "error_prediction", 100))


@query(
    "a12_prediction_per_bin",
    p.sql(
        f"SELECT CAST(floor((opt_value - lo)/0.25::DOUBLE) AS INTEGER) AS bin, "
        "((2*sum(CAST(round(mean_prediction*1000000) AS BIGINT)) + count(*)) // (2*count(*)))::DOUBLE/1000000.0::DOUBLE AS mean_prediction, count(*) AS n "
        "FROM ens, (SELECT min(opt_value) AS lo FROM ens) GROUP BY ALL",
        ENSEMBLE,
    ),
)
def prediction_per_bin(spark, sf):
    return plain(b.prediction_by_value(ensemble(spark, sf), "opt_value", "mean_prediction", digits=6))


DENSITY = (
    ENSEMBLE
    + """,
lim AS (SELECT min(opt_value) x0, max(opt_value) x1, min(mean_prediction) y0, max(mean_prediction) y1, count(*) AS total FROM ens),
binned AS (SELECT ens.*, CAST(least(floor((opt_value - x0)/(x1 - x0)*20), 19) AS INTEGER) AS bin_x,
  CAST(least(floor((mean_prediction - y0)/(y1 - y0)*20), 19) AS INTEGER) AS bin_y,
  total*((x1 - x0)/20*((y1 - y0)/20)) AS unit FROM ens, lim),
dens AS (SELECT *, count(*) OVER (PARTITION BY bin_x, bin_y)/unit AS density FROM binned)"""
)


@query(
    "a13_density_2d",
    p.sql(f"SELECT {p.d()}, col, \"row\", bin_x, bin_y, {p.r('density', 'density')} FROM dens", DENSITY),
)
def density_2d(spark, sf):
    out = b.density(ensemble(spark, sf), "opt_value", "mean_prediction", 20)
    return plain(out.select("date", "col", "row", "bin_x", "bin_y", "density"))


@query(
    "o04_sample_by_density",
    p.sql(
        f"SELECT {p.d()}, col, \"row\", {p.r('density', 'density')} FROM dens "
        "WHERE CAST(('0x' || substr(md5('1,' || strftime(date, '%Y-%m-%d') || ',' || col || ',' || \"row\"), 1, 8)) AS BIGINT) < 343597383 "
        "ORDER BY density",
        DENSITY,
    ),
)
def sample_by_density(spark, sf):
    out = b.density(ensemble(spark, sf), "opt_value", "mean_prediction", 20)
    kept = keyed_sample(out, ["date", "col", "row"], 0.08)
    return plain(kept.select("date", "col", "row", "density").orderBy("density"))


HIST_COLUMNS = ("opt_raw", "opt_value", "x", "y")
HIST = (
    "feats AS (SELECT unnest(['opt_raw', 'opt_value', 'x', 'y']) AS feature, "
    "unnest([opt_raw, opt_value, x, y]) AS value FROM px WHERE NOT is_water),\n"
    "lims AS (SELECT feature, min(value) AS lo, max(value) AS hi FROM feats WHERE value IS NOT NULL GROUP BY feature),\n"
    "hist AS (SELECT feature, CAST(least(floor((value - lo)/(hi - lo)*100), 99) AS INTEGER) AS bin, lo, hi, count(*) AS n "
    "FROM feats JOIN lims USING (feature) WHERE value IS NOT NULL GROUP BY ALL)"
)


@query(
    "a14_histograms",
    p.sql(
        f"SELECT feature, bin, {p.r('lo + bin*(hi - lo)/100', 'left_edge')}, {p.r('(hi - lo)/100', 'width')}, n FROM hist",
        HIST,
    ),
)
def histograms(spark, sf):
    return plain(b.histograms(g.pixels(spark, sf).where("NOT is_water"), HIST_COLUMNS))


@query(
    "a14_histogram_density",
    p.sql(
        f"SELECT feature, bin, {p.r('n/(sum(n) OVER (PARTITION BY feature)*((hi - lo)/100))', 'density')} FROM hist",
        HIST,
    ),
)
def histogram_density(spark, sf):
    hist = b.histograms(g.pixels(spark, sf).where("NOT is_water"), HIST_COLUMNS)
    return plain(b.with_density(hist).select("feature", "bin", "density"))


@query(
    "a14_log_histogram",
    p.sql(
        "SELECT CAST(least(floor((log10(opt_raw + 0.01234) - 0)/2*40), 39) AS INTEGER) AS bin, count(*) AS n "
        "FROM px WHERE opt_raw + 0.01234 BETWEEN 1 AND 100 GROUP BY ALL"
    ),
)
def log_histogram(spark, sf):
    rows = g.pixels(spark, sf).withColumn("v", F.col("opt_raw") + 0.01234)
    return b.log_spaced_histogram(rows, "v", 1.0, 100.0, 40)


@query(
    "a15_kernel_density",
    p.sql(
        f"SELECT {p.r('point', 'point')}, {p.r('sum(c*exp(-0.5*power((point - v)/h, 2)))/(any_value(total)*any_value(h)*sqrt(2*pi()))', 'density')} FROM ("
        "SELECT lo - 3*h + k.i*(hi - lo + 6*h)/199 AS point, h, total FROM ("
        "SELECT count(opt_raw) AS total, stddev_samp(opt_raw)*power(count(opt_raw), -0.2) AS h, min(opt_raw) lo, max(opt_raw) hi FROM px) s, range(200) k(i)) g, "
        "(SELECT opt_raw AS v, count(*) AS c FROM px WHERE opt_raw IS NOT NULL GROUP BY opt_raw) d GROUP BY point"
    ),
)
def kernel_density(spark, sf):
    return plain(ranks.kernel_density(g.pixels(spark, sf), "opt_raw"))


CORR = ("mw_value", "opt_raw", "opt_value", "col", "row")
PAIRS = [(x, y) for i, x in enumerate(CORR) for y in CORR[i + 1 :]]


@query(
    "a16_correlations",
    p.sql(
        " UNION ALL ".join(
            f"SELECT '{x}' AS a, '{y}' AS b, round(corr(\"{x}\", \"{y}\"), 6) + 0.0 AS corr FROM px WHERE NOT is_water"
            for x, y in PAIRS
        )
    ),
)
def correlations(spark, sf):
    return plain(a.correlations(g.pixels(spark, sf).where("NOT is_water"), CORR))


def _poly(x: str, coefficients) -> str:
    out = repr(coefficients[0]) + "::DOUBLE"
    for c in coefficients[1:]:
        out = f"({out}*{x} + ({c!r})::DOUBLE)"
    return out


def inverse_sql(q: str) -> str:
    def tail(u):
        s = f"sqrt(-2*ln({u}))"
        return f"({_poly(s, normal.INV_C)}/{_poly(s, normal.INV_D)})"

    c, sq = f"({q} - 0.5)", f"(({q} - 0.5)*({q} - 0.5))"
    return (
        f"CASE WHEN {q} < 0.02425 THEN {tail(q)} WHEN {q} > 1 - 0.02425 THEN -{tail(f'(1 - {q})')} "
        f"ELSE {_poly(sq, normal.INV_A)}*{c}/{_poly(sq, normal.INV_B)} END"
    )


def log_cdf_sql(z: str) -> str:
    """Its own way: the power series around 0, and from 4 deviations on the tail's fraction."""
    u, half_log = f"abs({z})", repr(0.5 * math.log(2 * math.pi)) + "::DOUBLE"
    series = "1.0::DOUBLE"
    for k in range(60, 0, -1):
        series = f"(1 + {u}*{u}/{2 * k + 1}.0::DOUBLE*{series})"
    fraction = u
    for k in range(60, 0, -1):
        fraction = f"({u} + {k}.0::DOUBLE/{fraction})"
    near = f"ln(0.5::DOUBLE - exp(-{u}*{u}/2 - {half_log})*{u}*{series})"
    tail = f"(CASE WHEN {u} < 4 THEN {near} ELSE -{u}*{u}/2 - ln({fraction}) - {half_log} END)"
    return f"(CASE WHEN {z} > 0 THEN ln(1 - exp({tail})) ELSE {tail} END)"


def ordered_cte(source: str, value: str) -> str:
    """Order statistics with their theoretical quantiles."""
    return f"""ordered AS (SELECT i, n, v, {inverse_sql('q')} AS m FROM (
  SELECT *, CASE WHEN i = n THEN power(0.5, 1.0/n) WHEN i = 1 THEN 1 - power(0.5, 1.0/n) ELSE (i - 0.3175)/(n + 0.365) END AS q FROM (
  SELECT row_number() OVER (ORDER BY {value}) AS i, count(*) OVER () AS n, {value} AS v FROM {source} WHERE {value} IS NOT NULL)))"""


ORDERED = ordered_cte("px", "opt_raw")
QQ_FIT = (
    f"SELECT {p.r('regr_slope(v, m)', 'slope')}, {p.r('regr_intercept(v, m)', 'intercept')}, {p.r('corr(v, m)', 'r')}, count(*) AS n FROM ordered"
)


@query(
    "a17_qq_points",
    p.sql(f"SELECT i, {p.r('m', 'theoretical')}, {p.r('v', 'ordered')} FROM ordered", ORDERED),
)
def qq_points(spark, sf):
    return plain(ranks.qq_points(g.pixels(spark, sf), "opt_raw"))


@query("a17_qq_fit", p.sql(QQ_FIT, ORDERED))
def qq_fit(spark, sf):
    return plain(ranks.qq_fit(g.pixels(spark, sf), "opt_raw"))


def _anderson_sql(value: str) -> str:
    return (
        f"SELECT count(*) AS n, {p.r(f'-count(*) - sum((2*i - 1)*{log_cdf_sql('z')} + (2*n + 1 - 2*i)*{log_cdf_sql('(-z)')})/count(*)', 'statistic')} FROM "
        f"(SELECT row_number() OVER (ORDER BY v) AS i, count(*) OVER () AS n, (v - avg(v) OVER ())/stddev_samp(v) OVER () AS z "
        f"FROM (SELECT {value} AS v FROM px WHERE opt_raw IS NOT NULL))"
    )


@query(
    "a18_anderson_darling",
    p.sql(
        f"SELECT 'raw' AS scale, * FROM ({_anderson_sql('opt_raw')}) UNION ALL SELECT 'log', * FROM ({_anderson_sql('ln(1 + opt_raw)')})"
    ),
)
def anderson_darling(spark, sf):
    rows = g.pixels(spark, sf).withColumn("log_raw", F.log1p("opt_raw"))
    parts = [
        ranks.anderson_darling(rows, v).select(F.lit(k).alias("scale"), "n", "statistic")
        for k, v in (("raw", "opt_raw"), ("log", "log_raw"))
    ]
    return plain(parts[0].union(parts[1]))


LONG_SCORES = " UNION ALL ".join(
    f"SELECT {k} AS fold, CASE WHEN season = {k} THEN 'Test' ELSE 'Train' END AS \"set\", opt_value AS y, exp(p{i}) - 1 AS p FROM pred"
    for i, k in enumerate(YEARS)
)
SCORES = (
    PREDICTIONS
    + f",\nscored AS (SELECT fold, \"set\", count(*) AS n, avg((y - p)*(y - p)) AS mse, sqrt(avg((y - p)*(y - p))) AS rmse, "
    f"1 - avg((y - p)*(y - p))/var_pop(y) AS r2 FROM ({LONG_SCORES}) GROUP BY ALL)"
)


def fold_scores(spark, sf, rows=None):
    rows = predictions(spark, sf) if rows is None else rows
    models = {k: F.expm1(f"p{i}") for i, k in enumerate(YEARS)}
    return metrics.fold_scores(rows, F.col("opt_value"), models, "season")


@query(
    "a19_fold_scores",
    p.sql(
        f"SELECT CAST(fold AS INTEGER) AS fold, \"set\", n, {p.r('mse', 'mse')}, {p.r('rmse', 'rmse')}, {p.r('r2', 'r2')} FROM scored",
        SCORES,
    ),
)
def scores_per_fold(spark, sf):
    return plain(fold_scores(spark, sf))


@query(
    "a19_scores_by_season",
    p.sql(
        "SELECT CAST(season AS INTEGER) AS season, count(*) AS n, "
        + ", ".join(
            p.r(e, n)
            for e, n in (
                ("avg(power(opt_value - mean_prediction, 2))", "mse"),
                ("sqrt(avg(power(opt_value - mean_prediction, 2)))", "rmse"),
                ("1 - avg(power(opt_value - mean_prediction, 2))/var_pop(opt_value)", "r2"),
            )
        )
        + " FROM ens GROUP BY season",
        ENSEMBLE,
    ),
)
def scores_by_season(spark, sf):
    rows = ensemble(spark, sf).withColumn("season", F.year("date"))
    return plain(metrics.regression_scores(rows, "opt_value", "mean_prediction", ["season"]))


@query(
    "a20_accuracy",
    p.sql(
        f"SELECT count(*) AS n, {p.r('avg(CAST((opt_value >= 2.5) = (mean_prediction >= 2.5) AS INTEGER))', 'accuracy')} FROM ens",
        ENSEMBLE,
    ),
)
def accuracy(spark, sf):
    labels = ensemble(spark, sf).select(
        (F.col("opt_value") >= 2.5).alias("actual"), (F.col("mean_prediction") >= 2.5).alias("predicted")
    )
    return plain(metrics.accuracy(labels, "actual", "predicted"))


SUMMARY = ", ".join(
    p.r(e, n)
    for e, n in (
        ("avg(rmse)", "rmse"),
        ("stddev_pop(rmse)", "rmse_std"),
        ("avg(r2)", "r2"),
        ("stddev_pop(r2)", "r2_std"),
    )
)


@query("a21_cv_summary", p.sql(f"SELECT 'CellMean' AS model, \"set\", {SUMMARY} FROM scored GROUP BY \"set\"", SCORES))
def cv_summary(spark, sf):
    scores = fold_scores(spark, sf).withColumn("model", F.lit("CellMean"))
    return plain(metrics.cv_summary(scores))


GLOBAL_MEANS = " UNION ALL ".join(
    f"SELECT {k} AS fold, CASE WHEN season = {k} THEN 'Test' ELSE 'Train' END AS \"set\", opt_value AS y, "
    f"exp((SELECT avg(log_value) FROM pred WHERE season <> {k})) - 1 AS p FROM pred"
    for k in YEARS
)


@query(
    "a22_model_comparison",
    p.sql(
        f"SELECT model, \"set\", {SUMMARY} FROM (SELECT 'CellMean' AS model, \"set\", rmse, r2 FROM scored UNION ALL "
        "SELECT 'Mean', \"set\", sqrt(avg((y - p)*(y - p))), 1 - avg((y - p)*(y - p))/var_pop(y) "
        f"FROM ({GLOBAL_MEANS}) GROUP BY fold, \"set\") WHERE \"set\" = 'Test' GROUP BY model, \"set\"",
        SCORES,
    ),
)
def model_comparison(spark, sf):
    rows = checkpointed(predictions(spark, sf))  # used by both models and by the means
    means = rows.agg(
        F.struct(*[F.avg(F.when(F.col("season") != k, F.col("log_value"))).alias(f"m{k}") for k in YEARS])
    ).scalar()
    constant = metrics.fold_scores(
        rows, F.col("opt_value"), {k: F.expm1(means[f"m{k}"]) for k in YEARS}, "season"
    )
    tables = [
        metrics.cv_summary(s.withColumn("model", F.lit(n)))
        for n, s in (("CellMean", fold_scores(spark, sf, rows)), ("Mean", constant))
    ]
    return plain(metrics.comparison_table(tables, test_only=True))


@query(
    "a23_ensemble_statistics",
    p.sql(
        f"SELECT {p.d()}, \"row\", col, "
        + ", ".join(
            p.r(c, c)
            for c in ("mean_prediction", "std_prediction", "error_prediction", "residual_prediction", "opt_value")
        )
        + " FROM ens",
        ENSEMBLE,
    ),
)
def ensemble_rows(spark, sf):
    return plain(ensemble(spark, sf).drop("log_value", "log_value_backtransformed"))


@query(
    "a26_error_by_region",
    p.sql(
        f"SELECT CASE WHEN \"row\" < ny // 2 THEN 'North' ELSE 'South' END AS region, {p.r('avg(error_prediction)', 'error')}, "
        f"{p.r('avg(mean_prediction)', 'predicted')}, {p.r('avg(opt_value)', 'actual')} FROM ens, spec GROUP BY ALL",
        ENSEMBLE,
    ),
)
def error_by_region(spark, sf):
    rows = with_region(ensemble(spark, sf), g.grid_of(spark, sf).nrows // 2)
    return plain(
        rows.groupBy("region").agg(
            F.avg("error_prediction").alias("error"),
            F.avg("mean_prediction").alias("predicted"),
            F.avg("opt_value").alias("actual"),
        )
    )


@query(
    "a27_duplicate_keys",
    "SELECT count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS n_duplicates FROM lineitem",
)
def duplicate_keys(spark, sf):
    return a.duplicate_keys(g.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "a28_melt_share_both_layers",
    p.sql(
        f"SELECT {p.r('avg(CASE WHEN opt_value/4 >= 0.64 THEN 1.0 ELSE 0.0 END)', 'opt_share')}, "
        f"{p.r('avg(CASE WHEN mw_value = 1 THEN 1.0 ELSE 0.0 END)', 'mw_share')} FROM px WHERE opt_value IS NOT NULL"
    ),
)
def melt_share_both_layers(spark, sf):
    rows = g.pixels(spark, sf).where("opt_value IS NOT NULL")
    return plain(
        rows.agg(
            a.share(F.col("opt_value") / 4 >= MELT_THRESHOLD).alias("opt_share"),
            a.share(F.col("mw_value") == 1).alias("mw_share"),
        )
    )


@query(
    "a29_box_plot",
    p.sql(
        f"SELECT CAST(s.mw_value AS INTEGER) AS mw_value, any_value(nv) AS n_values, {p.r('any_value(q1)', 'q1')}, {p.r('any_value(q2)', 'median')}, {p.r('any_value(q3)', 'q3')}, "
        f"{p.r('min(opt_raw) FILTER (WHERE opt_raw >= q1 - 1.5*(q3 - q1))', 'whisker_low')}, "
        f"{p.r('max(opt_raw) FILTER (WHERE opt_raw <= q3 + 1.5*(q3 - q1))', 'whisker_high')} "
        "FROM (SELECT * FROM px WHERE opt_raw < 10) s JOIN (SELECT mw_value, count(*) AS nv, quantile_cont(opt_raw, 0.25) q1, quantile_cont(opt_raw, 0.5) q2, "
        "quantile_cont(opt_raw, 0.75) q3 FROM px WHERE opt_raw < 10 GROUP BY mw_value) q ON q.mw_value = s.mw_value GROUP BY s.mw_value"
    ),
)
def box_plot(spark, sf):
    return plain(a.box_plot(g.pixels(spark, sf).where("opt_raw < 10"), "opt_raw", "mw_value"))


META = (
    f"meta AS (SELECT date, count(DISTINCT x) AS width, count(DISTINCT y) AS height, min(x) AS xmin, max(x) AS xmax, min(y) AS ymin, "
    "max(y) AS ymax, CAST(sum(mw_value) AS BIGINT) AS total, CAST(min(mw_value) AS INTEGER) AS low, CAST(max(mw_value) AS INTEGER) AS high "
    "FROM px WHERE day(date) <> 3 OR col > 1 GROUP BY date)"
)


def _meta(spark, sf):
    rows = g.pixels(spark, sf).where((F.dayofmonth("date") != 3) | (F.col("col") > 1))
    return a.scene_metadata(rows, "mw_value")


@query(
    "a30_scene_metadata",
    p.sql(f"SELECT * REPLACE ({p.d()}), (xmax - xmin)/(width - 1) AS resolution FROM meta", META),
)
def scene_metadata(spark, sf):
    return plain(_meta(spark, sf))


@query(
    "a30_scenes_off_contract",
    p.sql(f"SELECT {p.d()}, width, total FROM meta, spec WHERE width <> nx OR xmin <> -636500", META),
)
def scenes_off_contract(spark, sf):
    grid = g.grid_of(spark, sf)
    off = a.scenes_off_contract(_meta(spark, sf), width=grid.ncols, xmin=grid.x0)
    return plain(off.select("date", "width", "total"))


@query(
    "a31_prediction_day_coverage",
    p.sql(
        f"SELECT {p.d()}, {p.r('avg(CASE WHEN opt_value IS NULL THEN 1.0 ELSE 0.0 END)', 'missing')}, "
        f"{p.r('1 - count(opt_value)/any_value(nx*ny)', 'uncovered')} FROM px, spec WHERE mw_value <> -1 GROUP BY date"
    ),
)
def prediction_day_coverage(spark, sf):
    n = g.grid_of(spark, sf).n_cells
    ice = g.pixels(spark, sf).where("mw_value <> -1")
    return plain(
        ice.groupBy("date").agg(
            a.share(F.col("opt_value").isNull()).alias("missing"),
            (1 - F.count("opt_value") / n).alias("uncovered"),
        )
    )
