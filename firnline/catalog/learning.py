"""L: folds, models, cross-validation, benchmarks; A24, A25, O2, O3 on their results."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from firnline.catalog import prelude as p
from firnline.catalog.aggregates import ENSEMBLE, QQ_FIT, ordered_cte, predictions
from firnline.catalog.filters import AREA, SPREAD_CELLS, spread_cells
from firnline.catalog.registry import plain, query
from firnline.catalog.scalars import bin_sql
from firnline.functions import labels as fl
from firnline.functions.scalars import FEATURE_BOUNDS, melt_label
from firnline.ml import cv, deep_tree, estimators, folds, importance, linear, metrics
from firnline.ml.ensemble import ensemble_statistics
from firnline.ml.store import load_bundle, load_model, save_bundle, save_model
from firnline.operators.aggregates import majority
from firnline.operators.masks import combined_mask
from firnline.plans.features import build_features, static_layer
from firnline.plans.residuals import residual_report
from firnline.plans.training_table import prediction_table, training_table
from firnline.session import checkpointed, shared_folder
from firnline.sources import driver_grid as g
from firnline.sources.rasters import long_to_lines

FEATURES = [
    "x",
    "y",
    "mw_value",
    "mean_3",
    "mean_9",
    "sum_5",
    "mw_value_yesterday",
    "mw_value_7_day_average",
    "hours_of_daylight",
    "elevation_data",
    "slope_data",
    "aspect_data",
    "distance_to_margin",
]
CELL = ["col", "row"]  # the columns of the history windows' shuffle
_pixels: dict[tuple[str, str], str] = {}
_materialised: dict[tuple[str, str], str] = {}
_areas: dict[tuple[str, str], folds.Areas] = {}


def derived_pixels(spark, sf):
    """The pixel table, derived and written once per application: masks, calendar and features read it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _pixels:
        path = shared_folder(spark)
        names = ["date", "col", "row", "x", "y", "mw_value", "opt_value"]
        g.pixels(spark, sf).select(*names).write.parquet(path)
        _pixels[key] = path
    return spark.read.parquet(_pixels[key])


def all_features(spark, sf):
    """The extended table of the written pixels."""
    static = static_layer(g.cells(spark, sf))
    return build_features(derived_pixels(spark, sf), static, tasks=g.tasks_of(g.grid_of(spark, sf)))


def training(spark, sf):
    """The training table, written once per application and read back by every model.

    Masks are joined by the columns of the last shuffle of the pixels, which do not move again. The aspect of flat cells is undefined; such rows count as facing neither way.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _materialised:
        path = shared_folder(spark)
        mask = combined_mask(derived_pixels(spark, sf), cell=CELL)
        rows = training_table(all_features(spark, sf), mask, keep_ids=True, cell=CELL)
        half = 0.5  # scaled value of a cosine of 0
        rows.fillna({"aspect_data": half}).write.parquet(path)
        _materialised[key] = path
    return spark.read.parquet(_materialised[key])


def areas(spark, sf):
    """Folds of the training table, fitted once and shared by all models."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _areas:
        _areas[key] = folds.nested_areas(training(spark, sf))
    return _areas[key]


# L1 to L5: folds and nested cross-validation


@query("l01_kmeans_areas")
def kmeans_areas(spark, sf):
    rows = training(spark, sf)
    placed = folds.with_areas(rows, *areas(spark, sf))
    return plain(
        placed.groupBy("outer_area", "final_area").agg(
            F.countDistinct("x", "y").alias("n_cells"), F.count("*").alias("n_rows")
        )
    )


def _kmeans_sql(turns: int = folds.TURNS) -> str:
    """The same steps: seeds on the diagonal, then weighted means of the nearest cells."""
    near = "arg_min(c.i, {{'d': (w.x - c.cx)*(w.x - c.cx) + (w.y - c.cy)*(w.y - c.cy), 'i': c.i}})"
    steps = [
        "w AS MATERIALIZED (SELECT x, y, CAST(count(*) AS DOUBLE) AS w FROM px WHERE opt_value IS NOT NULL GROUP BY x, y)",
        "c0 AS (SELECT i, min(x) + (2*i + 1)/10.0::DOUBLE*(max(x) - min(x)) AS cx, min(y) + (2*i + 1)/10.0::DOUBLE*(max(y) - min(y)) AS cy "
        "FROM w, range(5) s(i) GROUP BY i)",
    ]
    for t in range(1, turns + 1):
        steps.append(
            f"a{t} AS (SELECT w.x, w.y, w.w, {near.format()} AS i FROM w, c{t - 1} c GROUP BY w.x, w.y, w.w)"
        )
        steps.append(
            f"c{t} AS MATERIALIZED (SELECT c.i, coalesce(sum(a.w*a.x)/sum(a.w), any_value(c.cx)) AS cx, coalesce(sum(a.w*a.y)/sum(a.w), any_value(c.cy)) AS cy "
            f"FROM c{t - 1} c LEFT JOIN a{t} a ON a.i = c.i GROUP BY c.i)"
        )
    steps.append(f"last AS (SELECT row_number() OVER (ORDER BY cx, cy) - 1 AS i, cx, cy FROM c{turns})")
    return p.sql(
        f"SELECT CAST(a.i AS INTEGER) AS area, {p.r('any_value(l.cx)', 'cx')}, {p.r('any_value(l.cy)', 'cy')}, count(*) AS n_cells, "
        f"CAST(sum(a.w) AS BIGINT) AS n_rows FROM (SELECT w.x, w.y, w.w, {near.format()} AS i FROM w, last c GROUP BY w.x, w.y, w.w) a "
        "JOIN last l ON l.i = a.i GROUP BY a.i",
        *steps,
    )


@query("l01_kmeans_steps", _kmeans_sql())
def kmeans_steps(spark, sf):
    """Areas of the observed cells with their centres."""
    weights = checkpointed(folds.cell_weights(g.pixels(spark, sf).where("opt_value IS NOT NULL")))
    centres = folds.fit_centres(weights)
    of = F.col("area")
    return plain(
        weights.groupBy(folds.area(centres).alias("area"))
        .agg(F.count("*").alias("n_cells"), F.sum("weight").cast("long").alias("n_rows"))
        .withColumns({
            "cx": F.element_at(F.array(*[F.lit(c[0]) for c in centres]), of + 1),
            "cy": F.element_at(F.array(*[F.lit(c[1]) for c in centres]), of + 1),
        })
    )


CENTRES = [(-630000.0, -667000.0), (-620500.0, -665500.0), (-628500.0, -678000.0), (-617500.0, -677500.0), (-624000.0, -672500.0)]


@query(
    "l01_assign_to_centres",
    p.sql(
        "SELECT col, \"row\", CAST(arg_min(c.i, {'d': (x - c.cx)*(x - c.cx) + (y - c.cy)*(y - c.cy), 'i': c.i}) AS INTEGER) AS area FROM cells, "
        f"(VALUES {', '.join(f'({i}, {x}::DOUBLE, {y}::DOUBLE)' for i, (x, y) in enumerate(CENTRES))}) c(i, cx, cy) GROUP BY col, \"row\""
    ),
)
def assign_to_centres(spark, sf):
    return g.cells(spark, sf).select("col", "row", folds.area(CENTRES).alias("area"))


# Five fixed areas of the stretched grid serve as folds where SQL has to know them.
AREAS = (
    f"areas AS (SELECT col, \"row\", {AREA} AS area FROM wide),\n"
    "obs_area AS (SELECT px.*, a.area, ln(1 + opt_value) AS log_value FROM px JOIN areas a ON a.col = px.col AND a.\"row\" = px.\"row\" WHERE opt_value IS NOT NULL)"
)


def observed_with_area(spark, sf):
    areas = spread_cells(spark, sf).select("col", "row", fl.spatial_area(F.col("x"), F.col("y")).alias("area"))
    rows = g.pixels(spark, sf).where("opt_value IS NOT NULL")
    return rows.join(areas, ["col", "row"]).withColumn("log_value", F.log1p("opt_value"))


@query(
    "l02_leave_one_area_out",
    p.sql(
        "SELECT k.area AS fold, (o.area = k.area) AS in_test, count(*) AS n, round(avg(opt_value), 6) + 0.0 AS mean_opt "
        "FROM (SELECT unnest([1, 2, 3, 4, 5]) AS area) k, obs_area o GROUP BY ALL",
        SPREAD_CELLS,
        AREAS,
    ),
)
def leave_one_area_out(spark, sf):
    """One pass: every row counts for its own area as test and for the others as training row."""
    rows = observed_with_area(spark, sf)
    each = rows.select("opt_value", "area", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("fold"))
    return plain(
        each.groupBy("fold", (F.col("area") == F.col("fold")).alias("in_test")).agg(
            F.count("*").alias("n"), F.avg("opt_value").alias("mean_opt")
        )
    )


@query("l03_l04_tuning_scores")
def tuning_scores(spark, sf):
    """Every grid point of the elastic net with its score on every inner area."""
    result = cv.spatial_cv_linear(training(spark, sf), FEATURES, "ElasticNetRegression", areas=areas(spark, sf))
    points = cv.parameter_grid(estimators.GRIDS["ElasticNetRegression"])
    named = spark.createDataFrame(
        [(i, q["alpha"], q["l1_ratio"]) for i, q in enumerate(points)],
        "grid_index int, alpha double, l1_ratio double",
    )
    return result.tuning.join(named, "grid_index")


@query("o03_best_hyper_parameters")
def best_hyper_parameters(spark, sf):
    result = cv.spatial_cv_linear(training(spark, sf), FEATURES, "RidgeRegression", areas=areas(spark, sf))
    return plain(cv.best_index(result.tuning))


def _linear_scores(spark, sf, name, features, **kw):
    return plain(
        cv.spatial_cv_linear(training(spark, sf), features, name, areas=areas(spark, sf), **kw).scores
    )


@query("l05_nested_cv_ridge")
def nested_cv_ridge(spark, sf):
    return _linear_scores(spark, sf, "RidgeRegression", FEATURES)


@query("l05_nested_cv_ridge_log_labels")
def nested_cv_ridge_log_labels(spark, sf):
    return _linear_scores(spark, sf, "RidgeRegression", FEATURES, label_space="log")


@query("l05_nested_cv_tree_tuned")
def nested_cv_tree_tuned(spark, sf):
    tree = estimators.decision_tree()
    grid = {"maxDepth": [7, 12], "minInstancesPerNode": [2, 6]}
    result = cv.spatial_cv(
        training(spark, sf), FEATURES, tree, "DecisionTree", grid, areas=areas(spark, sf)
    )
    return plain(result.scores)


# L6 to L8: benchmarks


@query(
    "l06_mean_benchmark",
    p.sql(
        "SELECT fold, \"set\", count(*) AS n, round(any_value(p), 6) + 0.0 AS prediction, round(avg((y - p)*(y - p)), 6) + 0.0 AS mse, "
        "round(sqrt(avg((y - p)*(y - p))), 6) + 0.0 AS rmse, round(1 - avg((y - p)*(y - p))/var_pop(y), 6) + 0.0 AS r2 FROM ("
        "SELECT k.area AS fold, CASE WHEN o.area = k.area THEN 'Test' ELSE 'Train' END AS \"set\", o.opt_value AS y, k.p "
        "FROM (SELECT a.area, exp(avg(o.log_value)) - 1 AS p FROM (SELECT DISTINCT area FROM obs_area) a JOIN obs_area o ON o.area <> a.area GROUP BY a.area) k, obs_area o) "
        "GROUP BY fold, \"set\"",
        SPREAD_CELLS,
        AREAS,
    ),
)
def mean_benchmark(spark, sf):
    rows = observed_with_area(spark, sf)
    return plain(cv.mean_benchmark(rows, "area", "log_value"))


CLASSED = f"""classed AS (SELECT opt_value, mw_value, {bin_sql('opt_value/4', fl.CLASS_EDGES)} AS bin,
  {bin_sql('opt_value/4', fl.ZERO_INCLUSIVE_EDGES)} AS ob, {bin_sql('mw_value', fl.ZERO_INCLUSIVE_EDGES)} AS mb FROM px WHERE opt_value IS NOT NULL)"""


@query(
    "l07_microwave_benchmark",
    p.sql(
        f"SELECT {p.r('avg(power(opt_value - mw_value, 2))', 'mse')}, {p.r('sqrt(avg(power(opt_value - mw_value, 2)))', 'rmse')}, "
        f"{p.r('1 - avg(power(opt_value - mw_value, 2))/var_pop(opt_value)', 'r2')}, count(*) AS n, "
        f"{p.r('avg(CAST((opt_value/4 >= 0.64) = (mw_value = 1) AS INTEGER))', 'binary_accuracy')}, "
        f"{p.r('avg(CAST(ob = mb AS INTEGER))', 'class_accuracy')} FROM classed",
        CLASSED,
    ),
)
def microwave_benchmark(spark, sf):
    rows = g.pixels(spark, sf).where("opt_value IS NOT NULL")
    small = F.col("opt_value") / 4
    labelled = rows.select(
        "opt_value",
        F.col("mw_value").cast("double").alias("mw_value"),
        melt_label(small).alias("melt"),
        fl.right_closed_bin(small, fl.ZERO_INCLUSIVE_EDGES).alias("ob"),
        fl.right_closed_bin(F.col("mw_value"), fl.ZERO_INCLUSIVE_EDGES).alias("mb"),
    )
    scores = metrics.regression_scores(labelled, "opt_value", "mw_value")
    binary = metrics.accuracy(labelled, "melt", "mw_value").select("accuracy").scalar()
    classes = metrics.accuracy(labelled, "ob", "mb").select("accuracy").scalar()
    return plain(scores.select("*", binary.alias("binary_accuracy"), classes.alias("class_accuracy")))


@query(
    "l08_constant_class_benchmarks",
    p.sql(
        f"SELECT CAST(majority AS INTEGER) AS majority, {p.r('avg(CAST(bin = majority AS INTEGER))', 'majority_accuracy')}, "
        f"{p.r('avg(CAST(opt_value/4 < 0.64 AS INTEGER))', 'zero_accuracy')}, {p.r('avg(CAST(bin = 1 AS INTEGER))', 'one_accuracy')} "
        "FROM classed, (SELECT bin AS majority FROM classed GROUP BY bin ORDER BY count(*) DESC, bin LIMIT 1) GROUP BY majority",
        CLASSED,
    ),
)
def constant_class_benchmarks(spark, sf):
    small = F.col("opt_value") / 4
    rows = g.pixels(spark, sf).where("opt_value IS NOT NULL").select(
        melt_label(small).alias("melt"), fl.right_closed_bin(small, fl.CLASS_EDGES).alias("bin")
    )
    most = majority(rows, "bin")
    constant = rows.withColumn("majority", most)
    return plain(
        constant.groupBy("majority").agg(
            F.avg((F.col("bin") == F.col("majority")).cast("int")).alias("majority_accuracy"),
            F.avg((F.col("melt") == 0).cast("int")).alias("zero_accuracy"),
            F.avg((F.col("bin") == 1).cast("int")).alias("one_accuracy"),
        )
    )


# L9 to L12: linear models, in full by cross-validation and on one or two features against SQL


@query("l09_linear_regression")
def linear_regression(spark, sf):
    return _linear_scores(spark, sf, "LinearRegression", FEATURES, tune=False)


@query("l09_linear_regression_without_xy")
def linear_regression_without_xy(spark, sf):
    return _linear_scores(spark, sf, "LinearRegression", FEATURES[2:], tune=False)


def _without_log(spark, sf, name, **kw):
    rows = training(spark, sf).withColumn("opt_value", F.expm1("opt_value"))
    result = cv.spatial_cv_linear(
        rows, FEATURES, name, tune=False, log_target=False, areas=areas(spark, sf), **kw
    )
    return plain(result.scores)


@query("l09_linear_regression_without_log")
def linear_regression_without_log(spark, sf):
    return _without_log(spark, sf, "LinearRegression")


@query("l10_ridge_without_log")
def ridge_without_log(spark, sf):
    return _without_log(spark, sf, "RidgeRegression", grid={"alpha": [20]})


@query("l11_lasso")
def lasso(spark, sf):
    return _linear_scores(spark, sf, "LassoRegression", FEATURES)


@query("l12_elastic_net")
def elastic_net(spark, sf):
    return _linear_scores(spark, sf, "ElasticNetRegression", FEATURES)


XLO, XHI = FEATURE_BOUNDS["x"]
TWO = f"""two AS (SELECT mw_value AS a, (x - ({XLO}))/({XHI} - ({XLO})) * 60 AS b, ln(1 + opt_value) AS y FROM px WHERE opt_value IS NOT NULL),
mom AS (SELECT count(*) AS n, var_pop(a)*count(*) AS saa, var_pop(b)*count(*) AS sbb, covar_pop(a, b)*count(*) AS sab,
  covar_pop(a, y)*count(*) AS say, covar_pop(b, y)*count(*) AS sby, avg(a) AS ma, avg(b) AS mb, avg(y) AS my FROM two)"""


def pair_sql(penalty: str) -> str:
    """Two-feature least squares with ``penalty`` added to the diagonal."""
    den = f"((saa + {penalty})*(sbb + {penalty}) - sab*sab)"
    return (
        f"fit AS (SELECT (say*(sbb + {penalty}) - sby*sab)/{den} AS wa, (sby*(saa + {penalty}) - say*sab)/{den} AS wb, n, ma, mb, my FROM mom)"
    )


def two_features(spark, sf):
    rows = g.pixels(spark, sf).where("opt_value IS NOT NULL")
    low, high = FEATURE_BOUNDS["x"]
    return rows.select(
        "date",
        "x",
        "y",
        F.col("mw_value").cast("double").alias("a"),
        ((F.col("x") - low) / (high - low) * 60).alias("b"),
        F.log1p("opt_value").alias("target"),
    )


def pair_fit(spark, sf, fit, **params):
    products = linear.cross_products(two_features(spark, sf), ["a", "b"], "target")[()]
    return fit(products, ["a", "b"], **params)


def fit_row(spark, fit):
    return plain(
        spark.createDataFrame(
            [(float(fit.coefficients[0]), float(fit.coefficients[1]), float(fit.intercept))],
            "wa double, wb double, intercept double",
        )
    )


FIT_OUT = f"SELECT {p.r('wa', 'wa')}, {p.r('wb', 'wb')}, {p.r('my - wa*ma - wb*mb', 'intercept')} FROM fit"


@query(
    "s09_model_save_and_load",
    p.sql(
        f"SELECT {p.d()}, x, y, {p.r('my - wa*ma - wb*mb + wa*mw_value + wb*((x - (-636500.0))/(824500.0 - (-636500.0))*60)', 'prediction')} FROM px, fit WHERE opt_value IS NOT NULL",
        TWO,
        pair_sql("0"),
    ),
)
def model_save_and_load(spark, sf):
    data = estimators.assemble(two_features(spark, sf), ["a", "b"])
    root = shared_folder(spark)
    save_model(estimators.linear("target").fit(data), root, "linear")
    back = load_model(root, "linear")
    return plain(back.transform(data).select("date", "x", "y", "prediction"))


@query("l09_ols_two_features", p.sql(FIT_OUT, TWO, pair_sql("0")))
def ols_two_features(spark, sf):
    return fit_row(spark, pair_fit(spark, sf, linear.ols))


@query("l10_ridge_two_features", p.sql(FIT_OUT, TWO, pair_sql("20")))
def ridge_two_features(spark, sf):
    return fit_row(spark, pair_fit(spark, sf, linear.ridge, alpha=20))


SOFT = "sign(say)*greatest(abs(say)/n - {l1}, 0)/(saa/n + {l2})"


def _one_feature_sql(l1: float, l2: float) -> str:
    w = SOFT.format(l1=l1, l2=l2)
    return p.sql(f"SELECT {p.r(w, 'wa')}, {p.r(f'my - {w}*ma', 'intercept')} FROM mom", TWO)


def _one_feature(spark, sf, fit, **params):
    products = linear.cross_products(two_features(spark, sf), ["a"], "target")[()]
    m = fit(products, ["a"], **params)
    return plain(
        spark.createDataFrame([(float(m.coefficients[0]), float(m.intercept))], "wa double, intercept double")
    )


@query("l11_lasso_one_feature", _one_feature_sql(0.01, 0))
def lasso_one_feature(spark, sf):
    return _one_feature(spark, sf, linear.lasso, alpha=0.01)


@query("l12_elastic_net_one_feature", _one_feature_sql(0.005, 0.005))
def elastic_net_one_feature(spark, sf):
    return _one_feature(spark, sf, linear.elastic_net, alpha=0.01, l1_ratio=0.5)


# L13 to L17: trees and classifiers


def _tree_scores(spark, sf, estimator, name, tune):
    """Scores of the fold models and, as fold -1, of the final model on all training rows."""
    rows = training(spark, sf)
    grid = estimators.GRIDS[name]
    result = cv.spatial_cv(rows, FEATURES, estimator, name, grid, tune=tune, areas=areas(spark, sf))
    final = cv.predict_all(estimators.assemble(rows, FEATURES), [result.final_model])
    back = final.select(F.expm1("opt_value").alias("y"), F.expm1("prediction_0").alias("p"))
    whole = metrics.regression_scores(back, "y", "p").select(
        F.lit(-1).alias("fold"), F.lit("Final").alias("set"), "n", "mse", "rmse", "r2", F.lit(name).alias("model")
    )
    return plain(result.scores.unionByName(whole))


@query("l13_decision_tree")
def decision_tree(spark, sf):
    """Depth and leaf size tuned on inner areas, for every outer area and for the final model."""
    return _tree_scores(spark, sf, estimators.decision_tree(), "DecisionTree", True)


@query("l14_random_forest")
def random_forest(spark, sf):
    """The first grid point, as tuning is off for the forest."""
    return _tree_scores(spark, sf, estimators.random_forest(), "RandomForest", False)


@query("l15_gradient_boosting")
def gradient_boosting(spark, sf):
    return _tree_scores(spark, sf, estimators.gradient_boosting(), "GradientBoosting", False)


def _labelled(spark, sf):
    """Training rows with labels, and the season as hold-out."""
    rows = training(spark, sf)
    value = F.expm1("opt_value") / 4
    labelled = rows.withColumns(
        {
            "melt": melt_label(value).cast("double"),
            "class": fl.right_closed_bin(F.round(value, 9), fl.CLASS_EDGES).cast("double"),
            "season": F.year("date"),
        }
    )
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(labelled)


def _accuracy(spark, sf, estimator, label):
    rows = _labelled(spark, sf)
    train = rows.where("season < 2020")
    model = estimator(train.count()).fit(train)
    return plain(metrics.accuracy(model.transform(rows), label, "prediction", ["season"]))


def _tree_accuracy(spark, sf, label):
    rows = _labelled(spark, sf)
    predicted = deep_tree.predictions(rows, FEATURES, label, F.col("season") < 2020, ["season"])
    return plain(metrics.accuracy(predicted, label, "prediction", ["season"]))


@query("l16_tree_classifier_binary")
def tree_classifier_binary(spark, sf):
    return _tree_accuracy(spark, sf, "melt")


@query("l16_tree_classifier_classes")
def tree_classifier_classes(spark, sf):
    return _tree_accuracy(spark, sf, "class")


@query("l17_logistic_binary")
def logistic_binary(spark, sf):
    return _accuracy(spark, sf, lambda n: estimators.logistic("melt", n), "melt")


@query("l17_logistic_one_vs_rest")
def logistic_one_vs_rest(spark, sf):
    return _accuracy(spark, sf, lambda n: estimators.logistic("class", n, one_vs_rest=True), "class")


# L18 to L21: hold-out, batch scoring, attribution, residuals

HOLD_TRAIN = "date BETWEEN DATE '2019-06-01' AND DATE '2019-06-14'"


@query(
    "l18_temporal_hold_out",
    p.sql(
        "SELECT part, date, count(*) AS n, round(sqrt(avg(power(opt_value - pr, 2))), 6) + 0.0 AS rmse FROM ("
        "SELECT CASE WHEN px.date <= DATE '2019-06-21' THEN 'test' ELSE 'predict' END AS part, "
        "CASE WHEN px.date <= DATE '2019-06-21' THEN 'all' ELSE strftime(px.date, '%Y-%m-%d') END AS date, opt_value, "
        "exp(my - wa*ma - wb*mb + wa*mw_value + wb*((x - (-636500.0))/(824500.0 - (-636500.0))*60)) - 1 AS pr FROM px, fit "
        "WHERE opt_value IS NOT NULL AND (px.date BETWEEN DATE '2019-06-15' AND DATE '2019-06-21' OR px.date IN (DATE '2019-06-22', DATE '2019-06-28'))) GROUP BY part, date",
        TWO.replace("WHERE opt_value IS NOT NULL)", f"WHERE opt_value IS NOT NULL AND {HOLD_TRAIN})", 1),
        pair_sql("0"),
    ),
)
def temporal_hold_out(spark, sf):
    rows = two_features(spark, sf)
    train = rows.where(F.col("date").between("2019-06-01", "2019-06-14"))
    fit = linear.ols(linear.cross_products(train, ["a", "b"], "target")[()], ["a", "b"])
    later = rows.where(
        F.col("date").between("2019-06-15", "2019-06-21") | F.col("date").isin("2019-06-22", "2019-06-28")
    )
    scored = later.withColumns(
        {"actual": F.expm1("target"), "predicted": F.expm1(fit.expression())}
    )
    is_test = F.col("date") <= "2019-06-21"
    groups = scored.select(
        F.when(is_test, "test").otherwise("predict").alias("part"),
        F.when(is_test, "all").otherwise(F.date_format("date", "yyyy-MM-dd")).alias("date"),
        "actual",
        "predicted",
    )
    return plain(
        metrics.regression_scores(groups, "actual", "predicted", ["part", "date"]).select(
            "part", "date", "n", "rmse"
        )
    )


BX = f"(x - ({XLO}))/({XHI} - ({XLO})) * 60"
FOLD_FITS = f"""twoa AS (SELECT area, mw_value AS a, {BX} AS b, log_value AS y FROM obs_area),
momk AS (SELECT k.area, count(*) AS n, var_pop(a)*count(*) AS saa, var_pop(b)*count(*) AS sbb, covar_pop(a, b)*count(*) AS sab,
  covar_pop(a, y)*count(*) AS say, covar_pop(b, y)*count(*) AS sby, avg(a) AS ma, avg(b) AS mb, avg(y) AS my
  FROM (SELECT DISTINCT area FROM twoa UNION ALL SELECT -1) k JOIN twoa t ON t.area <> k.area GROUP BY k.area),
fitk AS (SELECT area, wa, wb, my - wa*ma - wb*mb AS c FROM (
  SELECT *, (say*sbb - sby*sab)/(saa*sbb - sab*sab) AS wa, (sby*saa - say*sab)/(saa*sbb - sab*sab) AS wb FROM momk)),
scored AS (SELECT px.date, px.x, px.y, px.col, px."row", avg(p) AS mp, stddev_pop(p) AS sp
  FROM (SELECT px.*, exp(c + wa*mw_value + wb*({BX})) - 1 AS p FROM px, fitk WHERE area <> -1) px GROUP BY ALL)"""


def _with_two(rows):
    low, high = FEATURE_BOUNDS["x"]
    return rows.withColumns({"a": F.col("mw_value").cast("double"), "b": (F.col("x") - low) / (high - low) * 60})


def _two_feature_bundle(spark, sf):
    """Least squares without each of the five fixed areas and on all rows, stored and loaded again."""
    result = cv.leave_one_area_out(
        _with_two(observed_with_area(spark, sf)), ["a", "b"], "LinearRegression", "area", "log_value"
    )
    root = shared_folder(spark)
    save_bundle(spark, result, root, "two_features")
    return load_bundle(spark, root, "two_features")


@query(
    "s09_bundle_of_fold_models",
    p.sql(
        f"SELECT CAST(CASE WHEN k.area = -1 THEN -1 ELSE k.i END AS INTEGER) AS fold, count(*) AS n, {p.r('avg(c + wa*mw_value + wb*(' + BX + '))', 'mean_prediction')} "
        "FROM obs_area o, (SELECT *, row_number() OVER (ORDER BY area) - 2 AS i FROM fitk) k GROUP BY 1",
        SPREAD_CELLS,
        AREAS,
        FOLD_FITS,
    ),
)
def bundle_of_fold_models(spark, sf):
    """Mean predictions of the loaded fold models and of the loaded final model (-1)."""
    loaded = _two_feature_bundle(spark, sf)
    rows = cv.predict_folds(_with_two(observed_with_area(spark, sf)), loaded, "p")
    each = [(i, f"p{i}") for i in range(len(loaded.fold_models))]
    rows = rows.withColumn("final", loaded.final_model.expression())
    one = rows.agg(
        *[F.struct(F.lit(i).alias("fold"), F.count(c).alias("n"), F.avg(c).alias("mean_prediction")).alias(c) for i, c in [*each, (-1, "final")]]
    )
    return plain(one.select(F.inline(F.array(*one.columns))))


@query(
    "l19_score_all_pixels",
    p.sql(
        f"SELECT {p.d()}, x, y, {p.r('mp', 'mean_prediction')}, {p.r('sp', 'std_prediction')} FROM scored",
        SPREAD_CELLS,
        AREAS,
        FOLD_FITS,
    ),
)
def score_all_pixels(spark, sf):
    """Every pixel, water and cloud included, by the fold models of a stored bundle."""
    pixels = _with_two(g.pixels(spark, sf))
    return plain(cv.score_all(pixels, _two_feature_bundle(spark, sf), ["date", "x", "y"]))


@query(
    "l19_predicted_lines",
    p.sql(
        f"SELECT {p.d()}, \"row\", count(mp) AS n, {p.r('sum(round(mp, 6))', 'total')} FROM scored GROUP BY date, \"row\"",
        SPREAD_CELLS,
        AREAS,
        FOLD_FITS,
    ),
)
def predicted_lines(spark, sf):
    """The predictions as dense raster lines, then per line the cells and their sum."""
    grid = g.grid_of(spark, sf)
    pixels = _with_two(g.pixels(spark, sf))
    scored = cv.score_all(pixels, _two_feature_bundle(spark, sf), ["date", "row", "col"])
    lines = long_to_lines(scored.withColumn("p", F.round("mean_prediction", 6)), "p", grid, tasks=g.tasks_of(grid))
    present = F.filter("line", lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda acc, v: acc + v)
    return plain(lines.select("date", "row", F.size(present).cast("long").alias("n"), total.alias("total")))


@query("l19_fold_models_on_all_pixels")
def fold_models_on_all_pixels(spark, sf):
    """The ridge models of the nested cross-validation, stored and loaded, on the unfiltered table: mean and
    deviation of the predictions by day."""
    root = shared_folder(spark)
    save_bundle(spark, _ridge(spark, sf), root, "ridge")
    rows = prediction_table(all_features(spark, sf)).fillna({"aspect_data": 0.5})
    scored = cv.score_all(rows, load_bundle(spark, root, "ridge"), ["date", "row", "col"], "opt_value")
    return plain(
        scored.groupBy("date").agg(
            F.count("*").alias("n"),
            F.count("mean_prediction").alias("n_predicted"),
            F.count("residual_prediction").alias("n_observed"),
            F.avg("mean_prediction").alias("mean_prediction"),
            F.avg("std_prediction").alias("std_prediction"),
        )
    )


@query(
    "l20_linear_attribution",
    p.sql(
        f"SELECT {p.d()}, x, px.y, {p.r('wa*(mw_value - ma)', 'phi_a')}, {p.r('wb*((x - (-636500.0))/(824500.0 - (-636500.0))*60 - mb)', 'phi_b')} FROM px, fit WHERE opt_value IS NOT NULL",
        TWO,
        pair_sql("0"),
    ),
)
def linear_attribution(spark, sf):
    rows = two_features(spark, sf)
    products = linear.cross_products(rows, ["a", "b"], "target")[()]
    fit = linear.ols(products, ["a", "b"])
    means = {f: float(products.s[i] / products.n) for i, f in enumerate(["a", "b"])}
    return plain(linear.attributions(rows, fit, means).select("date", "x", "y", "phi_a", "phi_b"))


def _residuals(spark, sf):
    pred = ensemble_statistics(
        predictions(spark, sf).drop("opt_value").withColumnRenamed("log_value", "opt_value"),
        [f"p{i}" for i in range(5)],
        keep=("date", "col", "row"),
    )
    rounded = pred.withColumn("residual_prediction", F.round("residual_prediction", 6))
    return residual_report(rounded, ["date", "col", "row"])


RES = ENSEMBLE + ",\nres AS (SELECT *, round(residual_prediction, 6) AS rr FROM ens)"


@query(
    "l21_residual_histogram",
    p.sql(
        f"SELECT 'residual_prediction' AS feature, CAST(least(floor((rr - lo)/(hi - lo)*100), 99) AS INTEGER) AS bin, count(*) AS n "
        "FROM res, (SELECT min(rr) lo, max(rr) hi FROM res) GROUP BY ALL",
        RES,
    ),
)
def residual_histogram(spark, sf):
    return _residuals(spark, sf)["histogram"]().select("feature", "bin", "n")


@query("l21_residual_qq", p.sql(QQ_FIT, RES, ordered_cte("res", "rr")))
def residual_qq(spark, sf):
    return plain(_residuals(spark, sf)["qq"]())


@query(
    "l21_residual_sample",
    p.sql(
        f"SELECT {p.d()}, col, \"row\", {p.r('opt_value', 'opt_value_backtransformed')}, {p.r('mp', 'mean_prediction')}, {p.r('residual_prediction', 'residual_prediction')} FROM ens "
        "WHERE CAST(('0x' || substr(md5('1,' || strftime(date, '%Y-%m-%d') || ',' || col || ',' || \"row\"), 1, 8)) AS BIGINT) < 214748364",
        ENSEMBLE,
    ),
)
def residual_sample(spark, sf):
    return plain(_residuals(spark, sf)["sample"]())


# A24, A25, O2: importance over the folds


def _ridge(spark, sf):
    return cv.spatial_cv_linear(
        training(spark, sf), FEATURES, "RidgeRegression", {"alpha": [20]}, tune=False, areas=areas(spark, sf)
    )


def _seven_results(spark, sf):
    """One result for each kind of model, linear ones with a fixed penalty, trees at their first grid point."""
    rows, shared = training(spark, sf), areas(spark, sf)
    for name in ("LinearRegression", "RidgeRegression", "LassoRegression", "ElasticNetRegression"):
        grid = None if name == "LinearRegression" else {k: v[:1] for k, v in estimators.GRIDS[name].items()}
        yield cv.spatial_cv_linear(rows, FEATURES, name, grid, tune=False, areas=shared)
    trees = {
        "DecisionTree": estimators.decision_tree(),
        "RandomForest": estimators.random_forest(),
        "GradientBoosting": estimators.gradient_boosting(),
    }
    for name, estimator in trees.items():
        yield cv.spatial_cv(rows, FEATURES, estimator, name, estimators.GRIDS[name], tune=False, final=False, areas=shared)


@query("a24_feature_importance")
def feature_importance(spark, sf):
    """Signed coefficients, absolute coefficients or impurity importances of all seven kinds, each read from its
    stored bundle: seven times thirteen rows."""
    root, table = shared_folder(spark), None
    for result in _seven_results(spark, sf):
        save_bundle(spark, result, root, result.name)
        part = importance.importance_table(spark, load_bundle(spark, root, result.name))
        table = part if table is None else table.unionByName(part)
    return plain(importance.importance_summary(table))


@query("o02_top_features")
def top_features(spark, sf):
    table = importance.importance_table(spark, _ridge(spark, sf))
    return plain(importance.importance_summary(table, top=5))


@query("a25_coefficient_summary")
def coefficient_summary(spark, sf):
    result = cv.spatial_cv_linear(
        training(spark, sf), FEATURES, "LinearRegression", tune=False, areas=areas(spark, sf)
    )
    return plain(
        importance.coefficient_summary(
            importance.importance_table(spark, result),
            importance.intercept_table(spark, result),
            ["mw_value", "elevation_data"],
        )
    )
