"""Linear models against closed forms and Spark ML, folds, benchmarks, stored models."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer
from pyspark.sql import functions as F

from firnline.ml import cv, deep_tree, estimators, folds, importance, linear, metrics, store
from firnline.ml.logistic import OneVsRestLogistic
from firnline.operators.filters import check_features
from firnline.session import shared_folder

FEATURES = ["x", "y", "a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(11)
    n = 1500
    x, y, a, b = rng.random((4, n))
    target = 0.6 + 0.8 * a - 0.3 * b + 0.1 * x + 0.02 * rng.normal(size=n)
    x, y = np.floor(x * 10) / 10, np.floor(y * 10) / 10  # rows share cells
    rows = [tuple(map(float, r)) for r in zip(x, y, a, b, target)]
    return spark.createDataFrame(rows, "x double, y double, a double, b double, opt_value double").repartition(5).cache()


@pytest.fixture(scope="module")
def areas(data):
    return folds.nested_areas(data)


@pytest.fixture(scope="module")
def products(data):
    return linear.cross_products(data, FEATURES, "opt_value")[()]


def test_cross_products_do_not_depend_on_partitions(data, products):
    other = linear.cross_products(data.repartition(2), FEATURES, "opt_value")[()]
    np.testing.assert_allclose(other.ss, products.ss)
    parts = linear.cross_products(
        data.withColumn("g", (F.col("x") * 3).cast("int")), FEATURES, "opt_value", ["g"]
    )
    np.testing.assert_allclose(linear.total(list(parts.values())).ss, products.ss)
    assert set(parts) == {(0,), (1,), (2,)}


def test_closed_forms(data, products):
    m = np.array(data.select(*FEATURES, "opt_value").collect())
    x, y = m[:, :-1], m[:, -1]
    xc, yc = x - x.mean(0), y - y.mean()
    for alpha in (0.0, 20.0):
        want = np.linalg.solve(xc.T @ xc + alpha * np.eye(4), xc.T @ yc)
        got = linear.ridge(products, FEATURES, alpha) if alpha else linear.ols(products, FEATURES)
        np.testing.assert_allclose(got.coefficients, want, rtol=1e-8)
        assert got.intercept == pytest.approx(y.mean() - want @ x.mean(0))
        assert got.mse(products) == pytest.approx(np.mean((y - x @ got.coefficients - got.intercept) ** 2))


def test_spark_estimators_have_the_same_penalties(data, products):
    rows = estimators.assemble(data, FEATURES)
    n, s = products.n, float(data.agg(F.stddev_pop("opt_value")).first()[0])
    pairs = [
        (estimators.linear(), linear.ols(products, FEATURES)),
        (estimators.ridge(15, n, s), linear.ridge(products, FEATURES, 15)),
        (estimators.lasso(0.01), linear.lasso(products, FEATURES, 0.01)),
        (estimators.elastic_net(0.05, 0.1, s), linear.elastic_net(products, FEATURES, 0.05, 0.1)),
    ]
    for estimator, fit in pairs:
        model = estimator.fit(rows)
        np.testing.assert_allclose(model.coefficients.toArray(), fit.coefficients, atol=2e-5)
        assert model.intercept == pytest.approx(fit.intercept, abs=2e-5)


def test_areas_are_disjoint_and_cover_all_rows(data, areas):
    outer, inner, final = areas
    placed = folds.with_areas(data, outer, inner, final)
    assert len(outer) == len(inner) == len(final) == 5
    assert placed.where(F.col("outer_area").isNull()).count() == 0
    for k in range(5):
        train, test = folds.leave_one_out(placed, "outer_area", k)
        assert train.count() + test.count() == data.count()
        assert train.join(test, ["x", "y"], "left_semi").count() == 0
    centres = np.array(outer)
    for r in placed.limit(200).collect():
        d = ((centres - (r["x"], r["y"])) ** 2).sum(1)
        assert r["outer_area"] == d.argmin()


def test_nested_cv_beats_the_mean_and_agrees_with_the_evaluator(data, areas):
    result = cv.spatial_cv_linear(data, FEATURES, "RidgeRegression", areas=areas)
    scores = {(r["fold"], r["set"]): r for r in result.scores.collect()}
    placed = folds.with_areas(data, areas[0])
    bench = {(r["fold"], r["set"]): r for r in cv.mean_benchmark(placed, "outer_area").collect()}
    assert set(scores) == set(bench) and len(scores) == 10
    for key in scores:
        assert scores[key]["rmse"] < bench[key]["rmse"]
        assert scores[key]["n"] == bench[key]["n"]
    test = folds.leave_one_out(placed, "outer_area", 2)[1]
    scored = test.select(
        F.expm1("opt_value").alias("label"), F.expm1(result.fold_models[2].expression()).alias("prediction")
    )
    for metric in ("rmse", "r2", "mse"):
        want = RegressionEvaluator(labelCol="label", metricName=metric).evaluate(scored)
        assert scores[(2, "Test")][metric] == pytest.approx(want)
    direct = metrics.regression_scores(scored, "label", "prediction").first()
    assert direct["rmse"] == pytest.approx(scores[(2, "Test")]["rmse"])
    grid = estimators.GRIDS["RidgeRegression"]["alpha"]
    best = {r["outer"]: grid[r["grid_index"]] for r in cv.best_index(result.tuning).collect()}
    assert [best[i] for i in range(5)] == [m.params["alpha"] for m in result.fold_models]
    assert best[-1] == result.final_model.params["alpha"]


def test_tree_cv_scores_and_importance(spark, data, areas):
    result = cv.spatial_cv(
        data, FEATURES, estimators.decision_tree(), "DecisionTree",
        {"maxDepth": [3], "minInstancesPerNode": [6]}, areas=areas, final=False,
    )
    assert result.scores.count() == 10
    summary = importance.importance_summary(importance.importance_table(spark, result), top=2)
    assert {r["feature"] for r in summary.collect()} <= set(FEATURES)
    assert summary.where("rank = 1").first()["feature"] == "a"


def test_depths_share_fits_and_score_like_their_own_trees(data, areas, monkeypatch):
    tree, fits = estimators.decision_tree(), []
    fit = type(tree).fit
    monkeypatch.setattr(type(tree), "fit", lambda self, rows, *a: fits.append(a) or fit(self, rows, *a))
    grid = {"maxDepth": [2, 6], "minInstancesPerNode": [2, 30]}
    result = cv.spatial_cv(data, FEATURES, tree, "DecisionTree", grid, areas=areas)
    assert len(fits) <= 66  # 126 with a fit for each grid point, area and chosen model
    outer, inner, final = areas
    rows = estimators.assemble(folds.with_areas(data, outer, inner, final), FEATURES)
    found = {(r["outer"], r["inner"], r["grid_index"]): r["mse"] for r in result.tuning.collect()}
    assert len(found) == 120
    for label, column in ((1, F.when(F.col("outer_area") != 1, F.col("inner_area_1"))), (-1, F.col("final_area"))):
        for i, point in enumerate(cv.spark_grid(tree, grid)):
            own = fit(tree, rows.where(column != 3), point).transform(rows.where(column == 3))
            want = RegressionEvaluator(labelCol="opt_value", metricName="mse").evaluate(own)
            assert found[label, 3, i] == pytest.approx(want, rel=1e-9)
    best = {r["outer"]: r["grid_index"] for r in cv.best_index(result.tuning).collect()}
    for k, m in [*enumerate(result.fold_models), (-1, result.final_model)]:
        want = fit(tree, rows.where(F.col("outer_area") != k), cv.spark_grid(tree, grid)[best[k]])
        assert m.toDebugString.split("\n")[1:] == want.toDebugString.split("\n")[1:]


def test_grid_order_and_feature_guard():
    points = cv.parameter_grid({"b": [1, 2], "a": [3]})
    assert points == [{"a": 3, "b": 1}, {"a": 3, "b": 2}]
    with pytest.raises(ValueError):
        check_features(["x", "date"])


def test_models_and_scores_survive_storage(spark, data):
    rows = estimators.assemble(data, FEATURES)
    model = estimators.decision_tree(3).fit(rows)
    root = shared_folder(spark)
    store.save_model(model, root, "tree")
    back = store.load_model(root, "tree").transform(rows).select("x", "y", "prediction")
    assert back.exceptAll(model.transform(rows).select("x", "y", "prediction")).count() == 0
    store.save_scores(spark.range(3), root, "s")
    assert store.load_scores(spark, root, "s").count() == 3


@pytest.mark.parametrize("top_depth", [0, 3, 30])
def test_deep_tree_is_the_tree_of_the_engine_on_the_same_bins(spark, top_depth):
    rng = np.random.default_rng(3)
    n = 3000
    a, b, c = rng.random(n), rng.integers(0, 5, n).astype(float), rng.normal(size=n)
    label = np.floor(3 * a * (rng.random(n) > 0.2)) + (b > 3)
    rows = [(*map(float, r), bool(t)) for r, t in zip(zip(a, b, c, label), rng.random(n) < 0.7)]
    df = spark.createDataFrame(rows, "a double, b double, c double, label double, own boolean").repartition(5).cache()
    features = ["a", "b", "c"]
    found = deep_tree.predictions(df, features, "label", F.col("own"), features, top_depth=top_depth)
    codes = ["ca", "cb", "cc"]
    binned = Bucketizer(splitsArray=deep_tree.cuts(df.where("own"), features), inputCols=features, outputCols=codes).transform(df)
    whole = estimators.assemble(binned.withColumns({c: F.col(c) + 0.0 for c in codes}), codes)
    model = estimators.tree_classifier("label").setMaxBins(64).fit(whole.where("own"))
    assert model.depth > 10
    expected = {tuple(r)[:3]: r["prediction"] for r in model.transform(whole).select(*features, "prediction").collect()}
    got = {tuple(r)[:3]: r["prediction"] for r in found.collect()}
    assert len(got) == n
    differ = [k for k in expected if expected[k] != got[k]]
    assert not differ, len(differ)


def test_deep_tree_trains_on_few_rows_in_a_task(spark):
    """The rows of a top leaf go on in one task; Spark ML sees the top alone."""
    rows = spark.range(200_000).select((F.col("id") % 1000).cast("double").alias("a"), F.rand(5).alias("b"), F.col("id") % 2 == 0)
    rows = rows.toDF("a", "b", "own").withColumn("label", (F.xxhash64("a", "b") % 2 == 0).cast("double"))
    found = deep_tree.predictions(rows, ["a", "b"], "label", F.col("own"), ["own"])
    assert found.rdd.getNumPartitions() > 1
    assert found.count() == 200_000


def test_one_vs_rest_is_the_engines_in_few_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.random((4000, 3))
    score = np.stack([2 * x[:, 0], 3 * x[:, 1], x[:, 0] + 2 * x[:, 2]], axis=1) + rng.gumbel(0, 0.5, (4000, 3))
    kind = np.array([0.0, 1.0, 3.0])[score.argmax(1)]  # class 2 has no rows
    df = spark.createDataFrame([(*map(float, a), float(k)) for a, k in zip(x, kind)], "a double, b double, c double, kind double")
    rows = estimators.assemble(df, ["a", "b", "c"]).persist()
    passes = []
    once = OneVsRestLogistic._pass
    monkeypatch.setattr(OneVsRestLogistic, "_pass", staticmethod(lambda *args: passes.append(1) or once(*args)))
    model = estimators.logistic("kind", 4000, one_vs_rest=True).fit(rows)
    assert len(passes) <= 12
    base = LogisticRegression(labelCol="kind", standardization=False, regParam=1 / 4000, tol=1e-12)
    want = OneVsRest(classifier=base, labelCol="kind").fit(rows)
    for k in (0, 1, 3):
        own = want.models[k]
        assert model.weights[k] == pytest.approx([*own.coefficients, own.intercept], abs=1e-5)
    both = list(zip(model.transform(rows).collect(), want.transform(rows).collect()))
    assert sum(a["prediction"] != b["prediction"] for a, b in both) <= 2
    rows.unpersist()
