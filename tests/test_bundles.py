"""Moments, stored bundles, scoring of all rows, and all seven estimators from table to prediction."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from firnline.grid import Grid
from firnline.ml import cv, estimators, folds, importance, linear, store
from firnline.operators.masks import apply_masks
from firnline.session import shared_folder
from firnline.sources import rasters

FEATURES = ["x", "y", "a", "b"]
LINEAR = ("LinearRegression", "RidgeRegression", "LassoRegression", "ElasticNetRegression")


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x, y, a, b = rng.random((4, 600))
    target = 0.6 + 0.8 * a - 0.3 * b + 0.1 * x + 0.02 * rng.normal(size=600)
    x, y = np.floor(x * 8) / 8, np.floor(y * 8) / 8
    rows = [tuple(map(float, r)) for r in zip(x, y, a, b, target)]
    return spark.createDataFrame(rows, "x double, y double, a double, b double, opt_value double").repartition(4).cache()


@pytest.fixture(scope="module")
def areas(data):
    return folds.nested_areas(data)


@pytest.fixture(scope="module")
def ridge(data, areas):
    return cv.spatial_cv_linear(data, FEATURES, "RidgeRegression", areas=areas)


def by_numpy(m, alpha):
    x, y = m[:, :-1], m[:, -1]
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ yc)
    return w, np.mean((yc - xc @ w) ** 2)


def test_targets_far_from_zero_cost_no_digits(data):
    shift = 1e8
    shifted = data.select(*FEATURES, (F.col("opt_value") + shift).alias("opt_value"))
    near = linear.cross_products(data, FEATURES, "opt_value")[()]
    far = linear.cross_products(shifted, FEATURES, "opt_value")[()]
    m = np.array(shifted.select(*FEATURES, F.col("opt_value") - shift).collect())  # as rounded by the shift
    w, mse = by_numpy(m, 20.0)
    fit = linear.ridge(far, FEATURES, 20.0)
    np.testing.assert_allclose(fit.coefficients, w, rtol=0, atol=1e-9)
    assert fit.mse(far) == pytest.approx(mse, abs=1e-9)
    np.testing.assert_allclose(near.m, far.m, rtol=1e-5, atol=1e-5)
    bench = {r["set"]: r for r in cv.mean_benchmark(
        shifted.withColumn("k", (F.col("x") * 2).cast("int")), "k", log_target=False
    ).where("fold = 0").collect()}
    x, y = m[:, 0], m[:, -1]
    test, train = y[x < 0.5], y[x >= 0.5]
    assert bench["Test"]["mse"] == pytest.approx(np.mean((test - train.mean()) ** 2), rel=1e-7)
    assert bench["Train"]["mse"] == pytest.approx(train.var(), rel=1e-7)


def test_moments_merge_in_any_order(data):
    parts = linear.cross_products(data.withColumn("g", (F.col("x") * 4).cast("int")), FEATURES, "opt_value", ["g"])
    whole = linear.cross_products(data, FEATURES, "opt_value")[()]
    for order in (sorted(parts), sorted(parts, reverse=True)):
        merged = linear.total([parts[k] for k in order])
        np.testing.assert_allclose(merged.m, whole.m, rtol=1e-10, atol=1e-10)
        np.testing.assert_allclose(merged.mean, whole.mean, rtol=1e-12)


def test_nested_cv_collects_one_matrix_for_each_pair_of_areas(data, areas):
    placed = folds.with_areas(data, *areas)
    found = linear.grouped_moments(placed, FEATURES, "opt_value", cv.cv_families(5))
    assert len(found) <= 30
    for i in range(5):
        train = placed.where(F.col("outer_area") != i)
        assert sum(p.n for (f, _), p in found.items() if f == f"inner_{i}") == train.count()


def test_kmeans_is_the_same_in_any_order_and_leaves_no_area_empty(data):
    weights = folds.cell_weights(data)
    assert folds.fit_centres(weights) == folds.fit_centres(weights.repartition(7))
    corner = data.where("x < 0.2 or x > 0.8")
    centres = folds.fit_centres(folds.cell_weights(corner))
    assert corner.select(folds.area(centres).alias("a")).distinct().count() == 5
    assert folds.fit_centres(folds.cell_weights(data.where("false"))) == []


def same_predictions(rows, before, after):
    keep = ["x", "y", "a", "b"]
    one, two = (cv.score_all(rows, r, keep, "opt_value") for r in (before, after))
    assert one.exceptAll(two).count() == 0 and one.count() == two.count() == rows.count()
    return two


def test_linear_bundle(spark, data, ridge):
    root = shared_folder(spark)
    assert store.save_bundle(spark, ridge, root, "ridge") == 1
    back = store.load_bundle(spark, root, "ridge")
    assert back.features == FEATURES and back.name == "RidgeRegression" and len(back.fold_models) == 5
    same_predictions(data, ridge, back)
    assert back.final_model.params == ridge.final_model.params
    np.testing.assert_array_equal(back.final_model.coefficients, ridge.final_model.coefficients)
    assert back.scores.exceptAll(ridge.scores).count() == 0
    assert back.tuning.count() == ridge.tuning.count() == 5 * 5 * 6
    assert back.tuning.exceptAll(ridge.tuning).count() == 0


def test_tree_bundle(spark, data, areas):
    grid = {"max_depth": [2, 4], "min_samples_leaf": [2, 6]}
    tree = cv.spatial_cv(data, FEATURES, estimators.decision_tree(), "DecisionTree", grid, areas=areas)
    best = {r["outer"]: cv.parameter_grid(grid)[r["grid_index"]] for r in cv.best_index(tree.tuning).collect()}
    for i, m in enumerate([*tree.fold_models, tree.final_model]):
        point = best[i if i < 5 else -1]
        assert m.getMaxDepth() == point["max_depth"] and m.getMinInstancesPerNode() == point["min_samples_leaf"]
    root = shared_folder(spark)
    store.save_bundle(spark, tree, root, "tree")
    back = store.load_bundle(spark, root, "tree")
    same_predictions(data, tree, back)
    assert importance.importance_table(spark, back).exceptAll(importance.importance_table(spark, tree)).count() == 0
    assert back.final_model.toDebugString.split("\n", 1)[1] == tree.final_model.toDebugString.split("\n", 1)[1]


def test_versions_and_unfinished_saves(spark, ridge):
    root = shared_folder(spark)
    with pytest.raises(LookupError):
        store.load_bundle(spark, root, "none")
    store.save_bundle(spark, ridge, root, "m")
    # a save that stops before its manifest: the folder is there, the version is not
    spark.range(1).write.parquet(f"{root}/bundles/m/v2/coefficients")
    assert store.versions(spark, root, "m") == [1]
    assert store.save_bundle(spark, ridge, root, "m") == 2
    assert store.versions(spark, root, "m") == [1, 2]
    assert len(store.load_bundle(spark, root, "m", 1).fold_models) == 5
    with pytest.raises(LookupError):
        store.load_bundle(spark, root, "m", 3)


def test_all_rows_are_scored(spark, data, ridge):
    """Rows without a label are predicted, rows without a feature get null, no row is lost."""
    odd = spark.createDataFrame(
        [(0.1, 0.1, -1.0, 0.5, None), (0.2, 0.2, None, 0.5, 0.7)], "x double, y double, a double, b double, opt_value double"
    )
    rows = data.unionByName(odd)
    out = cv.score_all(rows, ridge, ["x", "y", "a"], "opt_value")
    assert out.count() == rows.count()
    masked = out.where("a = -1").first()
    assert masked["mean_prediction"] is not None and masked["residual_prediction"] is None
    assert out.where("a is null").first()["mean_prediction"] is None
    row = data.first()
    want = np.expm1([m.coefficients @ [row[f] for f in FEATURES] + m.intercept for m in ridge.fold_models])
    got = cv.score_all(data, ridge, [*FEATURES]).where(
        (F.col("a") == row["a"]) & (F.col("b") == row["b"])
    ).first()
    assert got["mean_prediction"] == pytest.approx(want.mean()) and got["std_prediction"] == pytest.approx(want.std())


@pytest.mark.parametrize("name", [*LINEAR, "DecisionTree", "RandomForest", "GradientBoosting"])
def test_from_table_to_prediction(spark, data, areas, name):
    """Load, filter, cross-validate, save, load and predict with every estimator."""
    root = shared_folder(spark)
    data.write.parquet(f"{root}/table")
    mask = data.select("x", "y").distinct().withColumn("melt", (F.col("x") > 0).cast("int"))
    rows = apply_masks(spark.read.parquet(f"{root}/table"), mask)
    assert 0 < rows.count() < data.count() and rows.where("x = 0").isEmpty()
    if name in LINEAR:
        grid = {k: v[:2] for k, v in estimators.GRIDS[name].items()}
        result = cv.spatial_cv_linear(rows, FEATURES, name, grid, areas=areas)
    else:
        estimator = {
            "DecisionTree": estimators.decision_tree(3),
            "RandomForest": estimators.random_forest(3, n_trees=4),
            "GradientBoosting": estimators.gradient_boosting(2, n_trees=3),
        }[name]
        result = cv.spatial_cv(rows, FEATURES, estimator, name, tune=False, areas=areas)
    store.save_bundle(spark, result, root, name)
    back = store.load_bundle(spark, root, name)
    scored = same_predictions(data, result, back)
    assert scored.where("mean_prediction is null").count() == 0
    assert scored.where("error_prediction < 1.5").count() > 0.9 * data.count()
    table = importance.importance_table(spark, back)
    assert table.count() == 5 * len(FEATURES)
    if name != "LinearRegression":
        assert table.where("importance < 0").count() == 0


def test_lines_are_filled_and_cells_outside_are_counted(spark):
    grid = Grid(x0=0.0, y0=0.0, step=1.0, ncols=1462, nrows=3)
    cells = [("d", r, c, float(c)) for r in (0, 2) for c in (0, 1, 700, 1461)] + [("d", 2, 5, None)]
    df = spark.createDataFrame(cells, "date string, row int, col int, v double")
    lines = {r["row"]: r["line"] for r in rasters.long_to_lines(df, "v", grid).collect()}
    assert [len(lines[i]) for i in range(3)] == [1462] * 3
    assert {i: v for i, v in enumerate(lines[0]) if v is not None} == {0: 0.0, 1: 1.0, 700: 700.0, 1461: 1461.0}
    assert lines[1] == [None] * 1462 and lines[2][5] is None
    off = df.unionByName(spark.createDataFrame([("d", 3, 0, 1.0), ("d", 0, 1462, 1.0), ("d", -1, 0, 1.0)], df.schema))
    with pytest.raises(ValueError, match="3 cells"):
        rasters.long_to_lines(off, "v", grid)
    dropped = rasters.long_to_lines(off, "v", grid, outside="drop")
    assert dropped.exceptAll(rasters.long_to_lines(df, "v", grid)).count() == 0
