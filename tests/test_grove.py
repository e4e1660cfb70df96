"""Trees grown for many fits at once, against the engine's own fits."""

import numpy as np
import pytest
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import functions as F

from firnline.ml import cv, estimators, folds, grove, store
from firnline.session import shared_folder

FEATURES = ["x", "y", "a", "b"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(23)
    x, y, a, b = rng.random((4, 1200))
    target = 0.6 + 0.8 * a - 0.3 * b + 0.1 * x + 0.02 * rng.normal(size=1200)
    rows = [tuple(map(float, r)) for r in zip(x, y, a, b, target)]
    return spark.createDataFrame(rows, "x double, y double, a double, b double, opt_value double").repartition(4).cache()


@pytest.fixture(scope="module")
def areas(data):
    return folds.nested_areas(data)


def never(*_):
    raise AssertionError("the engine fits this one by one")


def both(data, areas, ours, own):
    rows = estimators.assemble(folds.with_areas(data, *areas), FEATURES)
    return cv.predict_all(rows, [ours, own]).select("outer_area", "opt_value", "prediction_0", "prediction_1").toPandas()


def test_tuned_trees_of_all_fits_grow_in_one_pass_a_level(data, areas, monkeypatch):
    passes = []
    level = grove.best_of_level
    monkeypatch.setattr(grove, "best_of_level", lambda *args: passes.append(1) or level(*args))
    monkeypatch.setattr(DecisionTreeRegressor, "fit", never)
    grid = {"maxDepth": [2, 5], "minInstancesPerNode": [2, 30]}
    result = cv.spatial_cv(data, FEATURES, estimators.decision_tree(), "DecisionTree", grid, areas=areas)
    assert len(passes) <= 5
    assert result.tuning.count() == 120 and result.scores.count() == 10


@pytest.mark.parametrize("limit", ["DRIVER_BYTES", "TASK_BYTES"])
def test_sums_met_by_a_shuffle_or_in_several_passes_give_the_same_trees(data, areas, monkeypatch, limit):
    grid = {"maxDepth": [6], "minInstancesPerNode": [2, 6]}
    args = (data, FEATURES, estimators.decision_tree(), "DecisionTree", grid)
    whole = cv.spatial_cv(*args, areas=areas)
    monkeypatch.setattr(grove, limit, 0)
    again = cv.spatial_cv(*args, areas=areas)
    for one, two in zip([*whole.fold_models, whole.final_model], [*again.fold_models, again.final_model]):
        assert one.toDebugString.split("\n")[1:] == two.toDebugString.split("\n")[1:]


def test_more_values_than_cells_are_cut_at_quantiles_of_all_rows(data, areas, monkeypatch):
    monkeypatch.setattr(grove, "CELLS", 300)
    result = cv.spatial_cv(data, FEATURES, estimators.decision_tree(), "DecisionTree", areas=areas, tune=False)
    rows = estimators.assemble(folds.with_areas(data, *areas), FEATURES)
    found = both(data, areas, result.fold_models[1], estimators.decision_tree(5, 1).fit(rows.where("outer_area <> 1")))
    errors = [((found[f"prediction_{i}"] - found["opt_value"]) ** 2)[found["outer_area"] != 1].mean() for i in (0, 1)]
    assert errors[0] < 1.1 * errors[1]


def test_cells_of_skewed_values_hold_about_as_many_rows(spark):
    values = np.r_[np.zeros(5000), np.random.default_rng(1).lognormal(size=15000)]
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(3)
    ends, exact = grove.cell_ends(rows, ["v"])[0]
    assert not exact and len(ends) <= grove.CELLS
    sizes = np.bincount(np.searchsorted(ends[:-1], values))
    assert sizes[0] >= 5000 and sizes[1:].max() <= 4 * len(values) / grove.CELLS


def test_missing_values_are_refused(data, areas):
    gap = data.withColumn("a", F.when(F.col("a") < 0.9, F.col("a")))
    with pytest.raises(Exception, match="missing values"):
        cv.spatial_cv(gap, FEATURES, estimators.decision_tree(), "DecisionTree", areas=areas)


def test_boosting_of_all_fits_is_the_engines(data, areas, monkeypatch):
    booster = estimators.gradient_boosting(n_trees=8)
    rows = estimators.assemble(folds.with_areas(data, *areas), FEATURES)
    own = booster.fit(rows.where("outer_area <> 3"))
    monkeypatch.setattr(GBTRegressor, "fit", never)
    result = cv.spatial_cv(data, FEATURES, booster, "GradientBoosting", areas=areas)
    ours = result.fold_models[3]
    found = both(data, areas, ours, own)
    assert np.abs(found["prediction_0"] - found["prediction_1"]).max() < 1e-9
    np.testing.assert_allclose(ours.featureImportances.toArray(), own.featureImportances.toArray(), atol=1e-9)
    assert ours.treeWeights == own.treeWeights and result.final_model.getNumTrees == 8


def test_forests_of_all_fits_grow_together_and_score_like_the_engines(data, areas, monkeypatch):
    forest = estimators.random_forest(n_trees=40)
    rows = estimators.assemble(folds.with_areas(data, *areas), FEATURES)
    own = forest.fit(rows.where("outer_area <> 3"))
    passes = []
    level = grove.best_of_level
    monkeypatch.setattr(grove, "best_of_level", lambda *args: passes.append(1) or level(*args))
    monkeypatch.setattr(RandomForestRegressor, "fit", never)
    result, again = (cv.spatial_cv(data, FEATURES, forest, "RandomForest", areas=areas) for _ in range(2))
    assert len(passes) <= 14
    ours = result.fold_models[3]
    assert ours.toDebugString.split("\n")[1:] == again.fold_models[3].toDebugString.split("\n")[1:]
    assert ours.getNumTrees == 40 and len({t.toDebugString.split("\n", 1)[1] for t in ours.trees}) == 40
    found = both(data, areas, ours, own)
    errors = [((found[f"prediction_{i}"] - found["opt_value"]) ** 2).mean() for i in (0, 1)]
    assert errors[0] < 1.25 * errors[1]
    assert np.corrcoef(found["prediction_0"], found["prediction_1"])[0, 1] > 0.98
    np.testing.assert_allclose(ours.featureImportances.toArray(), own.featureImportances.toArray(), atol=0.1)


def test_draws_of_a_block_follow_the_poisson_law():
    block = {"y": np.zeros(200_000), "draw": [(2, 5)]}
    one, two = grove.drawn(block, 7, 0), grove.drawn(block, 7, 1)
    assert abs(one.mean() - 1) < 0.01 and abs(one.var() - 1) < 0.02 and abs((one == 0).mean() - np.exp(-1)) < 0.005
    assert abs(np.corrcoef(one, two)[0, 1]) < 0.01
    np.testing.assert_array_equal(one, grove.drawn(block, 7, 0))


def test_models_of_a_bundle_are_read_in_the_order_of_their_folds(spark, data, areas, monkeypatch):
    seen = []
    pool = store.ThreadPoolExecutor
    monkeypatch.setattr(store, "ThreadPoolExecutor", lambda n: seen.append(n) or pool(n))
    result = cv.spatial_cv(data, FEATURES, estimators.random_forest(n_trees=3), "RandomForest", areas=areas)
    root = shared_folder(spark)
    store.save_bundle(spark, result, root, "forest")
    back = store.load_bundle(spark, root, "forest")
    assert seen == [store.PARALLEL] * 2
    for one, two in zip([*result.fold_models, result.final_model], [*back.fold_models, back.final_model]):
        assert one.uid == two.uid and one.toDebugString == two.toDebugString
