"""Estimators of the reference models as Spark ML estimators with equivalent settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GBTRegressor,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark.sql import DataFrame

from firnline.ml.logistic import OneVsRestLogistic
from firnline.operators.filters import check_features

# Hyper-parameter grids.
GRIDS: dict[str, dict[str, list]] = {
    "LinearRegression": {"fit_intercept": [True]},
    "RidgeRegression": {"alpha": [15, 20, 30, 40, 50]},
    "LassoRegression": {"alpha": [0.01, 0.05, 0.1, 0.15, 0.25]},
    "ElasticNetRegression": {
        "alpha": [0.001, 0.005, 0.01, 0.05],
        "l1_ratio": [0.001, 0.005, 0.01, 0.05, 0.1],
    },
    "DecisionTree": {"max_depth": [7, 12], "min_samples_leaf": [2, 6]},
    "RandomForest": {
        "max_features": ["sqrt", 9, None],
        "min_samples_leaf": [2, 6],
        "max_depth": [7, 12],
    },
    "GradientBoosting": {"max_depth": [3]},
}


# The grids' names in Spark ML.
SPARK_NAMES = {
    "max_depth": "maxDepth",
    "min_samples_leaf": "minInstancesPerNode",
    "max_features": "featureSubsetStrategy",
}


def spark_parameter(name: str, value: object) -> tuple[str, object]:
    """A grid point's name and value for a Spark ML estimator."""
    if name == "max_features":
        value = "all" if value is None else str(value)
    return SPARK_NAMES.get(name, name), value


def assemble(df: DataFrame, features: Sequence[str], output: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=check_features(features), outputCol=output).transform(df)


def linear(label: str = "opt_value", **_: object) -> LinearRegression:
    return LinearRegression(labelCol=label, solver="normal", standardization=False)


def ridge(alpha: float, n: int, label_std: float, label: str = "opt_value") -> LinearRegression:
    """Penalty alpha * |w|^2 on the sum of squares; Spark divides by n and by the label's
    population deviation."""
    return linear(label).setRegParam(alpha * label_std / n).setElasticNetParam(0.0)


def lasso(alpha: float, label: str = "opt_value") -> LinearRegression:
    return linear(label).setRegParam(alpha).setElasticNetParam(1.0)


def elastic_net(alpha: float, l1_ratio: float, label_std: float, label: str = "opt_value") -> LinearRegression:
    l1 = alpha * l1_ratio
    reg = l1 + alpha * (1 - l1_ratio) * label_std
    return linear(label).setRegParam(reg).setElasticNetParam(l1 / reg)


def decision_tree(max_depth: int = 7, min_samples_leaf: int = 2, label: str = "opt_value", seed: int = 7):
    return DecisionTreeRegressor(
        labelCol=label, maxDepth=max_depth, minInstancesPerNode=min_samples_leaf, seed=seed
    )


def random_forest(
    max_depth: int = 7,
    max_features: str | int | None = "sqrt",
    min_samples_leaf: int = 2,
    n_trees: int = 100,
    label: str = "opt_value",
    seed: int = 7,
):
    subset = spark_parameter("max_features", max_features)[1]
    return RandomForestRegressor(
        labelCol=label,
        maxDepth=max_depth,
        featureSubsetStrategy=subset,
        minInstancesPerNode=min_samples_leaf,
        numTrees=n_trees,
        seed=seed,
    )


def gradient_boosting(max_depth: int = 3, n_trees: int = 100, label: str = "opt_value", seed: int = 7):
    return GBTRegressor(labelCol=label, maxDepth=max_depth, maxIter=n_trees, stepSize=0.1, seed=seed)


def tree_classifier(label: str, max_depth: int = 30, seed: int = 7):
    """The original grows without a limit; 30 is the deepest tree the engine allows."""
    return DecisionTreeClassifier(labelCol=label, impurity="entropy", maxDepth=max_depth, seed=seed)


def logistic(label: str, rows: int, c: float = 1.0, one_vs_rest: bool = False, max_iter: int = 100):
    """Penalty |w|^2 / 2 against ``c`` times the summed loss of ``rows`` training rows; the engine takes
    the mean loss. Intercepts are not penalised, also not those of the one-vs-rest models."""
    if one_vs_rest:
        return OneVsRestLogistic(label, c, max_iter)
    return LogisticRegression(
        labelCol=label, standardization=False, maxIter=max_iter, regParam=1.0 / (c * max(rows, 1))
    )
