"""Nested spatial cross-validation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

from pyspark.ml import Estimator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.ml import grove, linear
from firnline.ml.ensemble import ensemble_statistics
from firnline.ml.estimators import GRIDS, assemble, spark_parameter
from firnline.ml.folds import Areas, nested_areas, with_areas
from firnline.ml.metrics import fold_scores
from firnline.operators.filters import check_features


@dataclass
class CvResult:
    """Models of the outer folds, the final model, scores and tuning scores."""

    name: str
    features: list[str]
    fold_models: list
    final_model: object
    scores: DataFrame  # model, fold, set, n, mse, rmse, r2
    tuning: DataFrame | None = None  # outer, inner, grid_index, mse


def parameter_grid(grid: dict[str, Sequence]) -> list[dict]:
    """Cartesian product, keys in sorted order."""
    keys = sorted(grid)
    return [dict(zip(keys, values)) for values in product(*[grid[k] for k in keys])]


def spark_grid(estimator: Estimator, grid: dict[str, Sequence]) -> list[dict]:
    """The same product as parameter maps of an estimator; names of ``GRIDS`` are translated."""
    maps = []
    for point in parameter_grid(grid):
        named = (spark_parameter(k, v) for k, v in point.items())
        maps.append({estimator.getParam(k): v for k, v in named})
    return maps


def best_index(scores: DataFrame) -> DataFrame:
    """Grid point with the smallest mean score per outer set; the first minimum wins."""
    means = scores.groupBy("outer", "grid_index").agg(F.avg("mse").alias("mean_mse"))
    return means.groupBy("outer").agg(
        F.min_by("grid_index", F.struct("mean_mse", "grid_index")).alias("grid_index"),
        F.min("mean_mse").alias("mean_mse"),
    )


def _actual_and_back(target: str, log_target: bool, label_space: str) -> tuple[Column, Callable]:
    y = F.col(target)
    if not log_target:
        return y, lambda c: c
    return (y if label_space == "log" else F.expm1(y)), F.expm1


def cv_families(k: int) -> dict[str, Column]:
    """The inner areas of each outer area's training rows, and the areas that tune the final model."""
    out = {f"inner_{i}": F.when(F.col("outer_area") != i, F.col(f"inner_area_{i}")) for i in range(k)}
    return {**out, "final": F.col("final_area")}


def leave_one_area_out(
    df: DataFrame,
    features: Sequence[str],
    model: str,
    fold: str,
    target: str = "opt_value",
    log_target: bool = True,
    **params: object,
) -> CvResult:
    """One fit for each value of ``fold`` (an integer column) without its rows, and one on all rows; scores
    for both sets. One pass for the moments, one for the scores."""
    features = check_features(features)
    fit = linear.FITTERS[model]
    parts = {int(v): p for (_, v), p in linear.grouped_moments(df, features, target, {"fold": F.col(fold)}).items()}
    parts = dict(sorted(parts.items()))
    models = {k: fit(linear.total([p for j, p in parts.items() if j != k]), features, **params) for k in parts}
    actual, back = _actual_and_back(target, log_target, "original")
    scores = fold_scores(df, actual, {k: back(m.expression()) for k, m in models.items()}, fold)
    final = fit(linear.total(list(parts.values())), features, **params)
    return CvResult(model, features, list(models.values()), final, scores.withColumn("model", F.lit(model)))


def spatial_cv_linear(
    df: DataFrame,
    features: Sequence[str],
    model: str,
    grid: dict[str, Sequence] | None = None,
    tune: bool = True,
    target: str = "opt_value",
    log_target: bool = True,
    label_space: str = "original",
    areas: Areas | None = None,
) -> CvResult:
    """Nested spatial cross-validation of a linear model in two passes over the data.

    Pass 1 aggregates moments per (outer, inner) pair of areas and per final area, ``k * k + k``
    matrices; tuning and all fits use only those. Pass 2 scores all outer models at once. ``label_space='log'`` scores back-transformed
    predictions against untransformed labels, as the original figures were made. ``areas`` (from
    ``nested_areas``) lets several models share their folds.
    """
    features = check_features(features)
    points = parameter_grid(grid or GRIDS[model])
    fit = linear.FITTERS[model]
    outer, inner, final = areas or nested_areas(df)
    placed = with_areas(df, outer, inner, final)
    groups = linear.grouped_moments(placed, features, target, cv_families(len(outer)))
    by_fold: dict[str, dict[int, linear.Moments]] = {}
    for (family, value), p in groups.items():
        by_fold.setdefault(family, {})[int(value)] = p
    log: list[tuple[int, int, int, float]] = []

    def fitted(family: str, label: int) -> linear.LinearFit:
        """The best grid point on the family's areas, fitted on all of them."""
        areas_ = dict(sorted(by_fold[family].items()))
        sums = [0.0] * len(points)
        for j, held in areas_.items() if tune else ():
            others = [p for k, p in areas_.items() if k != j]
            if not others:
                continue
            rest = linear.total(others)
            for i, params in enumerate(points):
                score = fit(rest, features, **params).mse(held)
                log.append((label, j, i, score))
                sums[i] += score
        params = points[sums.index(min(sums))] if tune else points[0]
        return fit(linear.total(list(areas_.values())), features, **params)

    models = [fitted(f"inner_{i}", i) for i in range(len(outer))]
    final_model = fitted("final", -1)

    actual, back = _actual_and_back(target, log_target, label_space)
    predictions = {i: back(m.expression()) for i, m in enumerate(models)}
    scores = fold_scores(placed, actual, predictions, "outer_area").withColumn("model", F.lit(model))
    tuning = df.sparkSession.createDataFrame(
        log or [], "outer int, inner int, grid_index int, mse double"
    )
    return CvResult(model, features, models, final_model, scores, tuning if tune else None)


def spatial_cv(
    df: DataFrame,
    features: Sequence[str],
    estimator: Estimator,
    name: str,
    grid: dict[str, Sequence] | None = None,
    tune: bool = True,
    target: str = "opt_value",
    log_target: bool = True,
    label_space: str = "original",
    final: bool = True,
    parallelism: int = 4,
    areas: Areas | None = None,
) -> CvResult:
    """Nested spatial cross-validation of any Spark ML regressor. Without ``tune`` the first grid point is taken.

    Trees grow in passes that all fits share (``grove``). Other estimators, and ensembles that are tuned, are fitted one by one: one
    assembled table is kept for the run and every fit reads its rows by a filter on the area columns, so no
    fit keeps a copy of its training rows; at most ``parallelism`` fits run at a time, whatever the folds and
    grid points. A fold's grid points are scored on its held-out area in one pass.
    """
    features = check_features(features)
    outer, inner, final_areas = areas or nested_areas(df)
    placed = with_areas(df, outer, inner, final_areas)
    rows = assemble(placed, features)
    maps = spark_grid(estimator, grid) if grid else [{}]
    searched = tune and len(maps) > 1
    if grove.grows(estimator, maps, searched):
        same = list(final_areas) == list(outer)
        grown = grove.cross_validated(placed, features, target, estimator, maps, searched, len(outer), final, same)
        models, final_model, log = grown.fold_models, grown.final_model, grown.log
        scores = _scores(rows, models, name, target, log_target, label_space)
    else:
        kept = [target, "features", "outer_area", "final_area", *[f"inner_area_{i}" for i in range(len(outer))]]
        rows = rows.select(*kept).persist()
        try:
            models, final_model, log = _one_by_one(rows, estimator, maps, searched, target, len(outer), final, parallelism)
            scores = _scores(rows, models, name, target, log_target, label_space)
        finally:
            rows.unpersist()
    tuning = df.sparkSession.createDataFrame(log, "outer int, inner int, grid_index int, mse double") if searched else None
    return CvResult(name, features, models, final_model, scores, tuning)


def _scores(rows: DataFrame, models: Sequence, name: str, target: str, log_target: bool, label_space: str) -> DataFrame:
    """Train and test scores of the outer models: ten rows, brought in so that nothing is computed twice."""
    actual, back = _actual_and_back(target, log_target, label_space)
    predictions = {i: back(F.col(f"prediction_{i}")) for i in range(len(models))}
    result = fold_scores(predict_all(rows, models), actual, predictions, "outer_area").withColumn("model", F.lit(name))
    return rows.sparkSession.createDataFrame(result.collect(), result.schema)


def _one_by_one(
    rows: DataFrame, estimator: Estimator, maps: Sequence[dict], searched: bool, target: str, k: int, final: bool, parallelism: int
) -> tuple[list, object, list[tuple[int, int, int, float]]]:
    """Outer models, final model and tuning scores, each fit by the engine."""
    families = cv_families(k)
    labels = {f"inner_{i}": i for i in range(k)} | ({"final": -1} if final else {})

    def one(job: tuple[str, int]) -> list[tuple[int, int, int, float]]:
        """Scores of all grid points on one area of a family."""
        family, j = job
        area_ = families[family]
        held, rest = rows.where(area_ == j), rows.where(area_ != j)
        if held.isEmpty() or rest.isEmpty():
            return []
        models = [estimator.fit(rest, m) for m in maps]
        errors = [F.avg(F.pow(F.col(f"prediction_{i}") - F.col(target), 2)) for i in range(len(models))]
        found = predict_all(held, models).agg(*errors).first()
        return [(labels[family], j, i, float(score)) for i, score in enumerate(found)]

    def fit(label: int):
        own = rows.where(families["final"].isNotNull() if label < 0 else F.col("outer_area") != label)
        return estimator.fit(own, maps[chosen.get(label, 0)])

    with ThreadPoolExecutor(parallelism) as pool:
        jobs = [(f, j) for f in labels for j in range(k)] if searched else []
        log = [x for found in pool.map(one, jobs) for x in found]
        chosen = grove.chosen_points(log)
        models = list(pool.map(fit, [*range(k), *([-1] if final else [])]))
    return models[:k], models[k] if final else None, log


def predict_all(rows: DataFrame, models: Sequence, prefix: str = "prediction_") -> DataFrame:
    """One prediction column per model, in one pass."""
    for i, m in enumerate(models):
        rows = m.copy({m.predictionCol: f"{prefix}{i}"}).transform(rows)
    return rows


def predict_folds(rows: DataFrame, result: CvResult, prefix: str = "prediction_") -> DataFrame:
    """``rows`` with a prediction column for each fold model of ``result``, on the scale the models were
    fitted on, in one map over the rows whatever they are: masked, cloudy and water pixels too. A row that
    misses a feature gets null from every model."""
    names = [f"{prefix}{i}" for i in range(len(result.fold_models))]
    if all(isinstance(m, linear.LinearFit) for m in result.fold_models):
        return rows.withColumns({n: m.expression() for n, m in zip(names, result.fold_models)})
    complete = F.lit(True)
    for f in result.features:
        complete = complete & F.col(f).isNotNull()
    filled = rows.select("*", *[F.coalesce(F.col(f), F.lit(0.0)).alias(f"__{f}") for f in result.features])
    vectors = VectorAssembler(inputCols=[f"__{f}" for f in result.features], outputCol="__features").transform(filled)
    for n, m in zip(names, result.fold_models):
        vectors = m.copy({m.predictionCol: n, m.featuresCol: "__features"}).transform(vectors)
    return vectors.select(*rows.columns, *[F.when(complete, F.col(n)).alias(n) for n in names])


def score_all(
    rows: DataFrame, result: CvResult, keep: Sequence[str], target: str | None = None, log_target: bool = True
) -> DataFrame:
    """Predictions of all fold models for every row, reduced to mean and deviation on the original scale;
    with ``target`` also error and residual, null where it is missing."""
    label = target or "__none"
    known = rows if target else rows.withColumn(label, F.lit(None).cast("double"))
    predicted = predict_folds(known, result, "__p")
    names = [f"__p{i}" for i in range(len(result.fold_models))]
    out = ensemble_statistics(predicted, names, label, keep, log_target)
    return out if target else out.select(*keep, "mean_prediction", "std_prediction")


def mean_benchmark(
    df: DataFrame,
    fold: str,
    target: str = "opt_value",
    log_target: bool = True,
    label_space: str = "original",
) -> DataFrame:
    """Scores of predicting the training mean for each left-out area.

    One grouped aggregate of counts, means and deviations; what is left out is merged from the other
    areas' rows (one for each area), so nothing is subtracted from large sums.
    """
    actual, _ = _actual_and_back(target, log_target, label_space)
    parts = df.groupBy(F.col(fold).alias("fold")).agg(
        F.count(target).alias("n"),
        F.avg(target).alias("t"),
        F.avg(actual).alias("z"),
        (F.var_pop(actual) * F.count(actual)).alias("m"),
    )
    whole = F.collect_list(F.struct("fold", "n", "t", "z", "m")).over(Window.partitionBy(F.lit(0)))
    all_parts = F.col("areas")
    zero = F.lit(0.0)

    def total(rows: Column, value: Callable[[Column], Column]) -> Column:
        return F.aggregate(rows, zero, lambda acc, p: acc + value(p))

    with_rest = parts.withColumn("areas", whole).select(
        F.col("fold"),
        F.filter(all_parts, lambda p: p["fold"] != F.col("fold")).alias("Train"),
        F.filter(all_parts, lambda p: p["fold"] == F.col("fold")).alias("Test"),
    )
    n_train = total(F.col("Train"), lambda p: p["n"].cast("double"))
    mean = F.try_divide(total(F.col("Train"), lambda p: p["n"] * p["t"]), n_train)
    predicted = with_rest.withColumn("prediction", F.expm1(mean) if log_target else mean)

    def part(name: str) -> Column:
        rows, m = F.col(name), F.col("prediction")
        n = total(rows, lambda p: p["n"].cast("double"))
        centre = F.try_divide(total(rows, lambda p: p["n"] * p["z"]), n)
        return F.struct(
            F.lit(name).alias("set"),
            n.cast("long").alias("n"),
            total(rows, lambda p: p["m"] + p["n"] * (p["z"] - m) * (p["z"] - m)).alias("sse"),
            total(rows, lambda p: p["m"] + p["n"] * (p["z"] - centre) * (p["z"] - centre)).alias("sst"),
        )

    rows = predicted.select("fold", "prediction", F.inline(F.array(part("Train"), part("Test"))))
    mse = F.try_divide(F.col("sse"), F.col("n"))
    return rows.select(
        "fold", "set", "n", "prediction",
        mse.alias("mse"), F.sqrt(mse).alias("rmse"), (1 - F.try_divide(F.col("sse"), F.col("sst"))).alias("r2"),
    )
