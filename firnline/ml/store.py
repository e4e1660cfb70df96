"""Stored models: bundles of a cross-validation's fold models, final model, scores and tuning scores.

A bundle is a folder of versions, all of it written and read by Spark, so any file system Spark knows
serves::

    <root>/bundles/<name>/manifests     one row for each version: kind, features, number of folds
    <root>/bundles/<name>/v<version>/   coefficients (linear models) or models/<fold> (Spark ML),
                                        scores and tuning

The row in ``manifests`` is written last. A version without it does not exist for readers, so a save that
stops half-way leaves the version before as the latest.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml.pipeline import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.ml.cv import CvResult
from firnline.ml.linear import LinearFit

FINAL = -1
PARALLEL = 4  # models of a bundle that are written or read at a time
MANIFEST = "version long, name string, kind string, features array<string>, folds int, final boolean, tuned boolean"
COEFFICIENTS = "fold int, position int, feature string, coefficient double, intercept double, params string"


def save_model(model, root: str, name: str) -> str:
    """Any Spark ML model; wrapped so that loading needs no class name."""
    path = f"{root}/models/{name}"
    PipelineModel([model]).write().overwrite().save(path)
    return path


def load_model(root: str, name: str) -> PipelineModel:
    return PipelineModel.load(f"{root}/models/{name}")


def save_scores(scores: DataFrame, root: str, name: str) -> str:
    path = f"{root}/scores/{name}"
    scores.write.mode("overwrite").parquet(path)
    return path


def load_scores(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/scores/{name}")


def versions(spark: SparkSession, root: str, name: str) -> list[int]:
    """The complete versions of a bundle, oldest first."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(f"{root}/bundles/{name}/manifests").select("version").collect()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["version"] for r in rows)


def save_bundle(spark: SparkSession, result: CvResult, root: str, name: str) -> int:
    """Stores all of ``result`` as the next version, and returns its number. One writer at a time."""
    version = max(versions(spark, root, name), default=0) + 1
    base = f"{root}/bundles/{name}/v{version}"
    models = dict(enumerate(result.fold_models))
    if result.final_model is not None:
        models[FINAL] = result.final_model
    linear_ = all(isinstance(m, LinearFit) for m in models.values())
    if linear_:
        rows = [
            (fold, i, f, float(c), float(m.intercept), json.dumps(m.params, sort_keys=True))
            for fold, m in models.items()
            for i, (f, c) in enumerate(zip(m.features, m.coefficients))
        ]
        spark.createDataFrame(rows, COEFFICIENTS).coalesce(1).write.mode("overwrite").parquet(f"{base}/coefficients")
    else:
        with ThreadPoolExecutor(PARALLEL) as pool:
            list(pool.map(lambda k: PipelineModel([models[k]]).write().overwrite().save(f"{base}/models/{k}"), models))
    result.scores.coalesce(1).write.mode("overwrite").parquet(f"{base}/scores")
    if result.tuning is not None:
        result.tuning.coalesce(1).write.mode("overwrite").parquet(f"{base}/tuning")
    row = (
        version, result.name, "linear" if linear_ else "spark", list(result.features), len(result.fold_models),
        result.final_model is not None, result.tuning is not None,
    )
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{root}/bundles/{name}/manifests")
    return version


def load_bundle(spark: SparkSession, root: str, name: str, version: int | None = None) -> CvResult:
    """The latest or the asked version. Raises ``LookupError`` where there is none."""
    known = versions(spark, root, name)
    if not known or (version is not None and version not in known):
        raise LookupError(f"no bundle {name!r}" + (f" of version {version}" if known else "") + f" under {root}")
    version = known[-1] if version is None else version
    table = spark.read.schema(MANIFEST).parquet(f"{root}/bundles/{name}/manifests")
    manifest = table.where(F.col("version") == version).first()
    base, features = f"{root}/bundles/{name}/v{version}", list(manifest["features"])
    folds = [*range(manifest["folds"]), *([FINAL] if manifest["final"] else [])]
    if manifest["kind"] == "linear":
        by_fold: dict[int, list] = {k: [] for k in folds}
        for r in spark.read.parquet(f"{base}/coefficients").orderBy("fold", "position").collect():
            by_fold[r["fold"]].append(r)
        models = {
            k: LinearFit(
                tuple(r["feature"] for r in rows),
                np.array([r["coefficient"] for r in rows]),
                rows[0]["intercept"],
                json.loads(rows[0]["params"]),
            )
            for k, rows in by_fold.items()
        }
    else:
        with ThreadPoolExecutor(PARALLEL) as pool:
            models = dict(zip(folds, pool.map(lambda k: PipelineModel.load(f"{base}/models/{k}").stages[0], folds)))
    return CvResult(
        manifest["name"],
        features,
        [models[k] for k in range(manifest["folds"])],
        models.get(FINAL),
        spark.read.parquet(f"{base}/scores"),
        spark.read.parquet(f"{base}/tuning") if manifest["tuned"] else None,
    )
