"""Feature importance over the cross-validation models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from firnline.ml.cv import CvResult
from firnline.ml.linear import LinearFit

SIGNED = ("LinearRegression",)  # the other linear models use absolute coefficients


def importance_table(spark: SparkSession, result: CvResult) -> DataFrame:
    """``model, fold, feature, importance``; a handful of rows per model."""
    rows = []
    for k, m in enumerate(result.fold_models):
        if isinstance(m, LinearFit):
            values = m.coefficients if result.name in SIGNED else abs(m.coefficients)
        else:
            values = m.featureImportances.toArray()
        rows += [(result.name, k, f, float(v)) for f, v in zip(result.features, values)]
    return spark.createDataFrame(rows, "model string, fold int, feature string, importance double")


def intercept_table(spark: SparkSession, result: CvResult) -> DataFrame:
    rows = [(result.name, k, float(m.intercept)) for k, m in enumerate(result.fold_models)]
    return spark.createDataFrame(rows, "model string, fold int, intercept double")


def importance_summary(table: DataFrame, top: int | None = None) -> DataFrame:
    """Mean and sample deviation over the folds, ranked by absolute mean within each model."""
    stats = table.groupBy("model", "feature").agg(
        F.avg("importance").alias("mean"), F.stddev_samp("importance").alias("std")
    )
    order = W.partitionBy("model").orderBy(F.desc(F.abs("mean")), "feature")
    ranked = stats.withColumn("rank", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("rank") <= top)


def coefficient_summary(table: DataFrame, intercepts: DataFrame, features: list[str]) -> DataFrame:
    """Mean intercept, and mean and population deviation of selected coefficients."""
    base = intercepts.groupBy("model").agg(F.avg("intercept").alias("mean_intercept"))
    stats = (
        table.where(F.col("feature").isin(features))
        .groupBy("model", "feature")
        .agg(F.avg("importance").alias("mean"), F.stddev_pop("importance").alias("std"))
    )
    return stats.join(base, "model")
