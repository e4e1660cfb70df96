"""Scores as plain aggregates: any number of models, folds and sets in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def regression_scores(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MSE, RMSE and R2 per group; R2 is 1 - SSE / (sum y^2 - n mean(y)^2)."""
    y, p = F.col(actual), F.col(predicted)
    rows = df.where(y.isNotNull() & p.isNotNull())
    sse = F.sum((y - p) * (y - p))
    total = F.var_pop(y) * F.count("*")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"),
        (sse / F.count("*")).alias("mse"),
        F.sqrt(sse / F.count("*")).alias("rmse"),
        (1 - sse / total).alias("r2"),
    )


def accuracy(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows whose labels are equal."""
    hit = (F.col(actual) == F.col(predicted)).cast("int")
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


def fold_scores(df: DataFrame, actual: Column, predictions: dict[int, Column], fold: str) -> DataFrame:
    """Train and test scores of the model that left out each fold, in one pass.

    ``predictions`` maps the left-out fold to its model's prediction. Returns
    ``fold, set, n, mse, rmse, r2`` (set is Train or Test).
    """
    y = actual
    aggregates = []
    for k, p in predictions.items():
        for name, rows in (("Train", F.col(fold) != k), ("Test", F.col(fold) == k)):
            error = F.when(rows, (y - p) * (y - p))
            aggregates.append(
                F.struct(
                    F.lit(k).alias("fold"),
                    F.lit(name).alias("set"),
                    F.count(error).alias("n"),
                    F.sum(error).alias("sse"),
                    F.var_pop(F.when(rows, y)).alias("var"),
                ).alias(f"s_{k}_{name}")
            )
    one = df.agg(*aggregates)
    rows = one.select(F.inline(F.array(*[F.col(c) for c in one.columns])))
    mse = F.col("sse") / F.col("n")
    return rows.select(
        "fold",
        "set",
        "n",
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        (1 - mse / F.col("var")).alias("r2"),
    )


def cv_summary(scores: DataFrame, by: Sequence[str] = ("model", "set")) -> DataFrame:
    """Mean and population deviation of RMSE and R2 over the folds."""
    return scores.groupBy(*by).agg(
        F.avg("rmse").alias("rmse"),
        F.stddev_pop("rmse").alias("rmse_std"),
        F.avg("r2").alias("r2"),
        F.stddev_pop("r2").alias("r2_std"),
    )


def comparison_table(summaries: Sequence[DataFrame], test_only: bool = False) -> DataFrame:
    """Summaries of several models under each other."""
    table = summaries[0]
    for s in summaries[1:]:
        table = table.unionByName(s)
    return table.where("set = 'Test'") if test_only else table
