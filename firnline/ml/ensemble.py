"""Statistics over the predictions of the cross-validation models of one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensemble_statistics(
    df: DataFrame,
    predictions: Sequence[str],
    target: str = "opt_value",
    keep: Sequence[str] = ("row", "col"),
    log_scale: bool = True,
) -> DataFrame:
    """Mean, population deviation, absolute error and residual on the original scale.

    Predictions are transformed back first, then averaged. Everything is arithmetic within the
    row.
    """
    k = len(predictions)

    def back(c: str) -> Column:
        return F.expm1(c) if log_scale else F.col(c)

    actual = back(target)
    values = df.select("*", *[back(p).alias(f"_p{i}") for i, p in enumerate(predictions)])
    columns = [F.col(f"_p{i}") for i in range(k)]
    mean = sum(columns[1:], columns[0]) / k
    squares = [(c - F.col("mean_prediction")) ** 2 for c in columns]
    std = F.sqrt(sum(squares[1:], squares[0]) / k)
    return (
        values.withColumn("mean_prediction", mean)
        .withColumn("std_prediction", std)
        .select(
            *keep,
            "mean_prediction",
            "std_prediction",
            F.abs(F.col("mean_prediction") - actual).alias("error_prediction"),
            (actual - F.col("mean_prediction")).alias("residual_prediction"),
            target,
            actual.alias(f"{target}_backtransformed"),
        )
    )
