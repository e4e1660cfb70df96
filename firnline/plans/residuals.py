"""Residual analysis of an ensemble prediction."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from firnline.operators.binning import histograms
from firnline.operators.filters import keyed_sample
from firnline.operators.ranks import qq_fit


def residual_report(pred: DataFrame, keys: Sequence[str], fraction: float = 0.05) -> dict[str, Callable[[], DataFrame]]:
    """Histogram and normal Q-Q fit of the residuals, and a sample for scatter plots: each is computed when its
    function is called."""
    return {
        "histogram": lambda: histograms(pred, ["residual_prediction"]),
        "qq": lambda: qq_fit(pred, "residual_prediction"),
        "sample": lambda: keyed_sample(pred, keys, fraction).select(
            *keys, "opt_value_backtransformed", "mean_prediction", "residual_prediction"
        ),
    }
