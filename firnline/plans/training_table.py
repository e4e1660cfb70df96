"""Training matrix: extended table without clouds, masked cells and bad days, scaled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from firnline.functions.scalars import normalise
from firnline.operators.bounded import dates_of
from firnline.operators.masks import CELL, apply_masks


def training_table(
    extended: DataFrame,
    no_melt: DataFrame | None = None,
    little_melt: DataFrame | None = None,
    bad_days: DataFrame | None = None,
    scaled: bool = True,
    keep_ids: bool = False,
    cell: Sequence[str] = CELL,
) -> DataFrame:
    """``cell`` names the columns that the masks and ``extended`` share."""
    rows = apply_masks(extended, no_melt, little_melt, cell=cell)
    if bad_days is not None:
        rows = rows.join(dates_of(bad_days), "date", "left_anti")
    if not keep_ids:
        rows = rows.drop("row", "col", "date")
    return normalise(rows) if scaled else rows


def prediction_table(extended: DataFrame, scaled: bool = True) -> DataFrame:
    """Every pixel, including masked and cloudy ones."""
    return normalise(extended) if scaled else extended
