"""Joins between layers. All are equi joins; the engine picks broadcast by measured size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from firnline.operators.bounded import dates_of, of_pixel_size, per_date


def microwave_with_optical(microwave: DataFrame, optical: DataFrame) -> DataFrame:
    """All days at once: microwave pixels with the optical value of the same day and cell."""
    return microwave.join(optical, ["date", "x", "y"], "left")


def value_on_previous_day(pixels: DataFrame, value: str, name: str) -> DataFrame:
    """Self join on (cell, date - 1)."""
    before = pixels.select("x", "y", F.date_add("date", 1).alias("date"), F.col(value).alias(name))
    return pixels.join(before, ["x", "y", "date"], "left")


def attach_station(pixels: DataFrame, *series: DataFrame) -> DataFrame:
    """Left join of daily station series by date: one row for each date, broadcast, as a date is a hot key."""
    for s in series:
        pixels = pixels.join(per_date(s), "date", "left")
    return pixels


def drop_by_layer(pixels: DataFrame, layer: DataFrame, condition: Column) -> DataFrame:
    """Remove pixels whose (date, cell) meets a condition in another layer; days on which that
    layer has no scene are left out altogether."""
    with_scene = pixels.join(dates_of(layer), "date", "left_semi")
    return with_scene.join(of_pixel_size(layer.where(condition)), ["date", "x", "y"], "left_anti")


def nearest_cell(cells: DataFrame, px: float, py: float) -> Column:
    """The cell with the smallest |dx| + |dy| as a scalar struct; ties go to the smaller (x, y)."""
    distance = F.abs(F.col("x") - px) + F.abs(F.col("y") - py)
    return cells.agg(
        F.min_by(F.struct("x", "y"), F.struct(distance.alias("d"), F.col("x"), F.col("y")))
    ).scalar()


def series_at(pixels: DataFrame, cells: DataFrame, px: float, py: float) -> DataFrame:
    """Full history of the cell nearest to a point: a filter by a scalar, not a join."""
    at = nearest_cell(cells, px, py)
    return pixels.where((F.col("x") == at["x"]) & (F.col("y") == at["y"]))


def align(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells of the left layer that the right layer has."""
    return left.join(right.select("x", "y").distinct(), ["x", "y"], "left_semi")


def gap_fill(
    pixels: DataFrame, predictions: DataFrame, value: str, predicted: str, on: Sequence[str] = ("date", "x", "y")
) -> DataFrame:
    """``filled``: original value, else prediction; ``gap_only``: prediction where missing. Predictions of a
    cell for all its days are joined ``on`` the cell alone."""
    joined = pixels.join(predictions, list(on), "left")
    return joined.select(
        "*",
        F.coalesce(F.col(value), F.col(predicted)).alias("filled"),
        F.when(F.col(value).isNull(), F.col(predicted)).alias("gap_only"),
    )


def layer_sum(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Cellwise sum of two layers of the same grid."""
    r = right.select("x", "y", F.col(value).alias("_r"))
    return left.join(r, ["x", "y"]).select("x", "y", (F.col(value) + F.col("_r")).alias("total"))


def agreement(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """Number of common cells and of equal cells; a missing value never counts as equal."""
    r = right.select("x", "y", F.col(value).alias("_r"))
    return left.join(r, ["x", "y"]).agg(
        F.count("*").alias("n_cells"),
        F.count_if(F.col(value) == F.col("_r")).alias("n_equal"),
    )


def contingency(pixels: DataFrame, first: Column, second: Column, names: tuple[str, str]) -> DataFrame:
    return pixels.groupBy(first.alias(names[0]), second.alias(names[1])).agg(F.count("*").alias("n"))
