"""Value classes and spatial areas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Edges of the grain-diameter classes (mm), right-closed.
CLASS_EDGES = (0.0, 0.2, 0.4, 0.64, 0.8, 1.0, 1.2, 1.4, 1.6, 1.8, 2.0, 100.0)
ZERO_INCLUSIVE_EDGES = (-1e-12, 0.2 - 1e-12, 0.4 - 1e-12, *CLASS_EDGES[3:])


def right_closed_bin(value: Column, edges: Sequence[float]) -> Column:
    """Index i with edges[i] < value <= edges[i + 1]; NULL outside."""
    out = F.when(value <= edges[0], F.lit(None).cast("int"))
    for i, upper in enumerate(edges[1:]):
        out = out.when(value <= upper, i)
    return out


def observed_codes(df: DataFrame, bin_col: str, code_col: str) -> DataFrame:
    """Rank of the bin among the bins that occur.

    The occurring bins are found by one aggregate and enter as a scalar sorted array (its length
    is at most the number of classes).
    """
    present = df.agg(F.array_sort(F.collect_set(bin_col))).scalar()
    position = F.array_position(present, F.col(bin_col)).cast("int") - 1
    return df.withColumn(code_col, F.when(F.col(bin_col).isNotNull(), position))


def spatial_area(x: Column, y: Column) -> Column:
    """Five fixed areas. The boundaries in metres."""
    west, north_w, north_e, south = 142500.0, -1412000.0, -1660500.0, -2398000.0
    return (
        F.when(y < south, 5)
        .when((x <= west) & (y >= north_w), 1)
        .when((x > west) & (y >= north_e), 2)
        .when(x <= west, 3)
        .otherwise(4)
    )


def in_corner(x: Column, y: Column) -> Column:
    """The north-western corner that is kept out. Its limits in metres."""
    return (y > -1000000.0) & (x < -300000.0)


def composite_area(area: Column, subarea: Column, zero_override: int | None = None) -> Column:
    """Digits of area and subarea as one number, with an optional code for area 0."""
    code = F.concat(area.cast("string"), subarea.cast("string")).cast("int")
    return code if zero_override is None else F.when(area == 0, zero_override).otherwise(code)
