"""Exact Euclidean distance of every cell to the nearest cell of a set.

Pass 1 runs along columns with windows and finds, per cell, the nearest set cell of its own
column. Pass 2 works per raster line: the answer is the smallest of (column offset)^2 + (pass 1
distance)^2. A line is a bounded group (the width of the grid), and the offset loop stops as soon
as no farther column can be closer, so the work follows the largest distance present.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FAR = 2**31


def _nearest_in_line(line: pd.DataFrame) -> pd.DataFrame:
    """Per cell of one line: squared distance and position of the nearest set cell.

    Ties are resolved by the smaller (row, col).
    """
    line = line.sort_values("col", ignore_index=True)
    first = int(line["col"].iloc[0])
    width = int(line["col"].iloc[-1]) - first + 1
    at = line["col"].to_numpy(np.int64) - first
    gap = np.full(width, FAR, dtype=np.int64)
    source = np.full(width, FAR, dtype=np.int64)
    known = line["_src"].notna().to_numpy()
    row = int(line["row"].iloc[0])
    src = line["_src"].to_numpy(np.float64)[known].astype(np.int64)
    gap[at[known]] = np.abs(src - row)
    source[at[known]] = src
    cols = np.arange(width, dtype=np.int64)
    own = gap < FAR
    best = np.where(own, gap * gap, FAR * FAR)
    best_row, best_col = source.copy(), np.where(own, cols, FAR)
    for offset in range(1, width):
        if offset * offset > best.max():
            break
        for near, far in ((slice(offset, None), slice(None, -offset)), (slice(None, -offset), slice(offset, None))):
            ok = gap[far] < FAR
            cand = np.where(ok, gap[far] * gap[far] + offset * offset, FAR * FAR)
            b, br, bc = best[near], best_row[near], best_col[near]
            better = ok & (
                (cand < b)
                | ((cand == b) & ((source[far] < br) | ((source[far] == br) & (cols[far] < bc))))
            )
            best[near] = np.where(better, cand, b)
            best_row[near] = np.where(better, source[far], br)
            best_col[near] = np.where(better, cols[far], bc)
    found = best[at] < FAR * FAR
    return pd.DataFrame(
        {
            "row": line["row"].astype("int32"),
            "col": line["col"].astype("int32"),
            "sq": pd.Series(best[at], dtype="int64").where(found),
            "near_row": pd.Series(best_row[at], dtype="int64").where(found),
            "near_col": pd.Series(best_col[at] + first, dtype="int64").where(found),
        }
    )


def nearest_member(cells: DataFrame, member: str) -> DataFrame:
    """For every cell: ``sq`` (squared distance in cells), ``near_row``, ``near_col``.

    ``member`` names a boolean column; members are at distance 0 from themselves.
    """
    col_up = W.partitionBy("col").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    col_down = W.partitionBy("col").orderBy(F.desc("row")).rowsBetween(W.unboundedPreceding, 0)
    mark = F.when(F.col(member), F.col("row"))
    above, below = F.col("_above"), F.col("_below")
    one = cells.select("row", "col", member).select(
        "row",
        "col",
        F.last(mark, ignorenulls=True).over(col_up).alias("_above"),
        F.last(mark, ignorenulls=True).over(col_down).alias("_below"),
    )
    nearest = F.when(
        below.isNull() | (F.col("row") - above <= below - F.col("row")), above
    ).otherwise(below)
    return (
        one.select("row", "col", nearest.alias("_src"))
        .groupBy("row")
        .applyInPandas(_nearest_in_line, "row int, col int, sq long, near_row int, near_col int")
    )


def distance_to_margin(cells: DataFrame, is_water: str = "is_water") -> DataFrame:
    """``distance_to_margin`` in cells: 0 on water."""
    return nearest_member(cells, is_water).select(
        "row", "col", F.sqrt(F.col("sq").cast("double")).alias("distance_to_margin")
    )


def metric_distance(cells: DataFrame, member: str, step: float = 1000.0) -> DataFrame:
    """Nearest member cell and the distance to it in metres."""
    return nearest_member(cells, member).select(
        "row", "col", "near_row", "near_col", (F.sqrt(F.col("sq").cast("double")) * step).alias("metres")
    )
