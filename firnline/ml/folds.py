"""Spatial folds: k-means areas on cell coordinates.

Centres are fitted by Lloyd's steps on the distinct cells weighted by their number of rows, which gives
the same objective as fitting on the rows. Seeds lie on the diagonal of the cells' extent and each step is
one aggregate of ``k`` rows, so equal cells give equal areas on every run and in any order. The assignment is a column expression of (x, y): it is the same
on every evaluation and needs neither a join nor a stored fold column.
"""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Centres = list[tuple[float, float]]
Areas = tuple[Centres, list[Centres], Centres]
CELLS_PER_PARTITION = 100_000
TURNS = 20


def cell_weights(df: DataFrame) -> DataFrame:
    return df.groupBy("x", "y").agg(F.count("*").cast("double").alias("weight"))


def seeds(low: tuple[float, float], high: tuple[float, float], k: int) -> Centres:
    at = [(2 * i + 1) / (2 * k) for i in range(k)]
    return [tuple(a + f * (b - a) for a, b in zip(low, high)) for f in at]


def lloyd_step(weights: DataFrame, centres: Centres) -> Centres:
    """Each area's weighted mean; an area without cells moves to the cell that is farthest from its own
    centre (the smallest such cell), so that no area stays empty."""
    placed = weights.withColumn("_area", area(centres))
    found = {
        r["_area"]: (r["x"], r["y"])
        for r in placed.groupBy("_area")
        .agg(
            (F.sum(F.col("weight") * F.col("x")) / F.sum("weight")).alias("x"),
            (F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("y"),
        )
        .collect()
    }
    empty = [i for i in range(len(centres)) if i not in found]
    if empty:
        own = F.least(*[(F.col("x") - a) ** 2 + (F.col("y") - b) ** 2 for a, b in centres])
        far = weights.orderBy(own.desc(), "x", "y").limit(len(empty)).collect()
        found.update({i: (float(r["x"]), float(r["y"])) for i, r in zip(empty, far)})
    return [found.get(i, c) for i, c in enumerate(centres)]


def fit_centres(weights: DataFrame, k: int = 5, turns: int = TURNS) -> Centres:
    """Centres of ``weights(x, y, weight)``, sorted; at most ``turns`` steps, fewer once nothing moves."""
    e = weights.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if e[0] is None:
        return []
    centres = seeds((float(e[0]), float(e[1])), (float(e[2]), float(e[3])), k)
    for _ in range(turns):
        moved = lloyd_step(weights, centres)
        if moved == centres:
            break
        centres = moved
    return sorted(centres)


def area(centres: Centres, x: str = "x", y: str = "y") -> Column:
    """Index of the nearest centre; ties go to the smaller index."""
    distances = [
        (F.col(x) - cx) * (F.col(x) - cx) + (F.col(y) - cy) * (F.col(y) - cy) for cx, cy in centres
    ]
    nearest = F.least(*distances) if len(distances) > 1 else distances[0]
    out = F.when(distances[0] == nearest, 0)
    for i, d in enumerate(distances[1:], start=1):
        out = out.when(d == nearest, i)
    return out


def leave_one_out(df: DataFrame, fold: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows outside and inside area k."""
    return df.where(F.col(fold) != k), df.where(F.col(fold) == k)


def nested_areas(
    df: DataFrame, k: int = 5, parallelism: int = 6
) -> Areas:
    """Centres of the outer areas, of the inner areas of each outer training set, and of the areas used
    to tune the final model, which are those of all rows, as the outer ones.

    The cell weights are kept in partitions of a useful size, and the fits that do not depend on
    each other run at the same time.
    """
    counted = cell_weights(df).persist()
    try:
        weights = counted.coalesce(1 + counted.count() // CELLS_PER_PARTITION)
        outer = fit_centres(weights, k)
        jobs = [weights.where(area(outer) != i) for i in range(len(outer))]
        with ThreadPoolExecutor(parallelism) as pool:
            inner = list(pool.map(lambda rows: fit_centres(rows, k), jobs))
        return outer, inner, outer
    finally:
        counted.unpersist()


def with_areas(
    df: DataFrame, outer: Centres, inner: Sequence[Centres] = (), final: Centres | None = None
) -> DataFrame:
    columns = {"outer_area": area(outer)}
    columns.update({f"inner_area_{i}": area(c) for i, c in enumerate(inner)})
    if final is not None:
        columns["final_area"] = area(final)
    return df.withColumns(columns)
