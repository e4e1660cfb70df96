"""Linear models from centred moments.

One grouped aggregate gives row count, means and centred products of every area. All fits and inner
scores of the nested cross-validation (any subset of areas, any penalty) then follow from merging these
small matrices, so the number of passes over the data does not depend on the number of fits. Means and
deviations are kept apart, so a target far from zero costs no digits.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Partial matrices of a group are merged by this many tasks first, then by one.
MERGERS = 32


@dataclass(frozen=True)
class Moments:
    """Row count, means and centred products of (features, target)."""

    n: float
    mean: np.ndarray  # target last
    m: np.ndarray  # sums of products of deviations from the means, target last

    @staticmethod
    def of(values: np.ndarray) -> Moments:
        mean = values.mean(0)
        d = values - mean
        drift = d.mean(0)  # what rounding left in the mean
        return Moments(float(len(values)), mean + drift, d.T @ d - len(values) * np.outer(drift, drift))

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        d = other.mean - self.mean
        share = other.n / n
        return Moments(n, self.mean + share * d, self.m + other.m + self.n * share * np.outer(d, d))

    @property
    def s(self) -> np.ndarray:
        """Sums."""
        return self.n * self.mean

    @property
    def ss(self) -> np.ndarray:
        """Sums of products."""
        return self.m + self.n * np.outer(self.mean, self.mean)

    def centred(self) -> tuple[np.ndarray, np.ndarray]:
        return self.m[:-1, :-1], self.m[:-1, -1]


@dataclass(frozen=True)
class LinearFit:
    features: tuple[str, ...]
    coefficients: np.ndarray
    intercept: float
    params: dict = field(default_factory=dict)

    def expression(self) -> Column:
        out = F.lit(float(self.intercept))
        for c, f in zip(self.coefficients, self.features):
            out = out + F.col(f) * F.lit(float(c))
        return out

    def mse(self, p: Moments) -> float:
        w = np.append(-self.coefficients, 1.0)
        return float(w @ p.m @ w / p.n + (w @ p.mean - self.intercept) ** 2)


def grouped_moments(
    df: DataFrame, features: Sequence[str], target: str, families: dict[str, Column]
) -> dict[tuple[str, str], Moments]:
    """Moments of every (family, value), in one pass; a family is a column with few values, and a row
    with a null there is not in it. Rows with a missing feature or target are left out.

    Every task keeps one matrix for each (family, value) and hands it on; they are merged group by
    group, ``MERGERS`` merges first, so the driver receives one matrix for each group.
    """
    names = [*features, target]
    width, keys = len(names), list(families)
    present = df
    for c in names:
        present = present.where(F.col(c).isNotNull())
    data = present.select(
        *[families[k].cast("string").alias(f"family_{i}") for i, k in enumerate(keys)],
        *[F.col(c).cast("double").alias(f"value_{i}") for i, c in enumerate(names)],
    )
    schema = "family int, value string, part int, n double, mean array<double>, m array<double>"

    def row(family: int, value: str, part: int, p: Moments) -> dict:
        return {"family": family, "value": value, "part": part, "n": p.n, "mean": p.mean.tolist(), "m": p.m.ravel().tolist()}

    def partial(batches):
        task = TaskContext.get().partitionId()
        found: dict[tuple[int, str], Moments] = {}
        for batch in batches:
            values = batch.iloc[:, len(keys) :].to_numpy(float)
            for i in range(len(keys)):
                codes, groups = pd.factorize(batch.iloc[:, i])
                for c, group in enumerate(groups):
                    p = Moments.of(values[codes == c])
                    found[i, group] = found[i, group] + p if (i, group) in found else p
        rows = [row(i, g, task % MERGERS, p) for (i, g), p in found.items()]
        yield pd.DataFrame(rows, columns=["family", "value", "part", "n", "mean", "m"])

    def merged(part: pd.DataFrame) -> pd.DataFrame:
        rows = zip(part["n"], part["mean"], part["m"])
        p = total([Moments(n, np.array(a), np.array(m).reshape(width, width)) for n, a, m in rows])
        first = part.iloc[0]
        return pd.DataFrame([row(int(first["family"]), first["value"], int(first["part"]), p)])

    parts = data.mapInPandas(partial, schema)
    for by in (["family", "value", "part"], ["family", "value"]):
        parts = parts.groupBy(*by).applyInPandas(merged, schema)
    return {
        (keys[r["family"]], r["value"]): Moments(r["n"], np.array(r["mean"]), np.array(r["m"]).reshape(width, width))
        for r in parts.collect()  # width^2 numbers per group
    }


def cross_products(
    df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()
) -> dict[tuple, Moments]:
    """Moments per group of ``by`` (integer columns with few combinations)."""
    key = F.concat_ws(",", *[F.col(b).cast("string") for b in by]) if by else F.lit("")
    found = grouped_moments(df, features, target, {"by": key})
    return {tuple(int(v) for v in g.split(",")) if by else (): p for (_, g), p in found.items()}


def total(products: Sequence[Moments]) -> Moments:
    out = products[0]
    for p in products[1:]:
        out = out + p
    return out


def _finish(p: Moments, features: Sequence[str], w: np.ndarray, params: dict) -> LinearFit:
    return LinearFit(tuple(features), w, float(p.mean[-1] - w @ p.mean[:-1]), params)


def ols(p: Moments, features: Sequence[str], **params: object) -> LinearFit:
    g, c = p.centred()
    return _finish(p, features, np.linalg.lstsq(g, c, rcond=None)[0], params)


def ridge(p: Moments, features: Sequence[str], alpha: float) -> LinearFit:
    """Minimises sum of squares + alpha |w|^2 with a free intercept."""
    g, c = p.centred()
    w = np.linalg.solve(g + alpha * np.eye(len(c)), c)
    return _finish(p, features, w, {"alpha": alpha})


def elastic_net(
    p: Moments,
    features: Sequence[str],
    alpha: float,
    l1_ratio: float = 1.0,
    tol: float = 1e-10,
    max_iter: int = 10000,
) -> LinearFit:
    """Minimises mean squares / 2 + alpha (l1_ratio |w|_1 + (1 - l1_ratio) |w|^2 / 2) by
    coordinate descent on the cross products."""
    g, c = p.centred()
    g, c = g / p.n, c / p.n
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio)
    w = np.zeros(len(c))
    for _ in range(max_iter):
        move = 0.0
        for j in range(len(c)):
            if g[j, j] + l2 == 0:
                continue
            rho = c[j] - g[j] @ w + g[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (g[j, j] + l2)
            move, w[j] = max(move, abs(new - w[j])), new
        if move < tol:
            break
    else:
        warnings.warn(f"elastic net stopped after {max_iter} turns, last step {move:.3g}", stacklevel=2)
    return _finish(p, features, w, {"alpha": alpha, "l1_ratio": l1_ratio})


def lasso(p: Moments, features: Sequence[str], alpha: float) -> LinearFit:
    fit = elastic_net(p, features, alpha, 1.0)
    return LinearFit(fit.features, fit.coefficients, fit.intercept, {"alpha": alpha})


FITTERS = {
    "LinearRegression": ols,
    "RidgeRegression": ridge,
    "LassoRegression": lasso,
    "ElasticNetRegression": elastic_net,
}


def attributions(df: DataFrame, fit: LinearFit, means: dict[str, float]) -> DataFrame:
    """Contribution of each feature to each row: coefficient * (value - mean)."""
    return df.select(
        "*",
        *[
            (F.lit(float(c)) * (F.col(f) - F.lit(float(means[f])))).alias(f"phi_{f}")
            for c, f in zip(fit.coefficients, fit.features)
        ],
    )
