"""One-vs-rest logistic models by Newton steps, all classes in the same passes.

The engine fits one class after the other, and reads the rows once a step, up to a hundred times each. Here a pass
sums loss, gradient and second derivatives of every class at once, small matrices that are added up by Spark, and the minimum is
reached in some ten passes. The objective is the same: the summed loss and ``|w|^2 / (2 c)``, intercepts not penalised.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A model is done when its next step would lower its loss by less than this share.
TOLERANCE = 1e-12


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equally long arrays as a matrix with a column of ones for the intercept."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1)
    return np.c_[values, np.ones(len(values))]


def sums(x: np.ndarray, label: np.ndarray, weights: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """By class: rows of it, loss, gradient and second derivatives (all in a row) against the other classes."""
    out = {}
    for k, w in weights.items():
        own = label == k
        margin = x @ w
        p = 0.5 * (1.0 + np.tanh(0.5 * margin))
        loss = np.logaddexp(0.0, np.where(own, -margin, margin)).sum()
        second = (x * (p * (1.0 - p))[:, None]).T @ x
        out[k] = np.r_[own.sum(), loss, x.T @ (p - own), second.ravel()]
    return out


class OneVsRestLogistic(Estimator):
    """Fits on the columns ``features`` and ``label``, whose values are 0, 1, ..."""

    def __init__(self, label: str, c: float = 1.0, max_iter: int = 100):
        super().__init__()
        self.label, self.c, self.max_iter = label, c, max_iter

    def _fit(self, dataset: DataFrame) -> OneVsRestLogisticModel:
        rows = dataset.select(vector_to_array("features").alias("x"), F.col(self.label).cast("double").alias("label"))
        seen = rows.agg(
            F.count("*").alias("n"), F.count("label").alias("known"), F.max("label").alias("last"), F.max(F.size("x")).alias("width")
        ).first()
        if not seen["n"] or seen["known"] < seen["n"]:
            raise ValueError("no rows to train on" if not seen["n"] else f"{self.label} is null")
        classes = range(int(seen["last"]) + 1)
        kept = rows.select("label", *[F.col("x")[j].alias(f"x{j}") for j in range(seen["width"])]).persist()
        try:
            return OneVsRestLogisticModel(self._weights(kept, classes, seen["n"]))
        finally:
            kept.unpersist()

    def _weights(self, rows: DataFrame, classes: Iterable[int], n: int) -> np.ndarray:
        """Coefficients and intercept by class; ``rows`` has the label first."""
        penalty = np.r_[np.full(len(rows.columns) - 1, 1.0 / self.c), 0.0]
        size = len(penalty)
        at = {k: np.zeros(size) for k in classes}
        best: dict[int, tuple[float, np.ndarray]] = {}  # loss and place of the last step that lowered it
        open_ = dict(at)
        for _ in range(self.max_iter):
            for k, found in self._pass(rows, open_.copy(), size).items():
                w = open_.pop(k)
                if found[0] in (0, n):  # a class without rows, or the only one
                    at[k] = np.r_[np.zeros(size - 1), np.inf if found[0] else -np.inf]
                    continue
                loss = found[1] + 0.5 * (penalty * w * w).sum()
                if k in best and loss > best[k][0]:
                    if loss - best[k][0] > TOLERANCE * loss:
                        open_[k] = 0.5 * (w + best[k][1])
                    continue
                best[k], at[k] = (loss, w), w
                gradient = found[2 : 2 + size] + penalty * w
                step = np.linalg.lstsq(found[2 + size :].reshape(size, size) + np.diag(penalty), gradient, rcond=None)[0]
                if gradient @ step > TOLERANCE * loss:
                    open_[k] = w - step
            if not open_:
                break
        return np.array([at[k] for k in classes])

    @staticmethod
    def _pass(rows: DataFrame, weights: dict[int, np.ndarray], size: int) -> dict[int, np.ndarray]:
        """``sums`` over all rows: a task hands on one row for each sum."""
        length = 2 + size + size * size

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros(length) for k in weights}
            for batch in batches:
                x = np.column_stack([*(c.to_numpy() for c in batch.columns[1:]), np.ones(batch.num_rows)])
                if not np.isfinite(x).all():
                    raise ValueError("features have missing values")
                for k, part in sums(x, batch.column(0).to_numpy(), weights).items():
                    total[k] += part
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(list(weights), np.int32), length)),
                    pa.array(np.tile(np.arange(length, dtype=np.int32), len(weights))),
                    pa.array(np.concatenate(list(total.values()))),
                ],
                ["model", "i", "part"],
            )

        parts = rows.mapInArrow(partial, "model int, i int, part double").groupBy("model", "i").agg(F.sum("part").alias("t"))
        out = {k: np.zeros(length) for k in weights}
        for r in parts.collect():
            out[r["model"]][r["i"]] = r["t"]
        return out


class OneVsRestLogisticModel(Model):
    """``weights`` has a row for each class, its intercept last."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = self.weights

        @F.arrow_udf("double")
        def predicted(vectors: pa.Array) -> pa.Array:
            return pa.array((matrix(vectors) @ weights.T).argmax(1).astype(float))

        return dataset.withColumn("prediction", predicted(vector_to_array("features")))
