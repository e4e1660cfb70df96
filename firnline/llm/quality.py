"""Quality by compression: one zstandard dictionary of good text and one of bad text.

A text is cut into pieces of ``PIECE`` bytes over its whole length (the start of a compressor's
window is where a dictionary counts) and every piece is compressed with both dictionaries. The
feature is the normalised difference of the two compressed sizes; the compressed sizes for each
byte of text and the extremes over the pieces go with it, so that text which compresses itself is
seen as well. A logistic calibration turns them into the probability of label 1.

Bounds of the fit, all parameters: ``PIECES`` pieces for each dictionary, from ``PIECES`` texts at most,
and ``CALIBRATION`` texts, the smallest by a seeded hash among all labelled rows. Scoring is one pass without a shuffle.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.common import own_name, table

PIECE = 512
PIECES = 4000
CALIBRATION = 20_000
DICTIONARY = 112_640
LEVEL = 3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries and the calibration; ``weights`` is empty where no fit was possible, then
    every text gets ``prior``."""

    bad: bytes
    good: bytes
    mean: tuple[float, ...] = ()
    scale: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    prior: float = 0.5

    def score(self, features: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.full(len(features), self.prior)
        z = (features - np.array(self.mean)) / np.array(self.scale)
        return sigmoid(self.weights[0] + z @ np.array(self.weights[1:]))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def cut(text: str | None, size: int = PIECE) -> list[bytes]:
    """The whole text in pieces of ``size`` bytes; one empty piece for null and empty text."""
    raw = (text or "").encode()
    return [raw[i : i + size] for i in range(0, len(raw), size)] or [b""]


@functools.lru_cache(maxsize=2)
def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    trained = zstandard.ZstdCompressionDict(dictionary)
    trained.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        level=LEVEL,
        dict_data=trained,
        write_checksum=False,
        write_content_size=False,
        write_dict_id=False,
    )


def features_of(text: str | None, bad: bytes, good: bytes) -> list[float]:
    """Normalised difference, its smallest value over the pieces, both sizes for each byte, and the
    smallest size for each byte over the pieces."""
    pieces = cut(text)
    by_bad, by_good = compressor(bad).compress, compressor(good).compress
    b = np.array([len(by_bad(p)) for p in pieces], float)
    g = np.array([len(by_good(p)) for p in pieces], float)
    n = np.array([max(len(p), 1) for p in pieces], float)
    return [
        (b.sum() - g.sum()) / (b.sum() + g.sum()),
        ((b - g) / (b + g)).min(),
        g.sum() / n.sum(),
        b.sum() / n.sum(),
        (g / n).min(),
    ]


def dictionary_of(pieces: list[bytes]) -> bytes:
    """A trained dictionary; with too few pieces to train on, the pieces themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:] or b"\0" * 8


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps, the intercept unpenalised."""
    z = np.c_[np.ones(len(x)), x]
    penalty = ridge * len(y) * np.r_[0.0, np.ones(x.shape[1])]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = sigmoid(z @ w)
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9)
        step = np.linalg.solve(hessian, z.T @ (p - y) + penalty * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def fold(column: str, n: int) -> Column:
    """crc32 of the identifier as text, modulo ``n``; null for a null identifier."""
    return F.crc32(F.col(column).cast("string")) % n


def fit(docs: DataFrame, labels: DataFrame, seed: int = 7) -> QualityModel:
    """Fit on ``docs(doc_id, text)`` and ``labels(doc_id, label)``, label 0 or 1.

    The caller leaves held-out rows out of ``labels``. Half of the labelled rows (by hash) give the
    dictionaries, the other half the calibration. Rows with a null identifier or label are
    ignored; without rows of both labels the model scores every text with the share of label 1, or
    0.5 without any.
    """
    known = labels.where(F.col("label").isin(0, 1)).select("doc_id", "label")
    drawn = known.withColumn("_h", F.xxhash64("doc_id", F.lit(seed)))
    half = F.pmod("_h", F.lit(2))

    def first_rows(rows: DataFrame, n: int) -> DataFrame:
        """The texts of the ``n`` rows with the smallest hash; they are drawn before they meet texts."""
        few = rows.orderBy("_h", "doc_id").limit(n)
        return docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")

    def pieces_of(label: int) -> list[bytes]:
        def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = [(h, i, p) for h, t in zip(batch["_h"], batch["text"]) for i, p in enumerate(cut(t)) if p]
                yield pd.DataFrame(found, columns=["h", "i", "piece"])

        rows = first_rows(drawn.where((half == 0) & (F.col("label") == label)), PIECES)
        every = rows.select("_h", "text").mapInPandas(pieces, "h long, i int, piece binary")
        few = every.orderBy(F.xxhash64("h", "i", F.lit(seed)), "h", "i").limit(PIECES)
        return [bytes(r[0]) for r in few.select("piece").collect()]

    pieces = [pieces_of(0), pieces_of(1)]
    model = QualityModel(*map(dictionary_of, pieces))
    found = first_rows(drawn.where(half == 1), CALIBRATION).select("label", features(F.col("text"), model).alias("f")).toPandas()
    if not all(pieces) or found["label"].nunique() < 2:
        share = known.agg(F.avg("label")).first()[0]
        return QualityModel(model.bad, model.good, prior=0.5 if share is None else float(share))
    x, y = np.array(found["f"].tolist()), found["label"].to_numpy(float)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    weights = logistic((x - mean) / scale, y)
    return QualityModel(model.bad, model.good, tuple(mean), tuple(scale), tuple(weights))


def features(text: Column, model: QualityModel) -> Column:
    """The five features as an array column."""

    @F.arrow_udf("array<double>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([features_of(t.as_py(), model.bad, model.good) for t in texts], pa.list_(pa.float64()))

    return found(text)


def score(docs: DataFrame, model: QualityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1; null and empty texts get the score of no text. One text of a
    batch at a time becomes a Python string."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = [features_of(t.as_py(), model.bad, model.good) for t in texts]
            yield pa.array(model.score(np.array(x, float).reshape(len(x), -1)), pa.float64())

    return docs.withColumn(own_name(docs, out), scores(F.col(text)))


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``labels.quality`` of the rows that are not held out."""
    rows = table(spark, sf_dir, "labels").where(fold("doc_id", 3) != 1)
    return rows.select("doc_id", F.col("quality").alias("label"))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit(docs, training_labels(spark, sf_dir)))
    return scored.select(
        "doc_id",
        (fold("doc_id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
