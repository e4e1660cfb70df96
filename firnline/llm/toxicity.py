"""Toxicity by two class-conditional Kneser-Ney models over bytes.

Texts are compared with A-Z lower-cased and ASCII white space collapsed. For toxic and for ordinary
training texts an interpolated Kneser-Ney model of order ``ORDER`` predicts each byte; the
orders above ``SHARED`` keep counts for each class, and both back off to one shared bigram model whose
counts come from every document, so an expression that neither class knows says nothing. The score
is a logistic calibration of the log-likelihood ratio for each byte (and for each root of the length).

Counting is distributed: every task sends its partial n-gram counts, and the models are built by
grouping and joining n-gram codes. What scoring needs are two kinds of rows: an n-gram's log ratio,
and for contexts the log ratio of the back-off weights. Tables of at most ``BROADCAST_ROWS`` rows
(12 bytes each) go to the workers; larger ones stay tables and are joined with the documents' n-grams,
with equal scores.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.common import checkpointed, own_name, small, table
from firnline.llm.quality import fold, logistic, sigmoid

ORDER = 6
SHARED = 2
DISCOUNT = 0.75
CALIBRATION = 20_000
BROADCAST_ROWS = 16_000_000
CACHE_BITS = 20
CHUNK = 1 << 20
SPREAD = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str | None) -> bytes:
    """The bytes that are scored: words between single spaces, one before and one after."""
    words = (text or "").encode().lower().split()
    return b" " + b" ".join(words) + b" " if words else b""


def codes(raws: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The code of the last ``order`` bytes at each byte of all texts, and each text's number of
    bytes. In front of a text stand spaces."""
    pad = b" " * (ORDER - 1)
    b = np.frombuffer(b"".join(pad + r for r in raws), np.uint8).astype(np.uint64)
    sizes = np.array([len(r) for r in raws], np.int64)
    ends = np.cumsum(sizes + ORDER - 1)
    at = np.arange(sizes.sum()) + np.repeat(ends - sizes - (np.cumsum(sizes) - sizes), sizes)
    out = np.zeros(len(at), np.uint64)
    for i in range(order):
        out = (out << np.uint64(8)) | b[at - (order - 1 - i)]
    return out, sizes


def chunks(texts: list) -> Iterator[tuple[int, list[bytes]]]:
    """Texts in runs of about ``CHUNK`` bytes, with the index of each run's first text."""
    start, run, size = 0, [], 0
    for i, t in enumerate(texts):
        raw = plain(t)
        if run and size + len(raw) > CHUNK:
            yield start, run
            start, run, size = i, [], 0
        run.append(raw)
        size += len(raw)
    if run:
        yield start, run


def class_counts(rows: DataFrame) -> DataFrame:
    """``(code, n0, n1)`` of the n-grams of ``rows(label, text)``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = np.array(batch.column(0).to_pylist())
            texts = np.array(batch.column(1).to_pylist(), dtype=object)
            for label in (0, 1):
                for _, raws in chunks(list(texts[labels == label])):
                    code, n = np.unique(codes(raws, ORDER)[0], return_counts=True)
                    none = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(code.view(np.int64)), pa.array(none if label else n), pa.array(n if label else none)],
                        ["code", "n0", "n1"],
                    )

    partial = rows.select("label", "text").mapInArrow(count, "code long, n0 long, n1 long")
    return partial.groupBy("code").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def shared_bigrams(docs: DataFrame) -> np.ndarray:
    """P(byte | byte before) over every document, at most 65,536 counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, raws in chunks(batch.column(0).to_pylist()):
                total += np.bincount(codes(raws, 2)[0].astype(np.int64), minlength=1 << 16)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["code", "n"])

    found = docs.select("text").mapInArrow(count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    n = np.zeros((256, 256))
    found = found.toArrow()
    n.reshape(-1)[found["code"].to_numpy()] = found["n"].to_numpy()
    kinds = n > 0
    after = kinds.sum(0)
    unigram = np.maximum(after - DISCOUNT, 0) / max(after.sum(), 1)
    unigram = unigram + (1 - unigram.sum()) / 256
    total = np.maximum(n.sum(1, keepdims=True), 1)
    weight = np.where(n.sum(1, keepdims=True) > 0, DISCOUNT * kinds.sum(1, keepdims=True) / total, 1.0)
    return np.maximum(n - DISCOUNT, 0) / total + weight * unigram


def model_tables(counts: DataFrame, bigrams: np.ndarray) -> DataFrame:
    """``(kind, order, code, value)``: kind 0 is an n-gram's log ratio toxic to ordinary, kind 1 a
    context's log ratio of back-off weights."""
    spark = counts.sparkSession
    level = checkpointed(counts)
    levels = {ORDER: level}
    for order in range(ORDER - 1, SHARED, -1):
        mask = (1 << (8 * order)) - 1
        level = checkpointed(
            level.groupBy(F.col("code").bitwiseAND(F.lit(mask)).alias("code")).agg(
                F.sum((F.col("n0") > 0).cast("long")).alias("n0"),
                F.sum((F.col("n1") > 0).cast("long")).alias("n1"),
            )
        )
        levels[order] = level
    flat = pd.DataFrame({"low": np.arange(1 << 16), "q0": bigrams.reshape(-1), "q1": bigrams.reshape(-1)})
    below = spark.createDataFrame(flat)
    out = []
    for order in range(SHARED + 1, ORDER + 1):
        rows = levels[order].withColumn("context", F.shiftright("code", 8))
        context = rows.groupBy("context").agg(
            *(F.sum(f"n{c}").alias(f"t{c}") for c in (0, 1)),
            *(F.sum((F.col(f"n{c}") > 0).cast("long")).alias(f"d{c}") for c in (0, 1)),
        )
        weight = [
            F.when(F.col(f"t{c}") > 0, F.col(f"d{c}") * DISCOUNT / F.col(f"t{c}")).otherwise(1.0) for c in (0, 1)
        ]
        own = [
            F.when(F.col(f"t{c}") > 0, F.greatest(F.col(f"n{c}") - DISCOUNT, F.lit(0.0)) / F.col(f"t{c}")).otherwise(0.0)
            for c in (0, 1)
        ]
        low = F.col("code").bitwiseAND(F.lit((1 << (8 * (order - 1))) - 1)).alias("low")
        joined = rows.join(context, "context").select("*", low).join(below, "low")
        here = checkpointed(
            joined.select("code", *((own[c] + weight[c] * F.col(f"q{c}")).alias(f"p{c}") for c in (0, 1)))
        )
        out.append(here.select(F.lit(0).alias("kind"), F.lit(order).alias("order"), "code", F.log(F.col("p1") / F.col("p0")).alias("value")))
        out.append(context.select(F.lit(1).alias("kind"), F.lit(order).alias("order"), F.col("context").alias("code"), F.log(weight[1] / weight[0]).alias("value")))
        below = here.select(F.col("code").alias("low"), F.col("p0").alias("q0"), F.col("p1").alias("q1"))
    tables = out[0]
    for t in out[1:]:
        tables = tables.unionByName(t)
    return checkpointed(tables)


class Scorer:
    """Log ratios of n-gram codes from sorted arrays, behind a direct-mapped cache."""

    def __init__(self, tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]):
        self.tables = tables
        self.keys = np.full(1 << CACHE_BITS, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.values = np.zeros(1 << CACHE_BITS, np.float32)

    def _find(self, kind: int, order: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, values = self.tables.get((kind, order), (np.empty(0, np.uint64), np.empty(0, np.float32)))
        if not len(keys):
            return np.zeros(len(asked), bool), np.zeros(len(asked), np.float32)
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        hit = keys[at] == asked
        return hit, np.where(hit, values[at], np.float32(0))

    def exact(self, asked: np.ndarray) -> np.ndarray:
        """Each code's log ratio; where an order has not seen it, the context's ratio of back-off
        weights plus the next lower order's."""
        out = np.zeros(len(asked), np.float32)
        open_ = np.arange(len(asked))
        for order in range(ORDER, SHARED, -1):
            code = asked[open_] & np.uint64((1 << (8 * order)) - 1)
            hit, value = self._find(0, order, code)
            out[open_] += value
            open_ = open_[~hit]
            out[open_] += self._find(1, order, code[~hit] >> np.uint64(8))[1]
        return out

    def ratios(self, asked: np.ndarray) -> np.ndarray:
        slot = ((asked * SPREAD) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.values[slot]
        missed = np.flatnonzero(self.keys[slot] != asked)
        if len(missed):
            new, where = np.unique(asked[missed], return_inverse=True)
            found = self.exact(new)
            out[missed] = found[where]
            at = ((new * SPREAD) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
            self.keys[at], self.values[at] = new, found
        return out

    def totals(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Each text's summed log ratio and number of scored bytes."""
        sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for start, raws in chunks(texts):
            code, size = codes(raws, ORDER)
            running = np.r_[0.0, np.cumsum(self.ratios(code), dtype=np.float64)]
            ends = np.cumsum(size)
            sums[start : start + len(raws)] = running[ends] - running[ends - size]
            sizes[start : start + len(raws)] = size
        return sums, sizes


SCORERS: dict[str, Scorer] = {}


def scorer_of(name: str, tables: dict) -> Scorer:
    """The worker's scorer for one model, kept from task to task."""
    if name not in SCORERS:
        SCORERS.clear()
        SCORERS[name] = Scorer(tables)
    return SCORERS[name]


@dataclass
class ToxicityModel:
    """The tables as a DataFrame, their broadcast arrays where they are small enough, and the
    calibration: (mean, scale, weights), or a constant score."""

    tables: DataFrame
    arrays: object | None
    calibration: tuple | float

    def score(self, sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        if isinstance(self.calibration, float):
            return np.full(len(sums), self.calibration)
        mean, scale, weights = self.calibration
        return sigmoid(weights[0] + ((inputs(sums, sizes) - mean) / scale) @ weights[1:])


def inputs(sums: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    n = np.maximum(sizes, 1)
    return np.c_[sums / n, sums / np.sqrt(n)]


def sums_by_broadcast(docs: DataFrame, arrays, text: str, kept: list[str]) -> DataFrame:
    """``kept`` columns, ``llr`` and ``size`` of each row."""

    @F.pandas_udf("llr double, size long")
    def totals(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = scorer_of(*arrays.value)
        for texts in batches:
            llr, size = scorer.totals(texts.tolist())
            yield pd.DataFrame({"llr": llr, "size": size})

    name = own_name(docs, "found")
    return docs.select(*kept, totals(F.col(text)).alias(name)).select(*kept, f"{name}.llr", f"{name}.size")


def sums_by_join(docs: DataFrame, tables: DataFrame, text: str, kept: list[str]) -> DataFrame:
    """The same for tables beyond ``BROADCAST_ROWS``: the documents' distinct n-grams with their
    counts are joined with the log ratio of every n-gram of the corpus."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for t in batch.column(0).to_pylist():
                code, n = np.unique(codes([plain(t)], ORDER)[0], return_counts=True)
                code, n = (code.view(np.int64), n) if len(n) else ([None], [0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row] * len(n)), pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["row", "code", "n"]
                )
                row += 1

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            n = batch.num_rows
            yield batch.append_column(row_name, pa.array(np.arange(row, row + n)))
            row += n

    row_name = own_name(docs, "row")
    rows = checkpointed(
        docs.select(*kept, text).mapInArrow(number, docs.select(*kept, text).withColumn(row_name, F.lit(0).cast("long")).schema)
    )
    found = checkpointed(rows.select(F.col(text)).mapInArrow(grams, "row long, code long, n long"))
    value = F.lit(0.0)
    wanted = found.where("code is not null").select("code").distinct().withColumn("value", value).withColumn("open", F.lit(True))
    for order in range(ORDER, SHARED, -1):
        part = F.col("code").bitwiseAND(F.lit((1 << (8 * order)) - 1))
        of = lambda kind, name: tables.where(f"kind = {kind} and `order` = {order}").select(F.col("code").alias(name), F.col("value").alias(f"{name}_value"))
        wanted = (
            wanted.withColumn("part", part)
            .withColumn("above", F.shiftright("part", 8))
            .join(of(0, "gram"), F.col("part") == F.col("gram"), "left")
            .join(of(1, "context"), F.col("above") == F.col("context"), "left")
            .select(
                "code",
                (
                    F.col("value")
                    + F.when(
                        F.col("open"), F.coalesce("gram_value", "context_value", F.lit(0.0))
                    ).otherwise(0.0)
                ).alias("value"),
                (F.col("open") & F.col("gram").isNull()).alias("open"),
            )
        )
    sums = (
        found.join(wanted.select("code", "value"), "code", "left")
        .groupBy(F.col("row").alias("of_row"))
        .agg(F.sum(F.col("n") * F.coalesce("value", F.lit(0.0))).alias("llr"), F.sum("n").alias("size"))
    )
    return rows.join(sums, rows[row_name] == sums["of_row"]).select(*kept, "llr", "size")


def totals_of(docs: DataFrame, model: ToxicityModel, text: str, kept: list[str]) -> DataFrame:
    if model.arrays is None:
        return sums_by_join(docs, model.tables, text, kept)
    return sums_by_broadcast(docs, model.arrays, text, kept)


def fit(docs: DataFrame, labels: DataFrame, calibration: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> ToxicityModel:
    """Counts from all rows of ``labels(doc_id, label)``, the calibration from ``CALIBRATION`` rows
    (the smallest by hash) of ``calibration(doc_id, label)``, which should be other rows.

    Without calibration rows of both labels every text scores the share of label 1, or 0.5.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text")
    known = labels.where(F.col("label").isin(0, 1)).select("doc_id", "label")
    known = small(checkpointed(known))
    tables = model_tables(class_counts(texts.join(known, "doc_id")), shared_bigrams(texts))
    model = ToxicityModel(tables, None, 0.5)
    if tables.count() <= broadcast_rows:
        arrays = {}
        for kind in (0, 1):
            for order in range(SHARED + 1, ORDER + 1):
                part = tables.where(f"kind = {kind} and `order` = {order}")
                part = part.select("code", F.col("value").cast("float")).toArrow()
                code = part["code"].to_numpy().view(np.uint64)
                by = np.argsort(code)
                arrays[kind, order] = (code[by], part["value"].to_numpy()[by])
        model.arrays = spark.sparkContext.broadcast((uuid.uuid4().hex, arrays))
    few = calibration.where(F.col("label").isin(0, 1)).select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION)
    found = totals_of(texts.join(F.broadcast(few), "doc_id"), model, "text", ["label"]).toPandas()
    y = found["label"].to_numpy(float)
    if len(set(y)) < 2:
        model.calibration = float(y.mean()) if len(y) else 0.5
        return model
    x = inputs(found["llr"].to_numpy(), found["size"].to_numpy())
    mean, scale = x.mean(0), x.std(0) + 1e-12
    model.calibration = (mean, scale, logistic((x - mean) / scale, y))
    return model


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` without ``text``, with the probability of label 1 of the whole text. Null and empty
    texts have no bytes: their ratio is 0."""
    kept = [c for c in docs.columns if c != text]
    calibration, model_score = model.calibration, ToxicityModel.score

    @F.pandas_udf("double")
    def scored(llr: pd.Series, size: pd.Series) -> pd.Series:
        return pd.Series(model_score(ToxicityModel(None, None, calibration), llr.to_numpy(), size.to_numpy()))

    found = totals_of(docs, model, text, kept)
    return found.select(*kept, scored("llr", "size").alias(own_name(docs, out)))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document. Of the rows that are not held out three in four give the
    counts, the others the calibration."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    part = fold("doc_id", 5)
    model = fit(docs, labels.where(part.isin(1, 2, 3)), labels.where(part == 4))
    return score(docs, model).select(
        "doc_id",
        (part == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
