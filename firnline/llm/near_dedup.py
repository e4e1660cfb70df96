"""MinHash near-dedup of documents with tensored banding.

Two small collections of ``COLLECTION`` concatenated minhashes each are computed; every pair of one
value from the first and one from the second collection is the key of a table. ``COLLECTION``
squared tables of ``2 * WIDTH`` minhashes so cost ``2 * COLLECTION * WIDTH`` minhashes and not their
square. At a similarity s two documents meet in a table with probability
``(1 - (1 - s ** WIDTH) ** COLLECTION) ** 2``, which is 0.9999 at 0.8 and above for the defaults.
Candidates are verified on full shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.common import checkpointed, own_name, small, table
from firnline.llm.near import folded, joined, lists, minhashes, near_components, word_shingles

COLLECTION = 10
WIDTH = 2
PERCENT = 80
SEED = 11


def tensored(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The table keys of each set, ``COLLECTION ** 2`` of them."""
    h = minhashes(values, starts, 2 * COLLECTION * WIDTH, SEED)
    parts = [folded(h[:, i * WIDTH : (i + 1) * WIDTH], 0) for i in range(2 * COLLECTION)]
    pairs = [(i, j) for i in range(COLLECTION) for j in range(COLLECTION)]
    return np.stack(
        [
            folded(np.stack([parts[i], parts[COLLECTION + j]], 1), 1 + i * COLLECTION + j)
            for i, j in pairs
        ],
        axis=1,
    ) if len(h) else np.empty((0, COLLECTION**2), np.uint64)


def signed(docs: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """``(id, size, digest, keys)`` of each row: set size, digest of the set, table keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [word_shingles(t, width) for t in batch.column(1).to_pylist()]
            values, starts, full = joined(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    lists(len(sets), full, tensored(values, starts)),
                ],
                ["id", "size", "digest", "keys"],
            )

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.mapInArrow(sign, "id long, size long, digest binary, keys array<long>")


def shingle_sets(docs: DataFrame, ids: DataFrame, width: int, text: str, key: str) -> DataFrame:
    """``(id, size, shingles)`` of the rows whose id is asked for."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [word_shingles(t, width) for t in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(s) for s in found], pa.int64()),
                pa.array([s.tobytes() for s in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "shingles"])

    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    return rows.join(ids, "id", "left_semi").mapInArrow(sets, "id long, size long, shingles binary")


def near_groups(
    docs: DataFrame, width: int = 5, percent: int = PERCENT, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``(id, size, component_id)``, one row for each row of ``docs``.

    Words are compared with A-Z lower-cased; a text with fewer than ``width`` words is one shingle;
    null and empty texts have no shingles and are linked with nothing. Equal sets are one class
    and need no comparison. Identifiers are integers and unique; a row without one is linked with
    nothing and has a null component. An empty table gives an empty table.
    """
    rows = checkpointed(signed(docs, width, text, key))
    known = rows.where(F.col("id").isNotNull() & (F.col("size") > 0))
    classes = known.groupBy("digest").agg(F.min("id").alias("rep"))
    member = checkpointed(known.select("id", "digest").join(classes, "digest").select("id", "rep"))
    copies = small(checkpointed(member.where("id <> rep").select("id")))
    reps = known.select("id", "keys").join(copies, "id", "left_anti")
    roots = near_components(reps, lambda ids: shingle_sets(docs, ids, width, text, key), percent)
    placed = (
        member.join(roots.select(F.col("id").alias("rep"), "root"), "rep", "left")
        .select("id", F.coalesce("root", "rep").alias("root"))
    )
    return (
        rows.select("id", "size")
        .join(placed, "id", "left")
        .select("id", "size", F.coalesce("root", "id").alias("component_id"))
    )


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)`` that stay, one of each group, all columns as they are;
    rows without an identifier stay."""
    name = own_name(docs, "copy_id")
    gone = near_groups(docs, width, percent).where(F.col("id") != F.col("component_id"))
    gone = small(checkpointed(gone.select(F.col("id").alias(name))))
    return docs.join(gone, F.col("doc_id") == F.col(name), "left_anti")


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document, on two-word shingles."""
    groups = near_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), width=2)
    return groups.select(
        F.col("id").alias("doc_id"),
        F.col("size").alias("n_shingles"),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )

