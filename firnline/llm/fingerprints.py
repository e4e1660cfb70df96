"""Document fingerprints by locally consistent parsing.

A text's UTF-8 bytes are parsed in levels. At each level equal neighbours are first joined into one
run. Deterministic coin tossing then labels every symbol by the lowest bit in which it differs from
its left neighbour and by that bit's value; after ``TOSSES`` rounds labels are below eight and
neighbours still differ. A phrase starts at each local minimum of the labels, so its bounds depend on
a few symbols around it and on nothing else, and the phrase's hash is its name, the symbol of
the next level. Equal substrings therefore get equal names away from their ends wherever they
stand. The names of phrases from level ``FROM_LEVEL`` on, and the last name of the text, are its
signature; a fingerprint keeps the smallest 16 bits of the names in each of ``BINS`` bins. The
likeness of two fingerprints is the share of bins that agree among those that either fills.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.common import checkpointed, table, text_of
from firnline.llm.near import M1, M2, mixed

TOSSES = 4
FROM_LEVEL = 2
BINS = 64
NO_NAME = 0xFFFF
CHUNK = 1 << 21


def tossed(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Labels below eight, different for neighbours. ``starts`` are the places of first symbols; a
    first symbol has no left neighbour and tosses against the complement of its own last bit."""
    one = symbols.dtype.type(1)
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[starts] = symbols[starts] ^ one
    differ = symbols ^ left
    place = np.bitwise_count((differ & (~differ + one)) - one)
    bit = ((symbols >> place.astype(symbols.dtype)) & one).astype(np.uint8)
    return (place.astype(np.uint8) << 1) | bit


def next_level(names: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases' names and the text each belongs to; ``texts`` ascends."""
    new_text = np.r_[True, texts[1:] != texts[:-1]]
    runs = np.flatnonzero(new_text | np.r_[True, names[1:] != names[:-1]])
    lengths = np.diff(np.r_[runs, len(names)]).astype(np.uint64)
    texts, new_text = texts[runs], new_text[runs]
    names = mixed(names[runs] + lengths * M2)
    starts = np.flatnonzero(new_text)
    labels = tossed(names, starts)
    for _ in range(TOSSES - 1):
        labels = tossed(labels, starts)
    before, after = np.r_[labels[:1], labels[:-1]], np.r_[labels[1:], labels[-1:]]
    last = np.r_[new_text[1:], True]
    begins = ((labels < before) & (labels < after) & ~last) | new_text
    phrase = np.flatnonzero(begins)
    offset = np.arange(len(names)) - np.repeat(phrase, np.diff(np.r_[phrase, len(names)]))
    terms = mixed(names + (offset.astype(np.uint64) + np.uint64(1)) * M1)
    return mixed(np.add.reduceat(terms, phrase)), texts[phrase]


def fingerprints(raws: list[bytes]) -> np.ndarray:
    """One row of ``BINS`` 16-bit values for each text; an empty text has no names."""
    out = np.full((len(raws), BINS), NO_NAME, np.uint16)
    start = 0
    while start < len(raws):
        stop, size = start, 0
        while stop < len(raws) and (size == 0 or size + len(raws[stop]) <= CHUNK):
            size += len(raws[stop])
            stop += 1
        _parse(raws[start:stop], out[start:stop])
        start = stop
    return out


def _parse(raws: list[bytes], out: np.ndarray) -> None:
    symbols = np.frombuffer(b"".join(raws), np.uint8)
    texts = np.repeat(np.arange(len(raws)), [len(r) for r in raws])
    if not len(symbols):
        return
    names, level = mixed(np.arange(1, 257, dtype=np.uint64))[symbols], 0
    while len(names):
        names, texts = next_level(names, texts)
        level += 1
        size = np.bincount(texts, minlength=len(raws))
        whole = size[texts] == 1
        keep = whole if level < FROM_LEVEL else slice(None)
        found = mixed(names[keep])
        values = np.minimum((found >> np.uint64(24)) & np.uint64(0xFFFF), np.uint64(NO_NAME - 1))
        np.minimum.at(out, (texts[keep], (found >> np.uint64(58)).astype(np.int64)), values.astype(np.uint16))
        names, texts = names[~whole], texts[~whole]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, from 0 to 1; two fingerprints without names are alike."""
    filled = (a != NO_NAME) | (b != NO_NAME)
    same = ((a == b) & filled).sum(axis=1)
    n = filled.sum(axis=1)
    return np.where(n > 0, same / np.maximum(n, 1), 1.0)


def hexed(prints: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in prints]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


FIELDS = (
    "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double"
)


def compared(texts: list[str]) -> list[list]:
    """The fields of ``FIELDS`` for each text but the last, which only follows."""
    own = texts[:-1]
    changed = [edited(t, n).encode() for t, n in zip(own, texts[1:])]
    prints = fingerprints([t.encode() for t in texts])
    after = fingerprints(changed)
    return [
        [len(t) for t in own],
        [hashlib.sha256(c).hexdigest() for c in changed],
        hexed(prints[:-1]),
        hexed(after),
        likeness(prints[:-1], after).tolist(),
        likeness(prints[:-1], prints[1:]).tolist(),
    ]


def with_fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each whole text as hexadecimal string; null texts count as
    empty, and equal texts have equal fingerprints."""

    @F.pandas_udf("string")
    def prints(texts):
        import pandas as pd

        return pd.Series(hexed(fingerprints([(t or "").encode() for t in texts])), dtype=object)

    return docs.withColumn(out, prints(F.col(text)))


def fingerprint_chain(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` and the fields of ``FIELDS``, one row for each row of ``docs``, each text compared
    with its edited text and with the next text in descending ``key`` (after the last, the first).

    One range shuffle puts neighbours side by side. Each partition streams its rows; its first text
    and its last row are passed on and meet the neighbouring partitions' in a second, small
    step of one row for each partition. Null texts count as empty; null identifiers come last; rows
    that share an identifier are ordered by text. A table of one row is its own next.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").desc_nulls_last()  # ranges by identifier only: their sample goes to the driver
    rows = (
        docs.select(F.col(key).cast("long").alias("doc_id"), text_of(text).alias("t"))
        .repartitionByRange(parts, order)
        .sortWithinPartitions(order, F.col("t").desc())
    )
    names = [f.split()[0] for f in FIELDS.split(",")]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, first = TaskContext.get().partitionId(), [], [], True

        def out(columns: list[list], ids: list, edge: list, kind: int) -> pa.RecordBatch:
            n = len(ids)
            types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = columns or [[None] * n] * len(types)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part] * n, pa.int32()),
                    pa.array([kind] * n, pa.int32()),
                    pa.array(ids, pa.int64()),
                    pa.array(edge, pa.string()),
                    *(pa.array(c, t) for c, t in zip(columns, types)),
                ],
                ["part", "kind", "doc_id", "edge", *names],
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            ids += batch.column(0).to_pylist()
            texts += batch.column(1).to_pylist()
            if first:
                yield out([], [None], [texts[0]], 1)
                first = False
            yield out(compared(texts), ids[:-1], [None] * (len(ids) - 1), 0)
            ids, texts = ids[-1:], texts[-1:]
        if texts:
            yield out([], ids, texts, 2)

    done = checkpointed(rows.mapInArrow(stream, f"part int, kind int, doc_id long, edge string, {FIELDS}"))
    heads = done.where("kind = 1").select("part", "edge")
    filled = heads.select("part").withColumn("to", F.lead("part").over(Window.orderBy("part")))
    start = heads.agg(F.min("part").alias("p"))
    filled = filled.withColumn("to", F.coalesce("to", start.scalar()))
    lasts = (
        done.where("kind = 2")
        .select("part", "doc_id", "edge")
        .join(filled, "part")
        .join(heads.select(F.col("part").alias("to"), F.col("edge").alias("following")), "to")
        .select("doc_id", "edge", "following")
    )

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                fields = compared([batch.column(1)[i].as_py(), batch.column(2)[i].as_py()])
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": batch.column(0).slice(i, 1)} | {n: pa.array(f) for n, f in zip(names, fields)}
                )

    inner = done.where("kind = 0").select("doc_id", *names)
    return inner.unionByName(lasts.mapInArrow(ends, f"doc_id long, {FIELDS}"))


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    return fingerprint_chain(table(spark, sf_dir, "documents").select("doc_id", "text"))
