"""Fuzzy line dedup: one line stays of all lines that are alike.

Lines are cut at ``\\n`` and compared with A-Z lower-cased and ASCII white space collapsed. A line's
set is its character shingles of ``SHINGLE`` characters (a shorter line is one shingle). One hash of
each shingle gives a one-permutation MinHash of ``BANDS * ROWS`` bins; an empty bin takes the value of
a full bin that a hash of the bin's number picks, the same for every line. Lines meet where a band
agrees: at a similarity s with probability ``1 - (1 - s ** ROWS) ** BANDS`` if bins were independent, 0.998 at 0.8 and
above 0.9999 from 0.86 on. Bins of short lines are not: of pairs at exactly 0.80 with 9 to 144 shingles 0.991 to 0.995
meet in simulation. Bands of six rows keep lines apart that only share the letter runs of their
language (0.1 to 0.3), which bands of four bring together in numbers that grow with the corpus.
Candidates are verified on their exact sets, and a distributed union-find forms the components, of
which the line with the smallest (doc_id, position) stays. Equal lines are one class before anything
is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.common import own_name, small, table, written
from firnline.llm.near import SLICE, distinct, folded, mixed, near_components

SHINGLE = 5
BANDS = 21
ROWS = 6
PERCENT = 80
EMPTY = np.uint32(0xFFFFFFFF)
#: Characters that are hashed at a time, so that the arrays stay in the processor's cache.
BLOCK = 60_000
#: For each turn of filling empty bins, the bin that each bin looks at.
PICKS = np.random.default_rng(5).integers(0, BANDS * ROWS, (8 * BANDS * ROWS, BANDS * ROWS))


def plain_lines(text: str | None) -> list[str]:
    """The lines as they are compared, by position; a line without words is empty."""
    return [b" ".join(x.lower().split()).decode() for x in (text or "").encode().split(b"\n")]


def shingles(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all lines (none empty) in a row, repeats included, and the line of each."""
    gap = "\0" * SHINGLE
    codes = np.frombuffer(gap.join(lines + [""]).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(x) for x in lines], np.int64)
    counts = np.maximum(sizes - SHINGLE + 1, 1)
    starts = np.cumsum(sizes + SHINGLE) - sizes - SHINGLE
    line = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(len(line)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)
    total = np.zeros(len(codes) - SHINGLE + 1, np.uint64)
    for i in range(SHINGLE):
        total *= np.uint64(0x100000001B3)
        total += codes[i : i + len(total)]
    return mixed(total[at]), line


def blocks(lines: list[str]) -> Iterator[list[str]]:
    """The lines in order, in blocks of about ``BLOCK`` characters."""
    ends = np.cumsum([len(x) for x in lines]) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(lines)]
    return (lines[i:j] for i, j in zip(cuts, cuts[1:]) if i < j)


def line_shingles(stored: list) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each of the stored lines."""
    out = []
    for block in blocks([bytes(x).decode() for x in stored]):
        values, line = shingles(block)
        ends = np.flatnonzero(np.diff(line, append=-1)) + 1
        out += [distinct(values[i:j]) for i, j in zip([0, *ends.tolist()], ends.tolist())]
    return out


def signatures(values: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """One-permutation MinHash, ``BANDS * ROWS`` values for each of ``n`` lines."""
    k = BANDS * ROWS
    out = np.full(n * k, EMPTY)
    bins = (((values >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)).astype(np.int64)
    np.minimum.at(out, line * k + bins, values.astype(np.uint32))
    out = out.reshape(n, k)
    had = out != EMPTY
    rows = np.flatnonzero(~had.all(axis=1))
    for pick in PICKS:
        if not len(rows):
            break
        part = out[rows]
        take = (part == EMPTY) & had[rows][:, pick]
        part[take] = out[rows][:, pick][take]
        out[rows] = part
        rows = rows[(part == EMPTY).any(axis=1)]
    part = out[rows]
    out[rows] = np.where(part == EMPTY, part.min(axis=1, keepdims=True), part) if len(part) else part
    return out


def bands(values: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    s = signatures(values, line, n)
    return np.stack([folded(s[:, i * ROWS : (i + 1) * ROWS], i) for i in range(BANDS)], axis=1)


def band_keys(lines: list[str]) -> np.ndarray:
    """The band keys of each line."""
    parts = [bands(*shingles(x), len(x)) for x in blocks(lines)]
    return np.concatenate([np.empty((0, BANDS), np.uint64), *parts])


def signed_lines(docs: DataFrame, text: str, key: str) -> DataFrame:
    """``(doc_id, pos, digest, keys)`` of each line that is not empty. Of equal lines in a batch only
    the first has keys; the class takes the keys of any that has them."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, positions, digests, first, new = [], [], [], [], {}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for pos, x in enumerate(plain_lines(text)):
                    if x:
                        ids.append(doc)
                        positions.append(pos)
                        digests.append(hashlib.blake2b(x.encode(), digest_size=16).digest())
                        first.append(x not in new)
                        new.setdefault(x, len(new))
            keys = band_keys(list(new))
            offsets = np.r_[0, np.cumsum(np.where(first, BANDS, 0))].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(positions, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64).reshape(-1))),
                ],
                ["doc_id", "pos", "digest", "keys"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.mapInArrow(sign, "doc_id long, pos int, digest binary, keys array<long>")


def line_sets(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """``(id, size, shingles)`` of the lines ``wanted(id, doc_id, pos)``: the number of its distinct
    shingles and the line itself, an eighth of its hashes, which ``line_shingles`` makes of it."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines = [], []
            for t, asked in zip(batch.column("t").to_pylist(), batch.column("asked").to_pylist()):
                cut = (t or "").encode().split(b"\n")
                for x in asked:
                    ids.append(x["id"])
                    lines.append(b" ".join(cut[x["pos"]].lower().split()))
            sizes = []
            for i in range(0, len(lines), SLICE):
                sizes += [len(x) for x in line_shingles(lines[i : i + SLICE])]
            columns = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(lines, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "size", "shingles"])

    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("id", "pos")).alias("asked"))
    asked = small(written(asked), "size(asked)")
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))
    return rows.join(asked, "doc_id").mapInArrow(sets, "id long, size long, shingles binary")


def repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(doc_id, pos)`` of the lines that go. Lines without words never go. Identifiers are unique
    integers; lines of rows without an identifier are neither compared nor dropped."""
    signed = signed_lines(docs.where(F.col(key).isNotNull()), text, key)
    lines = written(signed.withColumn("id", F.monotonically_increasing_id()))
    place = F.struct("doc_id", "pos")
    has_keys = F.size("keys") > 0
    classes = written(
        lines.groupBy("digest").agg(
            F.min(place).alias("first"), F.min(F.when(has_keys, F.col("id"))).alias("id"), F.count("*").alias("n")
        )
    )
    keyed = lines.where(has_keys)
    copies = small(written(keyed.select("id").join(classes.select("id"), "id", "left_anti")))
    roots = near_components(
        keyed.select("id", "keys").join(copies, "id", "left_anti"),
        lambda ids: line_sets(docs, lines.select("id", "doc_id", "pos").join(ids, "id"), text, key),
        PERCENT,
        line_shingles,
    )
    in_root = classes.select("id", "digest", "first").join(roots, "id")
    keep = in_root.groupBy("root").agg(F.min("first").alias("keep"))
    fuzzy = in_root.join(keep, "root").select("digest", "keep")
    kept_at = (
        classes.join(fuzzy, "digest", "left")
        .where("n > 1 or keep is not null")
        .select("digest", F.coalesce("keep", "first").alias("keep"))
    )
    return (
        lines.select("digest", place.alias("at"))
        .join(kept_at, "digest")
        .where(F.col("at") != F.col("keep"))
        .select("at.doc_id", "at.pos")
    )


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text``, the other columns as they are.

    Null texts stay null; a text that lost all its lines becomes empty. Rows are never dropped."""
    name, gone_name = own_name(docs, "line_doc"), own_name(docs, "line_gone")
    gone = repeated_lines(docs, text, key).groupBy("doc_id").agg(F.collect_list("pos").alias(gone_name))
    gone = small(written(gone.withColumnRenamed("doc_id", name)), f"size({gone_name})")

    @F.arrow_udf("string")
    def without(texts: pa.Array, dropped: pa.Array) -> pa.Array:
        out = []
        for t, d in zip(texts, dropped):
            gone = set(d.as_py() or ())
            out.append("\n".join(x for i, x in enumerate(t.as_py().split("\n")) if i not in gone) if gone else t)
        return pa.array(out, pa.string())

    joined = docs.join(gone, docs[key] == F.col(name), "left")
    kept = [without(F.col(text), F.col(gone_name)).alias(text) if c == text else F.col(c) for c in docs.columns]
    return joined.select(*kept)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its remaining text and the number of its lines before and after."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    count = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    out = dedup_lines(docs.withColumn("n_lines", count))
    return out.select("doc_id", "n_lines", F.when(F.length("text") > 0, count).otherwise(0).alias("n_left"), "text")
