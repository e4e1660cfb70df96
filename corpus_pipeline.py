"""From raw documents to encoded training data: five stages, each written as Parquet and read again.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm import bpe, line_dedup, mixing, near_dedup, quality
from firnline.llm.common import own_name, shared_base, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below one half go; the rows ``labels`` holds out teach nothing."""
    model = quality.fit(docs, quality.training_labels(spark, sf_dir))
    scored = quality.score(docs, model)
    return scored.where(F.col(scored.columns[-1]) >= 0.5).select(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts, ``n_chars`` follows. A document whose every line was a repetition is
    a copy without content and goes; documents that were null or empty before stay."""
    had = own_name(docs, "had_text")
    out = line_dedup.dedup_lines(docs.withColumn(had, F.coalesce(F.length("text") > 0, F.lit(False))))
    kept = out.where(~F.col(had) | (F.length("text") > 0)).drop(had)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, on shingles of five words."""
    return near_dedup.drop_near_copies(docs, width=5, percent=80)


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source``, the identifiers as little-endian 32-bit integers and their number."""
    encoded = bpe.encode(docs.select("doc_id", "source", "text"), bpe.default_path())
    return encoded.select("doc_id", "source", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_deduplication),
    ("MinHash near-dedup", minhash_near_dedup),
    ("mixing sources to target weights", mixing_to_target_weights),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL cannot express the trained classifier, the fuzzy links, the subset sums or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each is written to the shared folder and read again."""
    folder = f"{shared_base(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
