"""Exact dedup by a tree-merge of sorted digest runs.

Every input partition makes one run: its distinct digests with the smallest identifier and the
number of rows. The runs are merged in rounds, ``fan_in`` runs to one, as in a binomial merge
tree, until one run is left; a run is spread over all tasks by its digests, so the last run is no
bigger task than the first. At each level equal digests leave one entry: the shuffle brings the
entries of a run and digest together, the smallest identifier and the summed count stay, and the
256-bit digest and the text's length are both compared, so an entry is never joined on a shortened
key alone. A group of copies reaches each merge with one row for each run below it, however large
it is.

The answer goes back down the same tree: each run takes ``keep_id`` and the group size from the run
it went into. Rows meet at (run, digest) and not at the digest, so a digest that a third of all
rows have is spread over as many tasks as there are runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.llm.common import SPACE, checkpointed, own_name, table, text_of

FAN_IN = 32
KEY = ["run", "digest", "length"]


def normalised(column: str = "text") -> Column:
    """Each stretch of ASCII white space as one space; null is the empty text."""
    return F.regexp_replace(text_of(column), SPACE, " ")


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``(id, run, digest, length)``: one row per document, ``run`` is its input partition."""
    plain = docs.select(F.col(key).alias("id"), normalised(text).alias("plain"))
    return plain.select(
        "id",
        F.spark_partition_id().alias("run"),
        F.unhex(F.sha2(F.encode("plain", "UTF-8"), 256)).alias("digest"),
        F.length("plain").alias("length"),
    )


def merge(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One round: runs ``k * fan_in`` to ``(k + 1) * fan_in - 1`` become run ``k``."""
    return (
        runs.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
        .groupBy(*KEY)
        .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    )


def exact_groups(
    docs: DataFrame, text: str = "text", key: str = "doc_id", fan_in: int = FAN_IN
) -> DataFrame:
    """``(id, keep_id, group_size, digest)``, one row for each row of ``docs``.

    Null texts count as empty and group with empty ones. A null identifier takes part in its group
    but is kept only where no row of the group has one. Rows that share an identifier and a text
    are members of one group, each counted. An empty table gives an empty table.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    leaves = checkpointed(digests(docs, text, key))
    level = leaves.groupBy(*KEY).agg(
        F.min("id").alias("keep_id"), F.count("*").alias("group_size")
    )
    levels = [checkpointed(level)]
    width = (leaves.agg(F.max("run")).first()[0] or 0) + 1
    while width > 1:
        levels.append(checkpointed(merge(levels[-1], fan_in)))
        width = -(-width // fan_in)
    answer = levels.pop()
    while levels:
        answer = _taken(levels.pop().select(*KEY), answer, fan_in)
    return _taken(leaves, answer, 1)


def _taken(lower: DataFrame, upper: DataFrame, fan_in: int) -> DataFrame:
    """Each row of ``lower`` with the answer of the run it went into."""
    up = F.floor(F.col("run") / fan_in).cast("int")
    above = upper.withColumnRenamed("run", "up")
    return lower.withColumn("up", up).join(above, ["up", "digest", "length"]).drop("up")


def drop_copies(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are. Identifiers must be unique."""
    name = own_name(docs, "kept_id")
    kept = exact_groups(docs, text, key).where(F.col("id") == F.col("keep_id"))
    return docs.join(kept.select(F.col("id").alias(name)), docs[key] == F.col(name), "left_semi")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    groups = exact_groups(docs)
    return groups.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
"""
