"""Mixing sources to target weights by subset-sum budget fitting.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating; a target is at most
``CEILING`` times its source's size, and what is above is shared again by weight. That fixed point is
``min(ceiling * size, level * weight)`` with one common level, found from running sums over the
sources (one row each).

Each source is taken whole as often as its target allows. For the remaining budget the documents are
counted by exact length; a proportional share of every length is taken, long lengths fill up
until at most ``TABLE`` words are missing, and a bounded-knapsack table over the lengths and counts
that are left closes the gap as far as a subset can. The table works on distinct lengths, never on
documents. Which documents of a length go is decided by a seeded hash: counts for each
(source, length, slice of the hash) are summed up, and ranks are only taken inside a slice, so
that a length that a third of all rows have is spread over ``SLICES`` tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from firnline.llm.common import WORD, checkpointed, table, text_of

WEIGHTS = (5, 2, 1)
CEILING = 3
TABLE = 1 << 17
SLICES = 1024
SEED = 23


def fit_counts(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many of ``counts[i]`` documents of ``lengths[i] > 0`` words to take, so that their words
    come as near to ``budget`` from below as the method finds."""
    total = int((lengths * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(counts), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int((lengths * taken).sum())
    order = np.argsort(-lengths, kind="stable")
    for spare in (table // 2, 0):
        for i in order:
            if rest <= table:
                break
            more = min(int(counts[i] - taken[i]), (rest - spare) // int(lengths[i]))
            taken[i] += more
            rest -= more * int(lengths[i])
    if 0 < rest <= table:
        taken += _knapsack(lengths, counts - taken, rest)
    return taken


def _knapsack(lengths: np.ndarray, left: np.ndarray, rest: int) -> np.ndarray:
    """The bounded-knapsack table: counts are split into powers of two, each such piece is used
    once, and a sum remembers the piece that reached it first."""
    by = np.full(rest + 1, -1, np.int32)
    reached = np.zeros(rest + 1, bool)
    reached[0] = True
    pieces = []
    for i in np.flatnonzero((left > 0) & (lengths <= rest)):
        many, power = min(int(left[i]), rest // int(lengths[i])), 1
        while many > 0 and not reached[rest]:
            n = min(power, many)
            many, power = many - n, power * 2
            weight = n * int(lengths[i])
            new = reached[:-weight] & ~reached[weight:]
            by[weight:][new] = len(pieces)
            reached[weight:] |= new
            pieces.append((i, n, weight))
        if reached[rest]:
            break
    taken = np.zeros(len(lengths), np.int64)
    at = int(np.flatnonzero(reached)[-1])
    while at:
        i, n, weight = pieces[by[at]]
        taken[i] += n
        at -= weight
    return taken


def targets(sizes: DataFrame) -> DataFrame:
    """``(source, source_size, target)`` from ``sizes(source, size)``."""
    sources = checkpointed(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((place - 1) % len(WEIGHTS) + 1).cast("int"))
    limit = (F.col("source_size") * CEILING).cast("double")
    ranked = sources.withColumn("weight", weight.cast("double")).withColumn("limit", limit)
    every = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = every.rowsBetween(Window.unboundedPreceding, -1)
    onward = every.rowsBetween(0, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    ) / F.sum("weight").over(onward)
    open_level = F.when(level * F.col("weight") <= F.col("limit"), level)
    return (
        ranked.withColumn("open_level", open_level)
        .withColumn("level", F.max("open_level").over(all_rows))
        .select(
            "source",
            "source_size",
            F.least("limit", F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"),
        )
    )


def decided(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``(row, size, source_size, target, copies)``: each row of ``docs`` as a struct and how many
    times the mix takes it, 0 to ``CEILING``.

    Size is the number of words; null texts have none. A null source is a source of its own, the
    last. Documents without words take no part in the fit. Rows that share an identifier are
    separate rows, in the order of a hash of their texts. An empty table gives an empty table.
    """
    rows = docs.select(
        F.struct(*docs.columns).alias("row"),
        F.col(source).alias("source"),
        F.regexp_count(text_of(text), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(F.col(key), F.lit(SEED)).alias("hash"),
    ).withColumn("slice", F.shiftright("hash", 54).cast("int"))
    slices = checkpointed(rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n")))
    planned = targets(slices.select("source", (F.col("size") * F.col("n")).alias("size")))
    planned = planned.withColumn(
        "rounds",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0),
    ).withColumn("budget", F.round(F.col("target") - F.col("rounds") * F.col("source_size")).cast("long"))
    planned = checkpointed(planned)

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        lengths, counts = group["size"].to_numpy(), group["n"].to_numpy()
        order = np.argsort(lengths, kind="stable")
        extra = np.zeros(len(group), np.int64)
        extra[order] = fit_counts(lengths[order], counts[order], int(group["budget"].iloc[0]))
        return group.assign(extra=extra)[["source", "size", "extra"]]

    plan = planned.withColumnRenamed("source", "p_source")
    same_plan = F.col("source").eqNullSafe(F.col("p_source"))
    histogram = slices.where("size > 0").groupBy("source", "size").agg(F.sum("n").alias("n"))
    fitted = checkpointed(
        histogram.join(plan, same_plan)
        .select("source", "size", "n", "budget")
        .groupBy("source")
        .applyInPandas(fit, "source string, size long, extra long")
    ).select(F.col("source").alias("f_source"), F.col("size").alias("f_size"), "extra")
    same_length = F.col("source").eqNullSafe(F.col("f_source")) & (F.col("size") == F.col("f_size"))
    so_far = (
        Window.partitionBy("source", "size")
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        slices.withColumn("before", F.coalesce(F.sum("n").over(so_far), F.lit(0)))
        .join(fitted, same_length, "left")
        .join(plan, same_plan)
        .select(
            F.col("source").alias("b_source"),
            F.col("size").alias("b_size"),
            F.col("slice").alias("b_slice"),
            (F.coalesce("extra", F.lit(0)) - F.col("before")).alias("open"),
            "rounds",
            "source_size",
            "target",
        )
    )
    inside = Window.partitionBy("source", "size", "slice").orderBy("hash", F.col(f"row.{key}"), F.xxhash64(F.col(f"row.{text}")))
    ranked = rows.withColumn("rank", F.row_number().over(inside))
    return ranked.join(
        before,
        F.col("source").eqNullSafe(F.col("b_source"))
        & (F.col("size") == F.col("b_size"))
        & (F.col("slice") == F.col("b_slice")),
    ).select(
        "row",
        "size",
        "source_size",
        "target",
        (F.col("rounds") + (F.col("rank") <= F.col("open")).cast("long")).alias("copies"),
    )


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, all columns as they are."""
    taken = decided(docs, text, source, key).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select(
        "row.*"
    )


def op9_mixing_sources_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's row per document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return decided(docs).select(
        "row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
