"""Helpers the training-data operators share: columns, checkpoints, connected components."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white space characters of the query contracts, as a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_see_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def id_order(column: str = "doc_id") -> Column:
    return F.col(column).asc_nulls_last()


def shared_base(spark: SparkSession) -> str:
    """The folder all executors reach: ``spark.checkpoint.dir`` of the session, else the directory
    already set on the context, else a folder below the session's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return base.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared checkpoint folder: read again after a lost executor, never
    recomputed by the steps that follow."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_base(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """As ``checkpointed``, as a Parquet table in the shared folder: columnar and compressed, so that
    identifiers in order and repeated keys take few bytes, and later steps read only their columns."""
    path = f"{shared_base(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of a few numbers that may be broadcast, some 50 MB; see ``small``.
BROADCAST_ROWS = 2_000_000


def dropped(*tables: DataFrame) -> None:
    """Deletes tables that ``written`` made, once nothing that is still to run reads them."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            spark = df.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, weight: str = "1", rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows (or, with ``weight``, numbers
    in them), counted now; else as it is, for a shuffled join. ``df`` should be checkpointed."""
    found = df.agg(F.sum(F.expr(weight)).alias("n")).first()["n"] or 0
    return F.broadcast(df) if found <= rows else df


def crc32_sql(text: str) -> str:
    """DuckDB's way to the unsigned CRC-32 of an ASCII string, for the statements that stand beside queries."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END"
    byte = f"list_reduce(range(8)::UBIGINT[], lambda x, i: {step}, xor(c, b))"
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ord({text}[i])::UBIGINT)"
    return f"CAST(xor(list_reduce({codes}, lambda c, b: {byte}, 4294967295::UBIGINT), 4294967295::UBIGINT) AS BIGINT)"


def own_name(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_" + uuid.uuid4().hex[:6]
    return name


def components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """Connected components of ``edges(a, b)`` as ``(id, root)``; root is the smallest id.

    Distributed union-find by alternating large-star and small-star steps: every step replaces
    edges by edges to a smaller neighbour, so the edge count never grows, and the forest ends as
    stars around the smallest ids. Minima are combined before the shuffle, so a node with very
    many neighbours costs one row for each map task; each round is a written table, and the one before it is deleted. Nothing is
    collected but two totals a round. Null ends are ignored. Raises if ``max_rounds`` is passed
    (the rounds needed grow with the logarithm of the component size).
    """
    a, b = F.col("a"), F.col("b")
    current = written(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct()
    )
    totals = (F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
    before = current.agg(*totals).first()
    for _ in range(max_rounds):
        both = current.unionByName(current.select(b.alias("a"), a.alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).distinct()
        )
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.when(b == F.col("m"), a).otherwise(b).alias("a"), F.col("m").alias("b"))
            .where(F.col("a") != F.col("b"))
            .distinct()
        )
        last, current = current, written(small)
        state = current.agg(*totals).first()
        dropped(last)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(b.alias("id"), b.alias("root")).distinct()
    return current.select(a.alias("id"), b.alias("root")).unionByName(roots)


def workers_see_package(spark: SparkSession) -> None:
    """Python workers on this machine find the package where it was imported from; a cluster
    installs it or gets it by ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
