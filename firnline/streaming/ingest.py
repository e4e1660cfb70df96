"""Incremental scene ingest: the feature table follows the arriving scenes.

A scene on day d changes the features of day d and, through the history windows, of the seven
days after it. Each micro-batch therefore rebuilds exactly those days with the batch code, so late and
repeated scenes give the same table as one batch run over everything.

The output is a folder of versions::

    <output>/days/version=<n>/date=<d>/   the days that version n rebuilt
    <output>/manifests/version=<n>/       one file: the dates of version n, and the stream's batch it came from

The manifest is one file, written last, so a version appears at once or not at all: readers see for each
date the newest version with a manifest, never half of a rebuilt week, and a retried batch that had been
committed is left alone. ``remove_superseded`` deletes days that the latest state no longer uses.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from firnline.plans.features import EXTENDED, build_features

SCENE_SCHEMA = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("mw_value", T.ByteType()),
        T.StructField("opt_value", T.DoubleType()),
    ]
)
STORE_SCHEMA = T.StructType([*SCENE_SCHEMA.fields, T.StructField("batch", T.LongType())])
MANIFEST = "date date, query string, batch long, version long"
HISTORY_DAYS = 7


def dates_after(dates: Iterable[dt.date]) -> list[dt.date]:
    """The dates and the week after each of them."""
    return sorted({d + dt.timedelta(k) for d in dates for k in range(HISTORY_DAYS + 1)})


def dates_before(dates: Iterable[dt.date]) -> list[dt.date]:
    """The dates and the week before each of them."""
    return sorted({d - dt.timedelta(k) for d in dates for k in range(HISTORY_DAYS + 1)})


def scene_dates(scenes: DataFrame) -> list[dt.date]:
    """Scene dates of a batch or of some partitions: a short list, like a directory listing."""
    return sorted(r["date"] for r in scenes.select("date").distinct().collect())


def one_per_pixel(rows: DataFrame, *order: str) -> DataFrame:
    """One row per pixel: the last by ``order``, then the largest."""
    values = [f.name for f in SCENE_SCHEMA if f.name not in ("date", "x", "y")]
    newest = rows.groupBy("date", "x", "y").agg(F.max_by(F.struct(*values), F.struct(*order, *values)).alias("v"))
    return newest.select("date", "x", "y", "v.*")


def latest_pixels(stored: DataFrame) -> DataFrame:
    """One row per pixel: the one of the latest batch, if a scene was delivered again. A batch is stored with
    one row per pixel, so only days that came in several batches are grouped."""
    deliveries = stored.groupBy("date").agg(F.count_distinct("batch").alias("n"))
    several = [r["date"] for r in deliveries.where("n > 1").collect()]
    names = [f.name for f in SCENE_SCHEMA]
    again = F.col("date").isin(several) if several else F.lit(False)
    once = stored.where(~again).select("date", "x", "y", *[n for n in names if n not in ("date", "x", "y")])
    return once.unionByName(one_per_pixel(stored.where(again), "batch")) if several else once


def manifests(spark: SparkSession, output: str) -> DataFrame:
    """``(date, query, batch, version)`` of all committed versions."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{output}/manifests")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def ingest_batch(batch: DataFrame, batch_id: int, store: str, static: DataFrame, output: str) -> None:
    """Keep the arrived scenes, rebuild the affected days and commit them as the next version.

    The store is partitioned by date and version: a retried batch overwrites itself, and a scene
    whose files arrive in several batches keeps all its parts. One writer at a time.
    """
    spark = batch.sparkSession
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""
    known = manifests(spark, output)
    if not known.where((F.col("query") == query) & (F.col("batch") == batch_id)).isEmpty():
        return  # committed before the stream could note it
    arrived = scene_dates(batch)
    if not arrived:
        return
    version = (known.agg(F.max("version")).first()[0] or 0) + 1
    band = F.floor(F.col("row") / 256)

    def overwrite(df: DataFrame, path: str, mode: str, *parts: str) -> None:
        df.repartition("date", band).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(
            *parts
        ).parquet(path)

    kept = one_per_pixel(batch).withColumn("batch", F.lit(version).cast("long"))
    overwrite(kept, store, "dynamic", "date", "batch")
    stored = spark.read.schema(STORE_SCHEMA).parquet(store)
    # literal dates prune the partitions of the store
    targets = scene_dates(stored.where(F.col("date").isin(dates_after(arrived))))
    history = dates_before(targets)
    window = latest_pixels(stored.where(F.col("date").isin(history)))
    overwrite(build_features(window, static, only=targets), f"{output}/days/version={version}", "static", "date")
    rows = spark.createDataFrame([(d, query, batch_id) for d in targets], "date date, query string, batch long")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{output}/manifests/version={version}")


def start_ingest(
    spark: SparkSession,
    incoming: str,
    store: str,
    static: DataFrame,
    output: str,
    checkpoint: str,
    bytes_per_batch: int = 1 << 36,
) -> StreamingQuery:
    """Process the scenes that are present (and, on the next start, those that arrived since).

    A batch is cut by bytes: cut by files, scenes of many files would come in several batches, each of which
    rebuilds all their days, and the number of both grows with the scenes."""
    arrivals = (
        spark.readStream.schema(SCENE_SCHEMA)
        .option("maxBytesPerTrigger", bytes_per_batch)
        .parquet(incoming)
    )
    return (
        arrivals.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(lambda batch, i: ingest_batch(batch, i, store, static, output))
        .start()
    )


def current_days(spark: SparkSession, output: str, version: int | None = None) -> dict[dt.date, int]:
    """The version of every date, in the latest state or as of a version: one entry for each scene date."""
    rows = manifests(spark, output)
    if version is not None:
        rows = rows.where(F.col("version") <= version)
    return {r["date"]: r["v"] for r in rows.groupBy("date").agg(F.max("version").alias("v")).collect()}


def read_output(spark: SparkSession, output: str, version: int | None = None) -> DataFrame:
    """The table as of its latest or a given version. What is read is fixed here: versions that are committed
    later do not change it."""
    days = current_days(spark, output, version)
    if not days:
        raise LookupError(f"nothing is committed under {output}")
    paths = [f"{output}/days/version={v}/date={d.isoformat()}" for d, v in sorted(days.items())]
    return spark.read.option("basePath", f"{output}/days").parquet(*paths).select(EXTENDED)


def remove_superseded(spark: SparkSession, output: str) -> int:
    """Deletes the rebuilt days that a later version replaced, and returns their number. Readers that began
    before the latest version must have ended."""
    days = current_days(spark, output)
    rows = manifests(spark, output).select("date", "version").collect()
    jvm, gone = spark._jvm, 0
    for r in rows:
        if days[r["date"]] != r["version"]:
            path = jvm.org.apache.hadoop.fs.Path(f"{output}/days/version={r['version']}/date={r['date'].isoformat()}")
            gone += int(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone
