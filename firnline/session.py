"""Session settings and the shared working folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8, name: str = "firnline") -> SparkSession:
    """A session for tests and single-machine runs; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_base(spark: SparkSession) -> str:
    """The folder every executor reaches: ``spark.checkpoint.dir`` of the session, else the checkpoint
    directory already set on the context, else a folder below the session's warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared place."""
    return f"{shared_base(spark).rstrip('/')}/firnline/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint directory, so that later steps do not recompute them
    and a lost executor costs nothing."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_base(spark))
    return df.checkpoint()
