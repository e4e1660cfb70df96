"""T: incremental ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from firnline.catalog.joins import EXTENDED_SQL
from firnline.catalog.registry import plain, query
from firnline.plans.features import static_layer
from firnline.session import shared_folder
from firnline.sources import driver_grid as g
from firnline.streaming.ingest import SCENE_SCHEMA, read_output, start_ingest


@query("t01_incremental_ingest", EXTENDED_SQL)
def incremental_ingest(spark, sf):
    """Three arrivals, the second one late (days 8 to 12 after days 13 to 28)."""
    root = shared_folder(spark)
    static_path = f"{root}/static"
    static_layer(g.cells(spark, sf)).write.parquet(static_path)
    static = spark.read.parquet(static_path)
    g.pixels(spark, sf).select([f.name for f in SCENE_SCHEMA]).write.parquet(f"{root}/scenes")
    scenes = spark.read.schema(SCENE_SCHEMA).parquet(f"{root}/scenes")
    day = F.dayofmonth("date")
    for part in (day <= 7, day > 12, day.between(8, 12)):
        scenes.where(part).write.mode("append").parquet(f"{root}/incoming")
        start_ingest(
            spark, f"{root}/incoming", f"{root}/store", static, f"{root}/out", f"{root}/checkpoint"
        ).awaitTermination()
    return plain(read_output(spark, f"{root}/out"))
