"""Incremental ingest equals one batch run, whatever the order and the split of the scenes."""

import pytest
from pyspark.sql import functions as F

from firnline.plans.features import build_features, static_layer
from firnline.session import shared_folder
from firnline.sources import driver_grid as g
from firnline.streaming.ingest import (
    SCENE_SCHEMA,
    current_days,
    ingest_batch,
    manifests,
    read_output,
    remove_superseded,
    start_ingest,
)

SF = "/root/testdata/sf0.001"


def test_split_late_and_repeated_scenes(spark):
    root = shared_folder(spark)
    static_layer(g.cells(spark, SF)).write.parquet(f"{root}/static")
    static = spark.read.parquet(f"{root}/static")
    season = g.pixels(spark, SF).where(F.year("date") == 2019).select([f.name for f in SCENE_SCHEMA])
    season.write.parquet(f"{root}/all")
    season = spark.read.schema(SCENE_SCHEMA).parquet(f"{root}/all")
    day, east = F.dayofmonth("date"), F.col("col") >= 12
    wrong = season.where(day == 6).withColumn("mw_value", F.lit(0).cast("tinyint"))
    arrivals = [
        season.where((day <= 16) & ~east & (day != 6)),
        wrong,  # delivered again below
        season.where((day <= 16) & east & (day != 6)),
        season.where((day == 6) | (day == 17)),
    ]
    for part in arrivals:
        part.coalesce(2).write.mode("append").parquet(f"{root}/in")
        start_ingest(
            spark, f"{root}/in", f"{root}/store", static, f"{root}/out", f"{root}/check"
        ).awaitTermination()
    got = read_output(spark, f"{root}/out")
    want = build_features(season.where(day <= 17), static)
    assert got.count() == want.count()

    def rounded(df):
        return df.select(
            *[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
        )

    assert rounded(got).exceptAll(rounded(want)).count() == 0


def test_readers_between_two_writes(spark):
    """A reader that began keeps its state, a write that stops before its manifest is not seen, and a batch
    that was committed is not written again."""
    root = shared_folder(spark)
    static_layer(g.cells(spark, SF)).write.parquet(f"{root}/static")
    static = spark.read.parquet(f"{root}/static")
    day = F.dayofmonth("date")
    season = g.pixels(spark, SF).where((F.year("date") == 2019) & (day <= 9)).select([f.name for f in SCENE_SCHEMA])
    out, store = f"{root}/out", f"{root}/store"
    with pytest.raises(LookupError):
        read_output(spark, out)
    twice = season.where(day <= 4)
    ingest_batch(twice.unionByName(twice), 0, store, static, out)  # repeated rows in one delivery
    first = read_output(spark, out)
    before = sorted(map(tuple, first.select("date", "col", "row", "mw_value_7_day_average").collect()), key=repr)
    assert len(before) == build_features(twice, static).count()
    # half of a rebuilt week without a manifest
    first.limit(5).write.partitionBy("date").parquet(f"{out}/days/version=2")
    assert set(current_days(spark, out).values()) == {1}
    ingest_batch(season.where(day > 4), 1, store, static, out)
    ingest_batch(season.where((day == 2) & (F.col("mw_value") != -1)).withColumn("mw_value", F.lit(1).cast("tinyint")), 2, store, static, out)
    assert sorted({r["version"] for r in manifests(spark, out).collect()}) == [1, 2, 3]
    again = sorted(map(tuple, first.select("date", "col", "row", "mw_value_7_day_average").collect()), key=repr)
    old = sorted(map(tuple, read_output(spark, out, 1).select("date", "col", "row", "mw_value_7_day_average").collect()), key=repr)
    assert again == before == old
    latest = read_output(spark, out)
    assert latest.count() == build_features(season, static).count()
    assert latest.where((day == 2) & (F.col("mw_value") != 1)).isEmpty()
    ingest_batch(season.where(day == 3).limit(1), 2, store, static, out)  # retried after its commit
    assert max(current_days(spark, out).values()) == 3
    assert remove_superseded(spark, out) > 0
    assert read_output(spark, out).exceptAll(latest).count() == 0


def test_scenes_of_many_files_are_built_once(spark):
    root = shared_folder(spark)
    static_layer(g.cells(spark, SF)).write.parquet(f"{root}/static")
    static = spark.read.parquet(f"{root}/static")
    days = g.pixels(spark, SF).where((F.year("date") == 2019) & (F.dayofmonth("date") <= 3))
    days.select([f.name for f in SCENE_SCHEMA]).repartition(70).write.parquet(f"{root}/in")
    start_ingest(spark, f"{root}/in", f"{root}/store", static, f"{root}/out", f"{root}/check").awaitTermination()
    assert set(current_days(spark, f"{root}/out").values()) == {1}
    assert read_output(spark, f"{root}/out").count() == build_features(days, static).count()
