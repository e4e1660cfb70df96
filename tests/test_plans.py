"""What the physical plans must look like to hold at a large scale."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from firnline.catalog import QUERIES
from firnline.grid import Grid
from firnline.operators import regrid
from firnline.operators.focal import focal
from firnline.operators.masks import apply_masks
from firnline.plans.features import build_features, dynamic_features
from firnline.session import shared_folder
from firnline.sources import driver_grid as g
from firnline.sources.tables import EXTENDED_SCHEMA, read_days, write_by_date

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark):
    path = shared_folder(spark)
    write_by_date(g.pixels(spark, SF).drop("is_water", "opt_raw"), path)
    return path


def test_focal_shuffles_once(spark, stored):
    pixels = spark.read.parquet(stored)
    text = plan(focal(pixels, F.col("mw_value"), {"a": (3, "mean"), "b": (9, "sum")}))
    assert text.count("Exchange") == 1


def test_features_shuffle_pixels_twice_and_the_mask_join_reuses_it(spark, stored):
    pixels = spark.read.parquet(stored)
    calendar = pixels.select("date").distinct()
    mask = pixels.groupBy("x", "y").agg(F.max("mw_value").alias("melt"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(apply_masks(dynamic_features(pixels, calendar), mask))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = text.split("\n")
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    history = next(i for i, line in enumerate(lines) if "Window" in line)
    assert not any("Exchange" in line for line in lines[join:history])
    pixel_side = lines[: next(i for i, line in enumerate(lines) if "FileScan" in line)]
    assert sum("Exchange hashpartitioning" in line for line in pixel_side) == 2
    assert "BroadcastHashJoin [date" in text


def test_date_range_prunes_partitions(spark, stored):
    text = plan(read_days(spark, stored, "2018-06-02", "2018-06-03").select("x", "mw_value"))
    filters = re.search(r"PartitionFilters: \[([^\]]*)\]", text).group(1)
    assert "2018-06-02" in filters and "2018-06-03" in filters
    assert "ReadSchema: struct<x:double,mw_value:tinyint>" in text
    assert "opt_value" in EXTENDED_SCHEMA.fieldNames()


def test_regridding_does_not_shuffle_the_fine_raster(spark):
    coarse, fine = Grid(0.0, 0.0, 4.0, 5, 5), Grid(0.0, 0.0, 1.0, 18, 18)
    rows = [(dt.date(2019, 6, 1), c, r, float(c + r)) for c in range(5) for r in range(5)]
    scenes = spark.createDataFrame(rows, "date date, ccol int, crow int, v double")
    near = regrid.nearest(scenes, "v", coarse, fine)
    assert near.count() == 18 * 18
    assert "Exchange" not in plan(near)


LAZY = [n for n in QUERIES if not n.startswith(("s0", "l0", "l1", "a15", "a17", "a18", "a24", "a25", "o0", "t01"))]


@pytest.mark.parametrize("name", LAZY)
def test_no_cartesian_product(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text


PIXEL_JOINS = ["f14_recode", "j10_drop_by_albedo"]


@pytest.mark.parametrize("name", PIXEL_JOINS)
def test_layers_of_pixel_size_are_not_broadcast(spark, name):
    """The planner estimates an exploded layer by its cells."""
    text = plan(QUERIES[name](spark, SF))
    assert re.search(r"SortMergeJoin \[date#\d+, knownfloatingpoint", text)
    assert not re.search(r"BroadcastHashJoin \[date#\d+, knownfloatingpoint", text)


def test_pixel_shuffles_have_as_many_tasks_as_rows_ask_for(spark, stored, monkeypatch):
    """Not the session's number, and none is added between the windows and the static layer."""
    pixels = spark.read.parquet(stored)
    static = g.cells(spark, SF).select("x", "y", "col", "row", *[
        F.lit(1.0).alias(n) for n in ("elevation_data", "slope_data", "aspect_data", "distance_to_margin")
    ])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        text = plan(build_features(pixels, static, pixels.select("date").distinct(), tasks=23))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning\(.*, 23\), REPARTITION_BY_NUM", text)) == 2
    pixel_side = text[: text.index("FileScan")]
    assert pixel_side.count("Exchange hashpartitioning") == 2


def test_tasks_follow_the_grid():
    small, large = (g.tasks_of(Grid(0.0, 0.0, 1.0, n, n)) for n in (50, 1500))
    assert small == 2 and 1250 <= large <= 1300


@pytest.mark.parametrize("name", ["w04_focal_mean_9", "s04_dense_raster_to_long"])
def test_pixels_are_not_shuffled_by_the_sessions_number(spark, name):
    assert "REPARTITION_BY_NUM" in plan(QUERIES[name](spark, SF))


def test_training_table_derives_the_pixels_once(spark, monkeypatch):
    from firnline.catalog import learning
    from firnline.operators.masks import combined_mask
    from firnline.plans.features import build_features, static_layer
    from firnline.plans.training_table import training_table
    from firnline.sources import driver_grid as g

    sf, calls, pixels = "/root/testdata/sf0.001", [], g.pixels
    for kept in (learning._pixels, learning._materialised):
        monkeypatch.setitem(kept, "none", "")
        kept.clear()
    monkeypatch.setattr(g, "pixels", lambda *a: calls.append(a) or pixels(*a))
    rows = learning.training(spark, sf)
    learning.all_features(spark, sf)
    assert len(calls) == 1  # mask and features derived them twice
    mask = combined_mask(pixels(spark, sf))
    features = build_features(pixels(spark, sf), static_layer(g.cells(spark, sf)))
    want = training_table(features, mask, keep_ids=True).fillna({"aspect_data": 0.5}).select(rows.columns)
    assert rows.count() == want.count() > 0
    assert rows.exceptAll(want).count() == 0
