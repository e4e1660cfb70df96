"""Queries of grid functions return every cell or pixel of the derived tables, water included."""

import pytest
from pyspark.sql import functions as F

from firnline.catalog import QUERIES
from firnline.functions.scalars import FEATURE_BOUNDS
from firnline.sources import driver_grid as g

SF = "/root/testdata/sf0.001"


def north_pixels(spark):
    grid = g.grid_of(spark, SF)
    y = F.lit(FEATURE_BOUNDS["y"][1]) - 2662000.0 * F.col("row") / (grid.nrows - 1)
    return g.pixels(spark, SF).where(y > -2000000).count()


def pixels(spark):
    return g.pixels(spark, SF).count()


def cells(spark):
    return g.cells(spark, SF).count()


COUNTED = {
    "p04_upper_half": north_pixels,
    "p12_feature_guard": pixels,
}
WHOLE = {
    "o01_sort_by_area_and_y": cells,
    "j18_overlap_window": lambda spark: g.cells(spark, SF).where("col BETWEEN 3 AND 18 AND row BETWEEN 2 AND 15").count(),
    "w01_grid_ranks": lambda spark: g.cells(spark, SF).where("(col + row) % 3 <> 0").count(),
    "w01_grid_ranks_by_contract": cells,
    "f05_hours_of_daylight": pixels,
    "f06_latitude": cells,
    "f10_spatial_areas": cells,
    "f11_composite_area": cells,
    "f15_half_cell_shift": cells,
    "l01_assign_to_centres": cells,
}


@pytest.mark.parametrize("name", COUNTED)
def test_counts_include_every_pixel(spark, name):
    want = COUNTED[name](spark)
    assert [r["n"] for r in QUERIES[name](spark, SF).collect()] in ([want], [want, want])


@pytest.mark.parametrize("name", WHOLE)
def test_every_row_is_returned(spark, name):
    assert QUERIES[name](spark, SF).count() == WHOLE[name](spark)
