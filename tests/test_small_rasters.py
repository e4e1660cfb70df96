"""Operators on small literal rasters against plain NumPy."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from firnline.functions import labels, normal, scalars
from firnline.functions.daylight import hours_of_daylight
from firnline.functions.projection import latitude
from firnline.grid import Grid
from firnline.operators import aggregates, distance, ranks, regrid
from firnline.operators.focal import focal
from firnline.operators.temporal import earlier_values, grid_ranks
from firnline.operators.terrain import shore_cells, slope_and_aspect
from firnline.sources import rasters
from firnline.sources.tables import missing_to_null, null_to_sentinel

DAY = dt.date(2019, 6, 8)


def long_frame(spark, matrix, value="v"):
    rows = [
        (DAY, r, c, None if math.isnan(v) else float(v))
        for r, line in enumerate(matrix)
        for c, v in enumerate(line)
    ]
    return spark.createDataFrame(rows, f"date date, row int, col int, {value} double")


def dense(df, value, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


def brute_focal(m, size, fn):
    h = size // 2
    out = np.full(m.shape, np.nan)
    for i in range(m.shape[0]):
        for j in range(m.shape[1]):
            w = m[max(i - h, 0) : i + h + 1, max(j - h, 0) : j + h + 1]
            w = w[~np.isnan(w)]
            if len(w):
                out[i, j] = fn(w)
    return out


@pytest.mark.parametrize("band", [2, 5, 256])
def test_focal_matches_brute_force_for_any_band(spark, band):
    rng = np.random.default_rng(3)
    m = rng.integers(0, 9, (13, 11)).astype(float)
    m[rng.random(m.shape) < 0.35] = np.nan
    m[:4, :4] = np.nan
    wanted = {
        "mean_3": (3, "mean", np.mean),
        "mean_5": (5, "mean", np.mean),
        "sum_5": (5, "sum", np.sum),
        "max_3": (3, "max", np.max),
        "min_3": (3, "min", np.min),
    }
    out = focal(
        long_frame(spark, m), F.col("v"), {n: s[:2] for n, s in wanted.items()}, band_lines=band
    ).cache()
    assert out.count() == m.size
    for name, (size, _, fn) in wanted.items():
        np.testing.assert_allclose(dense(out, name, m.shape), brute_focal(m, size, fn))


def test_focal_rejects_even_windows(spark):
    with pytest.raises(ValueError):
        focal(long_frame(spark, [[1.0]]), F.col("v"), {"m": (4, "mean")})


def test_distance_and_shore_match_brute_force(spark):
    rng = np.random.default_rng(5)
    water = rng.random((10, 8)) < 0.15
    water[0] = True
    rows = [(r, c, bool(water[r, c])) for r in range(10) for c in range(8)]
    cells = spark.createDataFrame(rows, "row int, col int, is_water boolean")
    found = {(r["row"], r["col"]): r for r in distance.metric_distance(cells, "is_water", 1.0).collect()}
    assert len(found) == 80
    sources = np.argwhere(water)
    for (r, c), got in found.items():
        sq = ((sources - (r, c)) ** 2).sum(axis=1)
        best = min((s, int(a), int(b)) for s, (a, b) in zip(sq, sources))
        assert (got["near_row"], got["near_col"]) == best[1:]
        assert got["metres"] == pytest.approx(math.sqrt(best[0]))
    shore = {(r["row"], r["col"]) for r in shore_cells(cells).collect()}
    expected = {
        (r, c)
        for r, c in sources
        if any(
            0 <= a < 10 and 0 <= b < 8 and not water[a, b]
            for a, b in ((r - 1, c), (r + 1, c), (r, c - 1), (r, c + 1))
        )
    }
    assert shore == expected


def test_distance_without_any_member_is_null(spark):
    cells = spark.createDataFrame([(0, 0, False), (0, 1, False)], "row int, col int, is_water boolean")
    assert {r["distance_to_margin"] for r in distance.distance_to_margin(cells).collect()} == {None}


def test_slope_and_aspect_of_a_plane(spark):
    rows = [(r, c, 5000.0 - 1000.0 * r) for r in range(4) for c in range(3)]
    out = slope_and_aspect(spark.createDataFrame(rows, "row int, col int, elevation_data double")).collect()
    for r in out:  # descends southwards by 45 degrees
        assert r["slope_data"] == pytest.approx(45.0)
        assert r["aspect_data"] == pytest.approx(-1.0)


def test_history_falls_back_where_scenes_are_missing(spark):
    days = [d for d in range(1, 25) if d not in (10, 12)]
    value = {d: (d * 7) % 3 for d in days}
    rows = [(dt.date(2019, 6, d), 0.0, 0.0, value[d]) for d in days]
    out = earlier_values(spark.createDataFrame(rows, "date date, x double, y double, mw_value int"))
    for r in out.collect():
        d = r["date"].day
        assert r["mw_value_yesterday"] == (value[d - 1] if d - 1 in value else value[d])
        week = [d - k for k in range(1, 8)]
        full = all(k in value for k in week)
        expected = sum(value[k] for k in week) / 7 if full else value[d]
        assert r["mw_value_7_day_average"] == pytest.approx(expected)


def test_grid_ranks_with_and_without_contract(spark):
    grid = Grid(100.0, 50.0, 10.0, 3, 2)
    rows = [(100.0 + 10 * c, 50.0 - 10 * r) for r in range(2) for c in range(3)]
    cells = spark.createDataFrame(rows, "x double, y double")
    a = {tuple(r) for r in grid_ranks(cells).select("x", "y", "col", "row").collect()}
    b = {tuple(r) for r in grid_ranks(cells, grid).select("x", "y", "col", "row").collect()}
    assert a == b


# Literal raster: x = 0, 1, 2 and y = 10, 12, 14, 16 with two missing values.
SMALL = [[1, 4, 2, 9], [2, 7, 6, math.nan], [6, math.nan, 5, 8]]


def test_regrid_to_the_same_grid_is_identity(spark):
    matrix = np.array(SMALL)
    grid = Grid(0.0, 0.0, 4.0, 4, 3)
    scenes = long_frame(spark, matrix).withColumnsRenamed({"row": "crow", "col": "ccol"})
    for fn in (regrid.nearest, regrid.bilinear):
        np.testing.assert_array_equal(dense(fn(scenes, "v", grid, grid), "v", matrix.shape), matrix)


def test_nearest_ties_and_hull(spark):
    coarse, fine = Grid(0.0, 0.0, 4.0, 2, 1), Grid(-2.0, 0.0, 2.0, 6, 1)  # x: -2 0 2 4 6 8
    scenes = spark.createDataFrame([(DAY, 0, 0, 1.0), (DAY, 1, 0, 2.0)], "date date, ccol int, crow int, v double")
    out = dense(regrid.nearest(scenes, "v", coarse, fine), "v", (1, 6))[0]
    np.testing.assert_array_equal(out, [np.nan, 1, 1, 2, np.nan, np.nan])


def test_dense_lines_round_trip(spark):
    matrix = np.array(SMALL)
    grid = Grid(0.0, 16.0, 2.0, 4, 3)
    present = long_frame(spark, matrix).where("v IS NOT NULL")
    lines = rasters.long_to_lines(present, "v", grid)
    assert lines.count() == 3
    back = rasters.lines_to_long(lines, "v", grid)
    np.testing.assert_array_equal(dense(back, "v", matrix.shape), matrix)
    whole = spark.createDataFrame([(DAY, [list(map(float, r)) for r in SMALL])], "date date, band array<array<double>>")
    long = rasters.lines_to_long(rasters.scene_to_lines(whole, "band"), "v", grid)
    np.testing.assert_array_equal(dense(long, "v", matrix.shape), matrix)


def test_class_edges_are_right_closed(spark):
    values = [0.0, 0.1, 0.2, 0.4, 0.64, 0.65, 2.0, 100.0, 100.1]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[0] for r in df.select(labels.right_closed_bin(F.col("v"), labels.CLASS_EDGES)).collect()]
    assert got == [None, 0, 0, 1, 2, 3, 9, 10, None]
    zero = df.select(labels.right_closed_bin(F.col("v"), labels.ZERO_INCLUSIVE_EDGES)).first()[0]
    assert zero == 0


def test_cap_keeps_missing_values(spark):
    df = spark.createDataFrame([(None,), (4.0,), (9.0,)], "v double")
    assert [r[0] for r in df.select(scalars.cap(F.col("v"))).collect()] == [None, 4.0, 5.0]


def test_missing_value_mapping(spark):
    df = spark.createDataFrame([(-1.0,), (float("nan"),), (2.0,), (None,)], "v double")
    null = df.select(missing_to_null(F.col("v")).alias("v"))
    assert [r[0] for r in null.collect()] == [None, None, 2.0, None]
    assert [r[0] for r in null.select(null_to_sentinel(F.col("v"))).collect()] == [-1.0, -1.0, 2.0, -1.0]


@pytest.mark.parametrize(
    "lat,day,coded,paper", [(60, 172, 18.668, 18.870), (70, 172, 24, 24), (80, 290, 4.844, 4.810)]
)
def test_daylight_variants(spark, lat, day, coded, paper):
    one = spark.range(1)
    args = (F.lit(float(lat)), F.lit(day))
    got = one.select(hours_of_daylight(*args), hours_of_daylight(*args, "paper")).first()
    assert got[0] == pytest.approx(coded, abs=5e-4)
    assert got[1] == pytest.approx(paper, abs=5e-4)


def test_latitude_of_grid_corners(spark):
    df = spark.createDataFrame([(-636500.0, -3324500.0), (824500.0, -662500.0)], "x double, y double")
    got = [r[0] for r in df.select(latitude(F.col("x"), F.col("y"))).collect()]
    assert got == pytest.approx([59.467657, 80.258757], abs=1e-6)


def test_normal_law_against_the_standard_library(spark):
    law = NormalDist()
    z = [-6.0, -3.1, -0.4, 0.0, 0.9, 2.7, 5.0]
    q = [1e-9, 0.01, 0.02425, 0.3, 0.5, 0.9, 0.99, 1 - 1e-7]
    cdf = spark.createDataFrame([(v,) for v in z], "v double").select(normal.cdf(F.col("v"))).collect()
    inv = spark.createDataFrame([(v,) for v in q], "v double").select(normal.inverse(F.col("v"))).collect()
    assert [r[0] for r in cdf] == pytest.approx([law.cdf(v) for v in z], rel=1e-12)
    assert [r[0] for r in inv] == pytest.approx([law.inv_cdf(v) for v in q], rel=2e-9, abs=1e-9)


def test_anderson_darling_far_beyond_seven_deviations(spark):
    """Against the statistic with exact tails: erfc is accurate to 26 deviations."""
    values = [math.sin(k * 12.9898) for k in range(4000)] + [-14.0, 15.0, 21.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    mean = sum(values) / len(values)
    std = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1))
    z = sorted((v - mean) / std for v in values)
    assert max(z) > 20

    def log_cdf(x):
        tail = math.log(0.5 * math.erfc(abs(x) / math.sqrt(2)))
        return math.log1p(-math.exp(tail)) if x > 0 else tail

    n = len(z)
    total = sum((2 * i + 1) * (log_cdf(z[i]) + log_cdf(-z[n - 1 - i])) for i in range(n))
    row = ranks.anderson_darling(df, "v").first()
    assert row["n"] == n and row["statistic"] == pytest.approx(-n - total / n, rel=1e-10)


def test_ranks_with_a_hot_value(spark):
    values = [1.0] * 200_000 + [float(v) for v in range(2, 300)] + [0.5]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranked = {r["v"]: (r["n"], r["lo"], r["hi"]) for r in ranks.value_ranks(df, "v").collect()}
    assert ranked[0.5] == (1, 1, 1)
    assert ranked[1.0] == (200_000, 2, 200_001)
    assert ranked[299.0] == (1, len(values), len(values))
    sample = ranks.ordered_sample(ranks.value_ranks(df, "v"))
    n, first, last, distinct = sample.agg(
        F.count("*"), F.min("i"), F.max("i"), F.count_distinct("i")
    ).first()
    assert (n, first, last, distinct) == (len(values), 1, len(values), len(values))


def test_exact_quantiles_per_category(spark):
    rng = np.random.default_rng(1)
    v, c = rng.normal(size=500), rng.integers(0, 3, 500)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(c, v)], "c int, v double")
    fractions = (0.01, 0.25, 0.5, 0.99)
    for r in ranks.exact_quantiles(df, "v", fractions, "c").collect():
        assert r["q"] == pytest.approx(np.quantile(v[c == r["c"]], fractions))


def test_ranks_do_not_depend_on_the_number_of_ranges(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(float(v),) for v in rng.integers(0, 400, 3000)], "v double")
    merged = ranks.merged_values(df, "v")
    few = ranks.rank_merged(merged)
    many = ranks.rank_merged(merged.repartition(7), range_rows=10)
    assert few.exceptAll(many).count() == 0 and few.count() == many.count() == merged.count()


def test_many_categories_and_a_hot_one(spark):
    """Box plots of 30,000 categories, one of which holds half of all rows over many ranges."""
    rng = np.random.default_rng(9)
    n = 60_000
    c = np.where(rng.random(n) < 0.5, 0, rng.integers(1, 30_000, n))
    v = np.round(rng.normal(size=n), 3)
    pdf = pd.DataFrame({"c": c, "v": v})
    df = spark.createDataFrame(pdf).repartition(6)
    cut, offsets = ranks.in_ranges(ranks.merged_values(df, "v", "c"), "c", range_rows=1000)
    assert offsets.where("c = 0").count() > 3
    got = aggregates.box_plot(df, "v", "c").toPandas().set_index("c").sort_index()
    by = pdf.groupby("c")["v"]
    q1, median, q3 = (by.quantile(p) for p in (0.25, 0.5, 0.75))
    for name, want in (("q1", q1), ("median", median), ("q3", q3), ("n_values", by.size())):
        np.testing.assert_allclose(got[name], want, atol=1e-12)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    inside = pdf[(pdf.v >= pdf.c.map(low)) & (pdf.v <= pdf.c.map(high))].groupby("c")["v"]
    np.testing.assert_allclose(got["whisker_low"], inside.min())
    np.testing.assert_allclose(got["whisker_high"], inside.max())


def test_few_values_are_expanded_in_many_tasks(spark):
    df = spark.range(600_000).select((F.col("id") % 3).cast("double").alias("v"))
    sample = ranks.ordered_sample(ranks.value_ranks(df, "v"))
    assert sample.rdd.getNumPartitions() == 1 + 600_000 // 250_000
    assert sample.agg(F.sum("i")).first()[0] == 600_000 * 600_001 // 2


def test_inverse_by_columns_is_the_inverse(spark):
    p = spark.range(1, 2000).select((F.col("id") / 2000).alias("p"))
    p = p.unionByName(spark.createDataFrame([(1e-9,), (normal.INV_TAIL,), (1 - 1e-9,)], "p double"))
    for r in normal.with_inverse(p, "p", "x").select("p", "x", normal.inverse(F.col("p")).alias("want")).collect():
        assert r["x"] == pytest.approx(r["want"], abs=1e-14)
