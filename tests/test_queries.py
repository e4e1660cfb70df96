"""Registered queries against their SQL on the smallest tables.

FIRNLINE_SOME_QUERIES=1 runs one in four.
"""

import os
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))
from check_queries import TABLES, rows_of  # noqa: E402

SF = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()
NAMES = list(SQL)[::4] if os.environ.get("FIRNLINE_SOME_QUERIES") else list(SQL)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    df = entry_points.queries()[name](spark, SF)
    rel = con.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(names, rel.fetchall())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.count() > 0
    assert df.columns == ["date", "region", "n", "mean_focal", "mean_week", "mean_log_opt"]


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry_points.queries())
