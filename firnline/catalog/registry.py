"""Registration of queries and helpers shared by them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(value: Column | str) -> Column:
    """Six decimals, without a negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value.cast("double"), 6) + F.lit(0.0)


def plain(df: DataFrame, *exact: str) -> DataFrame:
    """Comparable output: ISO dates, int for small integers, doubles rounded (unless exact)."""
    out = []
    for name, dtype in df.dtypes:
        c = F.col(name)
        if dtype == "date":
            c = F.date_format(c, "yyyy-MM-dd")
        elif dtype in ("tinyint", "smallint"):
            c = c.cast("int")
        elif dtype in ("double", "float") and name not in exact:
            c = r6(c)
        out.append(c.alias(name))
    return df.select(*out)
