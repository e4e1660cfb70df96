"""Scene quality: dates to leave out and pixels without them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.functions.dates import until_season_end
from firnline.operators.aggregates import bad_dates, missing_share
from firnline.operators.bounded import dates_of

MISSING_LIMIT = 0.86  # fixed value: share of missing optical pixels above which a day is bad


def dates_to_remove(
    pixels: DataFrame, limit: float = MISSING_LIMIT, manual: Sequence[str] = ()
) -> DataFrame:
    shares = missing_share(pixels)
    return bad_dates(shares, limit, until_season_end(F.col("date")), manual)


def without_bad_dates(pixels: DataFrame, dates: DataFrame) -> DataFrame:
    return pixels.join(dates_of(dates), "date", "left_anti")
