"""Hours of daylight from latitude and day of year (Forsythe et al. 1995, CBM model)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Model coefficients.
REVOLUTION = (0.2163108, 2.0, 0.9671396, 0.00860, 186.0)
DECLINATION = 0.39795
HORIZON_DEGREES = 0.8333


def hours_of_daylight(lat_degrees: Column, day_of_year: Column, variant: str = "reference") -> Column:
    """``variant='reference'`` takes the sine of the whole numerator, ``'paper'`` of the angle only."""
    a, b, c, e, shift = REVOLUTION
    theta = F.lit(a) + F.lit(b) * F.atan(F.lit(c) * F.tan(F.lit(e) * (day_of_year - shift)))
    decl = F.asin(F.lit(DECLINATION) * F.cos(theta))
    lat = lat_degrees * (math.pi / 180)
    horizon = HORIZON_DEGREES * math.pi / 180
    product = F.sin(lat) * F.sin(decl)
    if variant == "reference":
        top = F.sin(F.lit(horizon) + product)
    elif variant == "paper":
        top = F.lit(math.sin(horizon)) + product
    else:
        raise ValueError(f"unknown daylight variant {variant!r}")
    ratio = top / (F.cos(lat) * F.cos(decl))
    return (
        F.when(ratio >= 1, 24.0)
        .when(ratio <= -1, 0.0)
        .otherwise(24.0 - (24.0 / math.pi) * F.acos(ratio))
    )
