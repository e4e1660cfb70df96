"""Latitude from north polar stereographic metres (Snyder 1987, ellipsoidal inverse series)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and latitude of true scale.
SEMI_MAJOR = 6378137.0
FLATTENING = 1 / 298.257223563
TRUE_SCALE_LATITUDE = 70.0


def inverse_constants() -> tuple[float, tuple[float, float, float, float]]:
    """Scale of the radius and coefficients of sin(2k chi), k = 1..4."""
    e2 = 2 * FLATTENING - FLATTENING**2
    e = math.sqrt(e2)
    phi = math.radians(TRUE_SCALE_LATITUDE)
    s = e * math.sin(phi)
    t = math.tan(math.pi / 4 - phi / 2) / ((1 - s) / (1 + s)) ** (e / 2)
    m = math.cos(phi) / math.sqrt(1 - s * s)
    series = (
        e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360,
        7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520,
        7 * e2**3 / 120 + 81 * e2**4 / 1120,
        4279 * e2**4 / 161280,
    )
    return t / (SEMI_MAJOR * m), series


def latitude(x: Column, y: Column) -> Column:
    """Degrees north."""
    k, series = inverse_constants()
    chi = math.pi / 2 - 2 * F.atan(F.sqrt(x * x + y * y) * k)
    phi = chi
    for i, c in enumerate(series, start=1):
        phi = phi + c * F.sin(2 * i * chi)
    return F.degrees(phi)
