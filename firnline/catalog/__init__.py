"""Registered queries with, where SQL can express them, an equivalent statement."""

from firnline.catalog.registry import ORACLES, QUERIES  # noqa: F401
from firnline.catalog import (  # noqa: F401
    scans,
    filters,
    joins,
    aggregates,
    windows,
    scalars,
    learning,
    streams,
)
