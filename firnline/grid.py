"""Regular raster grids: index <-> coordinate arithmetic as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Cell centres ``x0 + col * step`` (eastwards) and ``y0 - row * step`` (southwards)."""

    x0: float
    y0: float
    step: float
    ncols: int
    nrows: int

    @property
    def n_cells(self) -> int:
        return self.ncols * self.nrows

    @property
    def x_last(self) -> float:
        return self.x0 + (self.ncols - 1) * self.step

    @property
    def y_last(self) -> float:
        return self.y0 - (self.nrows - 1) * self.step

    def x(self, col: Column) -> Column:
        return F.lit(self.x0) + col * F.lit(float(self.step))

    def y(self, row: Column) -> Column:
        return F.lit(self.y0) - row * F.lit(float(self.step))

    def col(self, x: Column) -> Column:
        return F.round((x - F.lit(self.x0)) / F.lit(float(self.step))).cast("int")

    def row(self, y: Column) -> Column:
        return F.round((F.lit(self.y0) - y) / F.lit(float(self.step))).cast("int")


# The 1 km polar stereographic analysis grid.
ANALYSIS_GRID = Grid(x0=-636500.0, y0=-662500.0, step=1000.0, ncols=1462, nrows=2663)
