"""Spatial cells. `CellIndex` is what operators need of an index; the built-in one is an equirectangular grid.

The grid's cells are integers that sort by latitude and then longitude, so a file sorted by cell skips row groups for
boxes. An icosahedral index can be put in its place; a corridor only needs cells that contain the gate's band.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F


class CellIndex(Protocol):
    def cell(self, lat: Column, lon: Column) -> Column: ...

    def parent(self, cell: Column) -> Column: ...

    def disk(self, lat: float, lon: float, rings: int) -> set[int]: ...

    def path(self, a: tuple[float, float], b: tuple[float, float]) -> list[tuple[float, float]]: ...


class GridIndex:
    """Square cells of 1/per_degree degrees; a parent has seven-and-a-bit (here 9) children."""

    def __init__(self, per_degree: int = 120):
        self.per_degree, self.columns = per_degree, 360 * per_degree

    def cell(self, lat: Column, lon: Column) -> Column:
        ok = lat.between(-90.0, 90.0) & lon.between(-180.0, 180.0)
        row, col = F.floor((lat + 90.0) * self.per_degree), F.floor((lon + 180.0) * self.per_degree)
        return F.when(ok, row * self.columns + col).cast("long")

    def parent(self, cell: Column) -> Column:
        row, col = F.floor(cell / self.columns), F.pmod(cell, F.lit(self.columns))
        return (F.floor(row / 3) * self.columns + F.floor(col / 3)).cast("long")

    def of(self, lat: float, lon: float) -> int:
        return int((lat + 90.0) * self.per_degree // 1) * self.columns + int((lon + 180.0) * self.per_degree // 1)

    def disk(self, lat: float, lon: float, rings: int) -> set[int]:
        c = self.of(lat, lon)
        return {c + i * self.columns + j for i in range(-rings, rings + 1) for j in range(-rings, rings + 1)}

    def path(self, a: tuple[float, float], b: tuple[float, float]) -> list[tuple[float, float]]:
        steps = max(2, int(2 * self.per_degree * max(abs(a[0] - b[0]), abs(a[1] - b[1]))) + 1)
        return [(a[0] + (b[0] - a[0]) * i / steps, a[1] + (b[1] - a[1]) * i / steps) for i in range(steps + 1)]
