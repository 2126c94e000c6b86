"""Georeference and cell type of a raster; held by the driver, never a column."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cell type to Spark type: Spark has no unsigned integers, so they are widened.
SPARK_TYPES = {"uint8": "smallint", "int16": "smallint", "uint16": "int", "int32": "int", "uint32": "bigint", "int64": "bigint", "float32": "float", "float64": "double"}
RANGES = {"uint8": (0, 255), "int16": (-(2**15), 2**15 - 1), "uint16": (0, 2**16 - 1), "int32": (-(2**31), 2**31 - 1), "uint32": (0, 2**32 - 1), "int64": (-(2**63), 2**63 - 1)}
UNSIGNED = frozenset(("uint8", "uint16", "uint32"))


class RasterError(ValueError):
    """An argument that an operator can't accept."""


def is_float(dtype: str) -> bool:
    return dtype.startswith("float")


def promote(a: str, b: str) -> str:
    """Type of an arithmetic result: small integers widen to int32, any float wins, float64 over float32."""
    if is_float(a) or is_float(b):
        return "float64" if "float64" in (a, b) else "float32"
    if "int64" in (a, b):
        return "int64"
    return "uint32" if "uint32" in (a, b) else "int32"


def fits(value: float, dtype: str) -> bool:
    return is_float(dtype) or (float(value).is_integer() and RANGES[dtype][0] <= value <= RANGES[dtype][1])


def default_nodata(dtype: str) -> float:
    """The nodata value of a raster that is made without one: the type's largest, NaN for floats."""
    return float("nan") if is_float(dtype) else float(RANGES[dtype][1])


EARTH = 6378137.0


def to_geographic(x, y):
    """Degrees of Web Mercator metres; numbers or columns."""
    m = F if isinstance(x, Column) or isinstance(y, Column) else math
    return x / EARTH * (180 / math.pi), (2 * m.atan(m.exp(y / EARTH)) - math.pi / 2) * (180 / math.pi)


def to_mercator(lon, lat):
    """Web Mercator metres of degrees; numbers or columns."""
    m = F if isinstance(lon, Column) or isinstance(lat, Column) else math
    return lon * (math.pi / 180 * EARTH), m.log(m.tan(math.pi / 4 + lat * (math.pi / 360))) * EARTH


@dataclass(frozen=True)
class RasterMeta:
    rows: int
    cols: int
    xll: float = 0.0
    yll: float = 0.0
    cell_size: float = 100.0
    nodata: float | None = None
    projection: str = ""

    def replace(self, **changes) -> RasterMeta:
        return replace(self, **changes)

    @property
    def size(self) -> int:
        return self.rows * self.cols

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """Left, bottom, right, top."""
        return self.xll, self.yll, self.xll + self.cols * self.cell_size, self.yll + self.rows * self.cell_size

    @property
    def epsg(self) -> int | None:
        """The number in a projection such as EPSG:3857."""
        code = self.projection.upper().removeprefix("EPSG:")
        return int(code) if code.isdigit() else None

    @property
    def bounds_geo(self) -> tuple[float, float, float, float]:
        """Bounds in degrees, of rasters in EPSG:4326 or EPSG:3857."""
        if self.epsg == 4326:
            return self.bounds
        if self.epsg == 3857:
            left, bottom, right, top = self.bounds
            return *to_geographic(left, bottom), *to_geographic(right, top)
        raise RasterError(f"no closed form from {self.projection or 'no projection'} to degrees")

    def xy(self, row, col):
        """Coordinates of a cell's centre; numbers or columns. Row 0 is the top."""
        return self.xll + (col + 0.5) * self.cell_size, self.yll + self.rows * self.cell_size - (row + 0.5) * self.cell_size

    def rc(self, x, y):
        """Cell that holds a coordinate; numbers or columns. It may lie outside, see ``contains``."""
        r, c = (self.yll + self.rows * self.cell_size - y) / self.cell_size, (x - self.xll) / self.cell_size
        if isinstance(x, Column) or isinstance(y, Column):
            return F.floor(r).cast("int"), F.floor(c).cast("int")
        return int(r // 1), int(c // 1)

    def contains(self, row, col):
        inside = (row >= 0) & (row < self.rows) & (col >= 0) & (col < self.cols)
        return inside if isinstance(inside, Column) else bool(inside)

    def same_extent(self, other: RasterMeta) -> bool:
        return (self.rows, self.cols) == (other.rows, other.cols)

    def aligned(self, other: RasterMeta) -> tuple[int, int]:
        """Row and column of other's top left cell here; raises unless both lie on one lattice."""
        if abs(self.cell_size - other.cell_size) > 1e-9 * self.cell_size:
            raise RasterError("rasters need the same cell size")
        dc = (other.xll - self.xll) / self.cell_size
        dr = (self.bounds[3] - other.bounds[3]) / self.cell_size
        if abs(dc - round(dc)) > 1e-6 or abs(dr - round(dr)) > 1e-6:
            raise RasterError("rasters don't lie on one lattice")
        return round(dr), round(dc)

    def scaled(self, k: int) -> RasterMeta:
        """With cells k times as large on a side."""
        if self.rows % k or self.cols % k:
            raise RasterError(f"{self.rows} x {self.cols} cells can't be divided by {k}")
        return self.replace(rows=self.rows // k, cols=self.cols // k, cell_size=self.cell_size * k)
