"""Raster ("map algebra") analytics on Spark: a raster is a DataFrame of cells (row, col, value), nodata is NULL."""

from .meta import RasterMeta
from .raster import Raster, align

__all__ = ["Raster", "RasterMeta", "align"]
