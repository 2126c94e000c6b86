"""Cell-wise mathematics: built-in column functions, nodata stays nodata, and what isn't a number becomes nodata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import UNSIGNED, RasterError, is_float
from ..raster import Raster, align


def _real(r: Raster, value: Column) -> Raster:
    """float64 of float64, float32 of everything else; NaN becomes nodata."""
    return r.with_value(F.when(~F.isnan(value), value), "float64" if r.dtype == "float64" else "float32")


def absolute(r: Raster) -> Raster:
    if r.dtype in UNSIGNED:
        raise RasterError("abs of an unsigned raster")
    return r.with_value(F.abs(r.value))


def rounded(r: Raster) -> Raster:
    """Half away from zero."""
    if not is_float(r.dtype):
        raise RasterError("round of an integer raster")
    return r.with_value(F.round(r.value.cast("double"), 0))


def sin(r: Raster) -> Raster:
    return _real(r, F.sin(r.value.cast("double")))


def cos(r: Raster) -> Raster:
    return _real(r, F.cos(r.value.cast("double")))


def _logarithm(r: Raster, f) -> Raster:
    """SQL's logarithm of 0 is NULL; here it is minus infinity, and that of a negative number is nodata."""
    v = r.value.cast("double")
    return _real(r, F.when(v == 0, F.lit(float("-inf"))).otherwise(f(v)))


def log(r: Raster) -> Raster:
    return _logarithm(r, F.ln)


def log10(r: Raster) -> Raster:
    return _logarithm(r, F.log10)


def exp(r: Raster) -> Raster:
    return _real(r, F.exp(r.value.cast("double")))


def power(r: Raster, exponent) -> Raster:
    if not isinstance(exponent, Raster):
        return _real(r, F.pow(r.value.cast("double"), F.lit(float(exponent))))
    if r.dtype != exponent.dtype:
        raise RasterError("rasters of one type are needed")
    a, b = align(r, exponent)
    return _real(a, F.pow(a.value.cast("double"), b.value.cast("double")))
