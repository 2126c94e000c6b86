"""Rescaling, weighted combination and masks."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import RasterError
from ..raster import Raster, align


def _range(r: Raster) -> tuple[float | None, float | None]:
    """Least and largest value: one row reaches the driver and goes into the plan as literals."""
    x = r.cells().agg(F.min("value").cast("double").alias("a"), F.max("value").cast("double").alias("b")).first()
    return x["a"], x["b"]


def normalise(r: Raster) -> Raster:
    """[least, largest] to [0, 1]; all nodata if there is no data or but one value."""
    lo, hi = _range(r)
    value = F.lit(None) if lo is None or hi == lo else (r.value.cast("double") - lo) / (hi - lo)
    return r.with_value(value, "float32", r.meta.replace(nodata=float("nan")))


def remap_to_byte(value: Column, lo: float, hi: float, first: int = 0, last: int = 254) -> Column:
    """[lo, hi] to first..last, rounded half away from zero; 0 outside."""
    v = value.cast("double")
    scaled = F.round(first + (v - lo) * ((last - first) / (hi - lo) if hi != lo else 0.0), 0)
    return F.when(v.isNotNull(), F.when(v.between(lo, hi), scaled).otherwise(0)).cast("smallint")


def remap_to_float(value: Column, lo: float, hi: float, first: float = 0.0, last: float = 1.0) -> Column:
    """[lo, hi] to first..last; first outside, and everywhere if lo equals hi."""
    v = value.cast("double")
    return F.when(v.isNotNull(), F.when(v.between(lo, hi), first + (v - lo) * ((last - first) / (hi - lo) if hi != lo else 0.0)).otherwise(first))


def normalise_to_byte(r: Raster) -> Raster:
    lo, hi = _range(r)
    return r.with_value(F.lit(None) if lo is None else remap_to_byte(r.value, lo, hi), "uint8", r.meta.replace(nodata=255))


def normalise_max(r: Raster, first: float, last: float) -> Raster:
    """[0, largest] to [first, last]."""
    _, hi = _range(r)
    return r.with_value(F.lit(None) if not hi else first + r.value.cast("double") * ((last - first) / hi), "float32")


def weighted_sum(rasters: Sequence[tuple[Raster, float]]) -> Raster:
    """Sum of data times weight, divided by the sum of weights if that is positive; 0 becomes nodata."""
    if not rasters:
        raise RasterError("no rasters")
    rs = align(*[r for r, _ in rasters])
    total = reduce(lambda a, b: a + b, [F.coalesce(r.value.cast("double"), F.lit(0.0)) * float(w) for r, (_, w) in zip(rs, rasters)])
    weight = sum(w for _, w in rasters)
    return rs[0].with_value(F.nullif(total, F.lit(0.0)) / (weight if weight > 0 else 1.0), "float32")


def weighted_product(rasters: Sequence[tuple[Raster, float]]) -> Raster:
    """Product of values to the power of their weights, divided by its largest value if that is positive; nodata where any is nodata."""
    rs = align(*[r for r, _ in rasters])
    p = reduce(lambda a, b: a * b, [F.pow(r.value.cast("double"), F.lit(float(w))) for r, (_, w) in zip(rs, rasters)])
    whole = rs[0].with_value(F.when(~F.isnan(p), p), "float64")
    _, most = _range(whole)
    return whole.with_value(whole.value / (most if most and most > 0 else 1.0), "float32")


def _masked(r: Raster, mask: Raster, value: Callable[[Column, Column], Column]) -> Raster:
    a, m = align(r, mask)
    return a.with_value(value(a.value, m.value))


def apply_mask(r: Raster, mask: Raster) -> Raster:
    """Nodata where the mask is nodata."""
    return _masked(r, mask, lambda v, m: F.when(m.isNotNull(), v))


def erase_outside_mask(r: Raster, mask: Raster) -> Raster:
    """Nodata where the mask is 0 or nodata; 0 if the raster has no nodata value."""
    outside = F.lit(0) if r.meta.nodata is None else F.lit(None)
    return _masked(r, mask, lambda v, m: F.when(m != 0, v).otherwise(outside))


def mask_where(r: Raster, mask: Raster, keep: Callable[[Column], Column]) -> Raster:
    """Values where keep(mask value) holds; a nodata mask cell has no value to test and is left out."""
    return _masked(r, mask, lambda v, m: F.when(keep(m), v))


def inside_mask(r: Raster, mask: Raster) -> Raster:
    return apply_mask(r, mask)


def outside_mask(r: Raster, mask: Raster) -> Raster:
    return _masked(r, mask, lambda v, m: F.when(m.isNull(), v))


def include_mask(mask: Raster, r: Raster) -> Raster:
    """1 where the mask is positive."""
    return _masked(r, mask, lambda v, m: F.when(m > 0, F.lit(1)).otherwise(v))


def exclude_mask(mask: Raster, r: Raster) -> Raster:
    """Nodata where the mask is positive."""
    return _masked(r, mask, lambda v, m: F.when(F.coalesce(m > 0, F.lit(False)), None).otherwise(v))
