"""Cell-wise predicates, conditionals, clamps, replacements and user functions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..meta import SPARK_TYPES, RasterError, is_float, promote
from ..raster import Raster, _flag, align


def logical_and(*rasters: Raster) -> Raster:
    """1 where all of two to eight rasters are non-zero; nodata where any is nodata."""
    return _fold(rasters, lambda a, b: a & b)


def logical_or(*rasters: Raster) -> Raster:
    return _fold(rasters, lambda a, b: a | b)


def _fold(rasters: Sequence[Raster], op) -> Raster:
    if not 2 <= len(rasters) <= 8:
        raise RasterError("two to eight rasters are needed")
    rs = align(*rasters)
    return rs[0].with_value(_flag(reduce(op, [r.value != 0 for r in rs]), *[r.value for r in rs]), "uint8", rs[0].meta.replace(nodata=255))


def logical_not(r: Raster) -> Raster:
    return ~r


def maximum(*rasters: Raster) -> Raster:
    """Cell-wise; nodata where any is nodata (SQL's greatest would skip it)."""
    return _extreme(rasters, F.greatest)


def minimum(*rasters: Raster) -> Raster:
    return _extreme(rasters, F.least)


def _extreme(rasters: Sequence[Raster], f) -> Raster:
    if len(rasters) < 2 or len({r.dtype for r in rasters}) > 1:
        raise RasterError("at least two rasters of one type are needed")
    rs = align(*rasters)
    known = reduce(lambda a, b: a & b, [r.value.isNotNull() for r in rs])
    return rs[0].with_value(F.when(known, f(*[r.value for r in rs])))


def is_nodata(r: Raster) -> Raster:
    return r.with_value(r.value.isNull().cast("smallint"), "uint8", r.meta.replace(nodata=None))


def is_data(r: Raster) -> Raster:
    return r.with_value(r.value.isNotNull().cast("smallint"), "uint8", r.meta.replace(nodata=None))


def replace_nodata(r: Raster, value: float) -> Raster:
    return r.with_value(F.coalesce(r.value, F.lit(value)))


def turn_value_into_nodata(r: Raster, value: float) -> Raster:
    return r.with_value(F.nullif(r.value, F.lit(value).cast(SPARK_TYPES[r.dtype])))


def replace_value(r: Raster, old: float, new: float) -> Raster:
    return r.with_value(F.when(r.value == F.lit(old), F.lit(new)).otherwise(r.value))


def equal_one_of(r: Raster, values: Sequence[float]) -> Raster:
    return r.with_value(_flag(r.value.isin(*values), r.value))


def _close(a: Column, b: Column, tolerance: float) -> Column:
    x, y = a.cast("double"), b.cast("double")
    infinite = (F.abs(x) == float("inf")) & (F.abs(y) == float("inf"))
    return infinite | (F.abs(x - y) <= 1e-8 + tolerance * F.abs(y))


def is_close(a: Raster, b: Raster, tolerance: float = 1e-6) -> Raster:
    """1 where both are nodata or within tolerance, else 0."""
    a, b = align(a, b)
    test = F.when(a.value.isNull() & b.value.isNull(), 1).when(a.value.isNull() | b.value.isNull(), 0).otherwise(_close(a.value, b.value, tolerance).cast("int"))
    return a.with_value(test, "uint8", a.meta.replace(nodata=None))


def all_close(a: Raster, b: Raster, tolerance: float = 1e-6) -> bool:
    if a.dtype != b.dtype:
        return False
    r = is_close(a, b, tolerance)
    return r.frame.where(r.value == 0).isEmpty()


def raster_equal(a: Raster, b: Raster) -> bool:
    """Same type, same nodata, same data; extents that differ raise."""
    x, y = align(a, b)
    return a.dtype == b.dtype and x.frame.where(~x.value.eqNullSafe(y.value)).isEmpty()


def tolerant_equal_to(a: Raster, b: Raster, tolerance: float = 1e-6) -> bool:
    return a.meta == b.meta and all_close(a, b, tolerance)


def if_then(condition: Raster, then: Raster) -> Raster:
    """then where the condition isn't 0, else nodata."""
    c, t = align(condition, then)
    return t.with_value(F.when(c.value != 0, t.value))


def if_then_else(condition: Raster, then, otherwise) -> Raster:
    """Branches may be rasters, numbers or None (nodata); nodata where the condition is nodata."""
    rasters = [x for x in (then, otherwise) if isinstance(x, Raster)]
    c, *aligned = align(condition, *rasters)
    found = iter(aligned)
    sides = [next(found) if isinstance(x, Raster) else x for x in (then, otherwise)]
    kinds = [x.dtype if isinstance(x, Raster) else ("float32" if isinstance(x, float) else None) for x in sides]
    named = [k for k in kinds if k]
    dtype = named[0] if named and len(set(named)) == 1 else (promote(*named) if named else "int32")
    t, e = [(x.value if isinstance(x, Raster) else F.lit(x)).cast(SPARK_TYPES[dtype]) for x in sides]
    return c.with_value(F.when(c.value != 0, t).when(c.value == 0, e), dtype)


def clip(r: Raster, low: float, high: float) -> Raster:
    return clip_high(clip_low(r, low), high)


def clip_low(r: Raster, low: float) -> Raster:
    return r.with_value(F.when(r.value < F.lit(low), F.lit(low)).otherwise(r.value))


def clip_high(r: Raster, high: float) -> Raster:
    return r.with_value(F.when(r.value > F.lit(high), F.lit(high)).otherwise(r.value))


def fill(r: Raster, value: float) -> Raster:
    """Every cell."""
    return r.with_value(F.lit(value))


def fill_values(r: Raster, value: float) -> Raster:
    """Cells with data only."""
    return r.with_value(F.when(r.value.isNotNull(), F.lit(value)))


def make_nodata(r: Raster) -> Raster:
    return r.with_value(F.lit(None))


def fill_random(r: Raster, low: float, high: float, seed: int | None = None) -> Raster:
    """Uniform in [low, high); whole numbers in [low, high] for integer rasters."""
    u = F.rand(seed)
    return r.with_value(low + u * (high - low) if is_float(r.dtype) else F.floor(low + u * (high - low + 1)))


def add_or_assign(a: Raster, b: Raster) -> Raster:
    """a + b where b has data, with nodata in a as 0; a where b is nodata."""
    a, b = align(a, b)
    return a.with_value(F.when(b.value.isNull(), a.value).otherwise(F.coalesce(a.value, F.lit(0)) + b.value))


def transform(f: Callable[..., Column], *rasters: Raster, dtype: str | None = None) -> Raster:
    """A user's expression over data cells of one or more rasters: f gets columns and gives one; nodata where any is nodata."""
    rs = align(*rasters)
    known = reduce(lambda a, b: a & b, [r.value.isNotNull() for r in rs])
    return rs[0].with_value(F.when(known, f(*[r.value for r in rs])), dtype or rs[0].dtype)


def transform_arrays(f: Callable, *rasters: Raster, dtype: str | None = None) -> Raster:
    """Same for what expressions can't say: f gets numpy arrays of a batch and gives one. Values go through Arrow, not row by row."""
    rs = align(*rasters)
    dtype = dtype or rs[0].dtype

    @F.arrow_udf(SPARK_TYPES[dtype])
    def call(cells: pa.Array) -> pa.Array:
        columns = cells.flatten()
        known = np.logical_and.reduce([np.asarray(c.is_valid()) for c in columns])
        values = f(*[np.asarray(c.fill_null(0)) for c in columns])
        return pa.array(values, mask=~known).cast({"smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}[SPARK_TYPES[dtype]], safe=False)

    return rs[0].with_value(call(F.struct(*[r.value.alias(f"v{i}") for i, r in enumerate(rs)])), dtype)
