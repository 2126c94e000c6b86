"""Neighbourhood operators.

Square sums and means are separable: two window passes, along rows and then along columns. What windows can't express runs
as numpy kernels over tiles with a halo (plans.tiles): one shuffle and bounded memory. Radii turn from metres to cells as
each operator defines it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..meta import RANGES, RasterError, RasterMeta, is_float
from ..plans.tiles import Tile, by_tiles, circle, shifted
from ..raster import Raster, grid


def along_row():
    return Window.partitionBy("row").orderBy("col")


def along_col():
    return Window.partitionBy("col").orderBy("row")


def _wide(dtype: str) -> str:
    return "int32" if dtype == "uint8" else dtype


def _square(cells: DataFrame, reach: int, **aggregates: Column) -> DataFrame:
    """(row, col, value) with sums of the named columns over (2 * reach + 1)^2 cells."""
    across = cells.select("row", "col", "value", *[F.sum(c).over(along_row().rangeBetween(-reach, reach)).alias(k) for k, c in aggregates.items()])
    return across.select("row", "col", "value", *[F.sum(k).over(along_col().rangeBetween(-reach, reach)).alias(k) for k in aggregates])


def sum_in_buffer(r: Raster, radius: float, style: str = "circular") -> Raster:
    """Nodata counts as 0 and the result has none. style: circular or square (of the circle's area)."""
    n, dtype = int(radius / r.meta.cell_size), _wide(r.dtype)
    meta = r.meta.replace(nodata=None)
    wide = F.coalesce(F.col("value"), F.lit(0)).cast("double" if is_float(dtype) else "bigint")
    if style == "square":
        return Raster.of(_square(r.cells(), int(n * math.sqrt(math.pi) / 2), s=wide).select("row", "col", F.col("s").alias("value")), meta, dtype)
    if style != "circular":
        raise RasterError(f"unknown style {style}")

    def kernel(t: Tile) -> pa.RecordBatch:
        v = t.layer["value"]
        upto = np.concatenate([np.zeros((len(v), 1), v.dtype), np.cumsum(v, axis=1)], axis=1)  # sums along rows: a chord is one difference
        rows, cols = t.inner
        out = np.zeros(t.shape, v.dtype)
        for dr in range(-n, n + 1):
            w = math.isqrt(n * n - dr * dr)
            a, b = slice(rows.start + dr, rows.stop + dr), slice(cols.start - w, cols.stop - w)
            out[t.inner] += upto[a, cols.start + w + 1 : cols.stop + w + 1] - upto[a, b]
        return t.cells(value=(out, None))

    cells = r.frame.select("row", "col", F.coalesce(r.value, F.lit(0)).alias("value"))
    sums = by_tiles(cells, r.meta, n, kernel, "row int, col int, value " + ("double" if is_float(dtype) else "bigint"))
    return Raster.of(sums, meta, dtype)


def integral_image(r: Raster) -> DataFrame:
    """(row, col, value): sum over all cells above and to the left, the cell included; nodata counts as 0."""
    v = F.coalesce(F.col("value"), F.lit(0)).cast("double" if is_float(r.dtype) else "bigint")
    upto = (Window.unboundedPreceding, 0)
    across = r.cells().select("row", "col", F.sum(v).over(along_row().rowsBetween(*upto)).alias("value"))
    return across.select("row", "col", F.sum("value").over(along_col().rowsBetween(*upto)).alias("value"))


def max_in_buffer(r: Raster, radius: float) -> Raster:
    """Largest within d^2 <= ceil(r^2); the type's lowest value where there is no data, so the result has no nodata."""
    cells = radius / r.meta.cell_size
    n, most = math.ceil(cells), math.ceil(cells * cells)
    lowest = -np.finfo("f4" if r.dtype == "float32" else "f8").max if is_float(r.dtype) else RANGES[r.dtype][0]
    offsets = [(dr, dc) for dr in range(-n, n + 1) for dc in range(-n, n + 1) if dr * dr + dc * dc <= most]

    def kernel(t: Tile) -> pa.RecordBatch:
        v = np.where(t.has["value"], t.layer["value"], lowest)
        out = v.copy()
        for dr, dc in offsets:
            np.maximum(out, shifted(v, dr, dc, lowest), out=out)
        return t.cells(value=(out, None))

    return Raster.of(by_tiles(r.cells(), r.meta, n, kernel, "row int, col int, value " + ("double" if is_float(r.dtype) else "bigint")), r.meta.replace(nodata=None), r.dtype)


def _mean(r: Raster, n: int) -> DataFrame:
    v = F.col("value").cast("double")
    return _square(r.cells(), n, s=F.coalesce(v, F.lit(0.0)), n=F.col("value").isNotNull().cast("int"))


def average_filter_square(r: Raster, cells: int) -> Raster:
    """Mean of the data in (2 * cells + 1)^2; nodata cells are filled where a neighbour has data."""
    return Raster.of(_mean(r, cells).select("row", "col", F.try_divide("s", "n").alias("value")), r.meta, "float64" if r.dtype == "float64" else "float32")


def blur_filter(r: Raster) -> Raster:
    """3 x 3 mean of the data; nodata stays."""
    return Raster.of(_mean(r, 1).select("row", "col", F.when(F.col("value").isNotNull(), F.col("s") / F.col("n")).alias("value")), r.meta, r.dtype if is_float(r.dtype) else "float32")


def filter_weight(mode: str, d2: int, cells: int) -> float:
    """Weight at squared distance d2: constant, linear, exponential (1 / d) or exponential2 (1 / d^2); 1 at the centre."""
    if mode == "constant" or (d2 == 0 and mode != "linear"):
        return 1.0
    if mode == "linear":
        return 1.0 - math.sqrt(d2) / (cells + 1)
    if mode in ("exponential", "exponential2"):
        return 1 / math.sqrt(d2) if mode == "exponential" else 1 / d2
    raise RasterError(f"unknown mode {mode}")


def spread_filter(r: Raster, mode: str, cells: int, normalise: bool = False) -> Raster:
    """Every data cell spreads its value by weight in a circle; normalised, its weights on the map sum to 1. Nodata where nothing arrives."""
    weights = [(dr, dc, filter_weight(mode, dr * dr + dc * dc, cells)) for dr, dc in circle(cells)]

    def kernel(t: Tile) -> pa.RecordBatch:
        v, has = t.layer["value"].astype(float), t.has["value"]
        if normalise:
            row, col = np.arange(t.shape[0]) + t.row0, np.arange(t.shape[1]) + t.col0
            area = np.zeros(t.shape)
            for dr, dc, w in weights:
                area += w * np.outer((row + dr >= 0) & (row + dr < t.meta.rows), (col + dc >= 0) & (col + dc < t.meta.cols))
            v = v / np.maximum(area, 1e-300)
        out, got = np.zeros(t.shape), np.zeros(t.shape, bool)
        for dr, dc, w in weights:
            out += w * shifted(v, dr, dc)
            got |= shifted(has, dr, dc, False)
        return t.cells(value=(out, got))

    return Raster.of(by_tiles(r.cells(), r.meta, cells, kernel, "row int, col int, value double"), r.meta, "float64" if r.dtype == "float64" else "float32")


#: Aggregates of neighbours: (values, has) stacked over offsets to (values, has).
NEIGHBOUR_AGGREGATES: dict[str, Callable] = {
    "sum": lambda v, h: (np.where(h, v, 0).sum(axis=0), h.any(axis=0)),
    "count": lambda v, h: (h.sum(axis=0).astype(float), np.ones(v.shape[1:], bool)),
    "min": lambda v, h: (np.where(h, v, np.inf).min(axis=0), h.any(axis=0)),
    "max": lambda v, h: (np.where(h, v, -np.inf).max(axis=0), h.any(axis=0)),
    "mean": lambda v, h: (np.where(h, v, 0).sum(axis=0) / np.maximum(h.sum(axis=0), 1), h.any(axis=0)),
}


def _neighbours(r: Raster, n: int, offsets: list[tuple[int, int]], aggregate: str | Callable) -> Raster:
    f = NEIGHBOUR_AGGREGATES[aggregate] if isinstance(aggregate, str) else aggregate

    def kernel(t: Tile) -> pa.RecordBatch:
        v, has = t.layer["value"].astype(float), t.has["value"]
        out, known = np.zeros(t.shape), np.zeros(t.shape, bool)
        rows, cols = t.inner
        for a in range(rows.start, rows.stop, 16):  # in bands, as the stack is as large as the neighbourhood
            band = slice(a, min(a + 16, rows.stop))
            part = lambda x: np.stack([x[band.start + dr : band.stop + dr, cols.start + dc : cols.stop + dc] for dr, dc in offsets])  # noqa: B023, E731
            out[band, cols], known[band, cols] = f(part(v), part(has))
        return t.cells(value=(out, known & has))

    return Raster.of(by_tiles(r.cells(), r.meta, n, kernel, "row int, col int, value double"), r.meta, "float64" if r.dtype == "float64" else "float32")


def filter_square(r: Raster, cells: int, aggregate: str | Callable) -> Raster:
    """A named or user aggregate of the neighbours of each data cell, the cell itself left out."""
    return _neighbours(r, cells, [(a, b) for a in range(-cells, cells + 1) for b in range(-cells, cells + 1) if (a, b) != (0, 0)], aggregate)


def filter_circular(r: Raster, cells: int, aggregate: str | Callable) -> Raster:
    return _neighbours(r, cells, [o for o in circle(cells) if o != (0, 0)], aggregate)


def majority_filter(r: Raster, radius: float) -> Raster:
    """Most frequent value within d^2 <= int(r^2); on ties the present value if it is among them, else the smallest."""
    if not r.meta.cell_size:
        raise RasterError("the cell size is 0")
    cells = float(np.float32(radius / r.meta.cell_size))
    offsets = circle(cells, int(cells * cells))

    def kernel(t: Tile) -> pa.RecordBatch:
        v, has = t.layer["value"], t.has["value"]
        out, known = v.copy(), np.zeros(t.shape, bool)
        rows, cols = t.inner
        for a in range(rows.start, rows.stop, 16):
            band = slice(a, min(a + 16, rows.stop))
            part = lambda x: np.stack([x[band.start + dr : band.stop + dr, cols.start + dc : cols.stop + dc] for dr, dc in offsets])  # noqa: B023, E731
            near, there = part(v), part(has)
            own, own_there = v[band, cols], has[band, cols]
            order = np.lexsort((near, ~there), axis=0)
            near, there = np.take_along_axis(near, order, axis=0), np.take_along_axis(there, order, axis=0)
            run = np.zeros(own.shape, np.int64)
            best, most, mine = own.copy(), np.zeros(own.shape, np.int64), np.zeros(own.shape, np.int64)
            for k in range(len(offsets)):  # runs of equal values, ascending: the first of the longest is the smallest
                run = np.where(there[k] & (k > 0) & (near[k] == near[k - 1]), run + 1, there[k].astype(np.int64))
                longer = there[k] & (run > most)
                best, most = np.where(longer, near[k], best), np.where(longer, run, most)
                mine += there[k] & own_there & (near[k] == own)
            out[band, cols] = np.where(own_there & (mine == most), own, best)
            known[band, cols] = most > 0
        return t.cells(value=(out, known))

    kind = "double" if is_float(r.dtype) else "bigint"
    return Raster.of(by_tiles(r.cells(), r.meta, int(cells), kernel, f"row int, col int, value {kind}"), r.meta, r.dtype)


def voronoi(spark, meta: RasterMeta, locations: Sequence[tuple[int, int]]) -> Raster:
    """Index of the nearest location (row, col) by cell distance, the lowest on ties. A tile looks only at locations that can be nearest in it."""
    if len(set(locations)) < len(locations):
        raise RasterError("a location is given twice")
    at = np.array(locations, np.int64).reshape(-1, 2)

    def kernel(t: Tile) -> pa.RecordBatch:
        (r0, c0), (r1, c1) = (t.row0, t.col0), (t.row0 + t.shape[0] - 1, t.col0 + t.shape[1] - 1)
        gap = np.maximum(np.maximum(r0 - at[:, 0], at[:, 0] - r1), 0) ** 2 + np.maximum(np.maximum(c0 - at[:, 1], at[:, 1] - c1), 0) ** 2
        far = np.maximum(np.abs(at[:, 0] - r0), np.abs(at[:, 0] - r1)) ** 2 + np.maximum(np.abs(at[:, 1] - c0), np.abs(at[:, 1] - c1)) ** 2
        r, c = np.mgrid[r0 : r1 + 1, c0 : c1 + 1]
        best, out = np.full(t.shape, np.iinfo(np.int64).max), np.full(t.shape, -1, np.int64)
        for i in (gap <= far.min()).nonzero()[0]:
            d = (r - at[i, 0]) ** 2 + (c - at[i, 1]) ** 2
            out, best = np.where(d < best, i, out), np.minimum(best, d)
        return t.cells(value=(out, None))

    if not len(at):
        return Raster(grid(spark, meta), F.lit(None), meta, "int32")
    return Raster.of(by_tiles(grid(spark, meta), meta, 0, kernel, "row int, col int, value bigint"), meta, "int32")
