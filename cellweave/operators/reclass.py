"""Reclassification: lookup joins and ranges.

A table is deduplicated to its first row per key and joined null-safely: whether it is broadcast is left to its measured
size. Ranges of a short table compile to one CASE expression inside the scan's stage, those of a long one to a vectorised search.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import SPARK_TYPES, RasterError, fits, is_float
from ..raster import Raster, align

NODATA = -9999
#: Ranges up to this number become one CASE expression, more are looked up by binary search.
MOST_RANGES = 1000


def mapping_type(rows: Sequence[Sequence[float | None]]) -> str:
    """int32 unless a number is fractional or too large, then float32."""
    return "int32" if all(x is None or x != x or fits(x, "int32") for row in rows for x in row) else "float32"


def _missing(x) -> bool:
    return x is None or x != x or x == NODATA


def reclass(table: Sequence[Sequence[float | None]] | DataFrame, *rasters: Raster, index: int = 1) -> Raster:
    """Value of data column index (1-based) in the first row whose keys equal the rasters' values.

    table: rows of one to three keys, as many as rasters, then data columns, in order; a DataFrame has the same columns after
    one named ord that gives the order. A key that is NaN or -9999 matches nodata; no match and -9999 give nodata. Values
    are converted to the table's type before they are compared.
    """
    k = len(rasters)
    if not 1 <= k <= 3:
        raise RasterError("one to three rasters are needed")
    rs = align(*rasters)
    spark = rs[0].frame.sparkSession
    if isinstance(table, DataFrame):
        names = [c for c in table.columns if c != "ord"]
        dtype = "float32" if any(t in ("float", "double") for c, t in table.dtypes if c != "ord") else "int32"
    else:
        width = {len(row) for row in table}
        if not table or len(width) > 1 or min(width) <= k:
            raise RasterError("the table needs rows of equal length with a data column")
        dtype = mapping_type(table)
        names = [f"c{i}" for i in range(min(width))]
        rows = [(i, *[None if _missing(x) else float(x) for x in row]) for i, row in enumerate(table)]
        table = spark.createDataFrame(rows, "ord bigint, " + ", ".join(f"{n} double" for n in names))
    if not 1 <= index <= len(names) - k:
        raise RasterError(f"the table has no data column {index}")
    t = SPARK_TYPES[dtype]
    known = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.col(c) != NODATA), F.col(c)).cast(t)
    first = table.select("ord", *[known(n).alias(f"__k{i}") for i, n in enumerate(names[:k])], known(names[k + index - 1]).alias("__x"))
    first = first.groupBy(*[f"__k{i}" for i in range(k)]).agg(F.min_by("__x", "ord").alias("__x"))
    cells = rs[0].frame.select("row", "col", *[r.value.cast(t).alias(f"__v{i}") for i, r in enumerate(rs)])
    on = [cells[f"__v{i}"].eqNullSafe(first[f"__k{i}"]) for i in range(k)]
    out = cells.join(first, on, "left").select("row", "col", F.col("__x").alias("value"))
    return Raster.of(out, rasters[0].meta.replace(nodata=NODATA), dtype)


def reclassi(table, *rasters: Raster, index: int) -> Raster:
    return reclass(table, *rasters, index=index)


def nreclass(table: Sequence[tuple[float, float, float | None]], r: Raster) -> Raster:
    """Value of the first row (low, high, value) with low < v <= high; -9999 and no range give nodata; the type stays."""
    if not is_float(r.dtype):
        for row in table:
            for x in row:
                if not _missing(x) and not fits(x, r.dtype):
                    raise RasterError(f"{x} doesn't fit type {r.dtype}")
    if len(table) > MOST_RANGES:
        return r.with_value(_looked_up(table, SPARK_TYPES[r.dtype])(r.value))
    t, out = SPARK_TYPES[r.dtype], None
    for low, high, value in table:
        inside = (r.value > F.lit(low).cast(t)) & (r.value <= F.lit(high).cast(t))
        x = F.lit(None if _missing(value) else value).cast(t)
        out = F.when(inside, x) if out is None else out.when(inside, x)
    return r.with_value(F.lit(None) if out is None else out)


def _looked_up(table: Sequence[tuple[float, float, float | None]], kind: str):
    """The same for long tables: ranges are cut into disjoint ones, of which a binary search finds a value's."""
    edges = np.unique([x for low, high, _ in table for x in (low, high)])
    starts = sorted((np.searchsorted(edges, low), i) for i, (low, high, _) in enumerate(table) if low < high)
    value, open_rows, k = np.full(len(edges), np.nan), [], 0
    for at in range(len(edges) - 1):  # the first row of those that cover (edges[at], edges[at + 1]]
        while k < len(starts) and starts[k][0] <= at:
            heapq.heappush(open_rows, starts[k][1])
            k += 1
        while open_rows and table[open_rows[0]][1] <= edges[at]:
            heapq.heappop(open_rows)
        if open_rows and not _missing(x := table[open_rows[0]][2]):
            value[at] = x

    @F.arrow_udf(kind)
    def find(cells: pa.Array) -> pa.Array:
        v = np.asarray(cells.cast(pa.float64()).fill_null(np.nan))
        at = np.searchsorted(edges, v, side="left") - 1
        out = np.where((at >= 0) & (at < len(edges) - 1) & ~np.isnan(v), value[np.clip(at, 0, len(edges) - 1)], np.nan)
        return pa.array(out, mask=np.isnan(out)).cast(cells.type)

    return find
