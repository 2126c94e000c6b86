"""Resampling to another grid of the same area or a part of it."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..meta import RasterError, RasterMeta, is_float
from ..raster import Raster, grid

#: Aggregates of the source cells whose centre lies in a target cell.
AGGREGATES = {
    "average": F.avg, "maximum": F.max, "minimum": F.min, "mode": lambda c: F.mode(c, True), "median": lambda c: F.percentile(c, 0.5),
    "first_quantile": lambda c: F.percentile(c, 0.25), "third_quantile": lambda c: F.percentile(c, 0.75),
}
#: Reach in source cells, and weight at a distance in source cells.
KERNELS = {"bilinear": 1, "cubic": 2, "cubic_spline": 2, "lanczos": 3}


def _weight(name: str, x):
    x = F.abs(x)
    inside = x < KERNELS[name]
    if name == "bilinear":
        w = 1 - x
    elif name == "cubic":
        w = F.when(x < 1, 1.5 * x * x * x - 2.5 * x * x + 1).otherwise(-0.5 * x * x * x + 2.5 * x * x - 4 * x + 2)
    elif name == "cubic_spline":
        w = F.when(x < 1, (4 - 6 * x * x + 3 * x * x * x) / 6).otherwise((2 - x) * (2 - x) * (2 - x) / 6)
    else:
        p = x * math.pi
        w = F.when(x == 0, 1.0).otherwise(3 * F.sin(p) * F.sin(p / 3) / F.nullif(p * p, F.lit(0.0)))
    return F.when(inside, w).otherwise(0.0)


def resample(r: Raster, meta: RasterMeta, algorithm: str = "nearest") -> Raster:
    """nearest, bilinear, cubic, cubic_spline and lanczos look at source cells around a target cell's centre (weights of nodata are
    shared out among the others); the rest aggregate the source cells whose centre lies in the target cell."""
    spark = r.frame.sparkSession
    size = r.meta.cell_size
    out = r.meta.replace(rows=meta.rows, cols=meta.cols, xll=meta.xll, yll=meta.yll, cell_size=meta.cell_size)
    dtype = r.dtype
    if algorithm in AGGREGATES:
        x, y = r.meta.xy(F.col("row"), F.col("col"))
        row, col = out.rc(x, y)
        blocks = r.cells().select(row.alias("row"), col.alias("col"), "value").groupBy("row", "col").agg(AGGREGATES[algorithm]("value").alias("value"))
        if algorithm in ("average", "median", "first_quantile", "third_quantile") and not is_float(dtype):
            dtype = "float32"
        return Raster.of(grid(spark, out).join(blocks, ["row", "col"], "left"), out, dtype)
    x, y = out.xy(F.col("row"), F.col("col"))
    source = r.cells().select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    if algorithm == "nearest":
        row, col = r.meta.rc(x, y)
        cells = grid(spark, out).withColumn("sr", row).withColumn("sc", col)
        return Raster.of(cells.join(source, ["sr", "sc"], "left").select("row", "col", "value"), out, dtype)
    if algorithm not in KERNELS:
        raise RasterError(f"unknown algorithm {algorithm}")
    reach = KERNELS[algorithm]
    at = grid(spark, out).withColumn("fr", (r.meta.bounds[3] - y) / size - 0.5).withColumn("fc", (x - r.meta.xll) / size - 0.5)
    taps = F.sequence(F.lit(1 - reach), F.lit(reach))
    near = at.withColumn("a", F.explode(taps)).withColumn("b", F.explode(taps)).withColumn("sr", (F.floor("fr") + F.col("a")).cast("int")).withColumn("sc", (F.floor("fc") + F.col("b")).cast("int"))
    w = _weight(algorithm, F.col("fr") - F.col("sr")) * _weight(algorithm, F.col("fc") - F.col("sc"))
    met = near.join(source.where("value is not null"), ["sr", "sc"], "left").withColumn("w", F.when(F.col("value").isNotNull(), w))
    value = F.try_divide(F.sum(F.col("w") * F.col("value")), F.sum("w"))
    value = value if is_float(dtype) else F.round(value, 0)
    return Raster.of(met.groupBy("row", "col").agg(value.alias("value")), out, dtype)
