"""Aggregates over whole rasters, comparisons of two, and reports. Each is one pass with partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import RasterError
from ..raster import Raster, align


def _one(r: Raster, **aggregates) -> dict:
    return r.cells().agg(*[a.alias(n) for n, a in aggregates.items()]).first().asDict()


def any_of(r: Raster) -> bool:
    return bool(_one(r, x=F.bool_or(F.col("value") != 0))["x"])


def all_of(r: Raster) -> bool:
    """Over data cells; true of none."""
    x = _one(r, x=F.bool_and(F.col("value") != 0))["x"]
    return x is None or x


def contains_only_nodata(r: Raster) -> bool:
    return r.frame.where(r.value.isNotNull()).isEmpty()


def has_nodata(r: Raster) -> bool:
    return not r.frame.where(r.value.isNull()).isEmpty()


def raster_sum(r: Raster) -> float:
    return float(_one(r, x=F.sum(F.col("value").cast("double")))["x"] or 0.0)


def mean(r: Raster) -> float | None:
    return _one(r, x=F.avg(F.col("value").cast("double")))["x"]


def raster_min(r: Raster):
    return _known(_one(r, x=F.min("value"))["x"])


def raster_max(r: Raster):
    return _known(_one(r, x=F.max("value"))["x"])


def _known(x):
    if x is None:
        raise RasterError("the raster has no data")
    return x


def minmax(r: Raster) -> tuple:
    x = _one(r, lo=F.min("value"), hi=F.max("value"))
    return _known(x["lo"]), _known(x["hi"])


def minmax_cells(r: Raster) -> DataFrame:
    """One row: the first cell of the least value and the last cell of the greatest, in row-major order."""
    at = F.col("row").cast("bigint") * r.meta.cols + F.col("col")
    data = r.cells().where("value is not null")
    least, most = F.min(F.struct("value", at.alias("at"))), F.max(F.struct("value", at.alias("at")))
    cols = F.lit(r.meta.cols)
    parts = data.agg(least.alias("a"), most.alias("b"))
    cell = lambda s, n: (F.call_function("div", F.col(f"{s}.at"), cols).cast("int").alias(f"{n}_row"), (F.col(f"{s}.at") % cols).cast("int").alias(f"{n}_col"))
    return parts.select(F.col("a.value").alias("min"), *cell("a", "min"), F.col("b.value").alias("max"), *cell("b", "max"))


def raster_stats(r: Raster) -> DataFrame:
    """One row of counts, sum, extremes, and the sample deviation of non-zero values about sum / (number of non-zero values)."""
    v = F.col("value").cast("double")
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v))
    nonzero = F.when(v != 0, v)
    n, total, squares = F.count(nonzero), F.coalesce(F.sum(v), F.lit(0.0)), F.coalesce(F.sum(nonzero * nonzero), F.lit(0.0))
    spread = (squares - total * total / n) / (n - 1)
    return r.cells().agg(
        F.count_if(whole < 0).alias("negative"), F.count_if(v > 0).alias("positive"), n.alias("nonzero"), F.count_if(v == 0).alias("zero"), F.count_if(F.isnan(v)).alias("nan"), F.count_if(v.isNull()).alias("nodata"),
        total.alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)))).alias("sigma_nonzero"),
    )


def histogram(r: Raster, most: int = 511) -> DataFrame:
    """(bin, count) of truncated values in [0, most]."""
    return r.cells().where(F.col("value").between(0, most)).groupBy(F.floor("value").cast("int").alias("bin")).agg(F.count("*").alias("count"))


def unique_values(r: Raster) -> DataFrame:
    return r.cells().where("value is not null").select("value").distinct()


def raster_diff(a: Raster, b: Raster, tolerance: float = 1e-6) -> DataFrame:
    """One row that counts the cells of each kind of difference; cells that are nodata in both don't count."""
    a, b = align(a, b)
    x, y = a.value.cast("double"), b.value.cast("double")
    close = F.abs(x - y) <= 1e-8 + tolerance * F.abs(y)
    kind = (
        F.when(x.isNull() & y.isNull(), None).when(x.isNull(), F.when(y == 0, "nodata_to_zero").otherwise("nodata_to_nonzero"))
        .when(y.isNull(), F.when(x == 0, "zero_to_nodata").otherwise("nonzero_to_nodata"))
        .when(close, "equal").when((x == 0) & (y != 0), "zero_to_nonzero").when((x != 0) & (y == 0), "nonzero_to_zero").otherwise("different")
    )
    kinds = ("equal", "zero_to_nonzero", "nonzero_to_zero", "nodata_to_zero", "nodata_to_nonzero", "zero_to_nodata", "nonzero_to_nodata", "different")
    return a.frame.select(kind.alias("kind")).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in kinds])


def info_summary(r: Raster) -> DataFrame:
    """What a report on a raster shows: extent, counts, averages with and without zeros."""
    s = raster_stats(r)
    return s.select(
        F.lit(r.meta.rows).alias("rows"), F.lit(r.meta.cols).alias("cols"), "min", "max", "sum", "nodata", "zero", "nonzero", "negative",
        (F.col("sum") / F.nullif(F.col("zero") + F.col("nonzero"), F.lit(0))).alias("average"), (F.col("sum") / F.nullif(F.col("nonzero"), F.lit(0))).alias("average_nonzero"),
    )
