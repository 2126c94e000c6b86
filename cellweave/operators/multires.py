"""Coarser and finer grids, and the distribution of amounts over cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import RasterError, RasterMeta, is_float
from ..raster import Raster, align
from .stats import raster_sum


def _split(r: Raster, k: int) -> DataFrame:
    each = F.sequence(F.lit(0), F.lit(k - 1))
    fine = r.cells().withColumn("__a", F.explode(each)).withColumn("__b", F.explode(each))
    return fine.select((F.col("row") * k + F.col("__a")).alias("row"), (F.col("col") * k + F.col("__b")).alias("col"), "value")


def inflate(r: Raster, k: int) -> Raster:
    """k x k copies of each cell."""
    return Raster.of(_split(r, k), r.meta.replace(rows=r.meta.rows * k, cols=r.meta.cols * k, cell_size=r.meta.cell_size / k), r.dtype)


def inflate_equal_sum(r: Raster, k: int) -> Raster:
    out = inflate(r, k)
    return out.with_value(out.value.cast("double") / (k * k), "float64" if r.dtype == "float64" else "float32")


def block_aggregate(r: Raster, k: int, aggregate, dtype: str | None = None) -> Raster:
    """An aggregate of the data of each k x k block."""
    meta = r.meta.scaled(k)
    at = lambda c: F.call_function("div", F.col(c), F.lit(k)).cast("int").alias(c)
    return Raster.of(r.cells().groupBy(at("row"), at("col")).agg(aggregate(F.col("value")).alias("value")), meta, dtype or r.dtype)


def deflate_equal_sum(r: Raster, k: int) -> Raster:
    """Block sums; nodata where a block has no data."""
    return block_aggregate(r, k, F.sum, r.dtype if is_float(r.dtype) else "int64")


def to_meta(r: Raster, meta: RasterMeta) -> Raster:
    k = round(meta.cell_size / r.meta.cell_size)
    if (r.meta.rows, r.meta.cols) != (meta.rows * k, meta.cols * k):
        raise RasterError("the target grid isn't a multiple of the raster's")
    return deflate_equal_sum(r, k)


def _lookup(r: Raster, weights: Mapping[int, float] | DataFrame, name: str) -> DataFrame:
    """(row, col, key, x): x of the key in a mapping or a table (key, x)."""
    table = weights if isinstance(weights, DataFrame) else r.frame.sparkSession.createDataFrame([(int(k), float(v)) for k, v in weights.items()], f"{name} bigint, x double")
    table = table.toDF(name, "x")
    return r.cells().withColumnRenamed("value", name).join(table, name, "left")


def categories_to_weights(categories: Raster, weights: Mapping[int, float] | DataFrame) -> Raster:
    """Weight of each cell's category, nodata if it has none."""
    return Raster.of(_lookup(categories, weights, "category").select("row", "col", F.col("x").alias("value")), categories.meta.replace(nodata=float("nan")), "float64")


def aggregate_multi_resolution(landuse: Raster, weights: Mapping[int, float] | DataFrame, meta: RasterMeta) -> Raster:
    return to_meta(categories_to_weights(landuse, weights), meta)


def weighted_distribution(zones: Raster, weights: Raster | float, amounts: Mapping[int, float] | DataFrame, zero_is_nodata: bool = True) -> Raster:
    """Each zone's amount split in proportion to weight.

    Zones whose weights are all 0 spread it evenly over cells with a weight, those without any weight over all of their
    cells. Zones without an amount stay nodata. Negative zones or weights, and amounts for zones that don't occur, raise.
    """
    z, w = align(zones, weights) if isinstance(weights, Raster) else (zones, zones.with_value(F.lit(float(weights)), "float64"))
    spark = z.frame.sparkSession
    amounts = amounts if isinstance(amounts, DataFrame) else spark.createDataFrame([(int(k), float(v)) for k, v in amounts.items()], "zone bigint, amount double")
    amounts = amounts.toDF("zone", "amount")
    cells = z.frame.select("row", "col", z.value.cast("bigint").alias("zone"), w.value.cast("double").alias("w"))
    totals = cells.where("zone is not null").groupBy("zone").agg(F.sum("w").alias("sum"), F.count("w").alias("n"), F.count_if(F.col("w").isNull()).alias("none"), F.coalesce(F.min("w"), F.lit(0.0)).alias("least"))
    known = amounts.join(totals, "zone", "left")
    if not known.where("sum is null and n is null or zone < 0 or least < 0").isEmpty():
        raise RasterError("an amount for a zone that doesn't occur, or a negative zone or weight")
    share = (
        F.when(F.col("sum") > 0, F.col("amount") * F.col("w") / F.col("sum")).when(F.col("n") > 0, F.when(F.col("w").isNotNull(), F.col("amount") / F.col("n")))
        .otherwise(F.try_divide("amount", "none"))
    )
    value = F.nullif(share, F.lit(0.0)) if zero_is_nodata else share
    out = cells.join(known, "zone", "left").select("row", "col", value.alias("value"))
    return Raster.of(out, zones.meta.replace(nodata=0.0 if zero_is_nodata else float("nan")), "float64")


def areal_weighted_distribution(zones: Raster, amounts: Mapping[int, float] | DataFrame) -> Raster:
    return weighted_distribution(zones, 1.0, amounts)


def aggregate_and_spread(landuse: Raster, weights: Mapping[int, float] | DataFrame, zones: Raster, amounts: Mapping[int, float] | DataFrame, meta: RasterMeta) -> Raster:
    """Amounts spread by land use weight, then summed on a coarser grid."""
    return to_meta(weighted_distribution(zones, categories_to_weights(landuse, weights), amounts, zero_is_nodata=False), meta)


def das_map(landuse: Raster, densities: Mapping[int, float] | DataFrame, zones: Raster, amounts: Mapping[int, float] | DataFrame) -> Raster:
    """Dasymetric mapping: an amount G_z goes to land use k by c_kz = C_k (A_kz / A_z) / (A_k / A), each cell getting
    G_z (c_kz / sum_k c_kz) / A_kz, or G_z / A_z where all c_kz are 0. The four counts come from one aggregate by grouping sets."""
    lu, z = align(landuse, zones)
    spark = lu.frame.sparkSession
    c = (densities if isinstance(densities, DataFrame) else spark.createDataFrame([(int(k), float(v)) for k, v in densities.items()], "k bigint, c double")).toDF("k", "c")
    g = (amounts if isinstance(amounts, DataFrame) else spark.createDataFrame([(int(k), float(v)) for k, v in amounts.items()], "z bigint, g double")).toDF("z", "g")
    cells = lu.frame.select("row", "col", lu.value.cast("bigint").alias("k"), z.value.cast("bigint").alias("z"))
    sets = cells.where("k is not null and z is not null").groupingSets([[F.col("k"), F.col("z")], [F.col("k")], [F.col("z")], []], "k", "z").agg(F.count("*").cast("double").alias("n"), F.grouping_id().alias("level"))
    kz, k, zz, whole = (sets.where(F.col("level") == n) for n in (0, 1, 2, 3))
    a = whole.select(F.col("n").alias("a"))
    joined = kz.select("k", "z", F.col("n").alias("akz")).join(k.select("k", F.col("n").alias("ak")), "k").join(zz.select("z", F.col("n").alias("az")), "z").join(c, "k", "left")
    total = a.first()  # one number
    whole_area = float(total["a"]) if total else 0.0
    ckz = joined.withColumn("ckz", F.coalesce("c", F.lit(0.0)) * (F.col("akz") / F.col("az")) / (F.col("ak") / whole_area)) if whole_area else joined.withColumn("ckz", F.lit(0.0))
    sums = ckz.groupBy("z").agg(F.sum("ckz").alias("sum"))
    gkz = ckz.join(sums, "z").join(g, "z").select("k", "z", (F.col("g") * F.when(F.col("sum") > 0, F.col("ckz") / F.col("sum") / F.col("akz")).otherwise(1 / F.col("az"))).alias("x"))
    out = cells.join(gkz, ["k", "z"], "left").select("row", "col", F.col("x").alias("value"))
    return Raster.of(out, landuse.meta.replace(nodata=float("nan")), "float64")


def das_map_multiresolution(landuse: Raster, densities, zones: Raster, amounts, meta: RasterMeta) -> Raster:
    return to_meta(das_map(landuse, densities, zones, amounts), meta)


def das_map_linear(landuse: Raster, weights, zones: Raster, amounts, proxy: Raster) -> Raster:
    """Amounts spread by land use weight times a proxy."""
    return weighted_distribution(zones, categories_to_weights(landuse, weights) * proxy.astype("float64"), amounts)


def distribute_proportions(r: Raster, proportions: Sequence[float]) -> list[Raster]:
    """A raster for each proportion; all nodata where it isn't positive."""
    return [r.with_value(r.value.cast("double") * float(p) if p > 0 else F.lit(None), "float64" if r.dtype == "float64" else "float32") for p in proportions]


def value_distribution(amount: float, r: Raster, total: float | None = None) -> Raster:
    total = raster_sum(r) if total is None else total
    return r.with_value(r.value.cast("double") * amount / total if total else F.lit(None), "float64" if r.dtype == "float64" else "float32")


def raster_distribution(r: Raster, fractions: Raster) -> tuple[Raster, Raster]:
    """Each value's fraction, and the rest; a missing fraction is 0, one outside [0, 1] raises."""
    a, f = align(r, fractions)
    if not f.frame.where((f.value < 0) | (f.value > 1)).isEmpty():
        raise RasterError("fractions lie in [0, 1]")
    part = a.value.cast("double") * F.coalesce(f.value.cast("double"), F.lit(0.0))
    dtype = "float64" if r.dtype == "float64" else "float32"
    return a.with_value(part, dtype), a.with_value(a.value.cast("double") - part, dtype)
