"""Zonal operators: one partial aggregate by zone, and a join back to the cells.

The table of zones is joined by size: adaptive execution broadcasts it if what the aggregate wrote is small, and else splits
the partitions of hot zones. A zone of any number of cells is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import RasterError, is_float
from ..plans.tiles import by_tiles, circle
from ..raster import Raster, align


def _pairs(zones: Raster, *values: Raster) -> DataFrame:
    """(row, col, zone, v0, v1...)."""
    z, *vs = align(zones, *values)
    return z.frame.select("row", "col", z.value.alias("zone"), *[v.value.alias(f"v{i}") for i, v in enumerate(vs)])


def _back(cells: DataFrame, by_zone: DataFrame, value: Column) -> DataFrame:
    """(row, col, value): value over the cells' columns and those of their zone."""
    return cells.join(by_zone, "zone", "left").select("row", "col", value.alias("value"))


def _clusters(clusters: Raster) -> Raster:
    if clusters.dtype != "int32":
        raise RasterError("clusters need type int32")
    return clusters


def _category(clusters: Raster, values: Raster, aggregate, dtype: str | None = None) -> Raster:
    """aggregate of the non-zero values of each non-zero cluster; 0 in cluster 0 and where a cluster has none."""
    cells = _pairs(_clusters(clusters), values)
    found = cells.where((F.col("zone") != 0) & (F.col("v0") != 0)).groupBy("zone").agg(aggregate("v0").alias("x"))
    out = _back(cells, found, F.when(F.col("zone").isNotNull(), F.coalesce(F.col("x"), F.lit(0))))
    return Raster.of(out, clusters.meta, dtype or values.dtype)


def _sum_type(dtype: str) -> str:
    return "int32" if dtype in ("uint8", "int16", "uint16") else dtype


def csum(clusters: Raster, values: Raster) -> Raster:
    return _category(clusters, values, F.sum, _sum_type(values.dtype))


def cmin(clusters: Raster, values: Raster) -> Raster:
    return _category(clusters, values, F.min)


def cmax(clusters: Raster, values: Raster) -> Raster:
    return _category(clusters, values, F.max)


def csum_map(clusters: Raster, values: Raster) -> DataFrame:
    """(zone, sum) of non-zero clusters that have a non-zero value."""
    return _pairs(_clusters(clusters), values).where((F.col("zone") != 0) & (F.col("v0") != 0)).groupBy("zone").agg(F.sum("v0").alias("sum"))


def cmode(clusters: Raster, values: Raster) -> Raster:
    """Most frequent value of each non-zero cluster, zeros included, the smallest on ties; 0 elsewhere, also in nodata clusters."""
    cells = _pairs(_clusters(clusters), values)
    counted = cells.where((F.col("zone") != 0) & F.col("v0").isNotNull()).groupBy("zone", "v0").agg(F.count("*").alias("n"))
    best = counted.groupBy("zone").agg(F.min(F.struct((-F.col("n")).alias("n"), "v0")).alias("x"))
    return Raster.of(_back(cells, best, F.coalesce(F.col("x.v0"), F.lit(0))), clusters.meta, values.dtype)


def _filtered(clusters: Raster, by: Raster, keep: Column) -> Raster:
    cells = _pairs(_clusters(clusters), by)
    hit = F.col("v0") != 0
    told = cells.where("zone <> 0").groupBy("zone").agg(F.coalesce(F.bool_or(hit), F.lit(False)).alias("some"), F.coalesce(F.bool_and(hit), F.lit(True)).alias("all"))
    out = _back(cells, told, F.when(F.col("zone").isNotNull(), F.when(keep, F.col("zone")).otherwise(0)))
    return Raster.of(out, clusters.meta, clusters.dtype)


def filter_or(clusters: Raster, by: Raster) -> Raster:
    """Clusters with a non-zero filter cell; nodata filter cells don't count."""
    return _filtered(clusters, by, F.col("some"))


def filter_and(clusters: Raster, by: Raster) -> Raster:
    return _filtered(clusters, by, F.col("all"))


def filter_not(clusters: Raster, by: Raster) -> Raster:
    return _filtered(clusters, by, ~F.col("some"))


def csum_in_buffer(clusters: Raster, values: Raster, radius: float) -> Raster:
    """Each non-zero value counts once for every cluster that has a cell within radius (metres); every cell gets its cluster's total."""
    cells = _pairs(_clusters(clusters), values)
    r = float(np.float32(radius / clusters.meta.cell_size))
    offsets = circle(r, int(r * r))

    def kernel(t) -> pa.RecordBatch:
        sums: dict[int, float] = {}
        v, has = t.layer["v0"], t.has["v0"]
        r0, c0 = (has & (v != 0))[t.inner].nonzero()
        near = np.where(t.has["zone"], t.layer["zone"], 0)
        for at in range(0, len(r0), 1 << 14):
            rr, cc = r0[at : at + (1 << 14)] + t.halo, c0[at : at + (1 << 14)] + t.halo
            seen = np.sort(np.stack([near[rr + dr, cc + dc] for dr, dc in offsets]), axis=0)
            new = np.concatenate([np.ones((1, len(rr)), bool), seen[1:] != seen[:-1]]) & (seen > 0)
            ids, place = np.unique(seen[new], return_inverse=True)
            total = np.bincount(place, np.broadcast_to(v[rr, cc].astype(float), seen.shape)[new], len(ids))
            for i, s in zip(ids.tolist(), total.tolist()):
                sums[i] = sums.get(i, 0.0) + s
        return pa.RecordBatch.from_pydict({"zone": pa.array(list(sums), pa.int32()), "x": pa.array(list(sums.values()), pa.float64())})

    parts = by_tiles(cells, clusters.meta, int(r) or 0, kernel, "zone int, x double")
    total = parts.groupBy("zone").agg(F.sum("x").alias("x"))
    out = _back(cells, total, F.when(F.col("zone").isNotNull(), F.coalesce(F.col("x"), F.lit(0.0))))
    return Raster.of(out, clusters.meta, _sum_type(values.dtype))


def choropleth_sum(values: Raster, areas: Raster) -> Raster:
    cells = _pairs(areas, values)
    return Raster.of(_back(cells, cells.where("zone is not null").groupBy("zone").agg(F.sum("v0").alias("x")), F.when(F.col("zone").isNotNull(), F.coalesce(F.col("x"), F.lit(0)))), areas.meta, _sum_type(values.dtype))


def choropleth_average(values: Raster, areas: Raster) -> Raster:
    """Sum over an area's cells with data, divided by the number of all its cells."""
    cells = _pairs(areas, values)
    by = cells.where("zone is not null").groupBy("zone").agg((F.coalesce(F.sum(F.col("v0").cast("double")), F.lit(0.0)) / F.count("*")).alias("x"))
    return Raster.of(_back(cells, by, F.col("x")), areas.meta, "float32" if values.dtype != "float64" else "float64")


def sum_mask(values: Raster, mask: Raster, ids: Sequence[int] | None = None) -> DataFrame:
    """(zone, sum); with ids, a row for each of them, 0 where it has no data."""
    found = _pairs(mask, values).where("zone is not null and v0 is not null").groupBy("zone").agg(F.sum("v0").alias("sum"))
    if ids is None:
        return found
    wanted = values.frame.sparkSession.createDataFrame([(int(i),) for i in ids], "zone int")
    return wanted.join(found, "zone", "left").select("zone", F.coalesce("sum", F.lit(0)).alias("sum"))


def count_mask(mask: Raster) -> DataFrame:
    return mask.cells().where("value is not null").groupBy(F.col("value").alias("zone")).agg(F.count("*").alias("count"))


#: Operations of table_row; each is an aggregate of v0, NULL where the category is left out.
ROW_OPERATIONS = {
    "Sum": lambda: F.sum("v0"), "Count": lambda: F.count("v0"), "CountNonZero": lambda: F.nullif(F.count_if(F.col("v0") != 0), F.lit(0)), "Min": lambda: F.min("v0"),
    "MinNonZero": lambda: F.min(F.when(F.col("v0") != 0, F.col("v0"))), "Max": lambda: F.max("v0"), "Average": lambda: F.avg("v0"),
}


def table_row(values: Raster, categories: Raster, operation: str) -> DataFrame:
    """(zone, value) of each category, in place of a row of text with a column for each. AverageInCat1 has a row for category 1 only."""
    cells = _pairs(categories, values).where("zone is not null")
    name = operation
    if operation == "AverageInCat1":
        cells, name = cells.where("zone = 1"), "Average"
    if name not in ROW_OPERATIONS:
        raise RasterError(f"unknown operation {operation}")
    return cells.groupBy("zone").agg(ROW_OPERATIONS[name]().alias("value")).where("value is not null")


def write_table_row(values: Raster, categories: Raster, operation: str, path: str, label: str, append: bool = False) -> None:
    """The same as a line of text: a column for each category, ascending. Categories are columns of a report, so of bounded number."""
    found = sorted(tuple(r) for r in table_row(values, categories, operation).collect())
    with open(path, "a" if append else "w", encoding="utf-8") as f:
        if not append:
            f.write("\t".join(["", *[str(z) for z, _ in found]]) + "\n")
        f.write("\t".join([label, *[str(v) for _, v in found]]) + "\n")


def distribute_spatial(values: Raster, mask: Raster, places: DataFrame) -> Raster:
    """Each id's sum at its place (id, row, col), 0 elsewhere. Ids of the mask without a place, and places without id, raise."""
    sums = sum_mask(values, mask)
    if not sums.join(places, sums.zone == places.id, "left_anti").isEmpty() or not places.join(sums, sums.zone == places.id, "left_anti").isEmpty():
        raise RasterError("ids of the mask and of the places differ")
    at = sums.join(places, sums.zone == places.id).groupBy("row", "col").agg(F.sum("sum").alias("x"))
    out = values.frame.select("row", "col").join(at, ["row", "col"], "left").select("row", "col", F.coalesce("x", F.lit(0)).alias("value"))
    return Raster.of(out, values.meta, values.dtype if is_float(values.dtype) else _sum_type(values.dtype))
