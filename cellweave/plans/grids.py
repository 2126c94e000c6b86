"""Rasters derived from the star-schema tables: dense keys become cells, attributes become layers of one wide frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import RasterMeta
from ..raster import Raster

COLS = 40

#: Layer to (cell type, expression); the expressions mean the same in Spark and in the SQL of the checks, where // is integer division.
LAYERS = {
    "id": ("int64", "p_partkey"),
    "a": ("int32", "CASE WHEN p_partkey % 11 <> 0 THEN p_size END"),
    "b": ("int32", "CASE WHEN p_partkey % 13 <> 0 THEN p_size % 7 END"),
    "f": ("float64", "CASE WHEN p_partkey % 11 <> 0 THEN p_size * CAST(0.5 AS DOUBLE) - 10 END"),
    "h": ("float64", "CASE WHEN p_partkey % 17 <> 0 THEN p_size * CAST(0.25 AS DOUBLE) END"),
    "price": ("float64", "p_retailprice"),
    "cls": ("int32", "CASE WHEN p_partkey % 19 <> 0 THEN p_size % 4 END"),
    "zone": ("int32", "CASE WHEN p_partkey % 23 <> 0 THEN CAST(substr(p_brand, 7) AS INT) END"),
    "full_zone": ("int32", "CAST(substr(p_brand, 7) AS INT)"),
    "cost": ("float64", "CAST(1 + p_size % 9 AS DOUBLE)"),
    "target": ("int32", "CASE WHEN p_partkey % 97 = 0 THEN 1 + p_size ELSE 0 END"),
    "wall": ("uint8", "CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END"),
    "weight": ("float64", "CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size % 8 AS DOUBLE) END"),
    "fraction": ("float64", "CAST(CASE WHEN p_size % 2 = 0 THEN 0.5 ELSE 1.0 END AS DOUBLE)"),
    "share": ("float64", "CASE WHEN p_partkey % 29 <> 0 THEN (p_size % 5) * CAST(0.25 AS DOUBLE) END"),
    "station": ("int32", "CASE WHEN p_partkey % 31 = 0 THEN 1 + p_size % 3 ELSE 0 END"),
}
LDD = "CASE WHEN p_partkey >= {last} THEN 5 WHEN p_partkey % 40 = 0 AND p_size % 3 = 0 THEN 2 WHEN p_partkey % 40 = 39 AND p_size % 3 = 2 THEN 2 ELSE 1 + p_size % 3 END"


class PartGrid:
    """The part table as a grid of COLS columns; attributes are its layers."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        part = spark.read.parquet(f"{sf_dir}/part.parquet")
        n = part.agg(F.max("p_partkey")).first()[0] + 1  # from the footer's statistics
        self.spark, self.sf_dir, self.meta = spark, sf_dir, RasterMeta(-(-n // COLS), COLS, nodata=-9999.0)
        last = (self.meta.rows - 1) * COLS
        named = {k: e for k, (_, e) in LAYERS.items()} | {"ldd": LDD.format(last=last)}
        self.frame: DataFrame = part.select(F.expr(f"CAST(p_partkey div {COLS} AS INT)").alias("row"), F.expr(f"CAST(p_partkey % {COLS} AS INT)").alias("col"), *[F.expr(e).alias(k) for k, e in named.items()])
        self._types = {k: t for k, (t, _) in LAYERS.items()} | {"ldd": "uint8"}

    def __getattr__(self, name: str) -> Raster:
        if name in self.__dict__.get("_types", {}):
            return Raster.of(self.frame, self.meta, self._types[name], name)
        raise AttributeError(name)

    def apart(self, name: str) -> Raster:
        """A layer read on its own, as a raster of another lineage."""
        return PartGrid(self.spark, self.sf_dir).__getattr__(name)


def part_sql() -> str:
    """CTEs n (rows of the grid) and g (its cells and layers)."""
    layers = ", ".join(f"{e} AS {k}" for k, (_, e) in LAYERS.items())
    ldd = LDD.format(last=f"((SELECT max(p_partkey) FROM part) // {COLS}) * {COLS}")
    return f"g AS (SELECT CAST(p_partkey // {COLS} AS INT) AS row, CAST(p_partkey % {COLS} AS INT) AS col, {layers}, {ldd} AS ldd FROM part), n AS (SELECT max(row) + 1 AS rows FROM g)"
