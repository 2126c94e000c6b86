"""Ranks over a whole table without a single-task window."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable


def global_rank(df: DataFrame, *keys: str, name: str = "rank") -> DataFrame:
    """Adds the 1-based position of every row in the order of keys.

    Rows are range-partitioned by keys and ranked inside their range; what precedes a range is a sum of range sizes, one
    number for each partition. Ranges are written first, so a recomputed task can't move their bounds.
    """
    ranged = durable(df.repartitionByRange(*keys).withColumn("__range", F.spark_partition_id()), "ranges")
    sizes = sorted((r["__range"], r["count"]) for r in ranged.groupBy("__range").count().collect())  # a row for each partition
    before = dict(zip((k for k, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for k, n in before.items() for x in (k, n)]), F.col("__range").cast("bigint")) if before else F.lit(0)
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*keys))
    return ranged.withColumn(name, (inside + offset).cast("bigint")).drop("__range")
