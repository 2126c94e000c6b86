"""Streams of points summed into cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..meta import RasterMeta
from ..operators.vector import point_sums


def stream_point_sums(points: DataFrame, field: str, meta: RasterMeta, time: str | None = None, late: str = "10 minutes", window: str | None = None) -> DataFrame:
    """(row, col, x) of a stream of points (x, y, field). With time and window, sums by time window too (column window), final after ``late``."""
    if time is None or window is None:
        return point_sums(points, field, meta)
    row, col = meta.rc(F.col("x"), F.col("y"))
    cells = points.withWatermark(time, late).select(F.window(time, window).alias("window"), row.alias("row"), col.alias("col"), F.col(field).alias("__f"))
    on_map = cells.where((F.col("row") >= 0) & (F.col("row") < meta.rows) & (F.col("col") >= 0) & (F.col("col") < meta.cols))
    return on_map.groupBy("window", "row", "col").agg(F.sum("__f").alias("x"))


def sum_points_into(points: DataFrame, field: str, meta: RasterMeta, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Each micro-batch's sums as a Parquet partition batch=n under path, written over if the batch is run again: the raster so far is the sum of them.
    available_now: end when everything there now is read."""

    def batch(df: DataFrame, n: int) -> None:
        point_sums(df, field, meta).write.mode("overwrite").parquet(f"{path}/batch={n}")

    writer = points.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
