"""Rasters in Arc/Info ASCII (.asc) and Parquet; windows, bands and palettes.

Formats that need a native raster library (tif, png, gif) are not read: ``read`` and ``write`` raise for them.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..meta import SPARK_TYPES, RasterError, RasterMeta, default_nodata, to_geographic, to_mercator
from ..operators.normalise import remap_to_byte
from ..raster import Raster, grid

HEADER = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value", "dx", "dy")


def parse_asc_header(lines: list[str]) -> tuple[RasterMeta, int]:
    """Metadata, and the number of header lines."""
    found: dict[str, float] = {}
    n = 0
    for line in lines:
        parts = line.split()
        if len(parts) != 2 or parts[0].lower() not in HEADER:
            break
        found[parts[0].lower()] = float(parts[1])
        n += 1
    if not {"ncols", "nrows"} <= set(found):
        raise RasterError("no header of an ASCII grid")
    size = found.get("cellsize", found.get("dx", 1.0))
    x = found.get("xllcorner", found.get("xllcenter", size / 2) - size / 2)
    y = found.get("yllcorner", found.get("yllcenter", size / 2) - size / 2)
    return RasterMeta(int(found["nrows"]), int(found["ncols"]), x, y, size, found.get("nodata_value")), n


def read_metadata(spark: SparkSession, path: str) -> RasterMeta:
    """Header only: the first lines of the file."""
    if path.endswith(".asc"):
        return _asc_header(spark, path)[0]
    if "." in path.rsplit("/", 1)[-1] and not path.endswith(".parquet"):
        raise RasterError(f"format of {path} is not supported")
    text = spark.read.text(f"{path}/_meta").first()[0]
    d = json.loads(text)
    return RasterMeta(**d["meta"])


def _asc_header(spark: SparkSession, path: str) -> tuple[RasterMeta, int]:
    """From the first lines of the first file that has any; a folder's files follow each other by name."""
    for file in sorted(spark.read.text(path).inputFiles()):
        if lines := spark.read.text(file).where(F.trim("value") != "").take(len(HEADER)):
            return parse_asc_header([r[0] for r in lines])
    raise RasterError(f"no ASCII grid in {path}")


def read_asc(spark: SparkSession, path: str, dtype: str = "float64") -> Raster:
    """An ASCII grid, of one file or a folder of parts. A line's number is its place in its split and what splits before hold: one count for each
    split is exchanged, no line is."""
    meta, n = _asc_header(spark, path)
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("file", "block").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each split
    numbered = lines.join(splits.select("file", "block", "first", before.alias("before")), ["file", "block"]).withColumn("line", F.col("before") + F.col("at") - F.col("first") - n).where("line >= 0")
    words = numbered.select("line", F.split(F.trim("value"), r"\s+").alias("words"))
    cells = words.select("line", F.posexplode("words").alias("k", "word"))  # a line holds a row of the grid
    frame = cells.select(F.col("line").cast("int").alias("row"), F.col("k").cast("int").alias("col"), F.expr("try_cast(word as double)").alias("value")).where(F.col("row") < meta.rows)
    return Raster.ingest(frame, meta, dtype)


def write_asc(r: Raster, path: str) -> None:
    """A folder of text parts that, put one after the other by name, are the grid file: the header, then a line for each row."""
    nodata = r.meta.nodata if r.meta.nodata is not None and not math.isnan(r.meta.nodata) else -9999
    m = r.meta
    head = "\n".join([f"ncols {m.cols}", f"nrows {m.rows}", f"xllcorner {m.xll!r}", f"yllcorner {m.yll!r}", f"cellsize {m.cell_size!r}", f"NODATA_value {nodata:g}"])  # one value, so that it stays whole
    text = F.coalesce(F.col("value").cast("string"), F.lit(f"{nodata:g}"))
    lines = r.cells().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", text.alias("t")))).alias("x"))  # a row of the grid is a line of the file
    body = lines.select(F.col("row").alias("line"), F.array_join(F.transform("x", lambda c: c["t"]), " ").alias("value"))
    r.frame.sparkSession.createDataFrame([(-1, head)], "line int, value string").union(body).orderBy("line").select("value").write.mode("overwrite").text(path)


def write_parquet(r: Raster, path: str, block: int = 256, bands: dict[int, Raster] | None = None) -> None:
    """Cells sorted by blocks, so that row and column filters skip most row groups; metadata beside them; a band is a partition."""
    for n, one in {1: r, **(bands or {})}.items():
        by = [F.call_function("div", F.col(c), F.lit(block)) for c in ("row", "col")]
        one.cells().repartitionByRange(*by).sortWithinPartitions(*by, "row", "col").write.mode("overwrite").parquet(f"{path}/band={n}")
    d = json.dumps({"meta": {k: v for k, v in vars(r.meta).items()}, "dtype": r.dtype})
    r.frame.sparkSession.createDataFrame([(d,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_meta")


def read_parquet(spark: SparkSession, path: str, band: int = 1) -> Raster:
    d = json.loads(spark.read.text(f"{path}/_meta").first()[0])
    cells = spark.read.schema(f"row int, col int, value {SPARK_TYPES[d['dtype']]}").parquet(f"{path}/band={band}")
    return Raster.of(cells, RasterMeta(**d["meta"]), d["dtype"])


def read(spark: SparkSession, path: str, dtype: str | None = None, extent: RasterMeta | None = None, band: int = 1) -> Raster:
    """By extension; dtype converts, extent crops and pads."""
    if path.endswith(".asc"):
        r = read_asc(spark, path, dtype or "float64")
    elif path.endswith(".parquet") or "." not in path.rsplit("/", 1)[-1]:
        r = read_parquet(spark, path, band)
        r = r if dtype in (None, r.dtype) else r.astype(dtype)
    else:
        raise RasterError(f"format of {path} is not supported")
    return r if extent is None else window(r, extent)


def write(r: Raster, path: str, dtype: str | None = None) -> None:
    r = r if dtype in (None, r.dtype) else r.astype(dtype)
    if path.endswith(".asc"):
        write_asc(r, path)
    elif path.endswith(".parquet") or "." not in path.rsplit("/", 1)[-1]:
        write_parquet(r, path)
    else:
        raise RasterError(f"format of {path} is not supported")


def window(r: Raster, extent: RasterMeta) -> Raster:
    """The raster on another extent of its lattice: cells outside become nodata. The filter reaches a Parquet scan."""
    dr, dc = r.meta.aligned(extent)
    nodata = r.meta.nodata if r.meta.nodata is not None else default_nodata(r.dtype)
    meta = r.meta.replace(rows=extent.rows, cols=extent.cols, xll=extent.xll, yll=extent.yll, nodata=nodata)
    cells = r.frame.where(F.col("row").between(dr, dr + extent.rows - 1) & F.col("col").between(dc, dc + extent.cols - 1))
    moved = cells.select((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col"), r.value.alias("value"))
    if dr >= 0 and dc >= 0 and dr + extent.rows <= r.meta.rows and dc + extent.cols <= r.meta.cols:
        return Raster.of(moved, meta, r.dtype)
    return Raster.of(grid(r.frame.sparkSession, meta).join(moved, ["row", "col"], "left"), meta, r.dtype)


def translate(r: Raster, extent: RasterMeta) -> Raster:
    """The raster on another extent: cropped and padded on its own lattice, else by the nearest cell."""
    try:
        return window(r, extent)
    except RasterError:
        from .resample import resample

        return resample(r, extent, "nearest")


def warp_raster(r: Raster, epsg: int) -> Raster:
    """The raster in another projection by the nearest cell: as it is for its own, by closed form between EPSG:4326 and EPSG:3857. Columns
    keep their number, and cells are square. Poles lie at infinity in EPSG:3857: of a raster that reaches one or beyond, the map ends half a
    cell before it, at the centres of the last cells that have a place."""
    if r.meta.epsg == epsg:
        return r
    if {r.meta.epsg, epsg} != {4326, 3857}:
        raise RasterError(f"no closed form from {r.meta.projection or 'no projection'} to EPSG:{epsg}")
    there, back = (to_mercator, to_geographic) if epsg == 3857 else (to_geographic, to_mercator)
    left, bottom, right, top = r.meta.bounds
    if epsg == 3857:
        most = 90 - r.meta.cell_size / 2
        bottom, top = -most if bottom <= -90 else bottom, most if top >= 90 else top
        if bottom >= top:
            raise RasterError("no cells between the poles")
    (x0, y0), (x1, y1) = there(left, bottom), there(right, top)
    size = (x1 - x0) / r.meta.cols
    nodata = r.meta.nodata if r.meta.nodata is not None else default_nodata(r.dtype)
    rows = max(1, math.ceil((y1 - y0) / size - 1e-9))
    meta = r.meta.replace(rows=rows, xll=x0, yll=y1 - rows * size, cell_size=size, projection=f"EPSG:{epsg}", nodata=nodata)
    row, col = r.meta.rc(*back(*meta.xy(F.col("row"), F.col("col"))))
    source = r.cells().select(F.col("row").alias("sr"), F.col("col").alias("sc"), "value")
    cells = grid(r.frame.sparkSession, meta).withColumn("sr", row).withColumn("sc", col)
    return Raster.of(cells.join(source, ["sr", "sc"], "left").select("row", "col", "value"), meta, r.dtype)


def read_array(spark: SparkSession, path: str, dtype: str | None = None, extent: RasterMeta | None = None):
    """A masked numpy array and its metadata: for small rasters."""
    r = read(spark, path, dtype, extent)
    return r.to_array(), r.meta


def write_array(spark: SparkSession, array, meta: RasterMeta, path: str, dtype: str | None = None) -> None:
    write(Raster.from_array(spark, array, meta, dtype), path)


def read_bytes(spark: SparkSession, data: bytes, dtype: str = "float64") -> Raster:
    """An ASCII grid in memory."""
    import numpy as np

    lines = [x for x in data.decode().splitlines() if x.strip()]
    meta, n = parse_asc_header(lines[: len(HEADER)])
    values = np.array([x.split() for x in lines[n : n + meta.rows]], float)
    return Raster.from_array(spark, np.ma.masked_invalid(values), meta, dtype)


def write_colormapped(r: Raster, path: str, palette: list[tuple[int, int, int, int]], low: float | None = None, high: float | None = None) -> None:
    """The colours of ``apply_colormap`` as four bands of a Parquet raster: red, green, blue, alpha."""
    colours = apply_colormap(r, palette, low, high)
    meta = r.meta.replace(nodata=None)
    bands = {n: Raster.of(colours.select("row", "col", F.col(c).alias("value")), meta, "uint8") for n, c in enumerate("rgba", 1)}
    write_parquet(bands[1], path, bands={n: b for n, b in bands.items() if n > 1})


def sub_raster(r: Raster, extent: RasterMeta) -> Raster:
    """The part that both share."""
    dr, dc = r.meta.aligned(extent)
    r0, c0 = max(0, dr), max(0, dc)
    r1, c1 = min(r.meta.rows, dr + extent.rows), min(r.meta.cols, dc + extent.cols)
    if r0 >= r1 or c0 >= c1:
        raise RasterError("the extents don't overlap")
    size = r.meta.cell_size
    return window(r, r.meta.replace(rows=r1 - r0, cols=c1 - c0, xll=r.meta.xll + c0 * size, yll=r.meta.bounds[3] - r1 * size))


def sub_area(r: Raster, row: int, col: int, rows: int, cols: int, data_only: bool = False) -> DataFrame:
    """(row, col, value) of a rectangle, clipped to the raster."""
    found = r.cells().where(F.col("row").between(row, row + rows - 1) & F.col("col").between(col, col + cols - 1))
    return found.where("value is not null") if data_only else found


def apply_colormap(r: Raster, palette: list[tuple[int, int, int, int]], low: float | None = None, high: float | None = None) -> DataFrame:
    """(row, col, r, g, b, a): the colour of each value mapped from [low, high] (the data's by default) to 0..255; nodata is transparent."""
    if len(palette) != 256:
        raise RasterError("a palette has 256 colours")
    if low is None or high is None:
        x = r.cells().agg(F.min("value").alias("a"), F.max("value").alias("b")).first()
        low, high = x["a"] if low is None else low, x["b"] if high is None else high
    colours = F.array(*[F.struct(*[F.lit(int(v)).cast("smallint").alias(n) for n, v in zip("rgba", c)]) for c in palette])
    index = remap_to_byte(r.value, float(low), float(high), 0, 255) if low is not None else F.lit(None).cast("smallint")
    clear = F.struct(*[F.lit(0).cast("smallint").alias(n) for n in "rgba"])
    found = F.when(index.isNull(), clear).otherwise(F.element_at(colours, index.cast("int") + 1))
    return r.frame.select("row", "col", found.alias("c")).select("row", "col", "c.*")

