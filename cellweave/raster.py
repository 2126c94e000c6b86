"""The Raster class: a lazy value expression over a frame of cells.

Rasters of one frame combine without any join: an expression over several of them is one projection, which Catalyst
fuses into one stage. Only rasters of different frames are aligned by an equi-join on (row, col). Grids are complete (a row
for each cell), so an inner join loses nothing.
"""

from __future__ import annotations

import itertools
import math
import numbers

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .meta import SPARK_TYPES, UNSIGNED, RasterError, RasterMeta, default_nodata, fits, is_float, promote

_names = itertools.count()
Number = numbers.Real


def clean(value: Column, dtype: str, nodata: float | None = None) -> Column:
    """value in the cell type; NaN and the nodata value become NULL."""
    out = value.cast(SPARK_TYPES[dtype])
    if is_float(dtype):
        out = F.when(~F.isnan(out), out)
    if nodata is not None and not math.isnan(nodata):
        out = F.when(out != F.lit(nodata), out)
    return out


class Raster:
    """frame has row and col; value is an expression over frame."""

    def __init__(self, frame: DataFrame, value: Column, meta: RasterMeta, dtype: str) -> None:
        self.frame, self.value, self.meta, self.dtype = frame, value, meta, dtype

    # construction

    @classmethod
    def of(cls, cells: DataFrame, meta: RasterMeta, dtype: str, column: str = "value") -> Raster:
        """From a complete table of cells (row, col, value) in which NULL is nodata."""
        return cls(cells, F.col(column).cast(SPARK_TYPES[dtype]), meta, dtype)

    @classmethod
    def ingest(cls, cells: DataFrame, meta: RasterMeta, dtype: str, column: str = "value") -> Raster:
        """Same, from raw values: the nodata value and NaN become NULL."""
        return cls(cells, clean(F.col(column), dtype, meta.nodata), meta, dtype)

    @classmethod
    def filled(cls, spark: SparkSession, meta: RasterMeta, dtype: str, fill: float | None = 0) -> Raster:
        """A raster of one value; the nodata value and None give nodata."""
        nothing = fill is None or (meta.nodata is not None and (fill == meta.nodata or (math.isnan(fill) and math.isnan(meta.nodata))))
        return cls(grid(spark, meta), F.lit(None if nothing else fill).cast(SPARK_TYPES[dtype]), meta, dtype)

    @classmethod
    def layers(cls, frame: DataFrame, meta: RasterMeta, **dtypes: str) -> dict[str, Raster]:
        """Rasters of one wide frame: column name to cell type."""
        return {n: cls.of(frame, meta, d, n) for n, d in dtypes.items()}

    @classmethod
    def from_array(cls, spark: SparkSession, array, meta: RasterMeta, dtype: str | None = None) -> Raster:
        """From a two-dimensional (masked) numpy array of the shape that meta names."""
        import numpy as np
        import pyarrow as pa

        data = np.ma.asarray(array)
        if data.shape != (meta.rows, meta.cols):
            raise RasterError(f"the array has shape {data.shape}, not {(meta.rows, meta.cols)}")
        kind = {"bool": "uint8", "uint64": "uint32"}.get(str(data.dtype), str(data.dtype))
        dtype = dtype or ("int32" if kind == "int64" else kind)
        r, c = np.mgrid[: meta.rows, : meta.cols]
        table = pa.table({"row": r.ravel().astype(np.int32), "col": c.ravel().astype(np.int32), "value": pa.array(data.filled(0).astype("f8" if is_float(dtype) else "i8").ravel(), mask=np.ma.getmaskarray(data).ravel())})
        return cls.ingest(spark.createDataFrame(table), meta, dtype)

    # edges

    def cells(self) -> DataFrame:
        """(row, col, value) in the cell type."""
        return self.frame.select("row", "col", self.value.cast(SPARK_TYPES[self.dtype]).alias("value"))

    def kept(self) -> Raster:
        """Written to the shared folder and read again: for a raster that many others use."""
        from .plans.durable import durable

        return Raster.of(durable(self.cells(), "raster"), self.meta, self.dtype)

    def to_array(self):
        """A masked numpy array at the edge of the system: for small rasters."""
        import numpy as np

        t = self.cells().toArrow()
        out = np.ma.masked_all((self.meta.rows, self.meta.cols), "f8" if is_float(self.dtype) else "i8")
        ok = np.asarray(t.column("value").is_valid())
        out[t.column("row").to_numpy()[ok], t.column("col").to_numpy()[ok]] = np.asarray(t.column("value").drop_null())
        return out

    # helpers

    def with_value(self, value: Column, dtype: str | None = None, meta: RasterMeta | None = None) -> Raster:
        return Raster(self.frame, value.cast(SPARK_TYPES[dtype or self.dtype]), meta or self.meta, dtype or self.dtype)

    def astype(self, dtype: str) -> Raster:
        """Conversion toward zero; a nodata value that doesn't fit is replaced by the new type's."""
        nodata = self.meta.nodata
        if nodata is not None and not fits(nodata, dtype):
            nodata = default_nodata(dtype)
        return self.with_value(self.value, dtype, self.meta.replace(nodata=nodata))

    def _other(self, other) -> tuple[Raster, Raster]:
        if isinstance(other, Raster):
            a, b = align(self, other)
            return a, b
        if isinstance(other, bool) or not isinstance(other, Number):
            raise RasterError(f"a raster or a number is needed, not {type(other).__name__}")
        if not is_float(self.dtype) and isinstance(other, float):
            raise RasterError("an integer raster can't be combined with a float")
        return self, Raster(self.frame, F.lit(other).cast(SPARK_TYPES[self.dtype]), self.meta, self.dtype)

    def _arithmetic(self, other, op) -> Raster:
        a, b = self._other(other)
        dtype = promote(a.dtype, b.dtype)
        t = SPARK_TYPES[dtype]
        return Raster(a.frame, op(a.value.cast(t), b.value.cast(t)).cast(t), _nodata_of(a, b, dtype), dtype)

    def __add__(self, other):
        return self._arithmetic(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._arithmetic(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._arithmetic(other, lambda a, b: a * b)

    __radd__, __rmul__ = __add__, __mul__

    def __rsub__(self, other):
        return self._arithmetic(other, lambda a, b: b - a)

    def __truediv__(self, other):
        if isinstance(other, Raster):  # a float result, nodata where the divisor is 0
            a, b = align(self, other)
            dtype = "float64" if b.dtype == "float64" else "float32"
            return Raster(a.frame, F.try_divide(a.value.cast("double"), b.value.cast("double")).cast(SPARK_TYPES[dtype]), _nodata_of(a, b, dtype), dtype)
        if other == 0:
            raise RasterError("division by zero")
        a, b = self._other(other)
        if is_float(self.dtype):
            return a.with_value(a.value / b.value)
        x, y = a.value.cast("bigint"), b.value.cast("bigint")
        return a.with_value(F.call_function("div", x, y), promote(self.dtype, self.dtype))  # toward zero

    def __rtruediv__(self, other):
        if self.meta.nodata is None and not self.frame.where(self.value == 0).isEmpty():
            raise RasterError("division by zero in a raster without a nodata value")
        dtype = "float64" if self.dtype == "float64" else "float32"
        return self.with_value(F.try_divide(F.lit(float(other)), self.value.cast("double")), dtype)

    def __neg__(self):
        if self.dtype in UNSIGNED:
            raise RasterError("unsigned rasters can't be negated")
        return self.with_value(-self.value)

    def _truth(self, other, op, same: bool = False) -> Raster:
        if isinstance(other, Raster):
            if same and self.dtype != other.dtype:
                raise RasterError("rasters of one type are needed")
            a, b = align(self, other)
            return Raster(a.frame, _flag(op(a.value, b.value), a.value, b.value), a.meta.replace(nodata=255), "uint8")
        return self.with_value(_flag(op(self.value, F.lit(other)), self.value), "uint8", self.meta.replace(nodata=255))

    def __eq__(self, other):
        return self._truth(other, lambda a, b: a == b)

    def __ne__(self, other):
        return self._truth(other, lambda a, b: a != b, same=True)

    def __lt__(self, other):
        return self._truth(other, lambda a, b: a < b, same=True)

    def __le__(self, other):
        return self._truth(other, lambda a, b: a <= b, same=True)

    def __gt__(self, other):
        return self._truth(other, lambda a, b: a > b, same=True)

    def __ge__(self, other):
        return self._truth(other, lambda a, b: a >= b, same=True)

    __hash__ = object.__hash__

    def __and__(self, other):
        return self._truth(other, lambda a, b: (a != 0) & (b != 0))

    def __or__(self, other):
        return self._truth(other, lambda a, b: (a != 0) | (b != 0))

    def __invert__(self):
        return self.with_value(_flag(self.value == 0, self.value), "uint8", self.meta.replace(nodata=255))

    def __bool__(self):
        return self.meta.size > 0

    def set_value(self, row: int, col: int, value: float | None) -> Raster:
        return self.with_value(F.when((F.col("row") == row) & (F.col("col") == col), F.lit(value)).otherwise(self.value))

    def add_to_cell(self, row: int, col: int, value: float) -> Raster:
        """The value added to one cell; nodata there counts as 0."""
        return self.with_value(F.when((F.col("row") == row) & (F.col("col") == col), F.coalesce(self.value, F.lit(0)) + F.lit(value)).otherwise(self.value))

    def resize(self, rows: int, cols: int, fill: float | None = None) -> Raster:
        """So many rows and columns from the top left cell; new cells have the fill, or nodata."""
        meta = self.meta.replace(rows=rows, cols=cols, yll=self.meta.bounds[3] - rows * self.meta.cell_size)
        known = self.frame.where((F.col("row") < rows) & (F.col("col") < cols)).select("row", "col", self.value.alias("value"), F.lit(True).alias("known"))
        frame = grid(self.frame.sparkSession, meta).join(known, ["row", "col"], "left")
        return Raster.of(frame.select("row", "col", F.when(F.col("known"), F.col("value")).otherwise(F.lit(fill)).alias("value")), meta, self.dtype)

    def __copy__(self) -> Raster:
        return Raster(self.frame, self.value, self.meta, self.dtype)

    def __deepcopy__(self, memo) -> Raster:
        return self.__copy__()  # rasters never change

    def with_meta(self, **changes) -> Raster:
        """Changed georeference, projection or nodata value; rows and columns stay."""
        if {"rows", "cols"} & set(changes):
            raise RasterError("use sources.window to change the extent")
        return Raster(self.frame, self.value, self.meta.replace(**changes), self.dtype)


def _flag(test: Column, *operands: Column) -> Column:
    """1 or 0, or nodata if any operand is: not SQL's three-valued logic."""
    known = operands[0].isNotNull()
    for x in operands[1:]:
        known &= x.isNotNull()
    return F.when(known, test.cast("smallint"))


def _nodata_of(a: Raster, b: Raster, dtype: str) -> RasterMeta:
    for nodata in (a.meta.nodata, b.meta.nodata):
        if nodata is not None and fits(nodata, dtype):
            return a.meta.replace(nodata=nodata)
    return a.meta if a.meta.nodata is None and b.meta.nodata is None else a.meta.replace(nodata=default_nodata(dtype))


def grid(spark: SparkSession, meta: RasterMeta) -> DataFrame:
    """(row, col) of every cell."""
    return spark.range(meta.size).select(F.expr(f"cast(id div {meta.cols} as int)").alias("row"), (F.col("id") % meta.cols).cast("int").alias("col"))


def align(*rasters: Raster) -> list[Raster]:
    """The rasters over one frame: as they are if they share it, else joined on (row, col), once for each further frame."""
    first = rasters[0]
    for r in rasters[1:]:
        if not first.meta.same_extent(r.meta):
            raise RasterError(f"extents differ: {first.meta.rows} x {first.meta.cols} and {r.meta.rows} x {r.meta.cols}")
    if all(r.frame is first.frame for r in rasters):
        return list(rasters)
    frames: list[DataFrame] = []
    for r in rasters:
        if not any(r.frame is f for f in frames):
            frames.append(r.frame)
    names = [f"__v{next(_names)}" for _ in rasters]
    joined = None
    for f in frames:
        part = f.select("row", "col", *[r.value.cast(SPARK_TYPES[r.dtype]).alias(n) for r, n in zip(rasters, names) if r.frame is f])
        joined = part if joined is None else joined.join(part, ["row", "col"])
    return [Raster(joined, F.col(n), r.meta, r.dtype) for r, n in zip(rasters, names)]
