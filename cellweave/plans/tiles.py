"""Tiles with a halo: the unit of work of neighbourhood operators that windows can't express.

A cell goes to its own tile and, near an edge, to the neighbours whose halo it lies in; so a group is at most (side + 2 *
halo)^2 cells whatever the raster's size, one shuffle brings it together, and a kernel sees plain numpy arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..meta import RasterMeta

#: Cells on a side of a tile; larger halos get larger tiles, so that a cell has few copies.
SIDE = 256


def side_for(halo: int) -> int:
    return max(SIDE, 2 * halo)


@contextmanager
def sized(side: int) -> Iterator[None]:
    """Other tiles for the operators called inside; results are the same."""
    global SIDE
    before, SIDE = SIDE, side
    try:
        yield
    finally:
        SIDE = before


class Tile:
    """Arrays of one tile: ``layer[name]`` has values, ``has[name]`` tells data from nodata, ``inner`` cuts the halo off."""

    def __init__(self, meta: RasterMeta, side: int, halo: int, tr: int, tc: int, names: list[str], table: pa.Table) -> None:
        self.meta, self.halo = meta, halo
        self.row0, self.col0 = tr * side - halo, tc * side - halo
        height, width = min(side, meta.rows - tr * side), min(side, meta.cols - tc * side)
        self.shape = (height + 2 * halo, width + 2 * halo)
        self.inner = (slice(halo, halo + height), slice(halo, halo + width))
        r, c = table.column("row").to_numpy() - self.row0, table.column("col").to_numpy() - self.col0
        fits = (r < self.shape[0]) & (c < self.shape[1])
        r, c = r[fits], c[fits]
        self.present = np.zeros(self.shape, bool)
        self.present[r, c] = True
        self.layer: dict[str, np.ndarray] = {}
        self.has: dict[str, np.ndarray] = {}
        for n in names:
            col = table.column(n)
            valid = np.asarray(col.is_valid())[fits]
            whole = pa.types.is_integer(col.type)
            values = np.asarray(col.fill_null(0))[fits]
            self.layer[n] = np.zeros(self.shape, np.int64 if whole else np.float64)
            self.layer[n][r, c] = np.where(valid, values, 0)
            self.has[n] = np.zeros(self.shape, bool)
            self.has[n][r, c] = valid

    def linear(self) -> np.ndarray:
        """Row-major index of every cell of the padded tile in the raster."""
        r, c = np.mgrid[self.row0 : self.row0 + self.shape[0], self.col0 : self.col0 + self.shape[1]]
        return r.astype(np.int64) * self.meta.cols + c

    def inside(self) -> np.ndarray:
        """Which cells of the padded tile lie on the raster."""
        r, c = np.mgrid[self.row0 : self.row0 + self.shape[0], self.col0 : self.col0 + self.shape[1]]
        return (r >= 0) & (r < self.meta.rows) & (c >= 0) & (c < self.meta.cols)

    def cells(self, **layers: tuple[np.ndarray, np.ndarray | None]) -> pa.RecordBatch:
        """Inner cells that are present, with (values, data) of the padded tile as columns."""
        here = self.present[self.inner]
        r, c = here.nonzero()
        cols = {"row": pa.array((r + self.row0 + self.halo).astype(np.int32)), "col": pa.array((c + self.col0 + self.halo).astype(np.int32))}
        for n, (values, data) in layers.items():
            cols[n] = pa.array(values[self.inner][here], mask=None if data is None else ~data[self.inner][here])
        return pa.RecordBatch.from_pydict(cols)


def dealt_to_tiles(cells: DataFrame, meta: RasterMeta, halo: int, side: int) -> DataFrame:
    """cells with columns __tr and __tc, a row for each tile that a cell lies in or in the halo of."""
    if not halo:
        return cells.withColumn("__tr", F.floor(F.col("row") / side).cast("int")).withColumn("__tc", F.floor(F.col("col") / side).cast("int"))

    def spread(c: str, n: int):
        first = F.greatest(F.floor((F.col(c) - halo) / side), F.lit(0)).cast("int")
        last = F.least(F.floor((F.col(c) + halo) / side), F.lit((n - 1) // side)).cast("int")
        return F.sequence(first, last)

    return cells.withColumn("__tr", F.explode(spread("row", meta.rows))).withColumn("__tc", F.explode(spread("col", meta.cols)))


def by_tiles(cells: DataFrame, meta: RasterMeta, halo: int, kernel: Callable[[Tile], pa.RecordBatch | pa.Table], schema: str, side: int | None = None, only: DataFrame | None = None) -> DataFrame:
    """kernel's rows for every tile of cells (row, col, any numeric layers), or for the tiles of only (tr, tc)."""
    side = side or side_for(halo)
    names = [c for c in cells.columns if c not in ("row", "col")]
    dealt = dealt_to_tiles(cells, meta, halo, side)
    if only is not None:
        dealt = dealt.join(only.select(F.col("tr").alias("__tr"), F.col("tc").alias("__tc")), ["__tr", "__tc"], "left_semi")

    def run(key, table):
        out = kernel(Tile(meta, side, halo, key[0].as_py(), key[1].as_py(), names, table))
        return pa.Table.from_batches([out]) if isinstance(out, pa.RecordBatch) else out

    return dealt.groupBy("__tr", "__tc").applyInArrow(run, schema)


def circle(radius: float, limit: float | None = None) -> list[tuple[int, int]]:
    """Offsets (dr, dc) with dr^2 + dc^2 <= limit (radius^2 if not given) in the window of int(radius)."""
    n, most = int(radius), radius * radius if limit is None else limit
    return [(dr, dc) for dr in range(-n, n + 1) for dc in range(-n, n + 1) if dr * dr + dc * dc <= most]


def shifted(a: np.ndarray, dr: int, dc: int, fill=0) -> np.ndarray:
    """a[r + dr, c + dc] at (r, c); fill beyond the edges."""
    out = np.full_like(a, fill)
    h, w = a.shape
    if abs(dr) < h and abs(dc) < w:
        out[max(0, -dr) : h - max(0, dr), max(0, -dc) : w - max(0, dc)] = a[max(0, dr) : h - max(0, -dr), max(0, dc) : w - max(0, -dc)]
    return out
