"""Connected components of cells.

Tiles are labelled on their own; only links that cross a tile's edge go into a table, which is contracted by plans.components.
A component is named by its smallest row-major index, and ids count these in order: the order in which a scan meets them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.durable import durable
from ..plans.ranking import global_rank
from ..plans.tiles import Tile, by_tiles, circle, shifted, side_for
from ..raster import Raster, align

STRAIGHT, DIAGONAL = [(0, 1), (1, 0)], [(1, 1), (1, -1)]


def _merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of a[i] and b[i]: every root is the smallest index of its set."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            break
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            upper = parent[parent]
            if (upper == parent).all():
                break
            parent = upper
    return parent


def labelled(cells: DataFrame, meta, offsets: list[tuple[int, int]], member: Callable[[Tile], np.ndarray], linked: Callable[[Tile, int, int], np.ndarray]) -> DataFrame:
    """cells with a column root: the least row-major index of the component of each member, NULL for others.

    offsets: one of every pair (dr, dc), (-dr, -dc). linked(tile, dr, dc) tells where a cell is linked to that at the offset.
    """
    halo = max(max(abs(a), abs(b)) for a, b in offsets)
    side = side_for(halo)
    names = [c for c in cells.columns if c not in ("row", "col")]

    def kernel(t: Tile) -> pa.Table:
        nodes, lin = member(t), t.linear()
        inner = np.zeros(t.shape, bool)
        inner[t.inner] = True
        parent, at = np.arange(lin.size), np.arange(lin.size).reshape(t.shape)
        crossing: list[tuple[np.ndarray, np.ndarray]] = []
        for dr, dc in offsets:
            hit = nodes & shifted(nodes, dr, dc, False) & linked(t, dr, dc)
            far_inner = shifted(inner, dr, dc, False)
            a = at[hit & inner & far_inner]
            parent = _merge(parent, a, a + dr * t.shape[1] + dc)
            a = at[hit & inner & ~far_inner]
            crossing.append((a, a + dr * t.shape[1] + dc))
            a = at[hit & ~inner & far_inner]
            crossing.append((a + dr * t.shape[1] + dc, a))
        flat = lin.ravel()
        batch = t.cells(**{n: (t.layer[n], t.has[n]) for n in names}, root=(flat[parent].reshape(t.shape), nodes))
        own, other = (np.concatenate(x) for x in zip(*crossing))
        out = pa.Table.from_batches([batch]).append_column("other", pa.nulls(len(batch), pa.int64()))
        pairs = np.unique(np.stack([flat[parent[own]], flat[other]], axis=1), axis=0) if len(own) else np.zeros((0, 2), np.int64)
        more = {f.name: pa.nulls(len(pairs), f.type) for f in out.schema} | {"root": pa.array(pairs[:, 0]), "other": pa.array(pairs[:, 1])}
        return pa.concat_tables([out, pa.table(more, schema=out.schema)])

    kinds = {n: "bigint" if t in ("tinyint", "smallint", "int", "bigint") else "double" for n, t in cells.dtypes}
    schema = "row int, col int, " + "".join(f"{n} {kinds[n]}, " for n in names) + "root bigint, other bigint"
    found = durable(by_tiles(cells, meta, halo, kernel, schema, side), "labels")
    own = found.where("other is null").drop("other")
    near_edge = " or ".join(f"{c} % {side} < {halo} or {c} % {side} >= {side - halo}" for c in ("row", "col"))
    border = own.where(f"root is not null and ({near_edge})").select((F.col("row").cast("bigint") * meta.cols + F.col("col")).alias("other"), F.col("root").alias("b"))
    links = found.where("other is not null").select(F.col("root").alias("a"), "other").join(border, "other").select("a", "b")
    top = components(links).select(F.col("v").alias("root"), F.col("root").alias("__top"))
    return own.join(top, "root", "left").select("row", "col", *names, F.coalesce("__top", "root").alias("root"))


def _same(*names: str) -> Callable[[Tile, int, int], np.ndarray]:
    def linked(t: Tile, dr: int, dc: int) -> np.ndarray:
        return np.logical_and.reduce([t.layer[n] == shifted(t.layer[n], dr, dc) for n in names])

    return linked


def _positive(t: Tile) -> np.ndarray:
    return t.has["value"] & (t.layer["value"] > 0)


def _ids(cells: DataFrame) -> DataFrame:
    """cells with id: the position of root among all roots."""
    cells = durable(cells, "components")
    ranked = global_rank(cells.where("root is not null").select("root").distinct(), "root", name="id")
    return cells.join(ranked, "root", "left")


def _labelled(r: Raster, diagonals: bool, *more: Raster) -> DataFrame:
    rs = align(r, *more)
    cells = rs[0].frame.select("row", "col", rs[0].value.alias("value"), *[x.value.alias(f"v{i}") for i, x in enumerate(rs[1:], 1)])
    return labelled(cells, r.meta, STRAIGHT + (DIAGONAL if diagonals else []), _positive, _same("value"))


def _result(r: Raster, cells: DataFrame, name: str, dtype: str = "int32") -> Raster:
    """name in components, 0 where the value is 0, nodata elsewhere."""
    value = F.when(F.col("root").isNotNull(), F.col(name)).when(F.col("value") == 0, F.lit(0))
    return Raster.of(cells.select("row", "col", value.alias("value")), r.meta.replace(nodata=-9999), dtype)


def cluster_id(r: Raster, diagonals: bool = False) -> Raster:
    """Ids 1, 2... of the components of equal positive values."""
    return _result(r, _ids(_labelled(r, diagonals)), "id")


def cluster_size(r: Raster, diagonals: bool = False) -> Raster:
    cells = durable(_labelled(r, diagonals), "components")
    n = cells.where("root is not null").groupBy("root").agg(F.count("*").alias("n"))
    return _result(r, cells.join(n, "root", "left"), "n")


def cluster_sum(r: Raster, values: Raster, diagonals: bool = False) -> Raster:
    """Sum of the data of a second raster over each component."""
    cells = durable(_labelled(r, diagonals, values), "components")
    s = cells.where("root is not null").groupBy("root").agg(F.coalesce(F.sum("v1"), F.lit(0)).alias("s"))
    return _result(r, cells.join(s, "root", "left"), "s", "float64" if values.dtype == "float64" else "float32")


def _half(offsets: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [o for o in offsets if o > (0, 0)]


def fuzzy_cluster_id(r: Raster, radius: float) -> Raster:
    """Positive cells, of whatever values, within d^2 <= int(r^2) of each other belong together."""
    n = float(np.float32(radius / r.meta.cell_size))
    cells = r.frame.select("row", "col", r.value.alias("value"))
    found = labelled(cells, r.meta, _half(circle(n, int(n * n))) or STRAIGHT, _positive, (lambda t, dr, dc: np.ones(t.shape, bool)) if n >= 1 else (lambda t, dr, dc: np.zeros(t.shape, bool)))
    return _result(r, _ids(found), "id")


def cluster_id_with_obstacles(categories: Raster, obstacles: Raster) -> Raster:
    """8-neighbour components of equal positive categories that don't pass obstacles, nor diagonally between two of them.

    Cells under obstacles then join the cluster that has most of their 8 neighbours, of several the one with the lowest id; 0 if
    there is none. Categories that aren't positive, and nodata in either raster, give nodata.
    """
    c, o = align(categories, obstacles)
    cells = c.frame.select("row", "col", c.value.alias("value"), o.value.alias("block"))

    def free(t: Tile) -> np.ndarray:
        return _positive(t) & t.has["block"] & (t.layer["block"] == 0)

    def linked(t: Tile, dr: int, dc: int) -> np.ndarray:
        same = t.layer["value"] == shifted(t.layer["value"], dr, dc)
        if dr and dc:
            wall = t.layer["block"] != 0
            same &= ~(shifted(wall, dr, 0, False) & shifted(wall, 0, dc, False))
        return same

    ids = _ids(labelled(cells, c.meta, STRAIGHT + DIAGONAL, free, linked)).select("row", "col", "value", "block", F.col("id"))

    def kernel(t: Tile) -> pa.RecordBatch:
        under = _positive(t) & t.has["block"] & (t.layer["block"] > 0)
        clusters = np.where(t.has["id"], t.layer["id"], 0)
        near = np.sort(np.stack([shifted(clusters, a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a, b) != (0, 0)]), axis=0)
        run, most, best = np.zeros(t.shape, int), np.zeros(t.shape, int), np.zeros(t.shape, np.int64)
        for k in range(len(near)):
            run = np.where((near[k] > 0) & (k > 0) & (near[k] == near[k - 1]), run + 1, (near[k] > 0).astype(int))
            longer = run > most
            best, most = np.where(longer, near[k], best), np.where(longer, run, most)
        return t.cells(value=(np.where(under, best, clusters), under | t.has["id"]))

    return Raster.of(by_tiles(ids, c.meta, 1, kernel, "row int, col int, value bigint"), c.meta.replace(nodata=-9999), "int32")


def _path_blocked(wall: np.ndarray, dr: int, dc: int) -> np.ndarray:
    """Where the walk to (dr, dc), diagonal steps first, meets an obstacle or passes between two."""
    r = c = 0
    blocked = np.zeros(wall.shape, bool)
    while (r, c) != (dr, dc):
        a, b = int(np.sign(dr - r)), int(np.sign(dc - c))
        blocked |= shifted(wall, r + a, c + b, True)
        if a and b:
            blocked |= shifted(wall, r, c + b, True) & shifted(wall, r + a, c, True)
        r, c = r + a, c + b
    return blocked


def fuzzy_cluster_id_with_obstacles(items: Raster, obstacles: Raster, radius: float) -> Raster:
    """Equal positive items of one obstacle-free background within d^2 <= int(r^2) belong together if the walk from one to the
    other, in either direction, is free. Items on obstacles have an id each; other cells are nodata."""
    i, o = align(items, obstacles)
    ground = cluster_id_with_obstacles(i.with_value(F.lit(1), "int32"), o)
    i, o, g = align(i, o, ground)
    n = float(np.float32(radius / items.meta.cell_size))
    cells = i.frame.select("row", "col", i.value.alias("value"), o.value.alias("block"), g.value.alias("ground"))

    def linked(t: Tile, dr: int, dc: int) -> np.ndarray:
        wall = t.layer["block"] != 0
        free = ~wall & ~shifted(wall, dr, dc, True)
        for name in ("value", "ground"):
            free &= t.layer[name] == shifted(t.layer[name], dr, dc)
        back = shifted(_path_blocked(wall, -dr, -dc), dr, dc, True)
        return free & ~(_path_blocked(wall, dr, dc) & back) if n >= 1 else np.zeros(t.shape, bool)

    window = int(n + 0.5)
    offsets = [(a, b) for a in range(-window, window + 1) for b in range(-window, window + 1) if a * a + b * b <= int(n * n)]
    found = _ids(labelled(cells, items.meta, _half(offsets) or STRAIGHT, _positive, linked))
    return Raster.of(found.select("row", "col", F.when(F.col("root").isNotNull(), F.col("id")).alias("value")), items.meta.replace(nodata=-9999), "int32")


