"""Distance, cost distance and allocation on the 8-neighbour grid.

Single-field operators relax tile by tile: a round brings each tile whose halo changed together with that one-cell halo, relaxes it to
rest in numpy and writes it; tiles at rest are neither exchanged nor written. Rounds end when no halo changed, so their number follows
the tiles that a shortest path crosses, not its cells. Operators with a field of their own for every source walk a frontier of (source, cell) by joins.
Ties of allocation go to the source of the smallest row-major index.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import RasterError
from ..plans.durable import durable
from ..plans.tiles import Tile, by_tiles, dealt_to_tiles, shifted, side_for
from ..raster import Raster, align

STEPS = [(dr, dc, float(np.sqrt(dr * dr + dc * dc))) for dr in (-1, 0, 1) for dc in (-1, 0, 1) if (dr, dc) != (0, 0)]
#: Path costs are compared at this many decimals, so that equal sums of different order tie.
DECIMALS = 9
#: Rounds after which the parts of a state are written as one table again.
COMPACT = 4


def _relaxed(cells: DataFrame, meta, diagonals: bool, limit: float | None) -> DataFrame:
    """(row, col, dist, seed) from cells (row, col, cost, wall, start): cost of entering a cell, NULL if none can; start cells are sources."""

    def kernel(t: Tile) -> pa.RecordBatch:
        far = np.iinfo(np.int64).max
        dist = np.where(t.has["dist"], t.layer["dist"], np.inf)
        seed = np.where(t.has["seed"], t.layer["seed"], far)
        before, before_seed = dist.copy(), seed.copy()
        wall = t.layer["wall"] != 0
        cost = np.where(t.has["cost"] & ~wall, t.layer["cost"], np.inf)
        moving = True
        while moving:
            moving = False
            for dr, dc, step in STEPS:
                d = np.round(shifted(dist, dr, dc, np.inf) + step * cost, DECIMALS)
                if dr and dc and not diagonals:
                    d[shifted(wall, dr, 0, False) & shifted(wall, 0, dc, False)] = np.inf
                if limit is not None:
                    d[d >= limit] = np.inf
                s = shifted(seed, dr, dc, far)
                better = (d < dist) | ((d == dist) & (s < seed) & np.isfinite(d))
                better[[0, -1], :] = better[:, [0, -1]] = False  # the halo belongs to other tiles
                if better.any():
                    dist, seed, moving = np.where(better, d, dist), np.where(better, s, seed), True
        changed = (dist != before) | (seed != before_seed)
        return t.cells(cost=(t.layer["cost"], t.has["cost"]), wall=(t.layer["wall"], None), dist=(dist, np.isfinite(dist)), seed=(seed, np.isfinite(dist)), changed=(changed.astype(np.int64), None))

    index = F.col("row").cast("bigint") * meta.cols + F.col("col")
    state = cells.select("row", "col", F.col("cost").cast("double").alias("cost"), F.col("wall").cast("bigint").alias("wall"), F.when(F.col("start"), F.lit(0.0)).alias("dist"), F.when(F.col("start"), index).alias("seed"))
    side, active, turn = side_for(1), None, 0
    own = [F.floor(F.col(c) / side).cast("int").alias(t) for c, t in (("row", "tr"), ("col", "tc"))]
    while True:
        found = durable(by_tiles(state, meta, 1, kernel, "row int, col int, cost double, wall bigint, dist double, seed bigint, changed bigint", side, active), "distance")
        rested = found.drop("changed") if active is None else state.select("*", *own).join(active, ["tr", "tc"], "left_anti").drop("tr", "tc").union(found.drop("changed"))
        turn += 1
        state = durable(rested, "distance-state") if turn % COMPACT == 0 else rested
        moved = dealt_to_tiles(found.where("changed <> 0").select("row", "col"), meta, 1, side).select(F.col("__tr").alias("tr"), F.col("__tc").alias("tc"), *[c.alias(f"own_{n}") for c, n in zip(own, ("tr", "tc"))])
        active = durable(moved.where("tr <> own_tr or tc <> own_tc").select("tr", "tc").distinct(), "active")
        if active.isEmpty():
            return state.select("row", "col", "dist", "seed")


def _field(targets: Raster, cost: Raster | None = None, obstacles: Raster | None = None, diagonals: bool = True, limit: float | None = None) -> DataFrame:
    """_relaxed, with a column target (value of the target raster)."""
    rs = iter(align(*[r for r in (targets, cost, obstacles) if r is not None]))
    t = next(rs)
    c = next(rs).value if cost is not None else F.lit(1.0)
    wall = (lambda o: F.coalesce(o != 0, F.lit(True)))(next(rs).value) if obstacles is not None else F.lit(False)
    cells = t.frame.select("row", "col", c.alias("cost"), wall.cast("int").alias("wall"), F.coalesce(t.value != 0, F.lit(False)).alias("start"))
    return _relaxed(cells, targets.meta, diagonals, limit)


def _joined(field: DataFrame, meta, value: Column, dtype: str, *rasters: Raster) -> Raster:
    frame = field
    for k, r in enumerate(rasters):
        frame = frame.join(r.cells().withColumnRenamed("value", f"r{k}"), ["row", "col"])
    return Raster.of(frame.select("row", "col", value.alias("value")), meta, dtype)


def distance(targets: Raster, obstacles: Raster | None = None, include_diagonal: bool = False, unreachable: float = float("inf")) -> Raster:
    """Metres to the nearest non-zero target; nodata targets stay nodata. Obstacles (non-zero or nodata) block, and diagonal
    steps between two of them too unless include_diagonal."""
    field = _field(targets, None, obstacles, include_diagonal or obstacles is None)
    value = F.when(F.col("r0").isNotNull(), F.coalesce(F.col("dist") * targets.meta.cell_size, F.lit(unreachable)))
    return _joined(field, targets.meta, value, "float32", targets)


def travel_distance(targets: Raster, times: Raster) -> Raster:
    """Cost of the cheapest way from a target, a step costing its length in cells times the time of the cell entered; nodata in
    either raster gives nodata, unreachable cells the largest float."""
    field = _field(targets, times)
    value = F.when(F.col("r0").isNotNull() & F.col("r1").isNotNull(), F.coalesce("dist", F.lit(float(np.finfo("f4").max))))
    return _joined(field, targets.meta, value, "float32", targets, times)


def _allocated(field: DataFrame, targets: Raster, values: Raster) -> Raster:
    """Value at each cell's source, 0 without one."""
    index = F.col("row").cast("bigint") * targets.meta.cols + F.col("col")
    t, v = align(targets, values)
    sources = t.frame.where(t.value != 0).select(index.alias("seed"), v.value.alias("x"))
    out = field.join(sources, "seed", "left").select("row", "col", F.when(F.col("seed").isNotNull(), F.col("x")).otherwise(0).alias("value"))
    return Raster.of(out, values.meta, values.dtype)


def closest_target(targets: Raster) -> Raster:
    """Value of the nearest target; 0 if there is none."""
    return _allocated(_field(targets), targets, targets)


def value_at_closest_target(targets: Raster, values: Raster) -> Raster:
    return _allocated(_field(targets), targets, values)


def value_at_closest_travel_target(targets: Raster, times: Raster, values: Raster) -> Raster:
    return _allocated(_field(targets, times), targets, values)


def value_at_closest_lt_travel_target(targets: Raster, times: Raster, values: Raster, most: float) -> Raster:
    """Only where the cost is less than ``most``."""
    return _allocated(_field(targets, times, limit=most), targets, values)


def _reached(sources: DataFrame, resistance: Raster, most: float, mean: bool) -> DataFrame:
    """(src, row, col, cost) of every cell that a source (src, row, col) reaches at a cost of at most ``most``, itself included at 0.

    A step costs its length times the resistance of the cell entered, or the mean of both cells'. The frontier holds improved
    (source, cell) pairs only; each round is an equi-join with the neighbours and an aggregate.
    """
    if most <= 0:
        raise RasterError("the largest cost must be positive")
    ground = resistance.cells().select("row", "col", F.col("value").cast("double").alias("t"))
    if not ground.where("t < 0").isEmpty():
        raise RasterError("resistance may not be negative")
    frontier = durable(sources.join(ground, ["row", "col"], "left").select("src", "row", "col", F.lit(0.0).alias("cost"), "t"), "reached")
    parts, whole = [frontier], None  # what was reached: a table of many rounds, and a part for each since
    frontier = frontier.where("t is not null")
    steps = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc"), F.lit(s).alias("step")) for a, b, s in STEPS])
    passable = ground.where("t is not null").withColumnRenamed("t", "t2")
    best = lambda rows: rows.groupBy("src", "row", "col").agg(F.min("cost").alias("cost"))

    def so_far() -> DataFrame:
        rows = [x.select("src", "row", "col", "cost") for x in ([whole] if whole is not None else []) + parts]
        return reduce(DataFrame.union, rows)

    while not frontier.isEmpty():
        out = frontier.withColumn("s", F.explode(steps)).select("src", (F.col("row") + F.col("s.dr")).alias("row"), (F.col("col") + F.col("s.dc")).alias("col"), "cost", "t", F.col("s.step").alias("step"))
        price = F.col("step") * ((F.col("t") + F.col("t2")) / 2 if mean else F.col("t2"))
        found = out.join(passable, ["row", "col"]).select("src", "row", "col", F.round(F.col("cost") + price, DECIMALS).alias("cost"), F.col("t2").alias("t"))
        found = found.where(F.col("cost") <= most).groupBy("src", "row", "col").agg(F.min("cost").alias("cost"), F.first("t").alias("t"))
        # a row that is no better than any part's is none of the frontier
        for old in ([whole] if whole is not None else []) + parts:
            found = found.join(old.select("src", "row", "col", F.col("cost").alias("old")), ["src", "row", "col"], "left").where("old is null or cost < old").drop("old")
        frontier = durable(found, "frontier")
        parts.append(frontier)
        if len(parts) > COMPACT:
            whole, parts = durable(best(so_far()), "reached"), []
    return best(so_far())


def _sources(r: Raster) -> DataFrame:
    return r.cells().where(F.col("value") != 0).select((F.col("row").cast("bigint") * r.meta.cols + F.col("col")).alias("src"), "row", "col")


def sum_within_travel_distance(mask: Raster, resistance: Raster, values: Raster, most: float, include_adjacent: bool = False) -> Raster:
    """For each non-zero mask cell the sum of values reachable within a cost, with the cells beside them on request; 0 elsewhere."""
    reached = _reached(_sources(mask), resistance, most, mean=True).select("src", "row", "col")
    if include_adjacent:
        around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (0, -1), (1, 0), (-1, 0))])
        reached = reached.withColumn("s", F.explode(around)).select("src", (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col")).distinct()
    total = reached.join(values.cells(), ["row", "col"]).groupBy("src").agg(F.sum("value").alias("x"))
    index = F.col("row").cast("bigint") * mask.meta.cols + F.col("col")
    out = mask.frame.select("row", "col", index.alias("src")).join(total, "src", "left").select("row", "col", F.coalesce("x", F.lit(0)).alias("value"))
    return Raster.of(out, values.meta, values.dtype)


def _per_target(targets: Raster, resistance: Raster, most: float) -> DataFrame:
    """(src, row, col, cost, target); targets on nodata resistance reach nothing."""
    t, r = align(targets, resistance)
    index = (F.col("row").cast("bigint") * targets.meta.cols + F.col("col")).alias("src")
    sources = t.frame.where((t.value != 0) & r.value.isNotNull()).select(index, "row", "col", t.value.alias("target"))
    return _reached(sources.drop("target"), resistance, most, mean=False).join(sources.select("src", "target"), "src")


def _over_cells(targets: Raster, found: DataFrame, dtype: str) -> Raster:
    out = targets.frame.select("row", "col").join(found, ["row", "col"], "left").select("row", "col", F.coalesce("x", F.lit(0)).alias("value"))
    return Raster.of(out, targets.meta, dtype)


def sum_targets_within_travel_distance(targets: Raster, resistance: Raster, most: float) -> Raster:
    """Each target adds its value to every cell that it reaches within a cost."""
    return _over_cells(targets, _per_target(targets, resistance, most).groupBy("row", "col").agg(F.sum("target").alias("x")), targets.dtype)


def node_value_distance_decay(targets: Raster, times: Raster, most: float, a: float, b: float) -> Raster:
    """Largest e^(a - b d) / (1 + e^(a - b d)) times target over the targets within a cost of ``most``, else 0."""
    decay = 1 / (1 + F.exp(b * F.col("cost") - a))
    return _over_cells(targets, _per_target(targets, times, most).groupBy("row", "col").agg(F.max(decay * F.col("target")).alias("x")), "float32")
