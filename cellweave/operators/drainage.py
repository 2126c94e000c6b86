"""Drainage networks (ldd): codes 7 8 9 / 4 5 6 / 1 2 3, 5 is a pit.

A network is a forest. Sums, maxima and first stations along its paths come from pointer doubling: after k rounds a
cell knows what lies within 2^k steps, so a river of any length takes a logarithm of it in rounds. Each round is two
equi-joins, of which none is broadcast, and is written; pointers that still move after log2(cells) rounds run in a loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..meta import RasterError
from ..plans.durable import durable, whole
from ..raster import Raster, align

#: Code to (dr, dc).
MOVES = {7: (-1, -1), 8: (-1, 0), 9: (-1, 1), 4: (0, -1), 6: (0, 1), 1: (1, -1), 2: (1, 0), 3: (1, 1)}


def _move(code: Column, k: int) -> Column:
    out = None
    for c, d in MOVES.items():
        out = F.when(code == c, d[k]) if out is None else out.when(code == c, d[k])
    return out


def _nodes(ldd: Raster, **layers: Raster) -> DataFrame:
    """id, row, col, code, r2, c2 (the cell it flows to, NULL for pits and nodata) and the layers as doubles."""
    rs = align(ldd, *layers.values())
    code, meta = rs[0].value, ldd.meta
    frame = rs[0].frame.select("row", "col", code.cast("int").alias("code"), *[r.value.cast("double").alias(n) for n, r in zip(layers, rs[1:])])
    index = F.col("row").cast("bigint") * meta.cols + F.col("col")
    return frame.select("*", index.alias("id"), (F.col("row") + _move(F.col("code"), 0)).alias("r2"), (F.col("col") + _move(F.col("code"), 1)).alias("c2"))


def _network(ldd: Raster, **layers: Raster) -> DataFrame:
    """_nodes of data cells with next (id, NULL in pits), step (length in cells) and the layers of the next cell as n_<layer>."""
    nodes = _nodes(ldd, **layers)
    cols = ldd.meta.cols
    if not nodes.where("code < 1 or code > 9").isEmpty():
        raise RasterError("invalid codes in the drainage network")
    if not nodes.where((F.col("r2") < 0) | (F.col("r2") >= ldd.meta.rows) | (F.col("c2") < 0) | (F.col("c2") >= cols)).isEmpty():
        raise RasterError("the drainage network leaves the map")
    here = nodes.where("code is not null").withColumn("next", F.col("r2").cast("bigint") * cols + F.col("c2"))
    there = nodes.where("code is not null").select(F.col("id").alias("next"), *[F.col(n).alias(f"n_{n}") for n in layers], F.lit(True).alias("__there"))
    step = F.when((F.col("r2") != F.col("row")) & (F.col("c2") != F.col("col")), F.lit(math.sqrt(2.0))).otherwise(F.lit(1.0))
    joined = durable(here.join(whole(there), "next", "left").withColumn("step", step), "network")
    if not joined.where("next is not null and __there is null").isEmpty():
        raise RasterError("the drainage network flows into nodata")
    return joined.drop("__there", "r2", "c2")


def _rounds(ldd: Raster) -> int:
    return math.ceil(math.log2(max(2, ldd.meta.size))) + 1


def _upstream(ldd: Raster, nodes: DataFrame, value: Column, weight: Column, combine: str) -> DataFrame:
    """(id, s): s combines what arrives from all cells upstream. combine: "sum" (weights multiply) or "max" (weights add)."""
    product = combine == "sum"
    state = durable(nodes.select("id", F.col("next").alias("jump"), weight.alias("w"), value.alias("s")), "flow")
    carried = F.col("w") * F.col("s") if product else F.col("w") + F.col("s")
    for _ in range(_rounds(ldd)):
        if state.where("jump is not null").isEmpty():
            return state.select("id", "s")
        arriving = state.where("jump is not null").groupBy(F.col("jump").alias("id")).agg((F.sum if product else F.max)(carried).alias("__in"))
        far = state.select(F.col("id").alias("jump"), F.col("jump").alias("__jump"), F.col("w").alias("__w"))
        s = F.col("s") + F.coalesce("__in", F.lit(0.0)) if product else F.greatest("s", "__in")
        w = F.col("w") * F.col("__w") if product else F.col("w") + F.col("__w")
        state = durable(whole(state).join(arriving, "id", "left").join(whole(far), "jump", "left").select("id", F.col("__jump").alias("jump"), w.alias("w"), s.alias("s")), "flow")
    raise RasterError("a loop in the drainage network")


def _downstream(ldd: Raster, nodes: DataFrame, stop: Column, add: Column, times: Column, strict: bool = True) -> DataFrame:
    """(id, last, total, product) along each cell's path to the first cell at which ``stop`` holds, or to its pit."""
    ends = stop | F.col("next").isNull()
    state = durable(nodes.select("id", F.when(ends, F.col("id")).otherwise(F.col("next")).alias("last"), F.when(ends, 0.0).otherwise(add).alias("total"), F.when(ends, 1.0).otherwise(times).alias("product")), "path")
    for _ in range(_rounds(ldd)):
        far = state.select(F.col("id").alias("last"), F.col("last").alias("__last"), F.col("total").alias("__total"), F.col("product").alias("__product"))
        joined = state.join(whole(far), "last").select("id", F.col("__last").alias("last"), (F.col("total") + F.col("__total")).alias("total"), (F.col("product") * F.col("__product")).alias("product"), (F.col("last") != F.col("__last")).alias("moved"))
        joined = durable(joined, "path")
        state = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return state
    if strict:
        raise RasterError("a loop in the drainage network")
    return state


def _result(ldd: Raster, found: DataFrame, value: Column, dtype: str) -> Raster:
    """value of (id, ...) on the whole grid; nodata where the ldd is."""
    index = F.col("row").cast("bigint") * ldd.meta.cols + F.col("col")
    out = ldd.frame.select("row", "col", index.alias("id")).join(whole(found), "id", "left").select("row", "col", value.alias("value"))
    return Raster.ingest(out, ldd.meta.replace(nodata=float("nan") if dtype.startswith("float") else -9999), dtype)


def _poison(c: Column) -> Column:
    """Nodata as NaN, which every sum and product downstream keeps."""
    return F.coalesce(c, F.lit(float("nan")))


def accuflux(ldd: Raster, freight: Raster) -> Raster:
    """Freight of each cell and all cells upstream; nodata freight makes what lies downstream nodata."""
    nodes = _network(ldd, freight=freight)
    return _result(ldd, _upstream(ldd, nodes, _poison(F.col("freight")), F.lit(1.0), "sum"), F.col("s"), "float64" if freight.dtype == "float64" else "float32")


def accufractionflux(ldd: Raster, freight: Raster, fraction: Raster) -> Raster:
    """Same, attenuated by the fraction of each cell passed, the first and the last included."""
    nodes = _network(ldd, freight=freight, fraction=fraction)
    found = _upstream(ldd, nodes, _poison(F.col("freight") * F.col("fraction")), _poison(F.col("n_fraction")), "sum")
    return _result(ldd, found, F.col("s"), "float32")


def flux_origin(ldd: Raster, freight: Raster, fraction: Raster, station: Raster) -> Raster:
    """What of a cell's freight arrives at the first station downstream, before that station's fraction; 0 if there is none.
    A cell with any station keeps its own freight times fraction; only stations of value 1 receive."""
    nodes = _network(ldd, freight=freight, fraction=fraction, station=station)
    own = F.coalesce(F.col("station") != 0, F.lit(False))
    stations = nodes.where("station = 1").select(F.col("id").alias("last"), F.lit(True).alias("__arrives"))
    passed = F.when(F.col("n_station") == 1, 1.0).otherwise(_poison(F.col("n_fraction")))
    start = F.col("freight") * F.col("fraction")
    path = _downstream(ldd, nodes, F.coalesce(F.col("station") == 1, F.lit(False)), F.lit(0.0), passed)
    found = nodes.join(whole(path), "id").join(whole(stations), "last", "left").select("id", F.when(own, _poison(start)).when(F.col("__arrives"), _poison(start * F.col("product"))).otherwise(0.0).alias("s"))
    return _result(ldd, found, F.col("s"), "float32")


def _station(ldd: Raster, stations: Raster) -> tuple[DataFrame, Column]:
    return _network(ldd, station=stations), F.coalesce(F.col("station") != 0, F.lit(False))


def ldd_cluster(ldd: Raster, ids: Raster) -> Raster:
    """Id of the first non-zero cell downstream, the cell itself included; 0 if there is none."""
    nodes, stop = _station(ldd, ids)
    path = _downstream(ldd, nodes, stop, F.lit(0.0), F.lit(1.0))
    at = nodes.select(F.col("id").alias("last"), F.col("station"))
    return _result(ldd, path.join(whole(at), "last").select("id", F.coalesce("station", F.lit(0.0)).alias("s")), F.col("s"), "int32")


def catchment(ldd: Raster, stations: Raster) -> Raster:
    """The most downstream station on the path of each cell, the cell itself included; 0 if there is none."""
    nodes, _ = _station(ldd, stations)
    state = durable(nodes.select("id", F.coalesce("next", "id").alias("last"), F.nullif(F.col("station"), F.lit(0.0)).alias("s")), "path")
    for _ in range(_rounds(ldd)):
        far = state.select(F.col("id").alias("last"), F.col("last").alias("__last"), F.col("s").alias("__s"))
        joined = durable(state.join(whole(far), "last").select("id", F.col("__last").alias("last"), F.coalesce("__s", "s").alias("s"), (F.col("last") != F.col("__last")).alias("moved")), "path")
        state = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return _result(ldd, state.select("id", F.coalesce("s", F.lit(0.0)).alias("s")), F.col("s"), "int32")
    raise RasterError("a loop in the drainage network")


def _friction(ldd: Raster) -> Column:
    return F.col("step") * ldd.meta.cell_size * (F.col("friction") + F.col("n_friction")) / 2


def ldd_dist(ldd: Raster, points: Raster, friction: Raster) -> Raster:
    """Friction distance to the first non-zero point downstream; nodata if there is none."""
    nodes = _network(ldd, station=points, friction=friction)
    path = _downstream(ldd, nodes, F.coalesce(F.col("station") != 0, F.lit(False)), _poison(_friction(ldd)), F.lit(1.0))
    at = nodes.where("station <> 0").select(F.col("id").alias("last"))
    return _result(ldd, path.join(whole(at), "last").select("id", F.col("total").alias("s")), F.col("s"), "float32")


def slopelength(ldd: Raster, friction: Raster) -> Raster:
    """Longest friction distance from any cell upstream."""
    nodes = _network(ldd, friction=friction)
    return _result(ldd, _upstream(ldd, nodes, F.lit(0.0), _friction(ldd), "max"), F.col("s"), "float32")


def max_upstream_dist(ldd: Raster) -> Raster:
    """Longest way from any cell upstream, in metres."""
    nodes = _network(ldd)
    return _result(ldd, _upstream(ldd, nodes, F.lit(0.0), F.col("step") * ldd.meta.cell_size, "max"), F.col("s"), "float32")


def ldd_validate(ldd: Raster) -> DataFrame:
    """(row, col, error): invalid (no code from 1 to 9), outside, nodata (flow into it) and loop (every cell of one)."""
    nodes = _nodes(ldd).where("code is not null")
    meta = ldd.meta
    off = (F.col("r2") < 0) | (F.col("r2") >= meta.rows) | (F.col("c2") < 0) | (F.col("c2") >= meta.cols)
    there = nodes.select(F.col("id").alias("next"), F.lit(True).alias("__there"))
    linked = nodes.withColumn("next", F.when(~off, F.col("r2").cast("bigint") * meta.cols + F.col("c2"))).join(whole(there), "next", "left")
    kind = F.when((F.col("code") < 1) | (F.col("code") > 9), "invalid").when(off, "outside").when(F.col("next").isNotNull() & F.col("__there").isNull(), "nodata")
    linked = durable(linked.withColumn("error", kind), "validate")
    sound = linked.select("id", F.when(F.col("error").isNull(), F.col("next")).alias("next"))
    path = _downstream(ldd, sound, F.lit(False), F.lit(0.0), F.lit(1.0), strict=False)
    ends = sound.where("next is null").select(F.col("id").alias("last"))
    loops = path.join(whole(ends), "last", "left_anti").select(F.col("last").alias("id")).distinct()
    found = linked.where("error is not null").select("row", "col", "error")
    return found.union(nodes.join(whole(loops), "id").select("row", "col", F.lit("loop").alias("error")))


def ldd_fix(ldd: Raster) -> Raster:
    """Invalid codes become nodata, cells that flow into nodata pits, and so does the first cell of every loop; flow off the map raises."""
    valid = Raster.of(ldd.with_value(F.when(ldd.value.between(1, 9), ldd.value)).cells(), ldd.meta, ldd.dtype)
    errors = durable(ldd_validate(valid), "errors")
    if not errors.where("error = 'outside'").isEmpty():
        raise RasterError("the drainage network leaves the map")
    pits = errors.where("error = 'nodata'").select("row", "col")
    loops = errors.where("error = 'loop'").select("row", "col")
    if not loops.isEmpty():
        nodes = _nodes(valid).join(whole(loops), ["row", "col"], "left_semi")
        from ..plans.components import components

        links = nodes.select(F.col("id").alias("a"), (F.col("r2").cast("bigint") * ldd.meta.cols + F.col("c2")).alias("b"))
        first = components(links).select("root").distinct()
        cols = F.lit(ldd.meta.cols)
        pits = pits.union(first.select(F.call_function("div", F.col("root"), cols).cast("int").alias("row"), (F.col("root") % cols).cast("int").alias("col")))
    cells = valid.cells().join(whole(pits.distinct().withColumn("__pit", F.lit(True))), ["row", "col"], "left")
    return Raster.of(cells.select("row", "col", F.when(F.col("__pit"), F.lit(5)).otherwise(F.col("value")).alias("value")), ldd.meta, ldd.dtype)
