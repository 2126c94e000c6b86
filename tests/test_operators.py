"""Small hand-written grids with known results, errors, and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave import Raster, RasterMeta
from cellweave.functions import absolute, log, rounded
from cellweave.meta import RasterError, promote
from cellweave.operators import cluster, distance, drainage, focal, local, multires, normalise, reclass, stats, vector, zonal
from cellweave.plans.ranking import global_rank
from cellweave.sources import grids, tables
from cellweave.sources.resample import resample

N = None


def ras(spark, rows, dtype="int32", cell=100.0, nodata=-9999, **more):
    data = np.ma.masked_invalid(np.array([[np.nan if x is None else x for x in r] for r in rows], float))
    return Raster.from_array(spark, data, RasterMeta(len(rows), len(rows[0]), cell_size=cell, nodata=nodata, **more), dtype)


def show(r, digits=None):
    a = r.to_array()
    return [[None if m else (round(v, digits) if digits is not None else v) for v, m in zip(x, y)] for x, y in zip(a.data.tolist(), np.ma.getmaskarray(a).tolist())]


def test_types_and_nodata(spark):
    a, b = ras(spark, [[1, N, 3]]), ras(spark, [[0, 2, 2]])
    assert promote("uint8", "uint8") == "int32" and promote("int32", "float32") == "float32" and (a + b).dtype == "int32"
    assert show(a + b) == [[1, N, 5]] and show(a / b) == [[N, N, 1.5]] and (a / b).dtype == "float32"
    assert show((a - 8) / 3) == [[-2, N, -1]]
    assert show(a & b) == [[0, N, 1]] and show(a | b) == [[1, N, 1]] and show(~b) == [[1, 0, 0]]
    with pytest.raises(RasterError):
        a / 0
    with pytest.raises(RasterError):
        a + 1.5
    with pytest.raises(RasterError):
        -ras(spark, [[1]], "uint8", nodata=255)
    with pytest.raises(RasterError):
        a + ras(spark, [[1]])
    with pytest.raises(RasterError):
        absolute(ras(spark, [[1]], "uint8", nodata=255))
    with pytest.raises(RasterError):
        rounded(a)
    assert show(rounded(ras(spark, [[-2.5, 0.5, 1.4]], "float64"))) == [[-3, 1, 1]]
    assert show(log(ras(spark, [[0.0, -1.0, 1.0]], "float64"))) == [[-math.inf, N, 0]]
    assert show(local.add_or_assign(ras(spark, [[1, N, N]]), ras(spark, [[N, 2, N]]))) == [[1, 2, N]]


def test_one_frame_needs_no_join(spark):
    frame = spark.range(6).select((F.col("id") % 2).cast("int").alias("row"), F.expr("cast(id div 2 as int)").alias("col"), F.col("id").alias("x"), (F.col("id") * 2).alias("y"))
    r = Raster.layers(frame, RasterMeta(2, 3), x="int64", y="int64")
    plan = (local.if_then_else(r["x"] > r["y"], r["x"] * 2, r["y"] + r["x"])).cells()._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_zonal(spark, tmp_path):
    c, v = ras(spark, [[1, 1, 1, 0, 2]]), ras(spark, [[1.1, 1.2, 1.3, 2.1, 3.1]], "float64")
    assert show(zonal.csum(c, v), 6) == [[3.6, 3.6, 3.6, 0, 3.1]]
    assert show(zonal.cmax(c, v)) == [[1.3, 1.3, 1.3, 0, 3.1]] and show(zonal.cmin(c, v)) == [[1.1, 1.1, 1.1, 0, 3.1]]
    assert show(zonal.cmode(ras(spark, [[1, 1, 1, 1, 2]]), ras(spark, [[1.1, 1.2, 1.3, 1.2, 3.1]], "float64"))) == [[1.2, 1.2, 1.2, 1.2, 3.1]]
    some = ras(spark, [[1.1, 1.2, 0, 1.2, 0]], "float64")
    assert show(zonal.filter_and(c, ras(spark, [[1.1, 1.2, 0, 1.2, 3.1]], "float64"))) == [[0, 0, 0, 0, 2]]
    assert show(zonal.filter_or(c, some)) == [[1, 1, 1, 0, 0]] and show(zonal.filter_not(c, some)) == [[0, 0, 0, 0, 2]]
    assert show(zonal.csum_in_buffer(ras(spark, [[1, 1, 0, 0, 2]]), ras(spark, [[1.1, 1.2, 1.3, 2.1, 2.2]], "float64"), 100), 6) == [[3.6, 3.6, 0, 0, 4.3]]
    areas, values = ras(spark, [[1, 1, 2], [1, 1, 2], [3, 3, 3]]), ras(spark, [[0, 1, 2], [3, 4, 5], [6, 7, 8]])
    assert show(zonal.choropleth_sum(values, areas)) == [[8, 8, 7], [8, 8, 7], [21, 21, 21]] and show(zonal.choropleth_average(values, areas)) == [[2, 2, 3.5], [2, 2, 3.5], [7, 7, 7]]
    cat, x = ras(spark, [[1, 1, 1, 2, 0]]), ras(spark, [[0, 12, 36, 31, 0]])
    row = lambda op: {r["zone"]: r["value"] for r in zonal.table_row(x, cat, op).collect()}
    assert row("Sum") == {0: 0, 1: 48, 2: 31} and row("Count") == {0: 1, 1: 3, 2: 1} and row("CountNonZero") == {1: 2, 2: 1} and row("MinNonZero") == {1: 12, 2: 31} and row("AverageInCat1") == {1: 16}
    with pytest.raises(RasterError):
        zonal.csum(v, v)
    zonal.write_table_row(x, cat, "Sum", f"{tmp_path}/row.tab", "first")
    zonal.write_table_row(x, cat, "Count", f"{tmp_path}/row.tab", "second", append=True)
    assert (tmp_path / "row.tab").read_text() == "\t0\t1\t2\nfirst\t0\t48\t31\nsecond\t1\t3\t1\n"
    assert local.tolerant_equal_to(v, v + 1e-9, 1e-6) and not local.tolerant_equal_to(v, v + 1.0, 1e-6)


MAJORITY = [[1, 1, 0, 2, 2, -3], [1, 1, 5, 2, 2, -3], [4, 4, 5, 3, 3, -3], [4, 4, 5, 3, 3, N], [0, 0, 6, 6, N, N], [0, 0, 6, N, N, N]]


def test_focal(spark):
    assert show(focal.majority_filter(ras(spark, MAJORITY), 200)) == [[1, 1, 1, 2, 2, -3], [1, 1, 5, 2, 2, -3], [4, 4, 5, 3, 3, -3], [4, 4, 5, 3, 3, 3], [0, 0, 6, 6, 3, -3], [0, 0, 6, 6, 6, N]]
    x = ras(spark, [[2, N, 4, 4], [4, 8, 4, 9], [2, 4, N, 7], [4, 4, 4, 8], [3, N, 4, -5]], "float64", cell=5)
    assert show(focal.sum_in_buffer(x, 5))[0] == [6, 14, 12, 17] and show(focal.sum_in_buffer(x, 10, "square"))[0] == [14, 22, 29, 21] and show(focal.max_in_buffer(x, 5))[0] == [4, 8, 4, 9]
    assert show(focal.sum_in_buffer(x, 0)) == show(local.replace_nodata(x, 0))
    y = ras(spark, [[1, 2, N, 4], [5, 6, 7, 8], [N, 10, 11, N]], "float64")
    assert show(focal.average_filter_square(y, 1), 6) == [[3.5, 4.2, 5.4, 6.333333], [4.8, 6, 6.857143, 7.5], [7, 7.8, 8.4, 8.666667]]
    assert show(focal.spread_filter(y, "linear", 0)) == show(y)
    total = stats.raster_sum(focal.spread_filter(local.replace_nodata(y, 0), "exponential", 2, normalise=True))
    assert math.isclose(total, 54, rel_tol=1e-9)
    with pytest.raises(RasterError):
        focal.voronoi(spark, RasterMeta(3, 3), [(0, 0), (0, 0)])


def test_tiles_agree_with_one_tile(spark):
    from cellweave.plans import tiles

    r = np.random.default_rng(1)
    grid = [[None if r.random() < 0.1 else int(r.integers(0, 3)) for _ in range(23)] for _ in range(17)]
    a = ras(spark, grid)
    targets, cost = ras(spark, (r.random((17, 23)) < 0.02).astype(int).tolist()), ras(spark, r.integers(1, 9, (17, 23)).tolist(), "float64")
    walls = ras(spark, (r.random((17, 23)) < 0.2).astype(int).tolist(), "uint8", nodata=255)
    runs = [lambda: focal.majority_filter(a, 200), lambda: focal.sum_in_buffer(a, 300), lambda: cluster.cluster_id(a, True), lambda: cluster.cluster_size(a), lambda: cluster.fuzzy_cluster_id(a, 200), lambda: distance.travel_distance(targets, cost), lambda: distance.closest_target(targets), lambda: zonal.csum_in_buffer(a, a, 200), lambda: focal.max_in_buffer(a, 300), lambda: focal.spread_filter(a, "linear", 2), lambda: focal.spread_filter(a, "exponential", 3, normalise=True), lambda: focal.filter_circular(a, 2, "sum"), lambda: cluster.cluster_id_with_obstacles(a, walls), lambda: cluster.fuzzy_cluster_id_with_obstacles(a, walls, 300), lambda: distance.distance(targets, walls), lambda: distance.value_at_closest_lt_travel_target(targets, cost, a, 20.0)]
    whole = [show(f(), 3) for f in runs]
    with tiles.sized(5):
        assert [show(f(), 3) for f in runs] == whole
    assert tiles.SIDE == 256


def test_clusters(spark):
    x = ras(spark, [[1, 1, 1, 1], [1, 1, 2, 3], [3, 3, 3, 3], [1, 1, 5, 5], [1, 1, 5, 1]])
    assert show(cluster.cluster_id(x)) == [[1, 1, 1, 1], [1, 1, 2, 3], [3, 3, 3, 3], [4, 4, 5, 5], [4, 4, 5, 6]]
    assert show(cluster.cluster_size(x)) == [[6, 6, 6, 6], [6, 6, 1, 5], [5, 5, 5, 5], [4, 4, 3, 3], [4, 4, 3, 1]]
    dots = [[0] * 6 for _ in range(6)]
    for i in (0, 2, 5):
        dots[i][i] = 1
    found = show(cluster.fuzzy_cluster_id(ras(spark, dots), 290))
    assert (found[0][0], found[2][2], found[5][5], found[0][1]) == (1, 1, 2, 0)
    walls = ras(spark, [[0, 1, 0], [0, 1, 0], [0, 1, 0]], "uint8", nodata=255)
    assert show(cluster.cluster_id_with_obstacles(ras(spark, [[1] * 3] * 3), walls)) == [[1, 1, 2]] * 3
    assert show(cluster.fuzzy_cluster_id_with_obstacles(ras(spark, [[1, 0, 1], [0, 0, 0], [0, 0, 0]]), walls, 300))[0] == [1, N, 2]


def test_distance(spark):
    t = [[0] * 10 for _ in range(5)]
    t[2][0], t[2][1], t[3][0], t[3][3] = 1, 2, 3, 1
    targets = ras(spark, t, "uint8", nodata=255)
    assert show(distance.distance(targets))[3] == [0, 100, 100, 0, 100, 200, 300, 400, 500, 600]
    empty = ras(spark, [[0, 0]], "uint8", nodata=255)
    assert show(distance.distance(empty)) == [[math.inf, math.inf]] and show(distance.closest_target(empty)) == [[0, 0]]
    line = ras(spark, [[1, 0, 0, 0]])
    block = ras(spark, [[0, 0, 1, 0]], "uint8", nodata=255)
    assert show(distance.distance(line, block)) == [[0, 100, math.inf, math.inf]]
    ones, cost = ras(spark, [[1, 0, 0, 0]]), ras(spark, [[1, 2, N, 1]], "float64")
    assert show(distance.sum_within_travel_distance(ones, cost, ras(spark, [[5, 6, 7, 8]]), 10)) == [[11, 0, 0, 0]]
    assert show(distance.sum_within_travel_distance(ones, cost, ras(spark, [[5, 6, 7, 8]]), 10, True)) == [[18, 0, 0, 0]]
    for bad in (0, -1):
        with pytest.raises(RasterError):
            distance.sum_within_travel_distance(ones, cost, ones, bad)


LDD = [[3, 3, 2, 1, 2], [3, 6, 2, 4, 1], [6, 3, 3, 2, 4], [9, 6, 6, 5, 4], [8, 9, 6, 8, 7]]  # keypad directions, 5 is the pit
KEYPAD = {7: (-1, -1), 8: (-1, 0), 9: (-1, 1), 4: (0, -1), 6: (0, 1), 1: (1, -1), 2: (1, 0), 3: (1, 1)}


def rivers(ldd):
    """Each cell's way down, itself first, as (row, col, length so far)."""
    for r in range(len(ldd)):
        for c in range(len(ldd[0])):
            way, y, x = [(r, c, 0.0)], r, c
            while ldd[y][x] != 5:
                dy, dx = KEYPAD[ldd[y][x]]
                y, x = y + dy, x + dx
                way.append((y, x, way[-1][2] + math.hypot(dy, dx)))
            yield way


def test_drainage_broadcasts_nothing(spark):
    """The tables of a network pack so well that Spark takes them for small."""
    n = 200
    meta = RasterMeta(n, n, cell_size=1.0, nodata=255)
    cells = spark.range(n * n).select(F.expr(f"int(id div {n})").alias("row"), F.expr(f"int(id % {n})").alias("col"), F.expr(f"if(id < {n * n - n}, 2, 5)").alias("value"), F.lit(1.0).alias("one"), F.expr(f"if(id div {n} = 150, 1, 0)").alias("station"))
    ldd, one, station = Raster.of(cells, meta, "uint8"), Raster.of(cells, meta, "float64", "one"), Raster.of(cells, meta, "int32", "station")
    limits = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.autoBroadcastJoinThreshold": "64k", "spark.sql.maxBroadcastTableSize": "100k"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        down = np.repeat(np.arange(n), n).reshape(n, n)
        assert (drainage.accuflux(ldd, one).to_array() == down + 1).all() and (drainage.accufractionflux(ldd, one, one).to_array() == down + 1).all()
        assert (drainage.max_upstream_dist(ldd).to_array() == down).all() and (drainage.slopelength(ldd, one).to_array() == down).all()
        assert (drainage.catchment(ldd, station).to_array() == (down <= 150)).all()
        assert (drainage.ldd_dist(ldd, station, one).to_array()[:151] == 150 - down[:151]).all()
    finally:
        for k in limits:
            spark.conf.unset(k)


def test_drainage(spark):
    ldd = ras(spark, LDD, "uint8", nodata=255, cell=1.0)
    amounts = [[1 + (3 * r + c) % 4 for c in range(5)] for r in range(5)]
    flux, longest = [[0.0] * 5 for _ in range(5)], [[0.0] * 5 for _ in range(5)]
    for way in rivers(LDD):
        for y, x, length in way:
            flux[y][x] += amounts[way[0][0]][way[0][1]]
            longest[y][x] = max(longest[y][x], length)
    assert show(drainage.accuflux(ldd, ras(spark, amounts, "float64", cell=1.0))) == flux
    assert np.allclose(show(drainage.max_upstream_dist(ldd)), longest)
    loop = ras(spark, [[6, 4]], "uint8", nodata=255)
    with pytest.raises(RasterError):
        drainage.accuflux(loop, ras(spark, [[1, 1]], "float64"))
    assert sorted(tuple(r) for r in drainage.ldd_validate(loop).collect()) == [(0, 0, "loop"), (0, 1, "loop")]
    assert show(drainage.ldd_fix(loop)) == [[5, 4]]
    with pytest.raises(RasterError):
        drainage.accuflux(ras(spark, [[4, 5]], "uint8", nodata=255), ras(spark, [[1, 1]], "float64"))


def test_distribution(spark):
    zones, w = ras(spark, [[1, 1, 1, 2, 2]]), ras(spark, [[1, 2, 3, 4, 5]], "float64")
    assert show(multires.weighted_distribution(zones, w, {1: 60, 2: 90}), 6) == [[10, 20, 30, 40, 50]]
    assert show(multires.weighted_distribution(zones, ras(spark, [[1, 2, N, N, N]], "float64"), {1: 60, 2: 90}), 6) == [[20, 40, N, 45, 45]]
    with pytest.raises(RasterError):
        multires.weighted_distribution(zones, w, {7: 1})
    das = multires.das_map(ras(spark, [[1, 1, 2, 2, 3]]), {0: 1, 1: 1, 2: 2, 3: 1}, zones, {1: 2, 2: 3})
    assert show(das, 6) == [[0.5, 0.5, 1, 1.5, 1.5]]
    fine = ras(spark, [[1, 2, N, 4], [5, 6, N, N]], "float64")
    assert show(multires.deflate_equal_sum(fine, 2)) == [[14, 4]]
    assert math.isclose(stats.raster_sum(multires.inflate_equal_sum(fine, 3)), stats.raster_sum(fine))
    part, rest = multires.raster_distribution(fine, ras(spark, [[0.5, N, 1, 0.25], [0, 1, 0, 0]], "float64"))
    assert show(part + rest) == show(fine)
    with pytest.raises(RasterError):
        multires.inflate(fine, 2).meta.scaled(5)


def test_masks_and_rescaling(spark):
    b = ras(spark, [[0, 32, 32], [64, 64, 64], [96, 96, 128]], "uint8", nodata=32)
    assert show(normalise.normalise_to_byte(b)) == [[0, N, N], [127, 127, 127], [191, 191, 254]]
    assert show(normalise.normalise(ras(spark, [[N, N]], "float64"))) == [[N, N]]
    a, c = ras(spark, [[1, N, 3]], "float64"), ras(spark, [[4, 9, 16]], "float64")
    assert show(normalise.weighted_sum([(a, 1), (c, 0.5)]), 4) == [[2, 3, 7.3333]] and show(normalise.weighted_product([(a, 1), (c, 0.5)]), 4) == [[0.1667, N, 1]]


def test_reclass(spark):
    table = [(0, 10), (1, N), (2, 12), (2, 13), (N, 19)]
    assert show(reclass.reclass(table, ras(spark, [[0, 1, 2, 3, N]]))) == [[10, N, 12, N, 19]]
    assert reclass.reclass([(0, 1.5)], ras(spark, [[0]])).dtype == "float32"
    assert show(reclass.nreclass([(-2, 0, 1), (0, 2, 2), (1, 5, N)], ras(spark, [[-2.0, 0.0, 0.5, 2.5, 9.0, N]], "float64"))) == [[N, 1, 2, N, N, N]]
    r = np.random.default_rng(9)
    cells = ras(spark, [[None if r.random() < 0.1 else float(x) for x in r.integers(-30, 1200, 40)] for _ in range(30)], "float64")
    ranges = [(float(a), float(a + b), N if k % 17 == 0 else float(k)) for k, (a, b) in enumerate(zip(r.integers(-20, 1100, 1500), r.integers(0, 40, 1500)))]
    expected = [[next((z for x, y, z in ranges if v is not None and x < v <= y), None) for v in row] for row in show(cells)]
    assert show(reclass.nreclass(ranges, cells)) == expected and show(reclass.nreclass([(int(a), int(b), None if c is None else int(c)) for a, b, c in ranges], cells.astype("int32"))) == expected
    for bad in ([], [(1,)], [(1, 2), (1, 2, 3)]):
        with pytest.raises(RasterError):
            reclass.reclass(bad, ras(spark, [[0]]))
    with pytest.raises(RasterError):
        reclass.nreclass([(0.5, 1, 2)], ras(spark, [[0]]))


def test_vectors(spark):
    meta = RasterMeta(5, 5)
    lines = spark.createDataFrame([(1, 0, 50.0, 50.0), (1, 1, 350.0, 150.0)], "line_id long, seq int, x double, y double")
    found = show(vector.rasterize_lines_aa(lines, meta), 6)
    assert found[3] == [N, 0.333333, 0.666667, 0.5, N] and found[4] == [0.5, 0.666667, 0.333333, N, N]
    square = spark.createDataFrame([(1, [[{"x": 100.0, "y": 100.0}, {"x": 300.0, "y": 100.0}, {"x": 300.0, "y": 300.0}, {"x": 100.0, "y": 300.0}]], 8.0)], "fid long, rings array<array<struct<x:double,y:double>>>, v double")
    clipped = show(vector.clip_polygon(ras(spark, [[1] * 4] * 4), square))
    assert clipped == [[N] * 4, [N, 1, 1, N], [N, 1, 1, N], [N] * 4]
    shifted = square.withColumn("rings", F.transform("rings", lambda g: F.transform(g, lambda p: F.struct((p["x"] + 50).alias("x"), (p["y"] - 30).alias("y")))))
    assert math.isclose(stats.raster_sum(vector.rasterize_polygons(shifted, "v", meta)), 8)
    with_hole = spark.createDataFrame([(1, [[{"x": 0.0, "y": 0.0}, {"x": 300.0, "y": 0.0}, {"x": 300.0, "y": 300.0}, {"x": 0.0, "y": 300.0}], [{"x": 100.0, "y": 100.0}, {"x": 200.0, "y": 100.0}, {"x": 200.0, "y": 200.0}, {"x": 100.0, "y": 200.0}]], 1.0)], "fid long, rings array<array<struct<x:double,y:double>>>, v double")
    assert show(vector.rasterize(with_hole, "v", RasterMeta(3, 3), add=True)) == [[1, 1, 1], [1, 0, 1], [1, 1, 1]]
    points = spark.createDataFrame([(50.0, 50.0, 2.0), (60.0, 40.0, 3.0), (900.0, 0.0, 1.0)], "x double, y double, v double")
    assert show(vector.add_points(points, "v", meta))[4] == [5, 0, 0, 0, 0]


def test_sources(spark, tmp_path):
    path = f"{tmp_path}/a.asc"
    with open(path, "w") as f:
        f.write("ncols 5\nnrows 4\nxllcorner 0\nyllcorner -10\ncellsize 2\nNODATA_value -1\n0 1 2 3 4\n5 6 7 8 9\n0 0 0 0 0\n0 0 -1 0 0\n")
    a = grids.read(spark, path, "int32")
    assert a.meta == RasterMeta(4, 5, 0.0, -10.0, 2.0, -1.0) and grids.read_metadata(spark, path) == a.meta
    assert show(a) == [[0, 1, 2, 3, 4], [5, 6, 7, 8, 9], [0] * 5, [0, 0, N, 0, 0]]
    for name in ("b.asc", "b.parquet"):
        grids.write(a, f"{tmp_path}/{name}")
        assert show(grids.read(spark, f"{tmp_path}/{name}", "int32")) == show(a)
    cut = grids.read(spark, path, "int32", extent=RasterMeta(2, 3, -2.0, -6.0, 2.0))
    assert show(cut) == [[N, 0, 1], [N, 5, 6]]
    with pytest.raises(RasterError):
        grids.read(spark, "x.tif")
    with pytest.raises(RasterError):
        grids.window(a, RasterMeta(2, 2, 0.5, -10, 2.0))
    with open(f"{tmp_path}/t.tab", "w") as f:
        f.write("1\t2,5\n2\tnan\n")
    assert tables.read_mapping(spark, f"{tmp_path}/t.tab") == [(1.0, 2.5), (2.0, None)]
    with open(f"{tmp_path}/g.json", "w") as f:
        f.write('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"v": 3}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]}}, {"type": "Feature", "properties": {"v": 4}, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]}}, {"type": "Feature", "properties": {"v": 5}, "geometry": {"type": "Point", "coordinates": [1, 1]}}]}')
    layer = tables.read_geojson(spark, f"{tmp_path}/g.json")
    assert stats.raster_sum(vector.rasterize_polygons(tables.polygons_of(layer, "v"), "v", RasterMeta(4, 4, cell_size=1.0))) == 3
    with open(f"{tmp_path}/g.geojsonl", "w") as f:
        f.write('{"type": "Feature", "properties": {"v": 5}, "geometry": {"type": "Point", "coordinates": [1, 1]}}\n\n{"type": "Feature", "properties": {"v": 6}, "geometry": {"type": "Point", "coordinates": [2, 1]}}\n')
    assert sorted(x["v"] for x in tables.points_of(tables.read_geojson(spark, f"{tmp_path}/g.geojsonl"), "v").collect()) == [5, 6]
    assert tables.lines_of(layer, "v").count() == 2 and tables.points_of(layer, "v").first()["v"] == 5
    up = resample(ras(spark, [[1, 2], [3, 4]], "float64"), RasterMeta(4, 4, cell_size=50.0), "nearest")
    assert show(up) == [[1, 1, 2, 2], [1, 1, 2, 2], [3, 3, 4, 4], [3, 3, 4, 4]]
    for name in ("bilinear", "cubic", "cubic_spline", "lanczos"):
        flat = resample(ras(spark, [[5, 5, 5], [5, N, 5]], "float64"), RasterMeta(4, 6, cell_size=50.0), name)
        assert {v for r in show(flat, 6) for v in r} <= {5.0, N}


def test_grids_of_many_parts(spark, tmp_path):
    """Every part but the first lacks the header; blank lines and several splits of a file are numbered through."""
    r = np.random.default_rng(5)
    a = ras(spark, r.integers(0, 9, (400, 7)).tolist())
    for key, value in (("spark.sql.adaptive.coalescePartitions.enabled", "false"), ("spark.sql.shuffle.partitions", "9"), ("spark.sql.files.maxPartitionBytes", "600b")):
        spark.conf.set(key, value)
    try:
        grids.write(a, f"{tmp_path}/parts.asc")
        assert len([x for x in __import__("os").listdir(f"{tmp_path}/parts.asc") if x.startswith("part-")]) >= 4
        assert show(grids.read(spark, f"{tmp_path}/parts.asc", "int32")) == show(a)
        with open(f"{tmp_path}/one.asc", "w") as f:
            f.write("ncols 7\n\nnrows 400\ncellsize 100\nNODATA_value -9999\n" + "\n".join(" ".join(map(str, x)) + "\n" * (i % 3 == 0) for i, x in enumerate(show(a))))
        assert show(grids.read(spark, f"{tmp_path}/one.asc", "int32")) == show(a)
    finally:
        for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.maxPartitionBytes"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    with pytest.raises(RasterError):
        (tmp_path / "empty.asc").write_text("")
        grids.read(spark, f"{tmp_path}/empty.asc")


def test_arrays_bytes_bands_and_command_line(spark, tmp_path, capsys):
    from cellweave.__main__ import main

    meta = RasterMeta(2, 3, nodata=-1.0)
    grids.write_array(spark, np.ma.masked_less(np.array([[1.0, -1.0, 2.5], [4.0, 0.0, 3.0]]), 0), meta, f"{tmp_path}/a.asc")
    found, same = grids.read_array(spark, f"{tmp_path}/a.asc")
    assert found.tolist() == [[1.0, N, 2.5], [4.0, 0.0, 3.0]] and same == meta
    assert show(grids.read_bytes(spark, b"ncols 2\nnrows 2\ncellsize 1\nNODATA_value 9\n1 9\n3 4\n")) == [[1, N], [3, 4]]
    grids.write_colormapped(ras(spark, [[0, 255, N]]), f"{tmp_path}/c.parquet", [(i, 255 - i, 7, 255) for i in range(256)], 0, 255)
    assert [show(grids.read(spark, f"{tmp_path}/c.parquet", band=k))[0] for k in (1, 2, 3, 4)] == [[0, 255, 0], [255, 0, 0], [7, 7, 0], [255, 255, 0]]
    assert main(["convert", f"{tmp_path}/a.asc", f"{tmp_path}/b.parquet", "--type", "float32", "--epsg", "31370"], spark) == [f"{tmp_path}/b.parquet written"]
    assert {"epsg", "rows: 2", "type: float32", "sum: 10.5"} & set(main(["info", f"{tmp_path}/b.parquet"], spark)) == {"rows: 2", "type: float32", "sum: 10.5"}
    assert grids.read(spark, f"{tmp_path}/b.parquet").meta.epsg == 31370 and capsys.readouterr().out
    import copy

    assert show(copy.deepcopy(ras(spark, [[1]]))) == [[1]]


def test_projection_near_and_beyond_poles(spark):
    beyond = Raster.from_array(spark, np.arange(8).reshape(4, 2), RasterMeta(4, 2, 3.0, 0.0, 30.0, -1.0, "EPSG:4326"), "int32")
    there = grids.warp_raster(beyond, 3857)
    assert math.isclose(there.meta.bounds_geo[3], 75.0) and show(there) == [[2, 3], [4, 5], [4, 5], [6, 7]]
    world = Raster.from_array(spark, np.arange(6).reshape(6, 1), RasterMeta(6, 1, 0.0, -90.0, 30.0, -1.0, "EPSG:4326"), "int32")
    found = [v for (v,) in show(grids.warp_raster(world, 3857))]
    assert set(found) == set(range(6)) and found == sorted(found)
    with pytest.raises(RasterError):
        grids.warp_raster(beyond.with_meta(yll=90.0), 3857)


def test_projections(spark):
    meta = RasterMeta(4, 5, 3.0, 50.0, 0.5, -1.0, "EPSG:4326")
    r = Raster.from_array(spark, np.arange(20).reshape(4, 5), meta, "int32")
    assert grids.warp_raster(r, 4326) is r and meta.bounds_geo == (3.0, 50.0, 5.5, 52.0)
    there = grids.warp_raster(r, 3857)
    assert np.allclose(there.meta.bounds_geo[0::2], (3.0, 5.5)) and math.isclose(there.meta.bounds_geo[3], 52.0) and there.meta.cols == 5 and there.meta.rows > 4
    assert [row[0] for row in show(there)][0] == 0 and {v for row in show(there) for v in row} - {N} == set(range(20))
    with pytest.raises(RasterError):
        grids.warp_raster(r, 31370)
    with pytest.raises(RasterError):
        _ = RasterMeta(1, 1).bounds_geo


def test_short_segments_weigh_as_one_line(spark):
    """However a line is cut, with repeated points, the weights are those of the whole."""
    meta = RasterMeta(6, 6, cell_size=1.0)
    ends = ((0.7, 1.2), (5.1, 3.4))
    cuts = [0, 0, 0.013, 0.02, 0.1, 0.1, 0.33, 0.5, 0.77, 0.78, 0.99, 1]
    points = [(1, k, ends[0][0] + t * (ends[1][0] - ends[0][0]), ends[0][1] + t * (ends[1][1] - ends[0][1])) for k, t in enumerate(cuts)]
    whole = [(1, 0, *ends[0]), (1, 1, *ends[1])]
    a, b = (show(vector.rasterize_lines_aa(spark.createDataFrame(x, "line_id long, seq int, x double, y double"), meta), 9) for x in (points, whole))
    assert a == b and math.isclose(sum(v or 0 for row in a for v in row), 4.4)


def test_polygon_areas_against_clipping(spark):
    """Stars with holes, in both directions, partly off the map, and one on the lattice."""
    r, meta, polygons = np.random.default_rng(3), RasterMeta(7, 9, -3.0, 1.0, 2.0), []
    for f in range(8):
        x, y, n = r.uniform(-4, 16), r.uniform(0, 16), int(r.integers(3, 9))
        star = lambda n, least, more: [(x + (least + more * r.random()) * math.cos(2 * math.pi * k / n), y + (least + more * r.random()) * math.sin(2 * math.pi * k / n)) for k in range(n)]  # noqa: E731, B023
        ring = star(n, 2, 5)
        polygons.append((f, [ring[:: -1 if f % 2 else 1]] + [star(5, 0.7, 0)] * (f % 3 == 0)))
    polygons.append((20, [[(1.0, 3.0), (5.0, 3.0), (5.0, 7.0), (1.0, 7.0)]]))
    frame = spark.createDataFrame([(f, [[{"x": a, "y": b} for a, b in g] for g in gs]) for f, gs in polygons], "fid long, rings array<array<struct<x:double,y:double>>>")
    found = {(x["fid"], x["row"], x["col"]): (x["coverage"], x["cell_coverage"]) for x in vector.polygon_coverage(frame, meta).collect()}

    def half(ring, axis, at, above):
        out = []
        for p, q in zip(ring, ring[1:] + ring[:1]):
            if (p[axis] >= at) == above:
                out.append(p)
            if (p[axis] >= at) != (q[axis] >= at):
                t = (at - p[axis]) / (q[axis] - p[axis])
                out.append(tuple(at if k == axis else p[k] + t * (q[k] - p[k]) for k in (0, 1)))
        return out

    area = lambda ring: abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1]))) / 2
    for f, gs in polygons:
        for row in range(7):
            for col in range(9):
                x, y = -3 + 2 * col, 15 - 2 * row
                parts = [area(half(half(half(half(g, 0, x, True), 0, x + 2, False), 1, y - 2, True), 1, y, False)) for g in gs]
                cell = parts[0] - sum(parts[1:])
                a, b = found.get((f, row, col), (0.0, 0.0))
                assert math.isclose(b, cell / 4, abs_tol=1e-8) and math.isclose(a, cell / (area(gs[0]) - sum(map(area, gs[1:]))), abs_tol=1e-8)


def test_stream_of_points_by_time_window(spark, tmp_path):
    from cellweave.streaming.points import stream_point_sums

    rows = [(50.0, 50.0, 2.0, "2024-01-01 10:05:00"), (60.0, 40.0, 3.0, "2024-01-01 10:55:00"), (50.0, 50.0, 4.0, "2024-01-01 11:00:00"), (950.0, 50.0, 9.0, "2024-01-01 11:00:00"), (150.0, 50.0, 1.0, "2024-01-01 10:30:00")]
    points = spark.createDataFrame(rows, "x double, y double, v double, t string").withColumn("t", F.to_timestamp("t"))
    points.write.parquet(f"{tmp_path}/points")
    stream = spark.readStream.schema(points.schema).parquet(f"{tmp_path}/points")
    sums = stream_point_sums(stream, "v", RasterMeta(2, 3), time="t", late="10 minutes", window="1 hour")
    sums.writeStream.outputMode("complete").format("memory").queryName("window_sums").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    found = sorted((x["window"]["start"].hour, x["row"], x["col"], x["x"]) for x in spark.table("window_sums").collect())
    assert found == [(10, 1, 0, 5.0), (10, 1, 1, 1.0), (11, 1, 0, 4.0)]
    assert sorted((x["row"], x["col"], x["x"]) for x in stream_point_sums(points, "v", RasterMeta(2, 3)).collect()) == [(1, 0, 9.0), (1, 1, 1.0)]


def test_global_rank(spark):
    ranked = global_rank(spark.range(1000).select(((F.col("id") * 7919) % 1009).alias("k")), "k").collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: r["k"])] == list(range(1, 1001))


def test_empty_and_nodata_only(spark):
    none = ras(spark, [[N, N], [N, N]])
    for r in (zonal.csum(none, none), cluster.cluster_id(none), focal.majority_filter(none, 100), distance.travel_distance(none, none.astype("float64"))):
        assert show(r) == [[N, N], [N, N]]
    assert stats.all_of(none) and not stats.any_of(none) and stats.contains_only_nodata(none) and stats.raster_sum(none) == 0
    with pytest.raises(RasterError):
        stats.raster_max(none)
