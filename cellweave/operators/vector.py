"""Vector to raster.

Points are arithmetic and an aggregate. Lines explode into cells by an integer formula. Polygons fill by scan lines: edges meet
the row centres they cross, and the crossings of a row pair up to ranges of columns. Anti-aliased lines explode into steps along their
longer side. Exact areas are sums over the pieces of edges.

Layers are tables: points (x, y, field), lines (line_id, seq, x, y, field), polygons (fid, rings array<array<struct<x, y>>>, field);
the first ring is the outline, others are holes.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..meta import RasterError, RasterMeta
from ..raster import Raster, grid
from .multires import weighted_distribution


def over_grid(found: DataFrame, meta: RasterMeta, dtype: str, empty=None) -> Raster:
    """found (row, col, x) over the whole grid."""
    value = F.col("x") if empty is None else F.coalesce("x", F.lit(empty))
    return Raster.of(grid(found.sparkSession, meta).join(found, ["row", "col"], "left").select("row", "col", value.alias("value")), meta, dtype)


def _inside(cells: DataFrame, meta: RasterMeta) -> DataFrame:
    return cells.where((F.col("row") >= 0) & (F.col("row") < meta.rows) & (F.col("col") >= 0) & (F.col("col") < meta.cols))


def point_sums(points: DataFrame, field: str, meta: RasterMeta) -> DataFrame:
    """(row, col, x): sum of field over the points on the map."""
    row, col = meta.rc(F.col("x"), F.col("y"))
    return _inside(points.select(row.alias("row"), col.alias("col"), F.col(field).alias("__f")), meta).groupBy("row", "col").agg(F.sum("__f").alias("x"))


def add_points(points: DataFrame, field: str, meta: RasterMeta) -> Raster:
    """Sum of a field of the points in each cell; 0 where there is none."""
    return over_grid(point_sums(points, field, meta), meta, "float64", 0.0)


def _segments(lines: DataFrame, *fields: str) -> DataFrame:
    """(line_id, x0, y0, x1, y1, fields) of neighbouring points."""
    order = Window.partitionBy("line_id").orderBy("seq")
    nxt = lines.select("line_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.lead("x").over(order).alias("x1"), F.lead("y").over(order).alias("y1"), *fields)
    return nxt.where("x1 is not null")


def line_cells(lines: DataFrame, meta: RasterMeta, *fields: str) -> DataFrame:
    """(line_id, row, col, fields): the cells of Bresenham lines, each once for a line."""
    (r0, c0), (r1, c1) = meta.rc(F.col("x0"), F.col("y0")), meta.rc(F.col("x1"), F.col("y1"))
    ends = _segments(lines, *fields).select("line_id", *fields, r0.alias("r0"), c0.alias("c0"), r1.alias("r1"), c1.alias("c1"))
    n = F.greatest(F.abs(F.col("r1") - F.col("r0")), F.abs(F.col("c1") - F.col("c0")))
    at = lambda a, b: (F.col(a) + F.call_function("div", 2 * F.col("k") * F.abs(F.col(b) - F.col(a)) + F.col("n"), F.greatest(2 * F.col("n"), F.lit(1))) * F.signum((F.col(b) - F.col(a)).cast("double")).cast("int")).cast("int")
    cells = ends.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n")))).select("line_id", at("r0", "r1").alias("row"), at("c0", "c1").alias("col"), *fields)
    return _inside(cells, meta).dropDuplicates(["line_id", "row", "col"])


def draw_lines(r: Raster, lines: DataFrame) -> Raster:
    """1 in the cells of lines, the raster elsewhere."""
    return _drawn(r, line_cells(lines, r.meta))


def draw_points(r: Raster, points: DataFrame) -> Raster:
    row, col = r.meta.rc(F.col("x"), F.col("y"))
    return _drawn(r, points.select(row.alias("row"), col.alias("col")))


def _drawn(r: Raster, cells: DataFrame) -> Raster:
    hit = cells.select("row", "col", F.lit(True).alias("__hit")).distinct()
    out = r.cells().join(hit, ["row", "col"], "left").select("row", "col", F.when(F.col("__hit"), F.lit(1)).otherwise(F.col("value")).alias("value"))
    return Raster.of(out, r.meta, r.dtype)


def polygon_cells(polygons: DataFrame, meta: RasterMeta, *fields: str) -> DataFrame:
    """(fid, row, col, fields) of the cells whose centre lies in a polygon (even-odd rule)."""
    ring = polygons.select("fid", *fields, F.explode("rings").alias("ring"))
    closed = ring.withColumn("n", F.size("ring")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a, b = F.col("ring")[F.col("k")], F.col("ring")[F.col("k") + 1 - F.when(F.col("k") + 1 == F.col("n"), F.col("n")).otherwise(0)]
    edges = closed.select("fid", *fields, a["x"].alias("xa"), a["y"].alias("ya"), b["x"].alias("xb"), b["y"].alias("yb")).where("ya <> yb")
    top = meta.bounds[3]
    first = F.greatest(F.ceil((top - F.greatest("ya", "yb")) / meta.cell_size - 0.5), F.lit(0)).cast("int")
    last = F.least(F.ceil((top - F.least("ya", "yb")) / meta.cell_size - 0.5) - 1, F.lit(meta.rows - 1)).cast("int")
    spans = edges.withColumn("r0", first).withColumn("r1", last).where("r0 <= r1").withColumn("row", F.explode(F.sequence("r0", "r1")))
    y = top - (F.col("row") + 0.5) * meta.cell_size
    x = F.col("xa") + (y - F.col("ya")) * (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya"))
    met = spans.select("fid", *fields, "row", x.alias("x")).groupBy("fid", *fields, "row").agg(F.array_sort(F.collect_list("x")).alias("xs"))  # the crossings of one polygon and row
    pair = met.withColumn("p", F.explode(F.sequence(F.lit(0), F.call_function("div", F.size("xs"), F.lit(2)).cast("int") - 1)))
    col = lambda k: F.ceil((F.col("xs")[2 * F.col("p") + k] - meta.xll) / meta.cell_size - 0.5)
    ranges = pair.select("fid", *fields, "row", F.greatest(col(0), F.lit(0)).cast("int").alias("c0"), F.least(col(1) - 1, F.lit(meta.cols - 1)).cast("int").alias("c1")).where("c0 <= c1")
    return ranges.select("fid", *fields, "row", F.explode(F.sequence("c0", "c1")).alias("col"))


def touched_cells(polygons: DataFrame, meta: RasterMeta, *fields: str) -> DataFrame:
    """(fid, row, col, fields) of the cells that polygons touch: those whose centre lies inside, and those that an edge enters (the cell
    below or to the right owns its upper and left sides)."""
    ring = polygons.select("fid", *fields, F.explode("rings").alias("ring")).withColumn("n", F.size("ring"))
    closed = ring.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    a, b = F.col("ring")[F.col("k")], F.col("ring")[F.col("k") + 1 - F.when(F.col("k") + 1 == F.col("n"), F.col("n")).otherwise(0)]
    left, _, _, top = meta.bounds
    size = meta.cell_size
    at = (lambda p, n: ((p["x"] - left) / size).alias(f"x{n}")), (lambda p, n: ((top - p["y"]) / size).alias(f"y{n}"))
    edges = closed.select("fid", *fields, *[f(p, n) for f in at for p, n in ((a, 0), (b, 1))])
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    rows = edges.withColumn("row", F.explode(F.sequence(F.floor(low), F.floor(high))))
    x_at = lambda y: F.when(F.col("y0") == F.col("y1"), F.col("x0")).otherwise(F.col("x0") + (y - F.col("y0")) * F.try_divide(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    first, last = x_at(F.greatest(low, F.col("row").cast("double"))), x_at(F.least(high, F.col("row") + 1.0))
    ends = rows.withColumn("p", F.when(F.col("y0") == F.col("y1"), F.least("x0", "x1")).otherwise(F.least(first, last))).withColumn("q", F.when(F.col("y0") == F.col("y1"), F.greatest("x0", "x1")).otherwise(F.greatest(first, last)))
    crossed = ends.select("fid", *fields, F.col("row").cast("int").alias("row"), F.explode(F.sequence(F.floor("p").cast("int"), F.floor("q").cast("int"))).alias("col"))
    return _inside(crossed, meta).union(polygon_cells(polygons, meta, *fields)).dropDuplicates(["fid", "row", "col"])


def rasterize(polygons: DataFrame, field: str, meta: RasterMeta, add: bool = False, empty: float | None = None, constant: float | None = None, all_touched: bool = False) -> Raster:
    """Burns a field (or a constant) into the cells whose centre lies inside, or all that are touched: of the last polygon by fid, or the sum."""
    if add and empty is not None and math.isnan(empty):
        raise RasterError("adding to NaN")
    p = polygons if constant is None else polygons.withColumn(field, F.lit(float(constant)))
    hit = (touched_cells if all_touched else polygon_cells)(p, meta, field).groupBy("row", "col").agg((F.sum(field) if add else F.max_by(field, "fid")).alias("x"))
    return over_grid(hit, meta, "float64", 0.0 if add and empty is None else empty)


def clip_polygon(r: Raster, polygons: DataFrame) -> Raster:
    """Nodata where the centre lies in no polygon."""
    hit = polygon_cells(polygons, r.meta).select("row", "col", F.lit(True).alias("__hit")).distinct()
    out = r.cells().join(hit, ["row", "col"], "left").select("row", "col", F.when(F.col("__hit"), F.col("value")).alias("value"))
    return Raster.of(out, r.meta, r.dtype)


#: Smaller shares of a cell are rounding.
LEAST_SHARE = 1e-9


def polygon_coverage(polygons: DataFrame, meta: RasterMeta, adjust: bool = False) -> DataFrame:
    """(fid, row, col, coverage, cell_coverage): the share of the polygon's area that lies in the cell, and of the cell's area that
    lies in the polygon. adjust: cells that several polygons share are divided so that their cell coverages sum to 1.

    Edges are cut at rows and columns; a piece covers what lies to its right: part of its own cell, and the height of the piece in
    the cells after it. So a cell's area is a sum over its own pieces and one over those before it in its row.
    """
    left, _, _, top = meta.bounds
    size, col = meta.cell_size, F.col
    near = lambda ring, k, n: ring[k + 1 - F.when(k + 1 == n, n).otherwise(0)]
    area = lambda ring: F.aggregate(F.sequence(F.lit(0), F.size(ring) - 1), F.lit(0.0), lambda s, k: s + ring[k]["x"] * near(ring, k, F.size(ring))["y"] - near(ring, k, F.size(ring))["x"] * ring[k]["y"]) / 2
    rings = polygons.select(col("fid").cast("bigint").alias("fid"), F.posexplode("rings").alias("place", "ring")).where(F.size("ring") > 2).withColumn("area", area(col("ring"))).where("area <> 0")
    outline = F.when(col("place") == 0, 1).otherwise(-1)
    total = rings.groupBy("fid").agg(F.sum(outline * F.abs("area")).alias("total")).where("total > 0")
    closed = rings.withColumn("n", F.size("ring")).withColumn("k", F.explode(F.sequence(F.lit(0), F.size("ring") - 1)))
    p, q = col("ring")[col("k")], near(col("ring"), col("k"), col("n"))
    x, y = (lambda c: (c["x"] - left) / size), (lambda c: (top - c["y"]) / size)
    edges = closed.select("fid", (outline * F.signum("area")).alias("sign"), x(p).alias("x0"), y(p).alias("y0"), x(q).alias("x1"), y(q).alias("y1")).where("y0 <> y1")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    first, last = F.greatest(F.floor(low), F.lit(0)), F.least(F.ceil(high) - 1, F.lit(meta.rows - 1))
    bands = edges.where(first <= last).withColumn("row", F.explode(F.sequence(first, last)))
    at = lambda v: col("x0") + (v - col("y0")) * (col("x1") - col("x0")) / (col("y1") - col("y0"))
    ya, yb = F.greatest(low, col("row").cast("double")), F.least(high, col("row") + 1.0)
    pieces = bands.select("fid", "row", (col("sign") * F.signum(col("y1") - col("y0")) * (yb - ya)).alias("dy"), F.least(at(ya), at(yb)).alias("a"), F.greatest(at(ya), at(yb)).alias("b"))
    cells = pieces.where(col("a") < meta.cols).withColumn("c", F.explode(F.sequence(F.greatest(F.floor("a"), F.lit(-1)), F.greatest(F.least(F.floor("b"), F.lit(meta.cols - 1)), F.lit(-1)))))
    start, stop = F.when(col("c") < 0, col("a")).otherwise(F.greatest(col("a"), col("c").cast("double"))), F.least(col("b"), col("c") + 1.0)
    share = col("dy") * F.when(col("b") == col("a"), 1.0).otherwise(F.try_divide(stop - start, col("b") - col("a")))
    inside = F.when(col("c") < 0, 1.0).otherwise(1 - ((start + stop) / 2 - col("c")))  # of the cell, to the right of the piece
    own = cells.select("fid", "row", F.greatest("c", F.lit(0)).alias("c"), share.alias("d"), (share * inside).alias("s")).groupBy("fid", "row", "c").agg(F.sum("d").alias("d"), F.sum("s").alias("s"))
    along = Window.partitionBy("fid", "row").orderBy("c")
    ranged = own.withColumn("before", F.coalesce(F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).withColumn("next", F.coalesce(F.lead("c").over(along), F.lit(meta.cols)))
    after = F.abs(col("before") + col("d"))
    run = F.when((after > LEAST_SHARE) & (col("next") > col("c") + 1), F.transform(F.sequence(col("c") + 1, col("next") - 1), lambda c: F.struct(c.alias("c"), after.alias("v"))))
    spread = ranged.select("fid", "row", F.explode(F.concat(F.array(F.struct(col("c"), F.abs(col("before") + col("s")).alias("v"))), F.coalesce(run, F.array().cast("array<struct<c:bigint,v:double>>")))).alias("e"))
    found = spread.select("fid", col("row").cast("int").alias("row"), col("e.c").cast("int").alias("col"), col("e.v").alias("cell_coverage")).where(col("cell_coverage") > LEAST_SHARE)
    found = found.join(total, "fid").select("fid", "row", "col", (col("cell_coverage") * (size * size) / col("total")).alias("coverage"), "cell_coverage")
    if not adjust:
        return found
    shared = Window.partitionBy("row", "col")
    of = Window.partitionBy("fid")
    whole = F.sum("cell_coverage").over(shared)
    border = F.count("*").over(shared) > 1
    new = found.withColumn("__new", F.when(border, F.col("cell_coverage") / whole).otherwise(F.col("cell_coverage")))
    return new.withColumn("coverage", F.col("__new") / F.sum("__new").over(of)).withColumn("cell_coverage", F.col("__new")).drop("__new")


def rasterize_polygons(polygons: DataFrame, field: str, meta: RasterMeta) -> Raster:
    """Sum over polygons of the field times the share of the polygon in the cell: totals are kept."""
    found = polygon_coverage(polygons, meta).join(polygons.select(F.col("fid").cast("bigint").alias("fid"), F.col(field).alias("__f")), "fid")
    return over_grid(found.groupBy("row", "col").agg(F.sum(F.col("coverage") * F.col("__f")).alias("x")), meta, "float64")


def cutout_polygon(r: Raster, coverage: DataFrame) -> Raster:
    """Value times the covered share of the cell; nodata where nothing is covered."""
    share = coverage.groupBy("row", "col").agg(F.sum("cell_coverage").alias("x"))
    out = r.cells().join(share, ["row", "col"], "left").select("row", "col", (F.col("value") * F.col("x")).alias("value"))
    return Raster.of(out, r.meta, "float64" if r.dtype == "float64" else "float32")


def line_weights(lines: DataFrame, meta: RasterMeta, *fields: str) -> DataFrame:
    """(line_id, row, col, w, km, fields): anti-aliased weight of each cell in each line, and the line's length.

    A segment is followed along its longer side (rows on a tie). In each step of one cell it weighs what it covers of that step, which
    is shared by the two cells across in proportion to their distance, so that weights depend on the line and not on how it is cut into
    segments. Segments beyond one side of the map, and those of no length, weigh nothing; ends off the map are moved onto its edge.
    """
    left, bottom, right, top = meta.bounds
    size, col = meta.cell_size, F.col
    segments = _segments(lines, *fields)
    onto = lambda c, low, high: F.greatest(F.least(col(c), F.lit(float(high))), F.lit(float(low)))
    meets = (F.greatest("x0", "x1") >= left) & (F.greatest("y0", "y1") >= bottom) & (F.least("x0", "x1") <= right) & (F.least("y0", "y1") <= top)
    x, y = (lambda c: (onto(c, left, right) - left) / size - 0.5), (lambda c: (top - onto(c, bottom, top)) / size - 0.5)
    ends = segments.where(((col("x0") != col("x1")) | (col("y0") != col("y1"))) & meets).select(col("line_id").cast("bigint").alias("line_id"), x("x0").alias("x0"), y("y0").alias("y0"), x("x1").alias("x1"), y("y1").alias("y1"))
    flat = F.abs(col("x1") - col("x0")) > F.abs(col("y1") - col("y0"))
    along = ends.select("line_id", flat.alias("flat"), F.struct(F.when(flat, col("x0")).otherwise(col("y0")).alias("a"), F.when(flat, col("y0")).otherwise(col("x0")).alias("b")).alias("p"), F.struct(F.when(flat, col("x1")).otherwise(col("y1")).alias("a"), F.when(flat, col("y1")).otherwise(col("x1")).alias("b")).alias("q"))
    risen = along.select("line_id", "flat", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")).where("p.a < q.a")
    steps = risen.withColumn("k", F.explode(F.sequence(F.floor(col("p.a") + 0.5), F.floor(col("q.a") + 0.5))))
    at = col("p.b") + (col("q.b") - col("p.b")) / (col("q.a") - col("p.a")) * (col("k") - col("p.a"))
    share = F.least(col("q.a"), col("k") + 0.5) - F.greatest(col("p.a"), col("k") - 0.5)
    across = steps.select("line_id", "flat", "k", at.alias("at"), F.floor(at).alias("low"), share.alias("share")).withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    w = col("share") * F.when(col("side") == 1, col("at") - col("low")).otherwise(1 - (col("at") - col("low")))
    cell = col("low") + col("side")
    found = across.select("line_id", F.when(col("flat"), cell).otherwise(col("k")).cast("int").alias("row"), F.when(col("flat"), col("k")).otherwise(cell).cast("int").alias("col"), w.alias("w"))
    cells = _inside(found.where("w > 0"), meta).groupBy("line_id", "row", "col").agg(F.sum("w").alias("w"))
    length = F.sum(F.sqrt(F.pow(col("x1") - col("x0"), F.lit(2)) + F.pow(col("y1") - col("y0"), F.lit(2)))) / 1000
    about = segments.groupBy(col("line_id").cast("bigint").alias("line_id")).agg(length.alias("km"), *[F.first(f).alias(f) for f in fields])
    return cells.join(about, "line_id")


def rasterize_lines_aa(lines: DataFrame, meta: RasterMeta, field: str | None = None, normalise: bool = False, by_length: bool = False) -> Raster:
    """Sum of anti-aliased weights, times the field; normalise: a line's weights sum to 1; by_length: times its kilometres. 0 is nodata."""
    w = line_weights(lines, meta, *[field] * (field is not None))
    x = F.col("w")
    if normalise:
        x = x / F.sum("w").over(Window.partitionBy("line_id"))
    if by_length:
        x = x * F.col("km")
    if field is not None:
        x = x * F.col(field)
    found = w.select("row", "col", x.alias("x")).groupBy("row", "col").agg(F.nullif(F.sum("x"), F.lit(0.0)).alias("x"))
    return over_grid(found, meta.replace(nodata=0.0), "float64")


def line_counts(lines: DataFrame, meta: RasterMeta, field: str | None = None) -> Raster:
    """Number of lines through each cell, or the sum of their field; nodata where there is none."""
    cells = line_cells(lines, meta, *[field] * (field is not None))
    return over_grid(cells.groupBy("row", "col").agg((F.count("*").cast("double") if field is None else F.sum(field)).alias("x")), meta.replace(nodata=0.0), "float64")


def linear_distribution(zones: Raster, lines: DataFrame, amounts, anti_aliased: bool = False) -> Raster:
    """Amounts of zones spread over the cells of lines."""
    weights = rasterize_lines_aa(lines, zones.meta) if anti_aliased else line_counts(lines, zones.meta)
    return weighted_distribution(zones, weights, amounts)


def proportional_distribution(lines: DataFrame, meta: RasterMeta, field: str, anti_aliased: bool = False) -> Raster:
    """Each line's field divided evenly, or by weight, over its cells."""
    if anti_aliased:
        return rasterize_lines_aa(lines, meta, field, normalise=True)
    cells = line_cells(lines, meta, field)
    share = F.col(field) / F.count("*").over(Window.partitionBy("line_id"))
    found = cells.select("row", "col", share.alias("x")).groupBy("row", "col").agg(F.sum("x").alias("x"))
    return over_grid(found, meta.replace(nodata=0.0), "float64")


def weighted_proportional_distribution(zones: Raster, lines: DataFrame, field: str, amounts, anti_aliased: bool = False) -> Raster:
    """Amounts of zones spread over the cells of lines by their field."""
    weights = rasterize_lines_aa(lines, zones.meta, field) if anti_aliased else line_counts(lines, zones.meta, field)
    return weighted_distribution(zones, weights, amounts)
