"""Registered queries over the star-schema tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import absolute, cos, exp, log, log10, power, rounded, sin
from ..meta import RasterMeta, is_float
from ..operators import cluster, distance, drainage, focal, local, multires, normalise, reclass, stats, vector, zonal
from ..raster import Raster
from ..sources import grids as io
from ..sources import resample as rs
from . import tiles
from .grids import PartGrid, part_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _shown(x, digits: int | None):
    """Rasters as (row, col, value) with value BIGINT, or DOUBLE rounded; tables as they are."""
    if not isinstance(x, Raster):
        return x
    value = F.col("value").cast("double") if is_float(x.dtype) else F.col("value").cast("bigint")
    return x.cells().select("row", "col", (F.round(value, digits) if digits is not None and is_float(x.dtype) else value).alias("value"))


def q(key: str, f: Callable[[PartGrid], object], sql: str | None = None, *, value: str | None = None, where: str = "", digits: int | None = None, real: bool = False, ctes: str = "") -> None:
    """Registers a query on the part grid. value: an expression over g for cell-wise checks; real: it is a 32-bit float."""
    QUERIES[key] = lambda spark, sf_dir: _shown(f(PartGrid(spark, sf_dir)), digits)
    if value is not None:
        v = f"CAST({value} AS FLOAT)" if real else value
        v = f"CAST({v} AS DOUBLE)" if digits is not None or real else v
        sql = f"SELECT row, col, {f'round({v}, {digits})' if digits is not None else v} AS value FROM g {where}"
    if sql is not None:
        SQL[key] = f"WITH RECURSIVE {part_sql()}{', ' + ctes if ctes else ''} {sql}"


def _int(e: str) -> str:
    return f"CAST({e} AS BIGINT)"


def _cells(value: str, source: str, digits: int | None = None) -> str:
    return f"SELECT row, col, {f'round({value}, {digits})' if digits is not None else value} AS value FROM {source}"


def _frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def _scalar(g: PartGrid, **values) -> DataFrame:
    kinds = {k: "boolean" if isinstance(v, bool) else "double" for k, v in values.items()}
    return _frame(g.spark, [tuple(values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))


# arithmetic, comparison, logic

for _key, _op, _sql in (("add", lambda a, b: a + b, "a + b"), ("sub", lambda a, b: a - b, "a - b"), ("mul", lambda a, b: a * b, "a * b")):
    q(_key, lambda g, op=_op: op(g.a, g.b), value=_int(_sql))
q("add_joined", lambda g: g.a + g.apart("b"), value=_int("a + b"))
q("div", lambda g: g.a / g.b, value="a / nullif(b, 0)", digits=4, real=True)
q("add_scalar", lambda g: g.a + 3, value=_int("a + 3"))
q("sub_scalar", lambda g: g.a - 3, value=_int("a - 3"))
q("rsub_scalar", lambda g: 3 - g.a, value=_int("3 - a"))
q("mul_scalar", lambda g: g.f * 2.5, value="f * 2.5::DOUBLE")
q("div_scalar", lambda g: (g.a - 20) / 7, value=_int("(a - 20) // 7"))
SQL["div_scalar"] = SQL["div_scalar"].replace("(a - 20) // 7", "trunc((a - 20) / 7.0)")
q("div_scalar_float", lambda g: g.f / 4, value="f / 4")
q("rdiv_scalar", lambda g: 100 / g.b, value="100.0 / nullif(b, 0)", digits=4, real=True)
q("negate", lambda g: -g.a, value=_int("-a"))
q("add_or_assign", lambda g: local.add_or_assign(g.a, g.b), value=_int("CASE WHEN b IS NULL THEN a ELSE coalesce(a, 0) + b END"))
for _key, _op, _sql in (("eq", lambda a, b: a == b, "="), ("ne", lambda a, b: a != b, "<>"), ("lt", lambda a, b: a < b, "<"), ("le", lambda a, b: a <= b, "<="), ("gt", lambda a, b: a > b, ">"), ("ge", lambda a, b: a >= b, ">=")):
    q(_key, lambda g, op=_op: op(g.a, g.cls), value=_int(f"a {_sql} cls"))
    q(f"{_key}_scalar", lambda g, op=_op: op(g.a, 25), value=_int(f"a {_sql} 25"))
_known = "CASE WHEN {0} IS NOT NULL AND {1} IS NOT NULL THEN CAST({2} AS BIGINT) END"
q("logical_and", lambda g: g.b & g.cls, value=_known.format("b", "cls", "b <> 0 AND cls <> 0"))
q("logical_or", lambda g: g.b | g.cls, value=_known.format("b", "cls", "b <> 0 OR cls <> 0"))
q("logical_not", lambda g: ~g.b, value=_int("b = 0"))
q("logical_and_n", lambda g: local.logical_and(g.a, g.b, g.cls), value="CASE WHEN a IS NOT NULL AND b IS NOT NULL AND cls IS NOT NULL THEN CAST(a <> 0 AND b <> 0 AND cls <> 0 AS BIGINT) END")
q("logical_or_n", lambda g: local.logical_or(g.b, g.cls, g.wall), value="CASE WHEN b IS NOT NULL AND cls IS NOT NULL THEN CAST(b <> 0 OR cls <> 0 OR wall <> 0 AS BIGINT) END")
q("any", lambda g: _scalar(g, value=stats.any_of(g.b)), "SELECT bool_or(b <> 0) AS value FROM g")
q("all", lambda g: _scalar(g, value=stats.all_of(g.b)), "SELECT coalesce(bool_and(b <> 0), true) AS value FROM g")
q("is_nodata", lambda g: local.is_nodata(g.a), value=_int("a IS NULL"))
q("is_data", lambda g: local.is_data(g.a), value=_int("a IS NOT NULL"))
q("contains_only_nodata", lambda g: _scalar(g, value=stats.contains_only_nodata(g.a), some=stats.has_nodata(g.a)), "SELECT count(a) = 0 AS value, count(a) < count(*) AS some FROM g")
q("replace_nodata", lambda g: local.replace_nodata(g.a, -1), value=_int("coalesce(a, -1)"))
q("turn_value_into_nodata", lambda g: local.turn_value_into_nodata(g.b, 3), value=_int("nullif(b, 3)"))
q("replace_value", lambda g: local.replace_value(g.b, 3, 99), value=_int("CASE WHEN b = 3 THEN 99 ELSE b END"))
q("equal_one_of", lambda g: local.equal_one_of(g.a, [1, 5, 9]), value=_int("a IN (1, 5, 9)"))
q("raster_equal", lambda g: _scalar(g, same=local.raster_equal(g.a, g.apart("a")), other=local.raster_equal(g.a, g.b)), "SELECT true AS same, count(*) FILTER (a IS DISTINCT FROM b) = 0 AS other FROM g")
q("allclose", lambda g: _scalar(g, same=local.all_close(g.f, g.f + 1e-9), other=local.all_close(g.f, g.h)), "SELECT true AS same, count(*) FILTER (f IS DISTINCT FROM h) = 0 AS other FROM g")
q("isclose", lambda g: local.is_close(g.f, g.h, 0.5), value="CASE WHEN f IS NULL AND h IS NULL THEN 1 WHEN f IS NULL OR h IS NULL THEN 0 ELSE CAST(abs(f - h) <= 1e-8 + 0.5 * abs(h) AS BIGINT) END::BIGINT")
q("if_then", lambda g: local.if_then(g.wall, g.a), value=_int("CASE WHEN wall <> 0 THEN a END"))
q("if_then_else", lambda g: local.if_then_else(g.b, g.a, -1), value=_int("CASE WHEN b <> 0 THEN a WHEN b = 0 THEN -1 END"))
q("clip", lambda g: local.clip(g.a, 10, 30), value=_int("CASE WHEN a < 10 THEN 10 WHEN a > 30 THEN 30 ELSE a END"))
q("clip_low", lambda g: local.clip_low(g.a, 10), value=_int("CASE WHEN a < 10 THEN 10 ELSE a END"))
q("clip_high", lambda g: local.clip_high(g.a, 30), value=_int("CASE WHEN a > 30 THEN 30 ELSE a END"))
q("udf_transform", lambda g: local.transform(lambda x, y: x * 10 + y, g.a, g.b), value=_int("a * 10 + b"))
q("udf_transform_arrays", lambda g: local.transform_arrays(lambda x, y: x * 10 + y, g.a, g.b), value=_int("a * 10 + b"))

# mathematics

q("abs", lambda g: absolute(g.f), value="abs(f)")
q("round", lambda g: rounded(g.f), value="CASE WHEN f < 0 THEN -floor(-f + 0.5) ELSE floor(f + 0.5) END")
q("sin", lambda g: sin(g.f), value="sin(f)", digits=8)
q("cos", lambda g: cos(g.f), value="cos(f)", digits=8)
q("log", lambda g: log(g.h), value="ln(nullif(h, 0))", digits=8)
q("log10", lambda g: log10(g.h), value="log10(nullif(h, 0))", digits=8)
q("exp", lambda g: exp(g.h), value="exp(h)", digits=4)
q("pow", lambda g: power(g.h, g.fraction), value="pow(h, fraction)", digits=8)
q("pow_scalar", lambda g: power(g.h, 2), value="pow(h, 2)", digits=8)
q("mean", lambda g: _scalar(g, value=stats.mean(g.f)), "SELECT avg(f) AS value FROM g")

# construction and conversion

q("create_fill", lambda g: Raster.filled(g.spark, g.meta, "int32", 7), value="7::BIGINT")
q("from_table", lambda g: Raster.ingest(g.frame.withColumn("x", F.coalesce("a", F.lit(-9999))), g.meta, "int32", "x"), value=_int("a"))
q("cast", lambda g: g.f.astype("int32"), value=_int("trunc(f)"))
q("fill", lambda g: local.fill_values(g.a, 5), value=_int("CASE WHEN a IS NOT NULL THEN 5 END"))
q("fill_random", lambda g: local.fill_random(g.a, 1, 6, seed=1).cells().select("row", "col", F.col("value").between(1, 6).alias("inside")), "SELECT row, col, true AS inside FROM g")
q("make_nodata", lambda g: local.make_nodata(g.a), value="CAST(NULL AS BIGINT)")
q("set_value", lambda g: g.a.set_value(1, 2, 77), value=_int("CASE WHEN row = 1 AND col = 2 THEN 77 ELSE a END"))
q("rc_to_xy", lambda g: g.frame.select("row", "col", *[c.alias(n) for n, c in zip("xy", g.meta.xy(F.col("row"), F.col("col")))]), "SELECT row, col, (col + 0.5) * 100.0::DOUBLE AS x, (SELECT rows FROM n) * 100.0::DOUBLE - (row + 0.5) * 100.0::DOUBLE AS y FROM g")
q("xy_to_rc", lambda g: g.frame.select("id", *[c.alias(n) for n, c in zip(("row", "col"), g.meta.rc(F.col("id") * 3.0, F.col("id") * 5.0))]), "SELECT id, CAST(floor(((SELECT rows FROM n) * 100.0::DOUBLE - id * 5.0) / 100.0::DOUBLE) AS INT) AS row, CAST(floor(id * 3.0::DOUBLE / 100.0::DOUBLE) AS INT) AS col FROM g")
_window = lambda g: RasterMeta(4, 6, 37 * 100.0, g.meta.bounds[3] - 300.0)  # noqa: E731  rows -1 to 2, columns 37 to 42
q("read_extent", lambda g: io.window(g.a, _window(g)), "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(a AS BIGINT) AS value FROM range(4) AS x(r), range(6) AS y(c) LEFT JOIN g ON g.row = r - 1 AND g.col = c + 37")
q("sub_raster", lambda g: io.sub_raster(g.a, _window(g)), "SELECT row, CAST(col - 37 AS INT) AS col, CAST(a AS BIGINT) AS value FROM g WHERE row <= 2 AND col >= 37")
q("sub_area", lambda g: io.sub_area(g.a, 1, 38, 2, 9, data_only=True), "SELECT row, col, a AS value FROM g WHERE row BETWEEN 1 AND 2 AND col >= 38 AND a IS NOT NULL")
q("colormap", lambda g: io.apply_colormap(g.a, [(i, 255 - i, i // 2, 255) for i in range(256)], 0, 51), "SELECT row, col, CAST(coalesce(i, 0) AS SMALLINT) AS r, CAST(coalesce(255 - i, 0) AS SMALLINT) AS g, CAST(coalesce(i // 2, 0) AS SMALLINT) AS b, CAST(CASE WHEN i IS NULL THEN 0 ELSE 255 END AS SMALLINT) AS a FROM (SELECT row, col, CAST(floor(a * 5.0 + 0.5) AS INT) AS i FROM g)")


def _written(g: PartGrid, suffix: str) -> Raster:
    from .durable import shared_dir

    path = f"{shared_dir(g.spark)}/grid-{abs(hash(g.sf_dir))}-{suffix}"
    io.write(g.a, path)
    return io.read(g.spark, path, "int32")


q("write_roundtrip", lambda g: _written(g, "a.parquet"), value=_int("a"))
q("read_asc", lambda g: _written(g, "a.asc"), value=_int("a"))

# statistics

q("raster_sum", lambda g: _scalar(g, value=stats.raster_sum(g.a)), "SELECT sum(a)::DOUBLE AS value FROM g")
q("raster_min", lambda g: _scalar(g, value=float(stats.raster_min(g.a))), "SELECT min(a)::DOUBLE AS value FROM g")
q("raster_max", lambda g: _scalar(g, value=float(stats.raster_max(g.a))), "SELECT max(a)::DOUBLE AS value FROM g")
q("minmax", lambda g: _scalar(g, low=stats.minmax(g.f)[0], high=stats.minmax(g.f)[1]), "SELECT min(f)::DOUBLE AS low, max(f)::DOUBLE AS high FROM g")
q("minmax_cell", lambda g: stats.minmax_cells(g.a), "SELECT (SELECT min(a) FROM g) AS min, arg_min(row, (a, id)) AS min_row, arg_min(col, (a, id)) AS min_col, (SELECT max(a) FROM g) AS max, arg_max(row, (a, id)) AS max_row, arg_max(col, (a, id)) AS max_col FROM g WHERE a IS NOT NULL")
q("max_n", lambda g: local.maximum(g.a, g.b, g.cls), value=_int("CASE WHEN a IS NOT NULL AND b IS NOT NULL AND cls IS NOT NULL THEN greatest(a, b, cls) END"))
q("min_n", lambda g: local.minimum(g.a, g.b, g.cls), value=_int("CASE WHEN a IS NOT NULL AND b IS NOT NULL AND cls IS NOT NULL THEN least(a, b, cls) END"))
q("raster_stats", lambda g: stats.raster_stats(g.f).withColumn("sigma_nonzero", F.round("sigma_nonzero", 6)), "SELECT count(*) FILTER (trunc(f) < 0) AS negative, count(*) FILTER (f > 0) AS positive, count(*) FILTER (f <> 0) AS nonzero, count(*) FILTER (f = 0) AS zero, 0::BIGINT AS nan, count(*) FILTER (f IS NULL) AS nodata, sum(f)::DOUBLE AS sum, min(f)::DOUBLE AS min, max(f)::DOUBLE AS max, round(stddev_samp(nullif(f, 0)), 6) AS sigma_nonzero FROM g")
q("histogram", lambda g: stats.histogram(g.a), "SELECT a AS bin, count(*) AS count FROM g WHERE a IS NOT NULL GROUP BY a")
q("unique_values", lambda g: stats.unique_values(g.b), "SELECT DISTINCT b AS value FROM g WHERE b IS NOT NULL")
q(
    "raster_diff", lambda g: stats.raster_diff(g.b, g.cls),
    "SELECT count(*) FILTER (b = cls) AS equal, count(*) FILTER (b = 0 AND cls <> 0) AS zero_to_nonzero, count(*) FILTER (b <> 0 AND cls = 0) AS nonzero_to_zero, count(*) FILTER (b IS NULL AND cls = 0) AS nodata_to_zero, count(*) FILTER (b IS NULL AND cls <> 0) AS nodata_to_nonzero, "
    "count(*) FILTER (b = 0 AND cls IS NULL) AS zero_to_nodata, count(*) FILTER (b <> 0 AND cls IS NULL) AS nonzero_to_nodata, count(*) FILTER (b <> cls AND b <> 0 AND cls <> 0) AS different FROM g",
)
q("info_summary", lambda g: stats.info_summary(g.f), "SELECT CAST((SELECT rows FROM n) AS INT) AS rows, 40 AS cols, min(f)::DOUBLE AS min, max(f)::DOUBLE AS max, sum(f)::DOUBLE AS sum, count(*) FILTER (f IS NULL) AS nodata, count(*) FILTER (f = 0) AS zero, count(*) FILTER (f <> 0) AS nonzero, count(*) FILTER (trunc(f) < 0) AS negative, sum(f)::DOUBLE / count(f) AS average, sum(f)::DOUBLE / count(*) FILTER (f <> 0) AS average_nonzero FROM g")

# zonal

_zonal = lambda agg, where="b <> 0": f"SELECT g.row, g.col, CAST(CASE WHEN g.zone IS NULL THEN NULL ELSE coalesce(z.x, 0) END AS BIGINT) AS value FROM g LEFT JOIN (SELECT zone, {agg} AS x FROM g WHERE zone <> 0 AND {where} GROUP BY zone) AS z ON g.zone = z.zone"
q("csum", lambda g: zonal.csum(g.zone, g.b), _zonal("sum(b)"))
q("cmin", lambda g: zonal.cmin(g.zone, g.b), _zonal("min(b)"))
q("cmax", lambda g: zonal.cmax(g.zone, g.b), _zonal("max(b)"))
q("csum_map", lambda g: zonal.csum_map(g.zone, g.b), "SELECT zone, CAST(sum(b) AS BIGINT) AS sum FROM g WHERE zone <> 0 AND b <> 0 GROUP BY zone")
q("cmode", lambda g: zonal.cmode(g.zone, g.b), "SELECT g.row, g.col, CAST(coalesce(m.b, 0) AS BIGINT) AS value FROM g LEFT JOIN (SELECT zone, b FROM (SELECT zone, b, count(*) AS n FROM g WHERE zone <> 0 AND b IS NOT NULL GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY zone ORDER BY n DESC, b) = 1) AS m ON g.zone = m.zone")
_filter = "SELECT g.row, g.col, CAST(CASE WHEN g.cls IS NOT NULL THEN CASE WHEN {0} THEN g.cls ELSE 0 END END AS BIGINT) AS value FROM g LEFT JOIN (SELECT cls, bool_or(hit) AS hits, bool_and(hit) AS every FROM (SELECT cls, b <> 0 AND zone < 3 AS hit FROM g WHERE cls <> 0) GROUP BY cls) AS z ON g.cls = z.cls"
_hit = lambda g: local.logical_and(g.b, g.full_zone < 3)
_filter = _filter.replace("b <> 0 AND zone < 3 AS hit", "CASE WHEN b IS NOT NULL THEN b <> 0 AND full_zone < 3 END AS hit")
q("filter_or", lambda g: zonal.filter_or(g.cls, _hit(g)), _filter.format("hits"))
q("filter_and", lambda g: zonal.filter_and(g.cls, _hit(g)), _filter.format("every"))
q("filter_not", lambda g: zonal.filter_not(g.cls, _hit(g)), _filter.format("NOT hits"))
q("csum_in_buffer", lambda g: zonal.csum_in_buffer(g.zone, g.b, 200), "SELECT g.row, g.col, CAST(CASE WHEN g.zone IS NOT NULL THEN coalesce(x, 0) END AS BIGINT) AS value FROM g LEFT JOIN (SELECT zone, sum(b) AS x FROM (SELECT DISTINCT v.id, v.b, z.zone FROM g AS v JOIN g AS z ON abs(v.row - z.row) <= 2 AND abs(v.col - z.col) <= 2 AND pow(v.row - z.row, 2) + pow(v.col - z.col, 2) <= 4 WHERE v.b <> 0 AND z.zone > 0) GROUP BY zone) AS t ON g.zone = t.zone")
q("choropleth_sum", lambda g: zonal.choropleth_sum(g.a, g.zone), "SELECT row, col, CAST(CASE WHEN zone IS NOT NULL THEN coalesce(sum(a) OVER (PARTITION BY zone), 0) END AS BIGINT) AS value FROM g")
q("choropleth_average", lambda g: zonal.choropleth_average(g.f, g.zone), "SELECT row, col, round(CASE WHEN zone IS NOT NULL THEN coalesce(sum(f) OVER (PARTITION BY zone), 0)::DOUBLE / count(*) OVER (PARTITION BY zone) END, 8) AS value FROM g", digits=8)
q("sum_mask", lambda g: zonal.sum_mask(g.a, g.zone), "SELECT zone, CAST(sum(a) AS BIGINT) AS sum FROM g WHERE zone IS NOT NULL AND a IS NOT NULL GROUP BY zone")
q("sum_mask_ids", lambda g: zonal.sum_mask(g.a, g.zone, [1, 2, 999]), "SELECT CAST(i AS INT) AS zone, CAST(coalesce(sum(a), 0) AS BIGINT) AS sum FROM (VALUES (1), (2), (999)) AS w(i) LEFT JOIN g ON g.zone = i GROUP BY i")
q("count_mask", lambda g: zonal.count_mask(g.zone), "SELECT zone, count(*) AS count FROM g WHERE zone IS NOT NULL GROUP BY zone")
for _op, _agg in (("Sum", "sum(b)"), ("Count", "count(b)"), ("CountNonZero", "nullif(count(*) FILTER (b <> 0), 0)"), ("Min", "min(b)"), ("MinNonZero", "min(nullif(b, 0))"), ("Max", "max(b)"), ("Average", "avg(b)"), ("AverageInCat1", "avg(b)")):
    _name = "table_row_" + "".join("_" + c.lower() if c.isupper() else c for c in _op).lstrip("_")
    q(_name, lambda g, op=_op: zonal.table_row(g.b, g.cls, op).select(F.col("zone"), F.round(F.col("value").cast("double"), 8).alias("value")), f"SELECT * FROM (SELECT cls AS zone, round(({_agg})::DOUBLE, 8) AS value FROM g WHERE cls {'= 1' if _op == 'AverageInCat1' else 'IS NOT NULL'} GROUP BY cls) WHERE value IS NOT NULL")
q("distribute_spatial", lambda g: zonal.distribute_spatial(g.a, g.full_zone, g.frame.groupBy(F.col("full_zone").alias("id")).agg(F.min("id").alias("at")).select("id", F.expr("cast(at div 40 as int)").alias("row"), F.expr("cast(at % 40 as int)").alias("col"))), "SELECT g.row, g.col, CAST(coalesce(x, 0) AS BIGINT) AS value FROM g LEFT JOIN (SELECT min(id) AS at, sum(a) AS x FROM g GROUP BY full_zone) AS z ON g.id = z.at")

# focal

_near = lambda value, on, group="": f"SELECT c.row, c.col, {value} AS value FROM g AS c LEFT JOIN g AS v ON {on} GROUP BY c.row, c.col{group}"
_circle = lambda n, most: f"v.row BETWEEN c.row - {n} AND c.row + {n} AND v.col BETWEEN c.col - {n} AND c.col + {n} AND (v.row - c.row) * (v.row - c.row) + (v.col - c.col) * (v.col - c.col) <= {most}"
_box = lambda n: f"v.row BETWEEN c.row - {n} AND c.row + {n} AND v.col BETWEEN c.col - {n} AND c.col + {n}"
q("sum_in_buffer_circular", lambda g: focal.sum_in_buffer(g.a, 350), _near("CAST(coalesce(sum(v.a), 0) AS BIGINT)", _circle(3, 9)))
q("sum_in_buffer_square", lambda g: focal.sum_in_buffer(g.a, 350, "square"), _near("CAST(coalesce(sum(v.a), 0) AS BIGINT)", _box(2)))
q("integral_image", lambda g: focal.integral_image(g.a), _near("CAST(coalesce(sum(v.a), 0) AS BIGINT)", "v.row <= c.row AND v.col <= c.col"))
q("max_in_buffer", lambda g: focal.max_in_buffer(g.a, 250), _near("CAST(coalesce(max(v.a), -2147483648) AS BIGINT)", _circle(3, 7)))
q("blur_filter", lambda g: focal.blur_filter(g.f), _near("round(CASE WHEN c.f IS NOT NULL THEN avg(v.f) END, 8)", _box(1), ", c.f"), digits=8)
q("average_filter_square", lambda g: focal.average_filter_square(g.f, 2), _near("round(avg(v.f), 8)", _box(2)), digits=8)
_d2 = "((v.row - c.row) * (v.row - c.row) + (v.col - c.col) * (v.col - c.col))"
_w = {"constant": "1.0::DOUBLE", "linear": f"(1 - sqrt({_d2}) / 3)", "exponential": f"CASE WHEN {_d2} = 0 THEN 1 ELSE 1 / sqrt({_d2}) END", "exponential2": f"CASE WHEN {_d2} = 0 THEN 1 ELSE 1.0::DOUBLE / {_d2} END"}
for _mode, _key in (("constant", "filter_constant"), ("linear", "filter_linear"), ("exponential", "filter_exp"), ("exponential2", "filter_exp2")):
    q(_key, lambda g, m=_mode: focal.spread_filter(g.f, m, 2), _near(f"round(sum(v.f * ({_w[_mode]})), 6)", _circle(2, 4)), digits=6)
    _area = f"area AS (SELECT c.id, sum({_w[_mode]}) AS area FROM g AS c JOIN g AS v ON {_circle(2, 4)} GROUP BY c.id), m AS (SELECT g.row, g.col, f / area AS f FROM g JOIN area USING (id))"
    q(f"{_key}_normalised", lambda g, m=_mode: focal.spread_filter(g.f, m, 2, True), f"SELECT c.row, c.col, round(sum(v.f * ({_w[_mode]})), 6) AS value FROM g AS c LEFT JOIN m AS v ON {_circle(2, 4)} GROUP BY c.row, c.col", digits=6, ctes=_area)
q("filter_square_agg", lambda g: focal.filter_square(g.f, 1, "max"), _near("CASE WHEN c.f IS NOT NULL THEN max(v.f) END", f"{_box(1)} AND v.id <> c.id", ", c.f"))
q("filter_circular_agg", lambda g: focal.filter_circular(g.f, 2, "sum"), _near("CASE WHEN c.f IS NOT NULL THEN sum(v.f) END", f"{_circle(2, 4)} AND v.id <> c.id", ", c.f"))
q("majority_filter", lambda g: focal.majority_filter(g.b, 200), f"SELECT c.row, c.col, CAST(m.b AS BIGINT) AS value FROM g AS c LEFT JOIN (SELECT id, b FROM (SELECT c.id, v.b, count(*) AS n, any_value(c.b) AS own FROM g AS c JOIN g AS v ON {_circle(2, 4)} WHERE v.b IS NOT NULL GROUP BY c.id, v.b) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, (b = own) IS TRUE DESC, b) = 1) AS m USING (id)")
_seeds = [(0, 3), (2, 30), (4, 12), (3, 38)]
q("voronoi", lambda g: focal.voronoi(g.spark, g.meta, _seeds), "SELECT row, col, CAST(arg_min(i, (pow(row - r, 2) + pow(col - c, 2), i)) AS BIGINT) AS value FROM g, (VALUES " + ", ".join(f"({i}, {r}, {c})" for i, (r, c) in enumerate(_seeds)) + ") AS s(i, r, c) GROUP BY row, col")

# formats, extents and projections


def _kept_file(g: PartGrid, name: str) -> str:
    import uuid

    from .durable import shared_dir

    return f"{shared_dir(g.spark)}/{uuid.uuid4().hex}-{name}"


def _banded(g: PartGrid) -> Raster:
    io.write_parquet(g.a, path := _kept_file(g, "bands.parquet"), bands={2: g.b})
    return io.read(g.spark, path, band=2)


def _mapped(g: PartGrid) -> Raster:
    from ..sources import tables

    lines = [(0, "0\t1,5"), (1, "1\tnan"), (2, "2\t-3"), (3, "4\t0,25")]
    g.spark.createDataFrame(lines, "k int, value string").coalesce(1).select("value").write.text(path := _kept_file(g, "map.tab"))
    return reclass.reclass(tables.read_mapping(g.spark, path), g.b)


def _in_parts(g: PartGrid) -> Raster:
    """An ASCII grid of a file for each row: written with a partition for each."""
    kept = g.spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), g.spark.conf.get("spark.sql.shuffle.partitions")
    for value in (("false", "16"), kept):
        g.spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", value[0])
        g.spark.conf.set("spark.sql.shuffle.partitions", value[1])
        if value is not kept:
            io.write(g.a, path := _kept_file(g, "parts.asc"))
    return io.read(g.spark, path, "int32")


q("read_band", _banded, value=_int("b"))
q("read_tab", _mapped, value="CASE b WHEN 0 THEN 1.5 WHEN 2 THEN -3 WHEN 4 THEN 0.25 END", real=True)
q("read_asc_parts", _in_parts, value=_int("a"))
q("translate", lambda g: io.translate(g.a, g.meta.replace(rows=3, cols=20, xll=100.0, yll=g.meta.bounds[3] - 600.0, cell_size=200.0)), "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(a AS BIGINT) AS value FROM range(3) AS x(r), range(20) AS y(c) LEFT JOIN g ON g.row = 2 * r + 1 AND g.col = 2 * c + 2")
q("resize", lambda g: g.a.resize(4, 50, 7), "SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(CASE WHEN g.id IS NULL THEN 7 ELSE a END AS BIGINT) AS value FROM range(4) AS x(r), range(50) AS y(c) LEFT JOIN g ON g.row = r AND g.col = c")
q("add_to_cell", lambda g: g.a.add_to_cell(1, 3, 5).add_to_cell(0, 0, 2), value=_int("CASE WHEN row = 1 AND col = 3 THEN coalesce(a, 0) + 5 WHEN row = 0 AND col = 0 THEN coalesce(a, 0) + 2 ELSE a END"))
q("remap_to_float", lambda g: g.a.with_value(normalise.remap_to_float(g.a.value, 5, 40, 1.0, 3.0), "float32"), value="CASE WHEN a BETWEEN 5 AND 40 THEN 1 + (a - 5) * (2.0::DOUBLE / 35) WHEN a IS NOT NULL THEN 1 END", digits=4, real=True)
q("rasterize_touched", lambda g: vector.rasterize(_polygons(g), "field", g.meta, add=True, all_touched=True), "SELECT row, col, coalesce(sum(field), 0)::DOUBLE AS value FROM ce LEFT JOIN bx ON l + 100 > x0 AND l < x1 AND b + 100 > y0 AND b < y1 GROUP BY row, col", ctes="bx(fid, x0, y0, x1, y1, field) AS (VALUES (1, 130.0::DOUBLE, 120.0::DOUBLE, 960.0::DOUBLE, 430.0::DOUBLE, 2.0::DOUBLE), (2, 700.0::DOUBLE, 20.0::DOUBLE, 1580.0::DOUBLE, 380.0::DOUBLE, 3.0::DOUBLE)), ce AS (SELECT row, col, col * 100.0::DOUBLE AS l, ((SELECT rows FROM n) - row - 1) * 100.0::DOUBLE AS b FROM g)")
_degrees = lambda g: g.a.with_meta(xll=3.0, yll=50.0, cell_size=0.05, projection="EPSG:4326")
_earth, _rad = "6378137.0::DOUBLE", "(pi() / 180)"
q(
    "warp_raster", lambda g: io.warp_raster(_degrees(g), 3857),
    f"SELECT CAST(r AS INT) AS row, CAST(c AS INT) AS col, CAST(a AS BIGINT) AS value FROM (SELECT r, c, CAST(floor((50 + 0.05::DOUBLE * (SELECT rows FROM n) - (2 * atan(exp((y1 - (r + 0.5) * s) / {_earth})) - pi() / 2) / {_rad}) / 0.05::DOUBLE) AS INT) AS sr, CAST(floor(((x0 + (c + 0.5) * s) / {_earth} / {_rad} - 3) / 0.05::DOUBLE) AS INT) AS sc FROM e, range(CAST(ceil((y1 - y0) / s - 1e-9) AS BIGINT)) AS y(r), range(40) AS x(c)) LEFT JOIN g ON g.row = sr AND g.col = sc",
    ctes=f"e AS (SELECT 3 * {_rad} * {_earth} AS x0, 2.0::DOUBLE / 40 * {_rad} * {_earth} AS s, ln(tan(pi() / 4 + 50 * {_rad} / 2)) * {_earth} AS y0, ln(tan(pi() / 4 + (50 + 0.05::DOUBLE * rows) * {_rad} / 2)) * {_earth} AS y1 FROM n)",
)

# rescaling, weights, masks

q("normalise", lambda g: normalise.normalise(g.f), value="(f - (SELECT min(f) FROM g)) / (SELECT max(f) - min(f) FROM g)", digits=5, real=True)
q("normalise_to_byte", lambda g: normalise.normalise_to_byte(g.a), value=_int("floor((a - (SELECT min(a) FROM g)) * (254.0::DOUBLE / (SELECT max(a) - min(a) FROM g)) + 0.5)"))
q("normalise_max", lambda g: normalise.normalise_max(g.h, 1, 3), value="1 + h * (2.0::DOUBLE / (SELECT max(h) FROM g))", digits=4, real=True)
q("weighted_sum", lambda g: normalise.weighted_sum([(g.f, 1), (g.h, 0.5)]), value="nullif(coalesce(f, 0) + coalesce(h, 0) * 0.5, 0) / 1.5", digits=4, real=True)
q("weighted_product", lambda g: normalise.weighted_product([(g.h, 1), (g.weight, 0.5)]), value="h * sqrt(weight) / (SELECT max(h * sqrt(weight)) FROM g)", digits=4, real=True)
q("apply_mask", lambda g: normalise.apply_mask(g.a, g.b), value=_int("CASE WHEN b IS NOT NULL THEN a END"))
q("erase_outside_mask", lambda g: normalise.erase_outside_mask(g.a, g.b), value=_int("CASE WHEN b <> 0 THEN a END"))
q("mask_fn", lambda g: normalise.mask_where(g.a, g.b, lambda m: m > 2), value=_int("CASE WHEN b > 2 THEN a END"))
q("inside_mask", lambda g: normalise.inside_mask(g.a, g.b), value=_int("CASE WHEN b IS NOT NULL THEN a END"))
q("outside_mask", lambda g: normalise.outside_mask(g.a, g.b), value=_int("CASE WHEN b IS NULL THEN a END"))
q("include_mask", lambda g: normalise.include_mask(g.b, g.a), value=_int("CASE WHEN b > 0 THEN 1 ELSE a END"))
q("exclude_mask", lambda g: normalise.exclude_mask(g.b, g.a), value=_int("CASE WHEN b > 0 THEN NULL ELSE a END"))

# reclassification

_table = [(0, 10, 1), (1, -9999, 2), (2, 12, 3), (2, 99, 4), (None, 19, 5), (5, 15, 6)]
_values = "t(i, k, v, w) AS (VALUES " + ", ".join(f"({i}, {'NULL' if k is None else k}, {v}, {w})" for i, (k, v, w) in enumerate(_table)) + ")"
q("reclass1", lambda g: reclass.reclass(_table, g.b), "SELECT g.row, g.col, CAST(nullif(f.v, -9999) AS BIGINT) AS value FROM g LEFT JOIN (SELECT k, arg_min(v, i) AS v FROM t GROUP BY k) AS f ON g.b IS NOT DISTINCT FROM f.k", ctes=_values)
q("reclassi1", lambda g: reclass.reclassi(_table, g.b, index=2), "SELECT g.row, g.col, CAST(f.w AS BIGINT) AS value FROM g LEFT JOIN (SELECT k, arg_min(w, i) AS w FROM t GROUP BY k) AS f ON g.b IS NOT DISTINCT FROM f.k", ctes=_values)
_two = [(x, y, 10 * x + y, x - y) for x in range(4) for y in (0, 2, 4)]
q("reclass2", lambda g: reclass.reclass(_two, g.b, g.cls), value=_int("CASE WHEN b <= 3 AND cls IN (0, 2, 4) THEN 10 * b + cls END"))
q("reclassi2", lambda g: reclass.reclassi(_two, g.b, g.cls, index=2), value=_int("CASE WHEN b <= 3 AND cls IN (0, 2, 4) THEN b - cls END"))
_three = [(x, y, z, 100 * x + 10 * y + z, x * y * z + 0.5) for x in range(3) for y in range(3) for z in range(2)]
q("reclass3", lambda g: reclass.reclass(_three, g.b, g.cls, g.wall), value="CASE WHEN b <= 2 AND cls <= 2 THEN (100 * b + 10 * cls + wall)::DOUBLE END")
q("reclassi3", lambda g: reclass.reclassi(_three, g.b, g.cls, g.wall, index=2), value="CASE WHEN b <= 2 AND cls <= 2 THEN (b * cls * wall + 0.5)::DOUBLE END")
q("nreclass", lambda g: reclass.nreclass([(0, 10, 1), (5, 20, 2), (20, 30, -9999), (30, 50, 4)], g.a), value=_int("CASE WHEN a > 0 AND a <= 10 THEN 1 WHEN a > 5 AND a <= 20 THEN 2 WHEN a > 30 AND a <= 50 THEN 4 END"))


def _nation_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers on a grid of 30 columns, reclassified from nation to region by the nation table."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.expr("cast(c_custkey div 30 as int)").alias("row"), F.expr("cast(c_custkey % 30 as int)").alias("col"), "c_nationkey")
    n = c.agg(F.max("row")).first()[0] + 1
    table = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("ord"), F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("v"))
    return _shown(reclass.reclass(table, Raster.of(c, RasterMeta(n, 30), "int32", "c_nationkey")), None)


QUERIES["reclass_table"] = _nation_regions
SQL["reclass_table"] = "SELECT CAST(c_custkey // 30 AS INT) AS row, CAST(c_custkey % 30 AS INT) AS col, CAST(n_regionkey AS BIGINT) AS value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"

# clusters: labels by a keyed recursion that keeps the least index of each component

_cc = "cc(id, root) USING KEY (id) AS (SELECT id, id AS root FROM g WHERE {member} UNION (SELECT e.b, min(cc.root) FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc AS o ON o.id = e.b WHERE cc.root < o.root GROUP BY e.b))"
_edge = "e AS (SELECT x.id AS a, y.id AS b FROM g AS x JOIN g AS y ON y.row BETWEEN x.row - {n} AND x.row + {n} AND y.col BETWEEN x.col - {n} AND x.col + {n} AND {on})"
_straight, _all8 = "abs(x.row - y.row) + abs(x.col - y.col) = 1 AND x.cls = y.cls AND x.cls > 0", "x.id <> y.id AND x.cls = y.cls AND x.cls > 0"


def _clusters(on: str, member: str = "cls > 0", n: int = 1) -> str:
    return _edge.format(on=on, n=n) + ", " + _cc.format(member=member)


_ids = "SELECT g.row, g.col, CAST(CASE WHEN k.root IS NOT NULL THEN k.r WHEN g.{0} = 0 THEN 0 END AS BIGINT) AS value FROM g LEFT JOIN (SELECT id, root, dense_rank() OVER (ORDER BY root) AS r FROM cc) AS k USING (id)"
q("cluster_id", lambda g: cluster.cluster_id(g.cls), _ids.format("cls"), ctes=_clusters(_straight))
q("cluster_id_diag", lambda g: cluster.cluster_id(g.cls, True), _ids.format("cls"), ctes=_clusters(_all8))
q("cluster_size", lambda g: cluster.cluster_size(g.cls), "SELECT g.row, g.col, CAST(CASE WHEN k.root IS NOT NULL THEN k.s WHEN g.cls = 0 THEN 0 END AS BIGINT) AS value FROM g LEFT JOIN (SELECT id, root, count(*) OVER (PARTITION BY root) AS s FROM cc) AS k USING (id)", ctes=_clusters(_straight))
q("cluster_sum", lambda g: cluster.cluster_sum(g.cls, g.f), "SELECT g.row, g.col, CASE WHEN k.root IS NOT NULL THEN coalesce(k.s, 0) WHEN g.cls = 0 THEN 0 END::DOUBLE AS value FROM g LEFT JOIN (SELECT id, root, sum(f) OVER (PARTITION BY root) AS s FROM cc JOIN g USING (id)) AS k USING (id)", ctes=_clusters(_straight), digits=6)
q("fuzzy_cluster_id", lambda g: cluster.fuzzy_cluster_id(g.target, 450), _ids.format("target"), ctes=_clusters("x.id <> y.id AND x.target > 0 AND y.target > 0 AND pow(x.row - y.row, 2) + pow(x.col - y.col, 2) <= 20", "target > 0", 4))
_free = "x.id <> y.id AND x.cls = y.cls AND x.cls > 0 AND x.wall = 0 AND y.wall = 0 AND NOT (x.row <> y.row AND x.col <> y.col AND EXISTS (SELECT 1 FROM g AS p WHERE p.row = x.row AND p.col = y.col AND p.wall <> 0) AND EXISTS (SELECT 1 FROM g AS p WHERE p.row = y.row AND p.col = x.col AND p.wall <> 0))"
q(
    "cluster_id_obstacles", lambda g: cluster.cluster_id_with_obstacles(g.cls, g.wall),
    "SELECT g.row, g.col, CAST(CASE WHEN g.cls > 0 AND g.wall > 0 THEN coalesce(m.r, 0) ELSE k.r END AS BIGINT) AS value FROM g LEFT JOIN k USING (id) LEFT JOIN (SELECT id, r FROM (SELECT x.id, k.r, count(*) AS n FROM g AS x JOIN g AS y ON y.row BETWEEN x.row - 1 AND x.row + 1 AND y.col BETWEEN x.col - 1 AND x.col + 1 JOIN k ON k.id = y.id WHERE x.wall > 0 GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, r) = 1) AS m USING (id)",
    ctes=_clusters(_free, "cls > 0 AND wall = 0") + ", k AS (SELECT id, dense_rank() OVER (ORDER BY root) AS r FROM cc)",
)
#: The walk from x to y (d2 <= 20) goes diagonally first; it is blocked by a wall on it and where it passes between two.
_blocked = "EXISTS (SELECT 1 FROM range(1, 5) AS s(k), g AS w, g AS u WHERE k <= greatest(abs({y}.row - {x}.row), abs({y}.col - {x}.col)) AND w.wall <> 0 AND u.wall <> 0 AND ((w.row = {x}.row + sign({y}.row - {x}.row) * least(k, abs({y}.row - {x}.row)) AND w.col = {x}.col + sign({y}.col - {x}.col) * least(k, abs({y}.col - {x}.col)) AND u.id = w.id) OR (k <= least(abs({y}.row - {x}.row), abs({y}.col - {x}.col)) AND w.row = {x}.row + sign({y}.row - {x}.row) * (k - 1) AND w.col = {x}.col + sign({y}.col - {x}.col) * k AND u.row = {x}.row + sign({y}.row - {x}.row) * k AND u.col = {x}.col + sign({y}.col - {x}.col) * (k - 1))))"
_ground = _clusters(_free.replace("x.cls = y.cls AND x.cls > 0 AND ", ""), "wall = 0").replace("cc", "gc").replace("e AS (", "ge AS (", 1).replace(" e ON e.", " ge ON ge.").replace("SELECT e.b", "SELECT ge.b").replace("e.b AND", "e.b AND").replace("GROUP BY e.b", "GROUP BY ge.b").replace("o.id = e.b", "o.id = ge.b")
q(
    "fuzzy_cluster_obstacles", lambda g: cluster.fuzzy_cluster_id_with_obstacles(g.target, g.wall, 450),
    "SELECT g.row, g.col, CAST(k.r AS BIGINT) AS value FROM g LEFT JOIN (SELECT id, dense_rank() OVER (ORDER BY root) AS r FROM cc) AS k USING (id)",
    ctes=_ground + ", it AS (SELECT g.*, gc.root AS ground FROM g JOIN gc USING (id) WHERE target > 0 AND wall = 0), near AS (SELECT x.id AS a, y.id AS b FROM it AS x JOIN it AS y ON x.id < y.id AND x.target = y.target AND x.ground = y.ground AND pow(x.row - y.row, 2) + pow(x.col - y.col, 2) <= 20 WHERE NOT (" + _blocked.format(x="x", y="y") + " AND " + _blocked.format(x="y", y="x") + ")), e AS (SELECT a, b FROM near UNION ALL SELECT b, a FROM near), " + _cc.format(member="target > 0"),
)

# distances

_steps = "m(dr, dc, step) AS (SELECT dr, dc, sqrt(dr * dr + dc * dc) FROM range(-1, 2) AS x(dr), range(-1, 2) AS y(dc) WHERE dr <> 0 OR dc <> 0)"
_chamfer = "100.0::DOUBLE * min(sqrt(2) * least(abs(c.row - t.row), abs(c.col - t.col)) + abs(abs(c.row - t.row) - abs(c.col - t.col)))"
q("distance", lambda g: distance.distance(g.target), f"SELECT c.row, c.col, round({_chamfer}, 1) AS value FROM g AS c, (SELECT row, col FROM g WHERE target <> 0) AS t GROUP BY c.row, c.col", digits=1)
_walk = lambda start, cost, ok="true", limit="": f"{_steps}, p(id, row, col, d) USING KEY (id) AS (SELECT id, row, col, 0.0::DOUBLE FROM g WHERE {start} UNION (SELECT y.id, any_value(y.row), any_value(y.col), min(round(p.d + m.step * {cost}, 9)) FROM p, m, g AS y LEFT JOIN recurring.p AS o ON o.id = y.id WHERE y.row = p.row + m.dr AND y.col = p.col + m.dc AND {ok} AND round(p.d + m.step * {cost}, 9) < coalesce(o.d, {limit or '1e30'}) GROUP BY y.id))"
_open = "y.wall = 0 AND NOT (m.dr <> 0 AND m.dc <> 0 AND EXISTS (SELECT 1 FROM g AS k WHERE k.row = p.row AND k.col = y.col AND k.wall <> 0) AND EXISTS (SELECT 1 FROM g AS k WHERE k.row = y.row AND k.col = p.col AND k.wall <> 0))"
q("distance_obstacles", lambda g: distance.distance(g.target, g.wall, unreachable=-1.0), "SELECT g.row, g.col, round(coalesce(p.d * 100.0, -1), 1) AS value FROM g LEFT JOIN p USING (id)", digits=1, ctes=_walk("target <> 0", "1", _open))
q("travel_distance", lambda g: distance.travel_distance(g.target, g.cost), "SELECT g.row, g.col, round(p.d, 2) AS value FROM g LEFT JOIN p USING (id)", digits=2, ctes=_walk("target <> 0", "y.cost"))
_nearest = "SELECT c.row, c.col, {0} AS value FROM g AS c JOIN (SELECT c.id, arg_min(t.id, (round(sqrt(2) * least(abs(c.row - t.row), abs(c.col - t.col)) + abs(abs(c.row - t.row) - abs(c.col - t.col)), 6), t.id)) AS s FROM g AS c, g AS t WHERE t.target <> 0 GROUP BY c.id) AS k USING (id) JOIN g AS s ON s.id = k.s"
q("closest_target", lambda g: distance.closest_target(g.target), _nearest.format("CAST(s.target AS BIGINT)"))
q("value_at_closest_target", lambda g: distance.value_at_closest_target(g.target, g.f), _nearest.format("s.f::DOUBLE"))
_reach = lambda start, cost, most: f"{_steps}, p(src, id, row, col, t, d) USING KEY (src, id) AS (SELECT id, id, row, col, cost, 0.0::DOUBLE FROM g WHERE {start} UNION (SELECT p.src, y.id, any_value(y.row), any_value(y.col), any_value(y.cost), min(round(p.d + m.step * {cost}, 9)) FROM p, m, g AS y LEFT JOIN recurring.p AS o ON o.id = y.id AND o.src = p.src WHERE y.row = p.row + m.dr AND y.col = p.col + m.dc AND round(p.d + m.step * {cost}, 9) <= {most} AND (o.d IS NULL OR round(p.d + m.step * {cost}, 9) < o.d) GROUP BY p.src, y.id))"
_alloc = lambda most: f"{_steps}, p(id, row, col, d, s) USING KEY (id) AS (SELECT id, row, col, 0.0::DOUBLE, id FROM g WHERE target <> 0 UNION (SELECT id, row, col, m.d, m.s FROM (SELECT y.id, any_value(y.row) AS row, any_value(y.col) AS col, min({{'d': round(p.d + m.step * y.cost, 9), 's': p.s}}) AS m FROM p, m, g AS y LEFT JOIN recurring.p AS o ON o.id = y.id WHERE y.row = p.row + m.dr AND y.col = p.col + m.dc AND round(p.d + m.step * y.cost, 9) < {most} AND (o.d IS NULL OR round(p.d + m.step * y.cost, 9) < o.d OR (round(p.d + m.step * y.cost, 9) = o.d AND p.s < o.s)) GROUP BY y.id)))"
_allocated = "SELECT g.row, g.col, CAST(CASE WHEN p.s IS NULL THEN 0 ELSE s.a END AS BIGINT) AS value FROM g LEFT JOIN p USING (id) LEFT JOIN g AS s ON s.id = p.s"
q("value_at_closest_travel_target", lambda g: distance.value_at_closest_travel_target(g.target, g.cost, g.a), _allocated, ctes=_alloc("1e300"))
q("value_at_closest_lt_travel_target", lambda g: distance.value_at_closest_lt_travel_target(g.target, g.cost, g.a, 15.0), _allocated, ctes=_alloc("15"))
q("sum_within_travel_distance", lambda g: distance.sum_within_travel_distance(g.target, g.cost, g.a, 8.0), "SELECT g.row, g.col, CAST(coalesce(x, 0) AS BIGINT) AS value FROM g LEFT JOIN (SELECT src, sum(a) AS x FROM p JOIN g USING (id) GROUP BY src) AS s ON s.src = g.id", ctes=_reach("target <> 0", "(p.t + y.cost) / 2", "8"))
q("sum_within_travel_distance_adjacent", lambda g: distance.sum_within_travel_distance(g.target, g.cost, g.a, 8.0, True), "SELECT g.row, g.col, CAST(coalesce(x, 0) AS BIGINT) AS value FROM g LEFT JOIN (SELECT src, sum(a) AS x FROM (SELECT DISTINCT p.src, y.id, y.a FROM p JOIN g AS y ON abs(p.row - y.row) + abs(p.col - y.col) <= 1) GROUP BY src) AS s ON s.src = g.id", ctes=_reach("target <> 0", "(p.t + y.cost) / 2", "8"))
q("sum_targets_within_travel_distance", lambda g: distance.sum_targets_within_travel_distance(g.target, g.cost, 9.0), "SELECT g.row, g.col, CAST(coalesce(x, 0) AS BIGINT) AS value FROM g LEFT JOIN (SELECT p.id, sum(s.target) AS x FROM p JOIN g AS s ON s.id = p.src GROUP BY p.id) AS r USING (id)", ctes=_reach("target <> 0", "y.cost", "9"))
q("node_value_distance_decay", lambda g: distance.node_value_distance_decay(g.target, g.cost, 9.0, 5.4, 0.45), "SELECT g.row, g.col, round(CAST(coalesce(x, 0) AS FLOAT)::DOUBLE, 3) AS value FROM g LEFT JOIN (SELECT p.id, max(s.target / (1 + exp(0.45 * p.d - 5.4))) AS x FROM p JOIN g AS s ON s.id = p.src GROUP BY p.id) AS r USING (id)", ctes=_reach("target <> 0", "y.cost", "9"), digits=3)

# the same in tiles so small that every raster crosses some

for _key in ("majority_filter", "max_in_buffer", "sum_in_buffer_circular", "csum_in_buffer", "filter_linear", "filter_exp_normalised", "filter_circular_agg", "cluster_id", "cluster_id_diag", "cluster_size", "fuzzy_cluster_id", "cluster_id_obstacles", "fuzzy_cluster_obstacles", "distance", "distance_obstacles", "travel_distance", "closest_target", "value_at_closest_travel_target"):

    def _tiled(spark: SparkSession, sf_dir: str, f=QUERIES[_key]) -> DataFrame:
        with tiles.sized(16):
            return f(spark, sf_dir)

    QUERIES[f"{_key}_tiles"], SQL[f"{_key}_tiles"] = _tiled, SQL[_key]

# drainage: w lists every (cell, cell downstream of it) with the length of the way and the product of fractions passed

_next = "CASE WHEN ldd = 5 THEN NULL ELSE id + 40 + (ldd - 2) END"
_ways = f"f AS (SELECT *, {_next} AS nxt FROM g), w(src, id, len, prod, fric, k) AS (SELECT id, id, 0.0::DOUBLE, 1.0::DOUBLE, 0.0::DOUBLE, 0 FROM f UNION ALL SELECT w.src, y.id, w.len + CASE WHEN x.ldd = 2 THEN 1 ELSE sqrt(2) END, w.prod * y.fraction, w.fric + CASE WHEN x.ldd = 2 THEN 1 ELSE sqrt(2) END * (x.cost + y.cost) / 2, w.k + 1 FROM w JOIN f AS x ON x.id = w.id JOIN f AS y ON y.id = x.nxt)"
_down = lambda value: f"SELECT d.row, d.col, {value} AS value FROM w JOIN g AS s ON s.id = w.src JOIN g AS d ON d.id = w.id GROUP BY d.row, d.col"
q("accuflux", lambda g: drainage.accuflux(g.ldd, g.weight.with_value(F.coalesce(g.weight.value, F.lit(1.0)))), _down("sum(coalesce(s.weight, 1))::DOUBLE"), ctes=_ways)
q("accufractionflux", lambda g: drainage.accufractionflux(g.ldd, g.cost, g.fraction), _down("round(sum(s.cost * s.fraction * w.prod), 3)"), ctes=_ways, digits=3)
q("max_upstream_dist", lambda g: drainage.max_upstream_dist(g.ldd), _down("round(max(w.len) * 100.0::DOUBLE, 0)"), ctes=_ways, digits=0)
q("slopelength", lambda g: drainage.slopelength(g.ldd, g.cost), _down("round(max(w.fric) * 100.0::DOUBLE, -1)"), ctes=_ways, digits=-1)
_first = "SELECT g.row, g.col, {0} AS value FROM g LEFT JOIN (SELECT w.src, arg_min(d.station, w.k) AS station, arg_max(d.station, w.k) AS last, arg_min(w.fric, w.k) AS fric FROM w JOIN g AS d ON d.id = w.id WHERE d.station <> 0 GROUP BY w.src) AS p ON p.src = g.id"
q("ldd_cluster", lambda g: drainage.ldd_cluster(g.ldd, g.station), _first.format("CAST(coalesce(p.station, 0) AS BIGINT)"), ctes=_ways)
q("catchment", lambda g: drainage.catchment(g.ldd, g.station), _first.format("CAST(coalesce(p.last, 0) AS BIGINT)"), ctes=_ways)
q("ldd_dist", lambda g: drainage.ldd_dist(g.ldd, g.station, g.cost), _first.format("round(p.fric * 100.0::DOUBLE, -1)"), ctes=_ways, digits=-1)
q("flux_origin", lambda g: drainage.flux_origin(g.ldd, g.cost, g.fraction, g.station), "SELECT g.row, g.col, round(CASE WHEN g.station <> 0 THEN g.cost * g.fraction ELSE coalesce(g.cost * g.fraction * p.prod / p.f, 0) END, 4) AS value FROM g LEFT JOIN (SELECT w.src, arg_min(w.prod, w.k) AS prod, arg_min(d.fraction, w.k) AS f FROM w JOIN g AS d ON d.id = w.id WHERE d.station = 1 GROUP BY w.src) AS p ON p.src = g.id", ctes=_ways, digits=4)
_bad = lambda g: g.ldd.with_value(F.expr("CASE WHEN id % 50 = 7 THEN NULL WHEN id % 60 = 9 THEN 12 WHEN id % 40 = 39 AND id % 3 = 0 THEN 6 WHEN id = 3 THEN 6 WHEN id = 4 THEN 4 ELSE ldd END"))
_bad_sql = "x AS (SELECT row, col, id, CASE WHEN id % 50 = 7 THEN NULL WHEN id % 60 = 9 THEN 12 WHEN id % 40 = 39 AND id % 3 = 0 THEN 6 WHEN id = 3 THEN 6 WHEN id = 4 THEN 4 ELSE ldd END AS l FROM g), y AS (SELECT *, CASE l WHEN 6 THEN id + 1 WHEN 4 THEN id - 1 WHEN 1 THEN id + 39 WHEN 2 THEN id + 40 WHEN 3 THEN id + 41 END AS nxt FROM x)"
q("ldd_validate", lambda g: drainage.ldd_validate(_bad(g)), "SELECT y.row, y.col, CASE WHEN y.l = 12 THEN 'invalid' WHEN y.l = 6 AND y.col = 39 THEN 'outside' WHEN z.id IS NOT NULL THEN 'nodata' ELSE 'loop' END AS error FROM y LEFT JOIN x AS z ON z.id = y.nxt AND z.l IS NULL WHERE y.l = 12 OR (y.l = 6 AND y.col = 39) OR z.id IS NOT NULL OR y.id IN (3, 4)", ctes=_bad_sql)
_loose = lambda g: g.ldd.with_value(F.expr("CASE WHEN id % 50 = 7 THEN NULL WHEN id % 60 = 9 THEN 12 WHEN id = 3 THEN 6 WHEN id = 4 THEN 4 ELSE ldd END"))
_loose_sql = "x AS (SELECT row, col, id, CASE WHEN id % 50 = 7 THEN NULL WHEN id % 60 = 9 THEN NULL WHEN id = 3 THEN 6 WHEN id = 4 THEN 4 ELSE ldd END AS l FROM g), y AS (SELECT *, CASE l WHEN 6 THEN id + 1 WHEN 4 THEN id - 1 WHEN 1 THEN id + 39 WHEN 2 THEN id + 40 WHEN 3 THEN id + 41 END AS nxt FROM x)"
q("ldd_fix", lambda g: drainage.ldd_fix(_loose(g)), "SELECT y.row, y.col, CAST(CASE WHEN z.id IS NOT NULL OR y.id = 3 THEN 5 ELSE y.l END AS BIGINT) AS value FROM y LEFT JOIN x AS z ON z.id = y.nxt AND z.l IS NULL", ctes=_loose_sql)

# several resolutions, distribution

q("inflate", lambda g: multires.inflate(g.a, 2), "SELECT CAST(row * 2 + i AS INT) AS row, CAST(col * 2 + j AS INT) AS col, CAST(a AS BIGINT) AS value FROM g, range(2) AS x(i), range(2) AS y(j)")
q("inflate_equal_sum", lambda g: multires.inflate_equal_sum(g.f, 2), "SELECT CAST(row * 2 + i AS INT) AS row, CAST(col * 2 + j AS INT) AS col, f::DOUBLE / 4 AS value FROM g, range(2) AS x(i), range(2) AS y(j)")
_block = "SELECT row // 5 AS row, col // 5 AS col, {0} AS value FROM g GROUP BY ALL"
q("deflate_equal_sum", lambda g: multires.deflate_equal_sum(g.a, 5), _block.format("CAST(sum(a) AS BIGINT)"))
_coarse = lambda g: g.meta.scaled(5)
_weights = {0: 1.0, 1: 0.0, 2: 100.0}
_lookup = "CASE {0} WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0 WHEN 2 THEN 100 END"
q("categories_to_weights", lambda g: multires.categories_to_weights(g.cls, _weights), value=_lookup.format("cls"))
q("aggregate_multi_resolution", lambda g: multires.aggregate_multi_resolution(g.cls, _weights, _coarse(g)), _block.format(f"sum({_lookup.format('cls')})"))
_amounts = {11: 60.0, 12: 90.0, 23: 1000.0}
_of = "CASE {0} WHEN 11 THEN 60.0::DOUBLE WHEN 12 THEN 90 WHEN 23 THEN 1000 END"
_dist = lambda w, digits=6: f"SELECT row, col, round(nullif(CASE WHEN s > 0 THEN amount * w / s WHEN c > 0 THEN CASE WHEN w IS NOT NULL THEN amount / c END ELSE amount / nullif(k - c, 0) END, 0), {digits}) AS value FROM (SELECT row, col, w, {_of.format('zone')} AS amount, sum(w) OVER (PARTITION BY zone) AS s, count(w) OVER (PARTITION BY zone) AS c, count(*) OVER (PARTITION BY zone) AS k FROM (SELECT row, col, zone, {w} AS w FROM g))"
q("weighted_distribution", lambda g: multires.weighted_distribution(g.zone, g.weight, _amounts), _dist("weight"), digits=6)
q("areal_weighted_distribution", lambda g: multires.areal_weighted_distribution(g.zone, _amounts), _dist("1.0::DOUBLE"), digits=6)
q("aggregate_and_spread", lambda g: multires.aggregate_and_spread(g.cls, _weights, g.zone, _amounts, _coarse(g)), f"SELECT row // 5 AS row, col // 5 AS col, round(sum(value), 5) AS value FROM ({_dist(_lookup.format('cls'), 14).replace('nullif(CASE WHEN s', '(CASE WHEN s').replace('END, 0), 14)', 'END), 14)')}) GROUP BY ALL", digits=5)
_das = f"SELECT row, col, round(CASE WHEN cls IS NOT NULL AND zone IS NOT NULL THEN amount * CASE WHEN total > 0 THEN ckz / total / akz ELSE 1 / az END END, 6) AS value FROM (SELECT *, sum(ckz / akz) OVER (PARTITION BY zone, ok) AS total FROM (SELECT row, col, cls, zone, ok, akz, az, {_of.format('zone')} AS amount, coalesce({_lookup.format('cls')}, 0) * (akz / az) / (ak / whole) AS ckz FROM (SELECT row, col, cls, zone, cls IS NOT NULL AND zone IS NOT NULL AS ok, count(*) FILTER (cls IS NOT NULL AND zone IS NOT NULL) OVER (PARTITION BY cls, zone)::DOUBLE AS akz, count(*) FILTER (cls IS NOT NULL AND zone IS NOT NULL) OVER (PARTITION BY cls)::DOUBLE AS ak, count(*) FILTER (cls IS NOT NULL AND zone IS NOT NULL) OVER (PARTITION BY zone)::DOUBLE AS az, count(*) FILTER (cls IS NOT NULL AND zone IS NOT NULL) OVER ()::DOUBLE AS whole FROM g)))"
q("das_map", lambda g: multires.das_map(g.cls, _weights, g.zone, _amounts), _das, digits=6)
q("das_map_multiresolution", lambda g: multires.das_map_multiresolution(g.cls, _weights, g.zone, _amounts, _coarse(g)), f"SELECT row // 5 AS row, col // 5 AS col, round(sum(value), 4) AS value FROM ({_das.replace('END END, 6) AS value', 'END END, 14) AS value')}) GROUP BY ALL", digits=4)
q("das_map_linear", lambda g: multires.das_map_linear(g.cls, _weights, g.zone, _amounts, g.cost), _dist(f"({_lookup.format('cls')}) * cost"), digits=6)
q("distribute_proportions", lambda g: (lambda x, y: _shown(x, None).withColumnRenamed("value", "first").join(_shown(y, None).withColumnRenamed("value", "second"), ["row", "col"]))(*multires.distribute_proportions(g.f, [0.25, 0.0])), "SELECT row, col, f::DOUBLE * 0.25::DOUBLE AS first, NULL::DOUBLE AS second FROM g")
q("value_distribution", lambda g: multires.value_distribution(1000.0, g.h), value="h::DOUBLE * 1000.0::DOUBLE / (SELECT sum(h)::DOUBLE FROM g)", digits=8)
q("raster_distribution", lambda g: multires.raster_distribution(g.h, g.share)[1], value="h::DOUBLE - h::DOUBLE * coalesce(share, 0)::DOUBLE")
for _algorithm, _agg in (("average", "round(avg(f), 6)"), ("maximum", "max(f)::DOUBLE"), ("minimum", "min(f)::DOUBLE"), ("median", "quantile_cont(f, 0.5)::DOUBLE"), ("first_quantile", "quantile_cont(f, 0.25)::DOUBLE"), ("third_quantile", "quantile_cont(f, 0.75)::DOUBLE")):
    q(f"resample_{_algorithm}", lambda g, m=_algorithm: rs.resample(g.f, _coarse(g), m), _block.format(_agg), digits=6)
q("resample_mode", lambda g: rs.resample(g.cls, _coarse(g), "mode"), "SELECT row // 5 AS row, col // 5 AS col, CAST(arg_min(cls, (-n, cls)) AS BIGINT) AS value FROM (SELECT row // 5 * 5 AS row, col // 5 * 5 AS col, cls, count(*) AS n FROM g WHERE cls IS NOT NULL GROUP BY ALL) GROUP BY ALL")
q("resample_nearest", lambda g: rs.resample(g.a, _coarse(g), "nearest"), "SELECT row // 5 AS row, col // 5 AS col, CAST(a AS BIGINT) AS value FROM g WHERE row % 5 = 2 AND col % 5 = 2")
_finer = lambda g: g.meta.replace(rows=g.meta.rows * 2, cols=g.meta.cols * 2, cell_size=50.0)
q("resample_bilinear", lambda g: rs.resample(g.h, _finer(g), "bilinear"), "SELECT CAST(t.r AS INT) AS row, CAST(t.c AS INT) AS col, round(sum(v.h * (1 - abs((t.r - 0.5) / 2 - v.row)) * (1 - abs((t.c - 0.5) / 2 - v.col))) / sum(CASE WHEN v.h IS NOT NULL THEN (1 - abs((t.r - 0.5) / 2 - v.row)) * (1 - abs((t.c - 0.5) / 2 - v.col)) END), 6) AS value FROM (SELECT row * 2 + i AS r, col * 2 + j AS c FROM g, range(2) AS x(i), range(2) AS y(j)) AS t LEFT JOIN g AS v ON abs((t.r - 0.5) / 2 - v.row) < 1 AND abs((t.c - 0.5) / 2 - v.col) < 1 GROUP BY t.r, t.c", digits=6)
_kernels = {
    "cubic": (2, "CASE WHEN {x} < 1 THEN 1.5 * {x} ** 3 - 2.5 * {x} ** 2 + 1 ELSE -0.5 * {x} ** 3 + 2.5 * {x} ** 2 - 4 * {x} + 2 END"),
    "cubic_spline": (2, "CASE WHEN {x} < 1 THEN (4 - 6 * {x} ** 2 + 3 * {x} ** 3) / 6 ELSE (2 - {x}) ** 3 / 6 END"),
    "lanczos": (3, "CASE WHEN {x} = 0 THEN 1 ELSE 3 * sin(pi() * {x}) * sin(pi() * {x} / 3) / (pi() * {x}) ** 2 END"),
}
for _algorithm, (_reach_of, _curve) in _kernels.items():
    _x, _y = "abs((t.c - 0.5::DOUBLE) / 2 - v.col)", "abs((t.r - 0.5::DOUBLE) / 2 - v.row)"
    _wxy = f"({_curve.format(x=_x)}) * ({_curve.format(x=_y)})"
    q(f"resample_{_algorithm}", lambda g, m=_algorithm: rs.resample(g.h, _finer(g), m), f"SELECT CAST(t.r AS INT) AS row, CAST(t.c AS INT) AS col, round(sum(v.h * {_wxy}) / sum(CASE WHEN v.h IS NOT NULL THEN {_wxy} END), 6) AS value FROM (SELECT row * 2 + i AS r, col * 2 + j AS c FROM g, range(2) AS x(i), range(2) AS y(j)) AS t LEFT JOIN g AS v ON {_x} < {_reach_of} AND {_y} < {_reach_of} GROUP BY t.r, t.c", digits=6)

# vectors


def _points(g: PartGrid) -> DataFrame:
    """A point for each line item: quantity and discount as coordinates, cents as the field."""
    li = g.spark.read.parquet(f"{g.sf_dir}/lineitem.parquet")
    return li.select((F.col("l_quantity") * 70).alias("x"), (F.col("l_linenumber") * 60.0).alias("y"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("field"))


q("add_points", lambda g: vector.add_points(_points(g), "field", g.meta), "SELECT g.row, g.col, coalesce(x, 0)::DOUBLE AS value FROM g LEFT JOIN (SELECT CAST(floor(((SELECT rows FROM n) * 100.0::DOUBLE - l_linenumber * 60.0::DOUBLE) / 100.0::DOUBLE) AS INT) AS row, CAST(floor(l_quantity * 70 / 100.0::DOUBLE) AS INT) AS col, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS x FROM lineitem GROUP BY ALL) AS p ON p.row = g.row AND p.col = g.col")


def _streamed(g: PartGrid) -> Raster:
    """The same from a stream of the table's files, each micro-batch summed into a partition of a Parquet raster."""
    import uuid

    from ..streaming import sum_points_into
    from .durable import shared_dir

    schema = g.spark.read.parquet(f"{g.sf_dir}/lineitem.parquet").schema
    li = g.spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(g.sf_dir)
    points = li.select((F.col("l_quantity") * 70).alias("x"), (F.col("l_linenumber") * 60.0).alias("y"), F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("field"))
    out = f"{shared_dir(g.spark)}/stream-{uuid.uuid4().hex}"
    sum_points_into(points, "field", g.meta, f"{out}/cells", f"{out}/state", available_now=True).awaitTermination()
    sums = g.spark.read.parquet(f"{out}/cells").groupBy("row", "col").agg(F.sum("x").alias("x"))
    return vector.over_grid(sums, g.meta, "float64", 0.0)


q("stream_points", _streamed)
SQL["stream_points"] = SQL["add_points"]
_line_rows = [(1, 0, 50.0, 50.0, 3.0), (1, 1, 350.0, 150.0, 3.0), (1, 2, 950.0, 250.0, 3.0), (2, 0, 150.0, 450.0, 5.0), (2, 1, 150.0, 50.0, 5.0), (2, 2, 1150.0, 50.0, 5.0)]
_lines = lambda g: _frame(g.spark, _line_rows, "line_id long, seq int, x double, y double, field double")
_on_lines = "lines(line_id, x0, y0, x1, y1, field) AS (VALUES (1, 50.0, 50.0, 350.0, 150.0, 3.0), (1, 350.0, 150.0, 950.0, 250.0, 3.0), (2, 150.0, 450.0, 150.0, 50.0, 5.0), (2, 150.0, 50.0, 1150.0, 50.0, 5.0)), sg AS (SELECT line_id, field, CAST(floor(((SELECT rows FROM n) * 100 - y0) / 100) AS INT) AS r0, CAST(floor(x0 / 100) AS INT) AS c0, CAST(floor(((SELECT rows FROM n) * 100 - y1) / 100) AS INT) AS r1, CAST(floor(x1 / 100) AS INT) AS c1 FROM lines), lc AS (SELECT DISTINCT line_id, field, r0 + ((2 * k * abs(r1 - r0) + m) // (2 * m)) * sign(r1 - r0) AS row, c0 + ((2 * k * abs(c1 - c0) + m) // (2 * m)) * sign(c1 - c0) AS col FROM (SELECT *, greatest(abs(r1 - r0), abs(c1 - c0)) AS m FROM sg), range(100) AS x(k) WHERE k <= m)"
q("draw_points", lambda g: vector.draw_points(g.a, _frame(g.spark, [(150.0, 120.0), (160.0, 130.0), (3950.0, 10.0), (-10.0, 50.0)], "x double, y double")), "SELECT row, col, CAST(CASE WHEN (col = 1 AND row = (SELECT rows FROM n) - 2) OR (col = 39 AND row = (SELECT rows FROM n) - 1) THEN 1 ELSE a END AS BIGINT) AS value FROM g")
q("draw_lines", lambda g: vector.draw_lines(g.a, _lines(g)), "SELECT g.row, g.col, CAST(CASE WHEN EXISTS (SELECT 1 FROM lc WHERE lc.row = g.row AND lc.col = g.col) THEN 1 ELSE a END AS BIGINT) AS value FROM g", ctes=_on_lines)
_smooth_points = {1: (3.0, [(50, 50), (350, 150), (350, 150), (950, 250)]), 2: (5.0, [(150, 450), (150, 50), (1150, 50)]), 3: (2.0, [(1210, 130), (1230, 135), (1260, 180), (1290, 210), (1297.5, 216), (1300, 300), (1420, 290)]), 4: (4.0, [(-150, 210), (260, 330), (300, -90), (-20, -70)])}
_smooth_rows = [(i, k, float(x), float(y), f) for i, (f, xy) in _smooth_points.items() for k, (x, y) in enumerate(xy)]
_smooth = lambda g: _frame(g.spark, _smooth_rows, "line_id long, seq int, x double, y double, field double")
_by_weight = f"""pt(line_id, seq, x, y, field) AS (VALUES {", ".join(f"({i}, {k}, {x}::DOUBLE, {y}::DOUBLE, {f}::DOUBLE)" for i, k, x, y, f in _smooth_rows)}),
s0 AS (SELECT line_id, field, x AS x0, y AS y0, lead(x) OVER (PARTITION BY line_id ORDER BY seq) AS x1, lead(y) OVER (PARTITION BY line_id ORDER BY seq) AS y1, (SELECT rows FROM n) * 100.0::DOUBLE AS top FROM pt),
km AS (SELECT line_id, sum(sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2)) / 1000 AS km FROM s0 WHERE x1 IS NOT NULL GROUP BY ALL),
s1 AS (SELECT line_id, field, least(greatest(x0, 0), 4000) / 100 - 0.5::DOUBLE AS x0, (top - least(greatest(y0, 0), top)) / 100 - 0.5::DOUBLE AS y0, least(greatest(x1, 0), 4000) / 100 - 0.5::DOUBLE AS x1, (top - least(greatest(y1, 0), top)) / 100 - 0.5::DOUBLE AS y1
  FROM s0 WHERE x1 IS NOT NULL AND (x0 <> x1 OR y0 <> y1) AND greatest(x0, x1) >= 0 AND greatest(y0, y1) >= 0 AND least(x0, x1) <= 4000 AND least(y0, y1) <= top),
s2 AS (SELECT line_id, field, abs(x1 - x0) > abs(y1 - y0) AS flat, * FROM s1),
s3 AS (SELECT line_id, field, flat, CASE WHEN flat THEN x0 ELSE y0 END AS a0, CASE WHEN flat THEN y0 ELSE x0 END AS b0, CASE WHEN flat THEN x1 ELSE y1 END AS a1, CASE WHEN flat THEN y1 ELSE x1 END AS b1 FROM s2),
s4 AS (SELECT *, unnest(range(CAST(floor(least(a0, a1) + 0.5) AS BIGINT), CAST(floor(greatest(a0, a1) + 0.5) AS BIGINT) + 1)) AS k FROM s3 WHERE a0 <> a1),
s5 AS (SELECT line_id, field, flat, k, b0 + (b1 - b0) / (a1 - a0) * (k - a0) AS v, least(greatest(a0, a1), k + 0.5) - greatest(least(a0, a1), k - 0.5) AS share FROM s4),
s6 AS (SELECT line_id, field, flat, k, floor(v) AS c, share * (1 - (v - floor(v))) AS w FROM s5 UNION ALL SELECT line_id, field, flat, k, floor(v) + 1, share * (v - floor(v)) FROM s5),
aa AS (SELECT line_id, field, km, g.row, g.col, sum(w) AS w, sum(sum(w)) OVER (PARTITION BY line_id) AS whole FROM s6 JOIN km USING (line_id) JOIN g ON g.row = CASE WHEN flat THEN c ELSE k END AND g.col = CASE WHEN flat THEN k ELSE c END WHERE w > 0 GROUP BY line_id, field, km, g.row, g.col)"""
for _key, _more, _sum in (("", {}, "w"), ("_normalised", {"field": "field", "normalise": True}, "w / whole * field"), ("_by_length", {"by_length": True}, "w * km")):
    q(f"rasterize_lines_aa{_key}", lambda g, m=_more: vector.rasterize_lines_aa(_smooth(g), g.meta, **m), f"SELECT g.row, g.col, round(x, 6) AS value FROM g LEFT JOIN (SELECT row, col, sum({_sum}) AS x FROM aa GROUP BY ALL) AS l ON l.row = g.row AND l.col = g.col", digits=6, ctes=_by_weight)
_low_zones = lambda g: g.full_zone.with_value(F.expr(f"CASE WHEN row < {g.meta.rows - 2} THEN 11 ELSE 12 END"))
_spread_low = "SELECT g.row, g.col, round(CASE WHEN g.row >= (SELECT rows - 2 FROM n) THEN 90.0::DOUBLE * x / (SELECT sum(l.x) FROM l WHERE l.row >= (SELECT rows - 2 FROM n)) END, 6) AS value FROM g LEFT JOIN l ON l.row = g.row AND l.col = g.col"
q("linear_distribution_aa", lambda g: vector.linear_distribution(_low_zones(g), _smooth(g), {12: 90.0}, anti_aliased=True), _spread_low, digits=6, ctes=_by_weight + ", l AS (SELECT row, col, sum(w) AS x FROM aa GROUP BY ALL)")
q("proportional_distribution_aa", lambda g: vector.proportional_distribution(_smooth(g), g.meta, "field", anti_aliased=True), "SELECT g.row, g.col, round(x, 6) AS value FROM g LEFT JOIN (SELECT row, col, sum(w / whole * field) AS x FROM aa GROUP BY ALL) AS l ON l.row = g.row AND l.col = g.col", digits=6, ctes=_by_weight)
q("weighted_prop_distribution_aa", lambda g: vector.weighted_proportional_distribution(_low_zones(g), _smooth(g), "field", {12: 90.0}, anti_aliased=True), _spread_low, digits=6, ctes=_by_weight + ", l AS (SELECT row, col, sum(w * field) AS x FROM aa GROUP BY ALL)")
q("linear_distribution", lambda g: vector.linear_distribution(g.full_zone.with_value(F.expr(f"CASE WHEN row < {g.meta.rows - 2} THEN 11 ELSE 12 END")), _lines(g), {12: 90.0}), "SELECT g.row, g.col, round(CASE WHEN g.row >= (SELECT rows - 2 FROM n) THEN 90.0::DOUBLE * x / (SELECT sum(l.x) FROM l WHERE l.row >= (SELECT rows - 2 FROM n)) END, 6) AS value FROM g LEFT JOIN l ON l.row = g.row AND l.col = g.col", digits=6, ctes=_on_lines + ", l AS (SELECT row, col, count(*) AS x FROM lc GROUP BY ALL)")
q("proportional_distribution", lambda g: vector.proportional_distribution(_lines(g), g.meta, "field"), "SELECT g.row, g.col, round(x, 6) AS value FROM g LEFT JOIN (SELECT row, col, sum(field::DOUBLE / k) AS x FROM (SELECT *, count(*) OVER (PARTITION BY line_id) AS k FROM lc) GROUP BY ALL) AS l ON l.row = g.row AND l.col = g.col", digits=6, ctes=_on_lines)
q("weighted_prop_distribution", lambda g: vector.weighted_proportional_distribution(g.full_zone.with_value(F.expr(f"CASE WHEN row < {g.meta.rows - 2} THEN 11 ELSE 12 END")), _lines(g), "field", {12: 90.0}), "SELECT g.row, g.col, round(CASE WHEN g.row >= (SELECT rows - 2 FROM n) THEN 90.0::DOUBLE * x / (SELECT sum(l.x) FROM l WHERE l.row >= (SELECT rows - 2 FROM n)) END, 6) AS value FROM g LEFT JOIN l ON l.row = g.row AND l.col = g.col", digits=6, ctes=_on_lines + ", l AS (SELECT row, col, sum(field)::DOUBLE AS x FROM lc GROUP BY ALL)")
_ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
_boxes = [(1, 130, 120, 960, 430, 2.0), (2, 700, 20, 1580, 380, 3.0)]
_polygons = lambda g: _frame(g.spark, [(i, [_ring((a, b), (c, b), (c, d), (a, d))], v) for i, a, b, c, d, v in _boxes], "fid long, rings array<array<struct<x:double,y:double>>>, field double")
_box_sql = "bx(fid, x0, y0, x1, y1, field) AS (VALUES " + ", ".join(f"({i}, {a}.0::DOUBLE, {b}.0::DOUBLE, {c}.0::DOUBLE, {d}.0::DOUBLE, {v}::DOUBLE)" for i, a, b, c, d, v in _boxes) + "), ce AS (SELECT row, col, col * 100.0::DOUBLE AS l, ((SELECT rows FROM n) - row - 1) * 100.0::DOUBLE AS b FROM g)"
_centre = "l + 50 >= x0 AND l + 50 < x1 AND b + 50 >= y0 AND b + 50 < y1"
q("rasterize_burn", lambda g: vector.rasterize(_polygons(g), "field", g.meta), f"SELECT row, col, arg_max(field, fid) AS value FROM ce LEFT JOIN bx ON {_centre} GROUP BY row, col", ctes=_box_sql)
q("rasterize_add", lambda g: vector.rasterize(_polygons(g), "field", g.meta, add=True), f"SELECT row, col, coalesce(sum(field), 0)::DOUBLE AS value FROM ce LEFT JOIN bx ON {_centre} GROUP BY row, col", ctes=_box_sql)
q("clip_polygon", lambda g: vector.clip_polygon(g.a, _polygons(g)), f"SELECT g.row, g.col, CAST(CASE WHEN EXISTS (SELECT 1 FROM ce, bx WHERE ce.row = g.row AND ce.col = g.col AND {_centre}) THEN a END AS BIGINT) AS value FROM g", ctes=_box_sql)
_overlap = "greatest(least(l + 100, x1) - greatest(l, x0), 0) * greatest(least(b + 100, y1) - greatest(b, y0), 0)"
q("polygon_coverage", lambda g: vector.polygon_coverage(_polygons(g), g.meta).select("fid", "row", "col", F.round("coverage", 8).alias("coverage"), F.round("cell_coverage", 8).alias("cell_coverage")), f"SELECT CAST(fid AS BIGINT) AS fid, row, col, round({_overlap} / ((x1 - x0) * (y1 - y0)), 8) AS coverage, round({_overlap} / 10000, 8) AS cell_coverage FROM ce, bx WHERE {_overlap} > 0", ctes=_box_sql)
q("rasterize_polygons", lambda g: vector.rasterize_polygons(_polygons(g), "field", g.meta), f"SELECT row, col, round(sum(field * {_overlap} / ((x1 - x0) * (y1 - y0))), 8) AS value FROM ce LEFT JOIN bx ON {_overlap} > 0 GROUP BY row, col", ctes=_box_sql, digits=8)
q("cutout_polygon", lambda g: vector.cutout_polygon(g.h, vector.polygon_coverage(_polygons(g), g.meta)), f"SELECT g.row, g.col, round(h * s, 6) AS value FROM g LEFT JOIN (SELECT row, col, sum({_overlap} / 10000) AS s FROM ce, bx WHERE {_overlap} > 0 GROUP BY ALL) AS k ON k.row = g.row AND k.col = g.col", ctes=_box_sql, digits=6)


def flagship(g: PartGrid) -> Raster:
    """Land use to categories, categories to clusters of some size, what is near them, and the value there."""
    category = reclass.nreclass([(0, 20, 1), (20, 60, 2)], g.a)
    large = (zonal.csum(category, category) >= 30).with_meta(nodata=255)
    near = focal.sum_in_buffer(local.logical_and(large, category == 1), 200, "square") > 0
    return g.price * near


q("flagship", flagship, f"SELECT g.row, g.col, g.price * near AS value FROM g JOIN (SELECT c.row, c.col, CAST(coalesce(sum(v.hit), 0) > 0 AS INT) AS near FROM g AS c LEFT JOIN h AS v ON {_box(1)} GROUP BY c.row, c.col) USING (row, col)", ctes="k AS (SELECT row, col, CASE WHEN a > 0 AND a <= 20 THEN 1 WHEN a > 20 AND a <= 60 THEN 2 END AS k FROM g), h AS (SELECT row, col, CASE WHEN k = 1 AND sum(k) OVER (PARTITION BY k) >= 30 THEN 1 WHEN k IS NOT NULL THEN 0 END AS hit FROM k)")
