"""Lookup tables (tab, csv) and vector layers (GeoJSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..meta import RasterError


def read_mapping(spark: SparkSession, path: str, keys: int = 1, delimiter: str | None = None, by_column: bool = False) -> list[tuple[float | None, ...]]:
    """Rows of a lookup table, in order: keys, then data. nan and empty fields are None; decimals may have a comma. by_column:
    the file has a line for each column. A lookup table is a parameter, read by the driver."""
    sep = delimiter or ("," if path.endswith(".csv") else "\t")
    rows = []
    for (line,) in spark.read.text(path).collect():
        fields = [x.strip().strip('"') for x in line.strip("\r\n").split(sep)] if line.strip() else []
        if fields:
            rows.append(tuple(_number(x if sep == "," else x.replace(",", ".")) for x in fields))
    if by_column:
        if len({len(r) for r in rows}) > 1:
            raise RasterError("columns of different length")
        rows = list(zip(*rows))
    width = {len(r) for r in rows}
    if len(width) != 1 or min(width) <= keys:
        raise RasterError(f"{path} needs rows of {keys} keys and a value")
    for r in rows:
        if any(x is not None and x == x and not float(x).is_integer() for x in r[:keys]):
            raise RasterError("keys are whole numbers")
    return rows


def _number(text: str) -> float | None:
    if text.lower() in ("", "nan"):
        return None
    try:
        return float(text)
    except ValueError as e:
        raise RasterError(f"{text!r} is not a number") from e


_RINGS = "array<array<array<double>>>"


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """(fid, kind, rings array<array<struct<x, y>>>, properties map<string, string>), a row for each part of a feature: the rings of a
    polygon, the points of a line as one ring, a point as one ring of one point. A file of a feature on each line (.geojsonl, .ndjson) is
    read by many tasks, a collection by one."""
    if path.endswith((".geojsonl", ".ndjson", ".jsonl")):
        features = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("f"))
    else:
        text = spark.read.text(path, wholetext=True)
        features = text.select(F.explode(F.from_json(F.get_json_object("value", "$.features"), "array<string>")).alias("f"))
    kind, coordinates = F.get_json_object("f", "$.geometry.type"), F.get_json_object("f", "$.geometry.coordinates")
    base = features.select(F.monotonically_increasing_id().alias("fid"), kind.alias("kind"), coordinates.alias("c"), F.from_json(F.get_json_object("f", "$.properties"), "map<string,string>").alias("properties"))
    nested = (
        F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", _RINGS)))
        .when(F.col("kind") == "MultiPolygon", F.from_json("c", f"array<{_RINGS}>"))
        .when(F.col("kind") == "LineString", F.array(F.array(F.from_json("c", "array<array<double>>"))))
        .when(F.col("kind") == "MultiLineString", F.transform(F.from_json("c", _RINGS), lambda line: F.array(line)))
        .when(F.col("kind") == "Point", F.array(F.array(F.array(F.from_json("c", "array<double>")))))
    )
    parts = base.select("fid", "kind", F.explode(nested).alias("part"), "properties")
    point = lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))
    return parts.select("fid", "kind", F.transform("part", lambda ring: F.transform(ring, point)).alias("rings"), "properties")


def points_of(layer: DataFrame, field: str) -> DataFrame:
    """(x, y, field) of point features."""
    p = F.col("rings")[0][0]
    return layer.where("kind = 'Point'").select(p["x"].alias("x"), p["y"].alias("y"), F.col("properties")[field].cast("double").alias(field))


def lines_of(layer: DataFrame, field: str | None = None) -> DataFrame:
    """(line_id, seq, x, y, field) of line features; parts of one feature are lines of their own."""
    own = [F.col("properties")[field].cast("double").alias(field)] if field else []
    each = layer.where("kind like '%LineString'").select(F.monotonically_increasing_id().alias("line_id"), F.posexplode(F.col("rings")[0]).alias("seq", "p"), *own)
    return each.select("line_id", "seq", F.col("p.x").alias("x"), F.col("p.y").alias("y"), *([field] if field else []))


def polygons_of(layer: DataFrame, field: str) -> DataFrame:
    """(fid, rings, field) of polygon features."""
    return layer.where("kind like '%Polygon'").select("fid", "rings", F.col("properties")[field].cast("double").alias(field))

