"""GeoJSON documents and line-delimited GeoJSON as feature rows (layer, fid, geom, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.functions.geometry import KINDS, coord, geom
from quadweave.functions.values import PROPS, props_of

FEATURE_SCHEMA = "layer string, fid bigint, geom struct<kind:tinyint,parts:array<array<array<struct<x:double,y:double>>>>>, props " + PROPS


class EmptyLayer(ValueError):
    """A layer without a single feature."""


def _xy(c: Column) -> Column:
    return coord(F.element_at(c, 1), F.element_at(c, 2))


def geometry_of(v: Column) -> Column:
    """A geometry variant -> the geometry struct; null for null geometries, collections and unknown types."""
    kind = F.variant_get(v, "$.type", "string")
    at = lambda t: F.variant_get(v, "$.coordinates", t)
    line = lambda a: F.transform(a, _xy)
    rings = lambda a: F.transform(a, line)
    d1, d2, d3, d4 = ("array<" * n + "double" + ">" * n for n in (1, 2, 3, 4))
    made = {
        "Point": lambda: F.array(F.array(F.array(_xy(at(d1))))),
        "LineString": lambda: F.array(F.array(line(at(d2)))),
        "Polygon": lambda: F.array(rings(at(d3))),
        "MultiPoint": lambda: F.array(F.array(line(at(d2)))),
        "MultiLineString": lambda: F.array(rings(at(d3))),
        "MultiPolygon": lambda: F.transform(at(d4), rings),
    }
    out = None
    for name, parts in made.items():
        g = geom(F.lit(KINDS[name]), parts())
        out = F.when(kind == name, g) if out is None else out.when(kind == name, g)
    return out


def features_to_rows(features: DataFrame, layer: str) -> DataFrame:
    """Variant column f (a Feature each) -> feature rows.

    Features without geometry are left out; members of geometry collections become features of their own with the
    same properties. fid is a hash of the feature, so it doesn't depend on files, partitions or the order of rows.
    """
    f = F.col("f")
    text = F.to_json(f)
    g = F.variant_get(f, "$.geometry", "variant")
    parted = features.where(g.isNotNull() & ~F.is_variant_null(g)).select(
        F.xxhash64(text).alias("fid0"),
        g.alias("g"),
        F.coalesce(F.to_json(F.variant_get(f, "$.properties", "variant")), F.lit("{}")).alias("p"),
    )
    members = F.when(F.variant_get("g", "$.type", "string") == "GeometryCollection", F.variant_get("g", "$.geometries", "array<variant>")).otherwise(F.array("g"))
    one = parted.select("fid0", "p", F.posexplode(members).alias("i", "m"))
    made = one.select(F.lit(layer).alias("layer"), F.when(F.col("i") == 0, F.col("fid0")).otherwise(F.xxhash64("fid0", "i")).alias("fid"), geometry_of(F.col("m")).alias("geom"), props_of("p").alias("props"))
    return made.where("geom is not null")


def read_geojson(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """A FeatureCollection, a Feature or a bare geometry per file."""
    doc = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    return geojson_rows(doc, layer)


def geojson_rows(doc: DataFrame, layer: str) -> DataFrame:
    v = F.col("v")
    kind = F.variant_get(v, "$.type", "string")
    as_feature = F.parse_json(F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), F.to_json(v), F.lit("}")))
    all_of = F.when(kind == "FeatureCollection", F.variant_get(v, "$.features", "array<variant>")).when(kind == "Feature", F.array(v)).otherwise(F.array(as_feature))
    return features_to_rows(doc.select(F.explode(all_of).alias("f")), layer)


def read_geojsonseq(spark: SparkSession, path: str, layer: str, permissive: bool = False) -> DataFrame:
    """One Feature per line, with or without a leading record separator; blank lines are skipped.

    A line that is no JSON or no Feature fails the read, or is left out if permissive.
    """
    return geojsonseq_rows(spark.read.text(path), layer, permissive)


def geojsonseq_rows(lines: DataFrame, layer: str, permissive: bool = False) -> DataFrame:
    text = F.trim(F.regexp_replace("value", "^\\x1E+", ""))
    text = F.regexp_replace(text, r"^[\s\x1E]+|\s+$", "")
    rows = lines.select(text.alias("value")).where("value <> ''")
    v = F.try_parse_json("value") if permissive else F.parse_json("value")
    rows = rows.select(v.alias("f"))
    ok = F.variant_get(F.col("f"), "$.type", "string") == "Feature"
    if permissive:
        return features_to_rows(rows.where(ok), layer)
    checked = F.when(ok, F.col("f")).otherwise(F.raise_error(F.concat(F.lit("not a Feature: "), F.substring(F.coalesce(F.to_json("f"), F.lit("null")), 1, 80))).cast("variant"))
    return features_to_rows(rows.select(checked.alias("f")), layer)


def require_features(rows: DataFrame, layer: str) -> DataFrame:
    """The rows, or EmptyLayer if there are none."""
    if rows.isEmpty():
        raise EmptyLayer(f"layer {layer!r} has no features")
    return rows
