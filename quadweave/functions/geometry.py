"""The geometry struct: kind and parts[polygon][ring][coordinate]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadweave.functions.mercator import _c, lat_to_y, lon_to_x

GEOM = "struct<kind:tinyint,parts:array<array<array<struct<x:double,y:double>>>>>"
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON = 1, 2, 3, 4, 5, 6
KINDS = {"Point": 1, "LineString": 2, "Polygon": 3, "MultiPoint": 4, "MultiLineString": 5, "MultiPolygon": 6}


def geom(kind, parts) -> Column:
    return F.struct(_c(kind).cast("tinyint").alias("kind"), parts.alias("parts"))


def coord(x, y) -> Column:
    return F.struct(_c(x).cast("double").alias("x"), _c(y).cast("double").alias("y"))


def point(x, y) -> Column:
    return geom(F.lit(POINT), F.array(F.array(F.array(coord(x, y)))))


def line(coords: Column) -> Column:
    return geom(F.lit(LINE), F.array(F.array(coords)))


def box(minx, miny, maxx, maxy) -> Column:
    ring = F.array(coord(minx, miny), coord(maxx, miny), coord(maxx, maxy), coord(minx, maxy), coord(minx, miny))
    return geom(F.lit(POLYGON), F.array(F.array(ring)))


def coords_of(g) -> Column:
    """All coordinates of a geometry as one array."""
    return F.flatten(F.flatten(_c(g)["parts"]))


def kind_name(kind) -> Column:
    k = _c(kind)
    out = F.when(k == 1, "Point")
    for name, i in list(KINDS.items())[1:]:
        out = out.when(k == i, name)
    return out


def mvt_type(kind) -> Column:
    """1 point, 2 line, 3 polygon."""
    k = _c(kind)
    return F.when(k > 3, k - 3).otherwise(k).cast("int")


def to_mercator(g, clamp: bool = False) -> Column:
    """Longitude and latitude to metres for every coordinate."""
    g = _c(g)
    return geom(g["kind"], F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda c: coord(lon_to_x(c["x"]), lat_to_y(c["y"], clamp))))))


def map_coords(g, fx, fy) -> Column:
    g = _c(g)
    return geom(g["kind"], F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda c: coord(fx(c["x"]), fy(c["y"]))))))


def map_points(g, f) -> Column:
    """Every coordinate by f(x, y) -> (x, y), for projections whose axes depend on one another."""
    g = _c(g)
    return geom(g["kind"], F.transform(g["parts"], lambda p: F.transform(p, lambda r: F.transform(r, lambda c: coord(*f(c["x"], c["y"]))))))


def bbox(g) -> Column:
    """(minx, miny, maxx, maxy), null without coordinates."""
    xs = F.transform(coords_of(g), lambda c: c["x"])
    ys = F.transform(coords_of(g), lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def byte_cost(g) -> Column:
    """Bytes that a geometry takes in memory: 16 a coordinate and 8."""
    return F.size(coords_of(g)) * 16 + 8
