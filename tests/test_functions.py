import math
import random

import pytest
from pyspark.sql import functions as F

from quadweave.functions import curves, mercator, values
from quadweave.functions.geometry import bbox, box, byte_cost, coords_of, kind_name, mvt_type, point, to_mercator


def one(spark, *cols):
    return tuple(spark.range(1).select(*cols).first())


def test_projection_fixed_points(spark):
    x, y, edge, pole = one(spark, mercator.lon_to_x(F.lit(0.0)), mercator.lat_to_y(F.lit(0.0)), mercator.lon_to_x(F.lit(180.0)), mercator.lat_to_y(F.lit(90.0), clamp=True))
    assert x == 0 and abs(y) < 1e-6
    assert abs(edge - mercator.EXTENT) < 1
    assert abs(pole - mercator.EXTENT) < 1
    lon, lat = one(spark, mercator.x_to_lon(mercator.lon_to_x(F.lit(12.5))), mercator.y_to_lat(mercator.lat_to_y(F.lit(-47.25))))
    assert math.isclose(lon, 12.5) and math.isclose(lat, -47.25)


def test_world_is_tile_zero(spark):
    b = one(spark, mercator.tile_bbox(F.lit(0), F.lit(0), F.lit(0)))[0]
    assert [round(v) for v in b] == [-20037508, -20037508, 20037508, 20037508]


def test_tolerance_falls_with_zoom(spark):
    t = one(spark, *[mercator.simplify_tolerance(F.lit(z)) for z in (0, 10, 16)])
    assert 9000 < t[0] < 11000 and t[0] > t[1] > t[2]


def test_tile_ids_are_a_curve(spark):
    assert [curves.tile_id_of(*t) for t in [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0)]] == [0, 1, 2, 3, 4]
    z = 5
    at = [curves.tile_of_id((4**z - 1) // 3 + i) for i in range(4**z)]
    assert len(set(at)) == 4**z
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(at, at[1:], strict=False))
    random.seed(1)
    rows = [(z, random.randrange(1 << z), random.randrange(1 << z)) for z in (1, 7, 14, 20, 24) for _ in range(20)]
    got = spark.createDataFrame(rows, "z int, x long, y long").select("z", "x", "y", curves.tile_id("z", "x", "y").alias("i")).collect()
    assert all(curves.tile_id_of(r.z, r.x, r.y) == r.i and curves.tile_of_id(r.i) == (r.z, r.x, r.y) for r in got)


def test_morton_puts_bits_three_apart(spark):
    random.seed(2)
    rows = [(random.randrange(1 << 21), random.randrange(1 << 21)) for _ in range(100)]
    got = spark.createDataFrame(rows, "x long, y long").select("x", "y", (curves.spread_bits("x") + F.shiftleft(curves.spread_bits("y"), 1)).alias("c")).collect()
    spread = lambda v, s: sum((v >> i & 1) << s * i for i in range(21))
    assert all(r.c == spread(r.x, 3) | spread(r.y, 3) << 1 for r in got)
    by3 = sorted(rows, key=lambda r: spread(r[0], 3) | spread(r[1], 3) << 1)
    assert by3 == sorted(rows, key=lambda r: spread(r[0], 2) | spread(r[1], 2) << 1)


def test_zigzag_and_commands(spark):
    assert one(spark, *[mercator.zigzag(F.lit(v)) for v in (0, -1, 1, -2, 4096)]) == (0, 1, 2, 3, 8192)
    assert one(spark, mercator.command(1, F.lit(1)), mercator.command(2, F.lit(3)), mercator.command(7, F.lit(1))) == (9, 26, 15)


def test_rounding_is_away_from_zero(spark):
    assert one(spark, mercator.quantize_x(F.lit(-0.5 / 4096), F.lit(0.0), F.lit(1.0)), mercator.quantize_x(F.lit(2.5 / 4096), F.lit(0.0), F.lit(1.0))) == (-1, 3)


def test_attribute_tags(spark):
    text = '{"a":1,"b":2.0,"c":1e3,"d":18446744073709551615,"e":null,"f":[1],"g":true,"h":"x"}'
    p = {r["k"]: (r["t"], r["s"]) for r in one(spark, values.props_of(F.lit(text)))[0]}
    assert p["a"] == (values.T_INT, "1") and p["b"] == (values.T_DOUBLE, "2.0") and p["c"] == (values.T_DOUBLE, "1000.0")
    assert p["d"][0] == values.T_DOUBLE and float(p["d"][1]) == float(2**64 - 1)
    assert p["e"] == (values.T_STRING, "null") and p["f"] == (values.T_STRING, "[1]")
    assert p["g"] == (values.T_BOOL, "true") and p["h"] == (values.T_STRING, "x")
    assert one(spark, values.props_of(F.lit(None).cast("string")), values.props_of(F.lit("[]"))) == ([], [])


def test_json_type_names(spark):
    names = one(spark, *[values.json_type_name(F.parse_json(F.lit(t))) for t in ("1", "2.5", '"x"', "true", "null", "[1]")])
    assert names == ("Number", "Number", "String", "Boolean", "Null", "mixed")


@pytest.mark.parametrize(("n", "text"), [(512, "512 B"), (1536, "1.5 KB"), (265 << 20, "265 MB"), (6400, "6.2 KB"), (3 << 50, "3.0 PB")])
def test_human_bytes(spark, n, text):
    assert one(spark, values.human_bytes(F.lit(n)))[0] == text


def test_bounds_and_crs(spark):
    b = one(spark, values.parse_bounds(F.lit("1, 2,3,4")), values.parse_bounds(F.lit("1,2,x,4")), values.parse_bounds(F.lit(None).cast("string")))
    assert b == ([1.0, 2.0, 3.0, 4.0], [-180.0, -85.0, 180.0, 85.0], [-180.0, -85.0, 180.0, 85.0])
    c = one(spark, values.detect_crs(F.lit('{"crs":{"properties":{"name":"urn:ogc:def:crs:EPSG::2927"}}}')), values.detect_crs(F.lit('{"n":"EPSG:1"}')), values.is_wgs84(F.lit("ogc:crs84")))
    assert c == ("EPSG:2927", None, True)


def test_geometry_structs(spark):
    g = box(F.lit(0.0), F.lit(1.0), F.lit(2.0), F.lit(3.0))
    row = one(spark, bbox(g), byte_cost(g), kind_name(g["kind"]), mvt_type(F.lit(6)), F.size(coords_of(to_mercator(point(F.lit(1.0), F.lit(1.0))))))
    assert tuple(row[0]) == (0, 1, 2, 3) and row[1:] == (88, "Polygon", 3, 1)


def test_valid_addresses(spark):
    got = one(spark, *[mercator.valid_address(F.lit(z), F.lit(x), F.lit(y)) for z, x, y in [(0, 0, 0), (1, 2, 0), (25, 0, 0), (3, 7, 7), (2, -1, 0)]])
    assert got == (True, False, False, True, False)
