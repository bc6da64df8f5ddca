import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from quadweave.operators import kernels as k
from quadweave.operators import mvt

RECT = (-1.0, -1.0, 1.0, 1.0)


def square(r):
    return [(-r, -r), (r, -r), (r, r), (-r, r), (-r, -r)]


def total(polygons):
    return sum(abs(k.area(p[0])) - sum(abs(k.area(h)) for h in p[1:]) for p in polygons)


def test_in_and_out():
    assert k.clip(1, [[[(0.0, 0.0)]]], RECT) == (1, [[[(0.0, 0.0)]]])
    assert k.clip(1, [[[(5.0, 5.0)]]], RECT) is None
    assert k.clip(2, [[[(-5.0, 0.0), (5.0, 0.0)]]], RECT) == (2, [[[(-1.0, 0.0), (1.0, 0.0)]]])
    assert total(k.clip(3, [[square(2.0)]], RECT)[1]) == 4
    assert k.clip(3, [[[(10.0, 10.0), (20.0, 10.0), (20.0, 20.0), (10.0, 10.0)]]], RECT) is None
    assert k.clip(4, [[[(0.0, 0.0), (9.0, 0.0), (1.0, 1.0)]]], RECT) == (4, [[[(0.0, 0.0), (1.0, 1.0)]]])


def test_lines_split_and_join():
    kind, parts = k.clip(2, [[[(-2.0, 0.0), (0.0, 0.0), (0.5, 0.5), (3.0, 0.5), (3.0, 0.8), (0.0, 0.8)]]], RECT)
    assert kind == 5 and len(parts[0]) == 2 and parts[0][0] == [(-1.0, 0.0), (0.0, 0.0), (0.5, 0.5), (1.0, 0.5)]


def test_concave_polygon_falls_into_parts():
    u = [(-3.0, -3.0), (3.0, -3.0), (3.0, 0.5), (0.7, 0.5), (0.7, -2.0), (-0.7, -2.0), (-0.7, 0.5), (-3.0, 0.5), (-3.0, -3.0)]
    kind, polygons = k.clip(3, [[u]], RECT)
    assert kind == 6 and len(polygons) == 2
    assert math.isclose(total(polygons), 2 * 0.3 * 1.5)


def test_holes_are_kept_and_cut():
    kind, polygons = k.clip(3, [[square(3.0), square(0.5)[::-1]]], RECT)
    assert kind == 3 and len(polygons[0]) == 2 and math.isclose(total(polygons), 3)
    hole = [(0.0, -0.5), (0.0, 0.5), (4.0, 0.5), (4.0, -0.5), (0.0, -0.5)]
    _, cut = k.clip(3, [[square(5.0), hole]], RECT)
    assert math.isclose(total(cut), 3)
    assert k.area(polygons[0][0]) > 0 > k.area(polygons[0][1])


def test_tiles_share_a_polygon_exactly():
    random.seed(5)
    for _ in range(60):
        n = random.randint(3, 14)
        ring = [(math.cos(2 * math.pi * i / n) * (r := random.uniform(0.3, 4)), math.sin(2 * math.pi * i / n) * r) for i in range(n)]
        whole = abs(k.area(ring))
        ring.append(ring[0])
        parts = [k.clip(3, [[ring]], (x, y, x + 2.0, y + 2.0)) for x in (-5.0, -3.0, -1.0, 1.0, 3.0) for y in (-5.0, -3.0, -1.0, 1.0, 3.0)]
        assert math.isclose(sum(total(p[1]) for p in parts if p), whole, rel_tol=1e-9)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-5, 5), st.floats(-5, 5)), min_size=2, max_size=12))
def test_clipped_lines_stay_inside(coords):
    got = k.clip(2, [[coords]], RECT)
    for ring in got[1][0] if got else []:
        assert len(ring) > 1 and all(-1 <= x <= 1 and -1 <= y <= 1 for x, y in ring)


def test_simplify_keeps_ends_and_rings():
    line = [(0.0, 0.0), (1.0, 0.01), (2.0, -0.01), (3.0, 0.0)]
    assert k.simplify_line(line, 0.1) == [(0.0, 0.0), (3.0, 0.0)]
    assert k.simplify_line(line, 0.001) == line
    ring = k.simplify(3, [[square(1.0)]], 100.0)[1][0][0]
    assert len(ring) == 4 and ring[0] == ring[-1]
    assert k.simplify(2, [[[(0.0, 0.0)]]], 1.0) is None
    assert k.simplify(1, [[[(0.0, 0.0)]]], 1.0) == (1, [[[(0.0, 0.0)]]])


def test_encoded_geometry_decodes_to_the_grid():
    tile = (0.0, 0.0, 4096.0, 4096.0)
    _, cmd = mvt.encode_geometry(5, [[[(0.0, 4096.0), (10.0, 4090.0)], [(100.0, 4000.0), (110.0, 3990.0)]]], tile)
    assert mvt.decode_geometry(cmd) == [[(0, 0), (10, 6)], [(100, 96), (110, 106)]]
    polygon = [[(0.0, 0.0), (100.0, 0.0), (100.0, 100.0), (0.0, 100.0), (0.0, 0.0)], [(20.0, 20.0), (20.0, 40.0), (40.0, 40.0), (20.0, 20.0)]]
    kind, cmd = mvt.encode_geometry(3, [polygon], tile)
    paths = mvt.decode_geometry(cmd)
    turn = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:], strict=False))
    assert kind == 3 and turn(paths[0]) > 0 > turn(paths[1])
    assert {(x, 4096 - y) for x, y in paths[0]} == set(map(lambda c: (int(c[0]), int(c[1])), polygon[0]))
    assert mvt.encode_geometry(2, [[[(0.0, 0.0)]]], tile)[1] == []


def test_layers_round_trip():
    layer = mvt.Layer("a")
    layer.add(1, [9, 2, 2], [("k", 6, "1"), ("d", 3, "1.0")])
    layer.add(1, [9, 4, 4], [("k", 6, "-5"), ("s", 1, "null"), ("b", 7, "true")])
    other = mvt.Layer("b")
    other.add(2, [9, 0, 0, 10, 2, 2], [])
    a, b = mvt.decode_tile(layer.encode() + other.encode())
    assert a["name"] == "a" and a["version"] == 2 and a["extent"] == 4096
    assert a["features"][0]["props"] == {"k": ("sint", 1), "d": ("double", 1.0)}
    assert a["features"][1]["props"] == {"k": ("sint", -5), "s": ("string", "null"), "b": ("bool", True)}
    assert b["features"][0]["paths"] == [[(0, 0), (1, 1)]]


def test_what_collapses_on_the_grid_is_not_drawn():
    tile = (0.0, 0.0, 4096.0, 4096.0)
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)]
    assert mvt.encode_geometry(3, [[square(10, 10, 0.2)]], tile)[1] == []
    drawn = mvt.encode_geometry(6, [[square(100, 100, 50)], [square(10, 10, 0.2), square(10.05, 10.05, 20)]], tile)[1]
    assert [len(p) for p in mvt.decode_geometry(drawn)] == [5]  # the hole went with its shell
    assert [len(p) for p in mvt.decode_geometry(mvt.encode_geometry(2, [[[(0, 0), (0.1, 0.1), (9, 9), (9.2, 9)]]], tile)[1])] == [2]
    assert mvt.encode_geometry(2, [[[(5, 5), (5.1, 5.1)]]], tile)[1] == []
