import random

import numpy as np
import pyarrow as pa
import pytest

from quadweave.operators import bulk, kernels, mvt
from quadweave.operators.tileset import part_rows

SIDE = 2 * bulk.EXTENT
COORDS = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
PROPS = pa.list_(pa.struct([("k", pa.string()), ("t", pa.int8()), ("s", pa.string())]))


def shapes(seed):
    """Lines and polygons of every sort: long and short, on tile edges, degenerate, concave, with holes, in parts."""
    rnd = random.Random(seed)
    at = lambda s=1.0: (rnd.uniform(-0.55, 0.55) * SIDE * s, rnd.uniform(-0.55, 0.55) * SIDE * s)
    edge = lambda: rnd.choice([0.0, SIDE / 4, -SIDE / 8, SIDE / 8 * (1 + 4 / 4096), SIDE / 2])

    def box(x, y, w, h):
        return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]

    for _ in range(40):
        yield 2, [[[at() for _ in range(rnd.randint(1, 7))]]]
        c = at()
        yield 2, [[[(c[0] + rnd.gauss(0, SIDE / 3000), c[1] + rnd.gauss(0, SIDE / 3000)) for _ in range(9)]]]
        yield 2, [[[(edge(), edge()), (edge(), edge()), (edge(), edge()), at()]]]
        yield 5, [[[at() for _ in range(3)], [at()], [at() for _ in range(2)]]]
        line = [at() for _ in range(4)]
        yield 2, [[[*line, line[-1], line[0]]]]
        size = rnd.choice([1e-6, 1e-4, 3e-4, 1e-3, 0.05, 0.4, 1.2]) * SIDE
        yield 3, [[box(*at(), size, size * rnd.choice([1, 0.3]))]]
        yield 3, [[box(*at(), size, size)[::-1]]]
        yield 3, [[box(edge(), edge(), SIDE / 8, SIDE / 4)]]
        star = [at(rnd.uniform(0.1, 1.3)) for _ in range(rnd.randint(3, 12))]
        yield 3, [[[*star, star[0]]]]
        yield 3, [[star]]
        yield 3, [[box(-SIDE / 5, -SIDE / 5, SIDE / 3, SIDE / 3), box(-SIDE / 9, -SIDE / 9, SIDE / 20, SIDE / 20)[::-1]]]
        yield 6, [[box(*at(), size, size)], [box(*at(), size, size)]]
        yield 6, [[box(*at(), size, size)]]
        yield 3, [[[(1.0, 1.0)] * 4]]
        yield 3, [[[(0.0, 0.0), (SIDE / 3, 0.0), (SIDE / 5, 0.0), (0.0, 0.0)]]]
        yield 4, [[[at(), at()]]]
        long = [at() for _ in range(30)]
        yield 3, [[[*long, long[0]]]]


def drawn(some, start, low, top, factor):
    parts = pa.array([[[[{"x": c[0], "y": c[1]} for c in r] for r in p] for p in g] for _, g in some], COORDS)
    boxes = [kernels.bounds(p) for _, p in some]
    w, h = (np.array([b[i + 2] - b[i] for b in boxes]) for i in (0, 1))
    z, x, y = (np.full(len(some), v) for v in start)
    kinds = np.array([k for k, _ in some])
    plain = [t for i, (k, p) in enumerate(some) for t in bulk.draw_plainly(i, k, p, start, (w[i], h[i]), low, top, factor)]
    return bulk.joined(list(bulk.draw(kinds, parts, z, x, y, w, h, low, top, factor))), plain


@pytest.mark.parametrize(("seed", "start", "low", "top", "factor"), [(1, (0, 0, 0), 0, 5, 1.0), (2, (0, 0, 0), 2, 4, 0.0), (3, (0, 0, 0), 0, 4, 40.0), (4, (2, 1, 2), 3, 6, 1.0)])
def test_arrays_draw_what_the_plain_kernels_draw(seed, start, low, top, factor, monkeypatch):
    monkeypatch.setattr(bulk, "POLYGONS", 300 * seed)
    monkeypatch.setattr(bulk, "HELD", 10_000)
    some = list(shapes(seed))
    got, plain = drawn(some, start, low, top, factor)
    end = np.cumsum(got.size)
    mine = {(r, z, x, y): (k, got.commands[e - n : e].tolist()) for r, z, x, y, k, n, e in zip(*[c.tolist() for c in (got.row, got.z, got.x, got.y, got.kind, got.size, end)], strict=True)}
    want = {t[:4]: t[4:] for t in plain}
    assert len(mine) == len(got) and len(want) == len(plain) > 1000
    assert mine == want


def test_parts_of_tiles_are_tiles_with_all_their_features():
    some = list(shapes(7))
    got, plain = drawn(some, (0, 0, 0), 0, 3, 1.0)
    props = [[{"k": "n", "t": 6, "s": str(i % 300)}, {"k": "s", "t": 1, "s": "x" * (i % 200)}][: i % 3] for i in range(len(some))]
    names = ["a" if i % 2 else "b" for i in range(len(some))]
    rows = pa.RecordBatch.from_arrays([pa.array(names), pa.array([0] * len(some), pa.int32()), pa.array(props, PROPS)], ["layer", "layer_ord", "props"])
    seen = 0
    for b in part_rows(rows, got):
        for r in b.to_pylist():
            (layer,) = mvt.decode_tile(r["data"])
            own = sorted((t for t in plain if t[1:4] == (r["z"], r["x"], r["y"]) and names[t[0]] == r["layer"]), key=lambda t: (t[4:], t[0]))
            plainly = mvt.Layer(r["layer"])
            for t in own:
                plainly.add(t[4], t[5], [(p["k"], p["t"], p["s"]) for p in props[t[0]]])
            (want,) = mvt.decode_tile(plainly.encode())
            key = lambda f: (f["type"], f["commands"], sorted(f["props"].items()))
            assert layer["name"] == r["layer"] and sorted(map(key, layer["features"])) == sorted(map(key, want["features"]))
            ((name, starts, ends),) = mvt.feature_spans(r["data"])
            of, xs, ys = bulk.drawn_points(np.frombuffer(r["data"], np.uint8), np.array(starts), np.array(ends))
            points = sorted((i, *c) for i, f in enumerate(layer["features"]) for p in f["paths"] for c in p)
            assert name == r["layer"] and r["features"] == len(starts) and sorted(zip(of.tolist(), xs.tolist(), ys.tolist(), strict=True)) == points
            seen += len(starts)
    assert seen == len(plain)


def test_extents_leave_out_what_has_no_finite_coordinates():
    c = lambda *v: [[[{"x": x, "y": y} for x, y in v]]]
    parts = pa.array([c((0.0, 1.0), (5.0, -1.0)), c(), [], [[]], c((0.0, 0.0), (float("nan"), 1.0)), c((0.0, float("inf"))), c((2.0, 2.0)), c((1e301, 0.0))], COORDS)
    for some, shift in ((parts, 0), (parts.slice(2), 2)):
        ok, w, h = bulk.extents(some)
        assert ok.tolist() == [True, False, False, False, False, False, True, False][shift:]
        assert shift or (w[0], h[0], w[6], h[6]) == (5.0, 2.0, 0.0, 0.0)
