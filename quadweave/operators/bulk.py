"""Clip, simplify and draw many features at once: the kernels of kernels.py and mvt.py on flat arrays.

Lines, and polygons of one ring that a half plane cuts into one piece, go down the pyramid level by level in arrays.
What arrays don't hold (points, holes, several polygons, rings cut into several pieces, long rings, coordinates that
aren't finite) goes through the plain kernels; both give the same tiles and commands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np

from quadweave.functions.mercator import BUFFER, EXTENT, GRID
from quadweave.operators import kernels
from quadweave.operators.kernels import JOIN, Parts, Rect
from quadweave.operators.mvt import CLOSE, LINE, MOVE, encode_geometry

#: Commands that are held before they are handed on, and polygons in tiles that are cut at once.
HELD = 4_000_000
POLYGONS = 20_000
#: Coordinates of a ring, its closing one included, up to which it is kept in arrays.
RING = 16


@dataclass
class Drawn:
    """Features in tiles: row, zoom, tile, type and the number of commands of each; all commands one after another."""

    row: np.ndarray
    z: np.ndarray
    x: np.ndarray
    y: np.ndarray
    kind: np.ndarray
    size: np.ndarray
    commands: np.ndarray

    def __len__(self) -> int:
        return len(self.row)

    def of(self, some: np.ndarray) -> Drawn:
        """Those that a mask or a list of places names."""
        start, size = (np.cumsum(self.size) - self.size)[some], self.size[some]
        return Drawn(*[c[some] for c in (self.row, self.z, self.x, self.y, self.kind)], size, self.commands[spread(start, size)])


def joined(some: list[Drawn]) -> Drawn:
    columns = zip(*[(d.row, d.z, d.x, d.y, d.kind, d.size, d.commands) for d in some], strict=True)
    return Drawn(*map(np.concatenate, columns)) if some else Drawn(*[np.zeros(0, np.int64)] * 7)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then those of the next."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def tile_rect(z: int, x: int, y: int) -> Rect:
    side = 2 * EXTENT / (1 << z)
    minx, maxy = -EXTENT + x * side, EXTENT - y * side
    return minx, maxy - side, minx + side, maxy


def grown(rect: Rect) -> Rect:
    b = (rect[2] - rect[0]) * BUFFER / GRID
    return rect[0] - b, rect[1] - b, rect[2] + b, rect[3] + b


def descend(kind: int, parts: Parts, at: tuple[int, int, int], last: int) -> Iterator[tuple[int, int, int, int, Parts]]:
    """(z, x, y, kind, parts) of every tile down to zoom `last` that the geometry meets, from one tile on.

    A tile's clip is cut from its parent's, whose buffered square holds it, so tiles that a feature doesn't meet
    are never looked at and big features cost as much as the tiles that they touch.
    """
    todo = [(*at, kind, parts)]
    while todo:
        z, x, y, k, p = todo.pop()
        got = kernels.clip(k, p, grown(tile_rect(z, x, y)))
        if got is None:
            continue
        yield z, x, y, *got
        if z < last:
            todo += [(z + 1, 2 * x + i, 2 * y + j, *got) for i in (0, 1) for j in (0, 1)]


def draw_plainly(row: int, kind: int, parts: Parts, at: tuple[int, int, int], size: tuple[float, float], low: int, top: int, factor: float) -> Iterator[tuple]:
    """(row, z, x, y, type, commands) of one feature below one tile by the plain kernels, at zooms low to top."""
    for z, x, y, k, p in descend(kind, parts, at, top):
        tol = 2 * EXTENT / (1 << z) / GRID * factor
        if z < low or too_small(*size, tol):
            continue
        tile = tile_rect(z, x, y)
        got = kernels.simplify(k, p, tol)
        got = got and kernels.clip(*got, grown(tile))
        if got:
            of, commands = encode_geometry(*got, tile)
            if commands:
                yield row, z, x, y, of, commands


def too_small(width, height, tol):
    return ((width > 0) | (height > 0)) & (width < tol) & (height < tol)


def from_rows(rows: list[tuple]) -> Drawn:
    if not rows:
        return joined([])
    *five, commands = zip(*rows, strict=True)
    return Drawn(*[np.array(c, np.int64) for c in five], np.array([len(c) for c in commands], np.int64), np.array([v for c in commands for v in c], np.int64))


def _rects(z: int, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """grown(tile_rect()) of many tiles, by the same arithmetic."""
    return grown(tile_rect(z, x, y))


def _zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)) & 0xFFFFFFFF


def _grid(v: np.ndarray, side: np.ndarray) -> np.ndarray:
    q = v / side * GRID
    return np.copysign(np.floor(np.abs(q) + 0.5), q).astype(np.int64)


def _far(xs: np.ndarray, ys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """kernels._far of many stretches with points between their ends."""
    n = hi - lo - 1
    at, own = spread(lo + 1, n), np.repeat(np.arange(len(lo)), n)
    ax, ay = xs[lo], ys[lo]
    dx, dy = xs[hi] - ax, ys[hi] - ay
    square = dx * dx + dy * dy
    px, py = xs[at] - ax[own], ys[at] - ay[own]
    dx, dy = dx[own], dy[own]
    t = np.maximum(0.0, np.minimum(1.0, (px * dx + py * dy) / np.where(square, square, 1.0)[own]))
    px, py = px - t * dx, py - t * dy
    d = px * px + py * py
    best = np.maximum.reduceat(d, np.cumsum(n) - n)
    hits = np.flatnonzero(d == best[own])
    return best, at[hits[np.r_[True, own[hits[1:]] != own[hits[:-1]]]]]


def simplified(xs: np.ndarray, ys: np.ndarray, starts: np.ndarray, sizes: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points Douglas-Peucker keeps of many paths of two points at least."""
    keep = np.zeros(len(xs), bool)
    keep[starts] = keep[starts + sizes - 1] = True
    if tolerance <= 0:
        keep[:] = True
        return keep
    lo, hi = starts, starts + sizes - 1
    while True:
        long = hi - lo > 1
        lo, hi = lo[long], hi[long]
        if not len(lo):
            return keep
        d, at = _far(xs, ys, lo, hi)
        cut = d > tolerance * tolerance
        lo, hi, at = lo[cut], hi[cut], at[cut]
        keep[at] = True
        lo, hi = np.concatenate([lo, at]), np.concatenate([at, hi])


class Lines:
    """Pieces of lines in tiles of one zoom: row and tile of each node; node, start and size of each piece."""

    def __init__(self, z, row, x, y, node, size, xs, ys):
        self.z, self.row, self.x, self.y, self.node, self.size, self.xs, self.ys = z, row, x, y, node, size, xs, ys
        self.start = np.cumsum(size) - size

    def segments(self) -> tuple[np.ndarray, np.ndarray]:
        """(first point, piece) of every segment."""
        return spread(self.start, self.size - 1), np.repeat(np.arange(len(self.size)), self.size - 1)

    def clip(self, z: int, x: np.ndarray, y: np.ndarray, a: np.ndarray, piece: np.ndarray) -> Lines:
        """What lies in tiles of zoom z, one for each node; a node may be left without pieces and goes."""
        node = self.node[piece]
        rect = _rects(z, x, y)
        p = [self.xs[a], self.ys[a]]
        q = [self.xs[a + 1], self.ys[a + 1]]
        near = np.ones(len(a), bool)
        for k in (0, 1):
            near &= (np.maximum(p[k], q[k]) >= rect[k][node]) & (np.minimum(p[k], q[k]) <= rect[k + 2][node])
        node, piece = node[near], piece[near]
        p, q = [c[near] for c in p], [c[near] for c in q]
        low, high = [rect[k][node] for k in (0, 1)], [rect[k + 2][node] for k in (0, 1)]
        d = [q[k] - p[k] for k in (0, 1)]
        t0, t1 = np.zeros(len(node)), np.ones(len(node))
        for k in (0, 1):
            flat = d[k] == 0  # such a segment lies between the two sides, as it is near
            by = np.where(flat, 1.0, d[k])
            u, v = (low[k] - p[k]) / by, (high[k] - p[k]) / by
            t0 = np.where(flat, t0, np.maximum(t0, np.minimum(u, v)))
            t1 = np.where(flat, t1, np.minimum(t1, np.maximum(u, v)))
        met = np.flatnonzero(t0 <= t1)
        node, piece, t0, t1 = node[met], piece[met], t0[met], t1[met]
        s, e = [], []
        for k in (0, 1):
            pk, dk, lk, hk = p[k][met], d[k][met], low[k][met], high[k][met]
            s.append(np.where(t0 == 0, pk, np.minimum(np.maximum(pk + t0 * dk, lk), hk)))
            e.append(np.where(t1 == 1, q[k][met], np.minimum(np.maximum(pk + t1 * dk, lk), hk)))
        new = np.ones(len(met), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (np.hypot(e[0][:-1] - s[0][1:], e[1][:-1] - s[1][1:]) > JOIN)
        end = np.cumsum(1 + new) - 1
        first = end[new] - 1
        xs, ys = np.empty(len(met) + len(first)), np.empty(len(met) + len(first))
        xs[end], ys[end], xs[first], ys[first] = e[0], e[1], s[0][new], s[1][new]
        node = node[new]
        fresh = np.ones(len(node), bool)
        fresh[1:] = node[1:] != node[:-1]
        own = node[fresh]
        return Lines(z, self.row[own], x[own], y[own], np.cumsum(fresh) - 1, np.diff(np.r_[first, len(xs)]), xs, ys)

    def children(self) -> Iterator[Lines]:
        a, piece = self.segments()
        for i in (0, 1):
            for j in (0, 1):
                yield self.clip(self.z + 1, 2 * self.x + i, 2 * self.y + j, a, piece)

    def drawn(self, seen: np.ndarray, factor: float) -> Drawn:
        """Commands of the nodes that are seen."""
        tol = 2 * EXTENT / (1 << self.z) / GRID * factor
        piece = np.repeat(np.arange(len(self.size)), self.size)
        keep = simplified(self.xs, self.ys, self.start, self.size, tol) & seen[self.node][piece]
        piece = piece[keep]
        node = self.node[piece]
        minx, miny, maxx, maxy = tile_rect(self.z, self.x, self.y)
        gx = _grid(self.xs[keep] - minx[node], (maxx - minx)[node])
        gy = _grid(maxy[node] - self.ys[keep], (maxy - miny)[node])
        apart = np.ones(len(piece), bool)
        apart[1:] = (piece[1:] != piece[:-1]) | (gx[1:] != gx[:-1]) | (gy[1:] != gy[:-1])
        apart &= np.bincount(piece[apart], minlength=len(self.size))[piece] > 1
        return _commands(self, piece[apart], self.node, gx[apart], gy[apart], 2)


def _commands(at, path: np.ndarray, node_of: np.ndarray, gx: np.ndarray, gy: np.ndarray, kind: int) -> Drawn:
    """Commands of paths (path of each point, ascending) whose nodes are ascending too."""
    if not len(path):
        return joined([])
    first = np.flatnonzero(np.r_[True, path[1:] != path[:-1]])
    n = np.diff(np.r_[first, len(path)])
    node = node_of[path[first]]
    dx, dy = gx.copy(), gy.copy()
    same = np.repeat(node, n)
    same = np.r_[False, same[1:] == same[:-1]]
    dx[1:] -= np.where(same[1:], gx[:-1], 0)
    dy[1:] -= np.where(same[1:], gy[:-1], 0)
    size = 2 + 2 * n + (kind == 3)
    start = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.int64)
    out[start], out[start + 3] = MOVE | 1 << 3, LINE | n - 1 << 3
    if kind == 3:
        out[start + size - 1] = CLOSE | 1 << 3
    k = np.arange(len(path)) - np.repeat(first, n)
    to = np.repeat(start, n) + np.where(k == 0, 1, 2 + 2 * k)
    out[to], out[to + 1] = _zigzag(dx), _zigzag(dy)
    head = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
    own = node[head]
    full = lambda v: np.full(len(own), v, np.int64)
    return Drawn(at.row[own], full(at.z), at.x[own], at.y[own], full(kind), np.add.reduceat(size, head), out)


class Rings:
    """Polygons of one closed ring each, in tiles of one zoom: coordinates in rows of equal length, n of them count."""

    def __init__(self, z, row, x, y, n, xs, ys):
        self.z, self.row, self.x, self.y, self.n, self.xs, self.ys = z, row, x, y, n, xs, ys

    def of(self, some: np.ndarray) -> Rings:
        return Rings(self.z, self.row[some], self.x[some], self.y[some], self.n[some], self.xs[some], self.ys[some])

    def part(self, k: int) -> Parts:
        n = int(self.n[k])
        return [[list(zip(self.xs[k, :n].tolist(), self.ys[k, :n].tolist(), strict=True))]]

    def box(self) -> tuple[np.ndarray, ...]:
        inside = np.arange(self.xs.shape[1]) < self.n[:, None]
        return tuple(f(np.where(inside, c, end), axis=1) for f, end in ((np.min, np.inf), (np.max, -np.inf)) for c in (self.xs, self.ys))

    def clip(self) -> tuple[Rings, Rings]:
        """(what lies in the tiles, polygons as they were that the plain kernel has to cut)."""
        rect = _rects(self.z, self.x, self.y)
        b = self.box()
        meets = (b[0] <= rect[2]) & (b[2] >= rect[0]) & (b[1] <= rect[3]) & (b[3] >= rect[1])
        within = meets & (b[0] >= rect[0]) & (b[2] <= rect[2]) & (b[1] >= rect[1]) & (b[3] <= rect[3])
        cut = self.of(np.flatnonzero(meets & ~within))
        own = [r[meets & ~within] for r in rect]
        whole = self.of(np.flatnonzero(within))
        if not len(cut.row):
            return whole, cut
        plain = np.zeros(len(cut.row), bool)
        xs, ys, n = _tidy(cut.xs, cut.ys, cut.n)
        for axis, sign, limit in ((0, 1.0, own[2]), (0, -1.0, own[0]), (1, 1.0, own[3]), (1, -1.0, own[1])):
            xs, ys, n, several = _half_plane(xs, ys, n, axis, sign, limit)
            plain |= several
            xs, ys, n = _tidy(xs, ys, n)
            n[n < 3] = 0
        area, most = _areas(xs, ys, n)
        # where rounding could tell, the plain kernel does
        plain |= (n > 0) & ((np.abs(area) <= 1e-9 * most) | (n + 1 > RING))
        good = (n > 0) & ~plain
        k = np.arange(RING)
        last = n[good][:, None]
        turn = np.where((area[good] > 0)[:, None], k, last - 1 - k)
        turn = np.where(k < last, turn, np.where((area[good] > 0)[:, None], 0, last - 1))  # the closing point and the rest
        take = lambda c: np.take_along_axis(c[good], turn, 1)
        done = Rings(cut.z, cut.row[good], cut.x[good], cut.y[good], n[good] + 1, take(xs), take(ys))
        return _stacked([whole, done]), cut.of(np.flatnonzero(plain))

    def children(self) -> list[Rings]:
        """Tile by tile, or together if they are few."""
        of = [(2 * self.x + i, 2 * self.y + j) for i in (0, 1) for j in (0, 1)]
        out = [Rings(self.z + 1, self.row, x, y, self.n, self.xs, self.ys) for x, y in of]
        return [_stacked(out)] if 4 * len(self.row) <= POLYGONS else out

    def drawn(self, seen: np.ndarray, factor: float) -> tuple[Drawn, Rings]:
        """(commands of the nodes that are seen, nodes that the plain kernels have to draw)."""
        here = self.of(np.flatnonzero(seen & (self.n > 3)))
        width = here.xs.shape[1]
        tol = 2 * EXTENT / (1 << here.z) / GRID * factor
        start = np.arange(len(here.n)) * width
        keep = np.zeros(here.xs.shape, bool)
        if len(start):
            keep = simplified(here.xs.ravel(), here.ys.ravel(), start, here.n, tol).reshape(here.xs.shape)
        inside = np.arange(width) < here.n[:, None]
        keep = np.where(here.n[:, None] > 4, keep, True) & inside
        rect, b = _rects(here.z, here.x, here.y), here.box()
        plain = (keep.sum(1) < 4) | (b[0] < rect[0]) | (b[2] > rect[2]) | (b[1] < rect[1]) | (b[3] > rect[3])
        closed = (here.xs[:, 0] == here.xs[np.arange(len(start)), here.n - 1]) & (here.ys[:, 0] == here.ys[np.arange(len(start)), here.n - 1])
        keep[np.flatnonzero(closed), here.n[closed] - 1] = False
        minx, miny, maxx, maxy = (v[:, None] for v in tile_rect(here.z, here.x, here.y))
        n = keep.sum(1)
        order = np.argsort(~keep, axis=1, kind="stable")
        gx = np.take_along_axis(_grid(np.where(inside, here.xs, minx) - minx, maxx - minx), order, 1)
        gy = np.take_along_axis(_grid(maxy - np.where(inside, here.ys, maxy), maxy - miny), order, 1)
        gx, gy, n = _tidy(gx, gy, n)
        turn, _ = _areas(gx, gy, n)
        k = np.arange(width)
        back = np.where((turn < 0)[:, None] & (k < n[:, None]), n[:, None] - 1 - k, k)
        gx, gy = np.take_along_axis(gx, back, 1), np.take_along_axis(gy, back, 1)
        draws = (k < n[:, None]) & ((turn != 0) & ~plain)[:, None]
        path = np.repeat(np.arange(len(n)), draws.sum(1))
        return _commands(here, path, np.arange(len(n)), gx[draws], gy[draws], 3), here.of(np.flatnonzero(plain))


def _stacked(some: list[Rings]) -> Rings:
    a = some[0]
    return Rings(a.z, *[np.concatenate([getattr(r, c) for r in some]) for c in ("row", "x", "y", "n", "xs", "ys")])


def _tidy(xs: np.ndarray, ys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """kernels._tidy of many rings."""
    if not len(n):
        return xs, ys, n
    k = np.arange(xs.shape[1])
    keep = k < n[:, None]
    keep[:, 1:] &= (xs[:, 1:] != xs[:, :-1]) | (ys[:, 1:] != ys[:, :-1])
    order = np.argsort(~keep, axis=1, kind="stable")
    xs, ys, n = np.take_along_axis(xs, order, 1), np.take_along_axis(ys, order, 1), keep.sum(1)
    every, last = np.arange(len(n)), np.maximum(n - 1, 0)
    return xs, ys, n - ((n > 1) & (xs[every, last] == xs[:, 0]) & (ys[every, last] == ys[:, 0]))


def _half_plane(xs, ys, n, axis, sign, limit):
    """kernels._half_plane of many open rings that fall into one piece at most; the last value marks the others."""
    every, width = np.arange(len(n)), xs.shape[1]
    k = np.arange(width)
    used = k < n[:, None]
    c = (xs, ys)
    d = sign * (limit[:, None] - c[axis])
    inside = (d >= 0) & used
    before = np.empty_like(inside)
    before[:, 1:], before[:, 0] = inside[:, :-1], inside[every, np.maximum(n - 1, 0)]
    enters = (inside & ~before).sum(1)
    cut = enters == 1
    m = inside.sum(1)
    first = np.argmax(inside & ~before, axis=1)
    size = np.where(cut, m + 2, np.where(m == n, n, 0))
    wide = max(width, int(size.max(initial=0)))
    j = np.arange(wide)
    ring = np.maximum(n, 1)[:, None]
    at = np.where(cut[:, None], (first[:, None] + j - 1) % ring, np.minimum(j, width - 1))
    out = [np.take_along_axis(v, at, 1) for v in c]

    def cross(i, o, rows):
        t = d[rows, i] / (d[rows, i] - d[rows, o])
        other = c[1 - axis]
        return other[rows, i] + t * (other[rows, o] - other[rows, i])

    rows = np.flatnonzero(cut)
    f, r = first[rows], n[rows]
    out[axis][rows, 0], out[1 - axis][rows, 0] = limit[rows], cross((f - 1) % r, f, rows)
    e = m[rows] + 1
    out[axis][rows, e], out[1 - axis][rows, e] = limit[rows], cross((f + m[rows] - 1) % r, (f + m[rows]) % r, rows)
    return out[0], out[1], size, enters > 1


def _areas(xs: np.ndarray, ys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the signed areas of open rings, and the sums of the sizes of what they are added up from."""
    if not len(n):
        return np.zeros(0, xs.dtype), np.zeros(0, xs.dtype)
    k = np.arange(xs.shape[1])
    used = k < n[:, None]
    after = np.where(k + 1 < n[:, None], np.minimum(k + 1, len(k) - 1), 0)
    a, b = xs * np.take_along_axis(ys, after, 1), np.take_along_axis(xs, after, 1) * ys
    return np.where(used, a - b, 0).sum(1), np.where(used, np.abs(a) + np.abs(b), 0).sum(1)


def _flat(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(polygons of each feature, rings of each polygon, coordinates of each ring, x and y of each) of an Arrow array."""
    counts = []
    for _ in range(3):
        counts.append(parts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        parts = parts.flatten()
    return *counts, *(c.to_numpy(zero_copy_only=False) for c in parts.flatten())


def extents(parts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether there are coordinates and all are finite, width, height) of each feature."""
    polygons, rings, sizes, xs, ys = _flat(parts)
    n = np.bincount(np.repeat(np.repeat(np.arange(len(parts)), polygons), rings), sizes, len(parts)).astype(np.int64)
    ok = n > 0
    w, h = np.zeros(len(parts)), np.zeros(len(parts))
    if ok.any():
        first = (np.cumsum(n) - n)[ok]
        with np.errstate(invalid="ignore"):
            w[ok], h[ok] = (np.maximum.reduceat(c, first) - np.minimum.reduceat(c, first) for c in (xs, ys))
        far = lambda c: np.maximum.reduceat(np.where(np.isnan(c), np.inf, np.abs(c)), first)
        ok[ok] = (far(xs) < 1e300) & (far(ys) < 1e300)
    return ok, w, h


def _drawn(kind: np.ndarray, parts, z: np.ndarray, x: np.ndarray, y: np.ndarray, width: np.ndarray, height: np.ndarray, low: int, top: int, factor: float) -> Iterator[Drawn]:
    """Commands in all tiles of zooms low to top that features meet, each from its tile on.

    parts: an Arrow array of polygons, rings and coordinates for each feature.
    """
    polygons, rings, sizes, xs, ys = _flat(parts)
    row_of_ring = np.repeat(np.repeat(np.arange(len(kind)), polygons), rings)
    odd = np.zeros(len(kind), bool)
    odd[np.repeat(row_of_ring, sizes)[~(np.isfinite(xs) & np.isfinite(ys))]] = True
    n_rings = np.bincount(row_of_ring, minlength=len(kind))
    starts = np.cumsum(sizes) - sizes
    line = np.isin(kind, (2, 5)) & (polygons == 1) & ~odd
    longest = np.zeros(len(kind), np.int64)
    np.maximum.at(longest, row_of_ring, sizes)
    ring = np.isin(kind, (3, 6)) & (polygons == 1) & (n_rings == 1) & (longest <= RING) & (longest > 3) & ~odd

    def plainly(hard: Rings, last: int) -> Iterator[Drawn]:
        for k in range(len(hard.row)):
            r = int(hard.row[k])
            yield from _some(draw_plainly(r, 3, hard.part(k), (hard.z, int(hard.x[k]), int(hard.y[k])), (width[r], height[r]), low, last, factor))

    for z0 in np.unique(z).tolist():
        tol = lambda at: 2 * EXTENT / (1 << at) / GRID * factor
        seen = lambda n: ~too_small(width[n.row], height[n.row], tol(n.z))
        own = line & (z == z0)
        mine = np.flatnonzero(own[row_of_ring] & (sizes > 1))
        if len(mine):
            nodes = np.flatnonzero(own)
            number = np.zeros(len(kind), np.int64)
            number[nodes] = np.arange(len(nodes))
            at = spread(starts[mine], sizes[mine])
            root = Lines(z0, nodes, x[nodes], y[nodes], number[row_of_ring[mine]], sizes[mine], xs[at], ys[at])
            todo = [root.clip(z0, root.x, root.y, *root.segments())]
            while todo:
                n = todo.pop()
                if not len(n.row):
                    continue
                if n.z >= low:
                    yield n.drawn(seen(n), factor)
                if n.z < top:
                    todo += n.children()
        mine = np.flatnonzero((ring & (z == z0))[row_of_ring])
        if len(mine):
            nodes = row_of_ring[mine]
            at = starts[mine][:, None] + np.minimum(np.arange(RING), sizes[mine][:, None] - 1)
            todo = [Rings(z0, nodes, x[nodes], y[nodes], sizes[mine], xs[at], ys[at])]
            while todo:
                now, hard = todo.pop().clip()
                yield from plainly(hard, top)
                if not len(now.row):
                    continue
                if now.z >= low:
                    done, hard = now.drawn(seen(now), factor)
                    yield done
                    yield from plainly(hard, now.z)
                if now.z < top:
                    todo += now.children()
    for r in np.flatnonzero(~line & ~ring).tolist():
        own = [[[(c["x"], c["y"]) for c in path] for path in p] for p in parts[r].as_py()]
        yield from _some(draw_plainly(r, int(kind[r]), own, (int(z[r]), int(x[r]), int(y[r])), (width[r], height[r]), low, top, factor))


def _some(rows: Iterator[tuple]) -> Iterator[Drawn]:
    while part := list(islice(rows, 1000)):
        yield from_rows(part)


def draw(*features) -> Iterator[Drawn]:
    """_drawn() in few pieces, none of which is much larger than HELD commands."""
    out, held = [], 0
    for d in _drawn(*features):
        if len(d):
            out.append(d)
            held += len(d.commands)
        if held > HELD:
            yield joined(out)
            out, held = [], 0
    if out:
        yield joined(out)


# ---- varints ------------------------------------------------------------------------------------------------------
def widths(v: np.ndarray) -> np.ndarray:
    """Bytes of each value as a varint; values are below 2 ** 35."""
    return 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21) + (v >= 1 << 28)


def varints(v: np.ndarray, width: np.ndarray) -> np.ndarray:
    end = np.cumsum(width)
    start = end - width
    out = np.empty(int(end[-1]) if len(end) else 0, np.uint8)
    out[start] = (v & 127) | ((width > 1) << 7)
    for k in range(1, 5):
        some = np.flatnonzero(width > k)
        if not len(some):
            break
        out[start[some] + k] = ((v[some] >> 7 * k) & 127) | ((width[some] > k + 1) << 7)
    return out


def feature_bytes(kind: np.ndarray, size: np.ndarray, commands: np.ndarray, n_tags: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each feature in them): features of a layer as its fields, as mvt.Layer.add() makes them."""
    start = np.cumsum(size) - size
    of_commands = np.add.reduceat(widths(commands), start)
    has = n_tags > 0
    of_tags = np.bincount(np.repeat(np.arange(len(size)), n_tags), widths(tags), len(size)).astype(np.int64) if len(tags) else np.zeros(len(size), np.int64)
    body = np.where(has, 1 + widths(of_tags) + of_tags, 0) + 3 + widths(of_commands) + of_commands
    count = 6 + size + np.where(has, 2 + n_tags, 0)
    end = np.cumsum(count)
    at = end - count
    out = np.empty(int(end[-1]), np.int64)
    out[at], out[at + 1] = 2 << 3 | 2, body
    own = at[has]
    out[own + 2], out[own + 3] = 2 << 3 | 2, of_tags[has]
    out[spread(own + 4, n_tags[has])] = tags
    at = at + np.where(has, 2 + n_tags, 0)
    out[at + 2], out[at + 3], out[at + 4], out[at + 5] = 3 << 3, kind, 4 << 3 | 2, of_commands
    out[spread(at + 6, size)] = commands
    width = widths(out)
    return varints(out, width), np.cumsum(width)[end - 1]


def _number(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, places behind them) of the varints that start at some places."""
    value, shift, at = np.zeros(len(at), np.int64), 0, at.copy()
    more = np.arange(len(at))
    while len(more):
        b = raw[at[more]].astype(np.int64)
        value[more] |= (b & 127) << shift
        at[more] += 1
        shift += 7
        more = more[b > 127]
    return value, at


def drawn_points(raw: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, x, y) of every point that the features between some places of bytes draw; rings end where they start.

    The same as mvt.decode_geometry() of their commands, for many features at once.
    """
    at, features = at.copy(), at
    span = np.zeros((2, len(features)), np.int64)
    todo = np.flatnonzero(at < end)
    while len(todo):
        key, at[todo] = _number(raw, at[todo])
        value, at[todo] = _number(raw, at[todo])
        long = key & 7 == 2
        own = todo[long]
        here = key[long] >> 3 == 4
        span[0, own[here]], span[1, own[here]] = at[own[here]], value[long][here]
        at[own] += value[long]
        todo = todo[at[todo] < end[todo]]
    raw = raw[spread(*span)]
    last = raw < 128
    first = np.flatnonzero(np.r_[True, last[:-1]][: len(raw)])
    k = np.arange(len(raw)) - np.repeat(first, np.diff(np.r_[first, len(raw)]))
    v = np.add.reduceat((raw & 127).astype(np.int64) << 7 * k, first) if len(first) else np.zeros(0, np.int64)
    done = np.r_[0, np.cumsum(last)]
    to = done[np.cumsum(span[1])]
    at = done[np.cumsum(span[1]) - span[1]]
    # commands of all features step by step; the places of their points, and where rings close
    places, owners, paths, closings = [], [], np.full(len(features), -1, np.int64), []
    todo = np.flatnonzero(at < to)
    while len(todo):
        c = v[at[todo]]
        closes = c & 7 == CLOSE
        own, n, place = todo[~closes], c[~closes] >> 3, at[todo][~closes] + 1
        moves = c[~closes] & 7 == MOVE
        paths[own[moves]] = place[moves] + 2 * (n[moves] - 1)
        places.append(np.repeat(place, n) + 2 * spread(np.zeros(len(n), np.int64), n))
        owners.append(np.repeat(own, n))
        closings.append((todo[closes], paths[todo[closes]]))
        at[todo] += 1
        at[own] += 2 * n
        todo = todo[at[todo] < to[todo]]
    if not places:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    place, owner = np.concatenate(places), np.concatenate(owners)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    fresh = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    of = np.repeat(np.arange(len(fresh)), np.diff(np.r_[fresh, len(owner)]))

    def walked(deltas: np.ndarray) -> np.ndarray:
        total = np.cumsum((deltas >> 1) ^ -(deltas & 1))
        return total - np.r_[0, total][fresh][of]

    xs, ys = walked(v[place]), walked(v[place + 1])
    rings, starts = (np.concatenate(c) for c in zip(*closings, strict=True))
    shut = np.searchsorted(place, starts)
    return np.r_[owner, rings], np.r_[xs, xs[shut]], np.r_[ys, ys[shut]]
