"""Clip and simplify kernels on plain Python geometry: kind and parts[polygon][ring] of (x, y) pairs."""

from __future__ import annotations

import math

Coord = tuple[float, float]
Ring = list[Coord]
Parts = list[list[Ring]]
Rect = tuple[float, float, float, float]
#: Pieces of a line whose ends are nearer than this are one.
JOIN = 1e-12


def bounds(parts: Parts) -> Rect | None:
    xs = [c[0] for p in parts for r in p for c in r]
    if not xs:
        return None
    ys = [c[1] for p in parts for r in p for c in r]
    return min(xs), min(ys), max(xs), max(ys)


def area(ring: Ring) -> float:
    """Signed area, positive if counter-clockwise; the closing duplicate doesn't matter."""
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def contains(ring: Ring, p: Coord) -> bool:
    x, y = p
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def clip_segment(a: Coord, b: Coord, rect: Rect) -> tuple[Coord, Coord] | None:
    """The part of a segment inside a closed rectangle, by parameter intervals of its four sides."""
    x0, y0, x1, y1 = rect
    dx, dy = b[0] - a[0], b[1] - a[1]
    t0, t1 = 0.0, 1.0
    for d, lo, hi in ((dx, x0 - a[0], x1 - a[0]), (dy, y0 - a[1], y1 - a[1])):
        if d == 0:
            if lo > 0 or hi < 0:
                return None
            continue
        u, v = lo / d, hi / d
        t0, t1 = max(t0, min(u, v)), min(t1, max(u, v))
        if t0 > t1:
            return None
    at = lambda t: (min(max(a[0] + t * dx, x0), x1), min(max(a[1] + t * dy, y0), y1))
    return (a if t0 == 0 else at(t0)), (b if t1 == 1 else at(t1))


def clip_line(coords: Ring, rect: Rect) -> list[Ring]:
    """Pieces of a line inside the rectangle; a piece has two points at least."""
    out: list[Ring] = []
    now: Ring = []
    for a, b in zip(coords, coords[1:], strict=False):
        got = clip_segment(a, b, rect)
        if got is None:
            continue
        s, e = got
        if now and math.hypot(now[-1][0] - s[0], now[-1][1] - s[1]) <= JOIN:
            now.append(e)
        else:
            if len(now) > 1:
                out.append(now)
            now = [s, e]
    if len(now) > 1:
        out.append(now)
    return out


def _half_plane(rings: list[Ring], axis: int, sign: float, limit: float) -> list[Ring]:
    """Rings (open, without the closing duplicate) cut at one side of the rectangle.

    Inside is sign * c[axis] <= sign * limit. The polygon's interior meets the cutting line in the intervals between
    the 1st and 2nd, the 3rd and 4th ... crossing, so chains are joined along these: separate parts stay separate.
    """
    whole: list[Ring] = []
    chains: list[Ring] = []
    for ring in rings:
        d = [sign * (limit - c[axis]) for c in ring]
        if min(d) >= 0:
            whole.append(ring)
            continue
        if max(d) < 0:
            continue
        n = len(ring)

        def cross(i: int, j: int, ring=ring, d=d) -> Coord:
            t = d[i] / (d[i] - d[j])
            other = ring[i][1 - axis] + t * (ring[j][1 - axis] - ring[i][1 - axis])
            return (limit, other) if axis == 0 else (other, limit)

        first = next(i for i in range(n) if d[i] >= 0 and d[i - 1] < 0)
        now: Ring = []
        for k in range(n):
            i = (first + k) % n
            if d[i] >= 0:
                if d[i - 1] < 0:
                    now = [cross(i - 1, i)]
                now.append(ring[i])
                j = (i + 1) % n
                if d[j] < 0:
                    now.append(cross(i, j))
                    chains.append(now)
    if not chains:
        return whole
    ends = sorted((c[k][1 - axis], i, k) for i, c in enumerate(chains) for k in (0, -1))
    partner: dict[tuple[int, int], tuple[int, int]] = {}
    for a, b in zip(ends[::2], ends[1::2], strict=True):
        partner[a[1:]] = b[1:]
        partner[b[1:]] = a[1:]
    used: set[int] = set()
    for i in range(len(chains)):
        if i in used:
            continue
        ring, at, leave = [], i, -1
        while at not in used:
            used.add(at)
            ring += chains[at] if leave == -1 else chains[at][::-1]
            at, enter = partner[at, leave]
            leave = -1 if enter == 0 else 0
        whole.append(ring)
    return whole


def _tidy(ring: Ring) -> Ring:
    out: Ring = []
    for c in ring:
        if not out or c != out[-1]:
            out.append(c)
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out


def clip_polygon(polygon: list[Ring], rect: Rect) -> list[list[Ring]]:
    """Polygon with holes and a rectangle -> polygons; shells counter-clockwise, holes clockwise, rings closed."""
    rings = [_tidy(r) for r in polygon]
    rings = [r for r in rings if len(r) > 2]
    for axis, sign, limit in ((0, 1.0, rect[2]), (0, -1.0, rect[0]), (1, 1.0, rect[3]), (1, -1.0, rect[1])):
        rings = [r for r in map(_tidy, _half_plane(rings, axis, sign, limit)) if len(r) > 2]
    scale = (rect[2] - rect[0]) * (rect[3] - rect[1])
    rings = [r for r in rings if abs(area(r)) > 1e-18 * scale]
    return nest(rings)


def nest(rings: list[Ring]) -> list[list[Ring]]:
    """Rings that lie in an odd number of others are holes of the smallest one around them."""
    if len(rings) == 1:
        return [[oriented(rings[0], True)]]
    boxes = [bounds([[r]]) for r in rings]
    sizes = [abs(area(r)) for r in rings]
    around = []
    for i, r in enumerate(rings):
        p = inner_point(r)
        around.append([j for j, s in enumerate(rings) if j != i and sizes[j] > sizes[i] and boxes[j][0] <= p[0] <= boxes[j][2] and boxes[j][1] <= p[1] <= boxes[j][3] and contains(s, p)])
    out = {i: [oriented(r, True)] for i, r in enumerate(rings) if len(around[i]) % 2 == 0}
    for i, r in enumerate(rings):
        if i not in out:
            shell = min((j for j in around[i] if j in out), key=lambda j: sizes[j], default=None)
            if shell is not None:
                out[shell].append(oriented(r, False))
    return list(out.values())


def inner_point(ring: Ring) -> Coord:
    """A point strictly inside a ring: the middle of the first interval on a line through its height."""
    ys = sorted({c[1] for c in ring})
    if len(ys) < 2:
        return ring[0]
    k = max(range(len(ys) - 1), key=lambda i: ys[i + 1] - ys[i])
    y = (ys[k] + ys[k + 1]) / 2
    xs = sorted(a[0] + (y - a[1]) / (b[1] - a[1]) * (b[0] - a[0]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True) if (a[1] > y) != (b[1] > y))
    return ((xs[0] + xs[1]) / 2, y) if len(xs) > 1 else ring[0]


def oriented(ring: Ring, ccw: bool) -> Ring:
    """The closed ring in the asked direction."""
    r = ring if (area(ring) > 0) == ccw else ring[::-1]
    return [*r, r[0]]


def clip(kind: int, parts: Parts, rect: Rect) -> tuple[int, Parts] | None:
    """Geometry inside a closed rectangle, or None. One piece keeps a single kind, several make it a multi kind."""
    b = bounds(parts)
    if b is None or b[0] > rect[2] or b[2] < rect[0] or b[1] > rect[3] or b[3] < rect[1]:
        return None
    within = b[0] >= rect[0] and b[2] <= rect[2] and b[1] >= rect[1] and b[3] <= rect[3]
    if kind in (1, 4):
        kept = parts[0][0] if within else [c for c in parts[0][0] if rect[0] <= c[0] <= rect[2] and rect[1] <= c[1] <= rect[3]]
        return (kind, [[kept]]) if kept else None
    if kind in (2, 5):
        pieces = [r for r in parts[0] if len(r) > 1] if within else [p for r in parts[0] for p in clip_line(r, rect)]
        if not pieces:
            return None
        return (kind if kind == 5 or len(pieces) == 1 else 5), [pieces]
    if within:
        return kind, parts
    polygons = [q for p in parts for q in clip_polygon(p, rect)]
    if not polygons:
        return None
    return (kind if kind == 6 or len(polygons) == 1 else 6), polygons


def _far(coords: Ring, lo: int, hi: int) -> tuple[float, int]:
    """(squared distance, index) of the point farthest from the segment between two points of a line."""
    (ax, ay), (bx, by) = coords[lo], coords[hi]
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    best, at = -1.0, lo
    for i in range(lo + 1, hi):
        px, py = coords[i][0] - ax, coords[i][1] - ay
        if n:
            t = max(0.0, min(1.0, (px * dx + py * dy) / n))
            px, py = px - t * dx, py - t * dy
        d = px * px + py * py
        if d > best:
            best, at = d, i
    return best, at


def simplify_line(coords: Ring, tolerance: float, least: int = 2) -> Ring:
    """Douglas-Peucker; the farthest points stay until there are `least`, whatever the tolerance."""
    n = len(coords)
    if n <= least:
        return list(coords)
    limit = tolerance * tolerance
    keep = {0, n - 1}
    todo = [(0, n - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        d, at = _far(coords, lo, hi)
        if d > limit:
            keep.add(at)
            todo += [(lo, at), (at, hi)]
    while len(keep) < least:
        order = sorted(keep)
        d, at = max(_far(coords, a, b) for a, b in zip(order, order[1:], strict=False) if b - a > 1)
        keep.add(at)
    return [coords[i] for i in sorted(keep)]


def simplify(kind: int, parts: Parts, tolerance: float) -> tuple[int, Parts] | None:
    """Points stay; lines keep two points and rings four coordinates; what is shorter from the start goes."""
    if kind in (1, 4) or tolerance <= 0:
        return kind, parts
    if kind in (2, 5):
        lines = [simplify_line(r, tolerance) for r in parts[0] if len(r) > 1]
        return (kind, [lines]) if lines else None
    polygons = []
    for p in parts:
        rings = [simplify_line(r, tolerance, 4) for r in p if len(r) > 3]
        if rings and p and len(p[0]) > 3:
            polygons.append(rings)
    return (kind, polygons) if polygons else None


def clip_simplify_clip(kind: int, parts: Parts, rect: Rect, tolerance: float) -> tuple[int, Parts] | None:
    """Clip the original, simplify the clipped, clip again (simplified edges may leave the rectangle)."""
    got = clip(kind, parts, rect)
    got = got and simplify(*got, tolerance)
    return got and clip(*got, rect)
