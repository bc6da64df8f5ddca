"""Mapbox Vector Tiles: a protobuf writer and reader of our own, on plain values."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterable

from quadweave.functions.mercator import GRID
from quadweave.functions.values import T_BOOL, T_DOUBLE, T_INT
from quadweave.operators.kernels import Coord, Parts, Rect, Ring
from quadweave.sources.archive_format import read_varint, write_varint

#: Fixed values of the tile format.
MOVE, LINE, CLOSE = 1, 2, 7
VERSION = 2


def half_away(v: float) -> int:
    """Round halves away from zero, as Spark's round does."""
    return int(math.copysign(math.floor(abs(v) + 0.5), v))


def zigzag(v: int) -> int:
    return ((v << 1) ^ (v >> 63)) & 0xFFFFFFFF


def unzigzag(v: int) -> int:
    return (v >> 1) ^ -(v & 1)


class Pen:
    """Commands of one feature; the cursor goes on from part to part."""

    def __init__(self, tile: Rect):
        self.x0, self.y1 = tile[0], tile[3]
        self.w, self.h = tile[2] - tile[0], tile[3] - tile[1]
        self.x = self.y = 0
        self.out: list[int] = []

    def grid(self, coords: Ring) -> list[tuple[int, int]]:
        return [(half_away((x - self.x0) / self.w * GRID), half_away((self.y1 - y) / self.h * GRID)) for x, y in coords]

    def to(self, points: Iterable[tuple[int, int]]) -> None:
        for x, y in points:
            self.out += [zigzag(x - self.x), zigzag(y - self.y)]
            self.x, self.y = x, y

    def points(self, coords: Ring) -> None:
        own = self.grid(coords)
        if own:
            self.out.append(MOVE | len(own) << 3)
            self.to(own)

    def line(self, coords: Ring) -> None:
        own = distinct_runs(self.grid(coords))
        if len(own) > 1:
            self.out.append(MOVE | 1 << 3)
            self.to(own[:1])
            self.out.append(LINE | (len(own) - 1) << 3)
            self.to(own[1:])

    def ring(self, coords: Ring, shell: bool) -> bool:
        """Shells have a positive area in the grid, whose rows count downwards; holes a negative one.

        A ring without area in the grid is not drawn; returns whether it was.
        """
        if len(coords) < 4:
            return False
        own = distinct_runs(self.grid(coords[:-1] if coords[0] == coords[-1] else coords))
        while len(own) > 1 and own[0] == own[-1]:
            own.pop()
        turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(own, own[1:] + own[:1], strict=True))
        if not turn:
            return False
        if (turn < 0) == shell:
            own.reverse()
        self.out.append(MOVE | 1 << 3)
        self.to(own[:1])
        self.out.append(LINE | (len(own) - 1) << 3)
        self.to(own[1:])
        self.out.append(CLOSE | 1 << 3)
        return True


def distinct_runs(points: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The points without those that repeat the one before."""
    return [p for i, p in enumerate(points) if i == 0 or p != points[i - 1]]


def encode_geometry(kind: int, parts: Parts, tile: Rect) -> tuple[int, list[int]]:
    """(type, commands) of a geometry in a tile; no commands if nothing can be drawn."""
    pen = Pen(tile)
    if kind in (1, 4):
        pen.points(parts[0][0])
        return 1, pen.out
    if kind in (2, 5):
        for r in parts[0]:
            pen.line(r)
        return 2, pen.out
    for p in parts:
        # the holes of a shell that has no area in the grid go with it, or they would cut the polygon before
        if p and pen.ring(p[0], True):
            for r in p[1:]:
                pen.ring(r, False)
    return 3, pen.out


def decode_geometry(commands: list[int]) -> list[list[tuple[int, int]]]:
    """Commands -> paths in grid units; closed rings end where they start."""
    out: list[list[tuple[int, int]]] = []
    x = y = i = 0
    while i < len(commands):
        cmd, n = commands[i] & 7, commands[i] >> 3
        i += 1
        if cmd == CLOSE:
            out[-1].append(out[-1][0])
            continue
        for _ in range(n):
            x += unzigzag(commands[i])
            y += unzigzag(commands[i + 1])
            i += 2
            if cmd == MOVE:
                out.append([(x, y)])
            else:
                out[-1].append((x, y))
    return out


def field(number: int, wire: int, body: bytes) -> bytes:
    return write_varint(number << 3 | wire) + (write_varint(len(body)) + body if wire == 2 else body)


def packed(values: Iterable[int]) -> bytes:
    return b"".join(map(write_varint, values))


def encode_value(tag: int, text: str) -> bytes:
    if tag == T_BOOL:
        return field(7, 0, b"\1" if text == "true" else b"\0")
    if tag == T_INT:
        v = int(text)
        return field(6, 0, write_varint(((v << 1) ^ (v >> 63)) & (1 << 64) - 1))
    if tag == T_DOUBLE:
        return field(3, 1, struct.pack("<d", float(text)))
    return field(1, 2, text.encode("utf-8", "surrogatepass"))


class Layer:
    """A layer as it grows: features one at a time, keys and values numbered as they come."""

    def __init__(self, name: str, extent: int = GRID):
        self.name, self.extent = name, extent
        self.keys: dict[str, int] = {}
        self.values: dict[bytes, int] = {}
        self.features: list[bytes] = []

    def add(self, kind: int, commands: list[int], props: list[tuple[str, int, str]]) -> None:
        tags = self.tags([(k, encode_value(t, s)) for k, t, s in props])
        body = (field(2, 2, packed(tags)) if tags else b"") + field(3, 0, write_varint(kind)) + field(4, 2, packed(commands))
        self.features.append(field(2, 2, body))

    def tags(self, props: list[tuple[str, bytes]]) -> list[int]:
        """Numbers of the keys and encoded values of one feature."""
        out: list[int] = []
        for k, v in props:
            out.append(self.keys.setdefault(k, len(self.keys)))
            out.append(self.values.setdefault(v, len(self.values)))
        return out

    def encode(self, features: bytes | None = None) -> bytes:
        """The layer as a field of a tile, so that tiles of several layers are plain concatenations.

        features: those of the layer, encoded elsewhere with its tags.
        """
        body = field(15, 0, write_varint(VERSION)) + field(1, 2, self.name.encode()) + (b"".join(self.features) if features is None else features) + b"".join(field(3, 2, k.encode("utf-8", "surrogatepass")) for k in self.keys) + b"".join(field(4, 2, v) for v in self.values) + field(5, 0, write_varint(self.extent))
        return field(3, 2, body)


def fields(raw: bytes) -> Iterable[tuple[int, int | bytes]]:
    at = 0
    while at < len(raw):
        key, at = read_varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = read_varint(raw, at)
        elif wire == 2:
            n, at = read_varint(raw, at)
            value, at = raw[at : at + n], at + n
        elif wire == 1:
            value, at = raw[at : at + 8], at + 8
        elif wire == 5:
            value, at = raw[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {wire}")
        yield number, value


def feature_spans(raw: bytes) -> list[tuple[str, list[int], list[int]]]:
    """(name, starts, ends) of the layers of an uncompressed tile: where the bodies of their features lie in it."""
    layers, at = [], 0
    while at < len(raw):
        key, at = read_varint(raw, at)
        if key != (3 << 3 | 2):
            raise ValueError(f"a tile has a field of key {key}")
        n, at = read_varint(raw, at)
        name, starts, ends, last = "", [], [], at + n
        while at < last:
            key = raw[at]
            n = raw[at + 1]
            at += 2
            if key & 7 == 0:
                at = read_varint(raw, at - 1)[1]
                continue
            if n > 127:
                n, at = read_varint(raw, at - 1)
            if key == (2 << 3 | 2):
                starts.append(at)
                ends.append(at + n)
            elif key == (1 << 3 | 2):
                name = raw[at : at + n].decode()
            at += n
        layers.append((name, starts, ends))
    return layers


def _unpack(raw: bytes) -> list[int]:
    out, at = [], 0
    while at < len(raw):
        v, at = read_varint(raw, at)
        out.append(v)
    return out


def decode_value(raw: bytes) -> tuple[str, object]:
    for n, v in fields(raw):
        if n == 1:
            return "string", v.decode("utf-8", "surrogatepass")
        if n == 2:
            return "float", struct.unpack("<f", v)[0]
        if n == 3:
            return "double", struct.unpack("<d", v)[0]
        if n in (4, 5):
            return "int", v
        if n == 6:
            return "sint", unzigzag(v)
        if n == 7:
            return "bool", bool(v)
    return "string", ""


def decode_tile(raw: bytes) -> list[dict]:
    """Layers of an uncompressed tile: name, version, extent, features with type, paths and typed attributes."""
    layers = []
    for n, body in fields(raw):
        if n != 3:
            continue
        out: dict = {"name": "", "version": 1, "extent": GRID, "features": []}
        keys, values, features = [], [], []
        for m, v in fields(body):
            if m == 1:
                out["name"] = v.decode()
            elif m == 2:
                features.append(v)
            elif m == 3:
                keys.append(v.decode("utf-8", "surrogatepass"))
            elif m == 4:
                values.append(decode_value(v))
            elif m == 5:
                out["extent"] = v
            elif m == 15:
                out["version"] = v
        for f in features:
            d = dict(fields(f))
            tags = _unpack(d.get(2, b""))
            commands = _unpack(d.get(4, b""))
            out["features"].append({"type": d.get(3, 0), "commands": commands, "paths": decode_geometry(commands), "props": {keys[a]: values[b] for a, b in zip(tags[::2], tags[1::2], strict=True)}})
        layers.append(out)
    return layers


def coord_tuples(parts) -> Parts:
    """Arrow or Row structs -> plain tuples."""
    return [[[(c["x"], c["y"]) for c in r] for r in p] for p in parts]


__all__ = ["Coord", "Layer", "Pen", "decode_geometry", "decode_tile", "encode_geometry", "encode_value", "half_away", "unzigzag", "zigzag"]
