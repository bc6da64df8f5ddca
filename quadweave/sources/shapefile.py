"""ESRI shapefiles (.shp with .dbf and .prj) as a Python data source."""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quadweave.functions.values import T_BOOL, T_DOUBLE, T_INT, T_STRING
from quadweave.sources.crs import require_wgs84_prj
from quadweave.sources.geojson import FEATURE_SCHEMA

#: Fixed values of the format: base shape types; +10 adds z, +20 adds m.
POINT, POLYLINE, POLYGON, MULTIPOINT = 1, 3, 5, 8


def signed_area(ring: list[tuple[float, float]]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def inside(p: tuple[float, float], ring: list[tuple[float, float]]) -> bool:
    x, y = p
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def group_rings(rings: list[list[tuple[float, float]]]) -> list[list[list[tuple[float, float]]]]:
    """Clockwise rings are shells; others are holes of the smallest shell around them, or shells if there is none."""
    shells = [[r] for r in rings if signed_area(r) <= 0]
    for hole in (r for r in rings if signed_area(r) > 0):
        around = [s for s in shells if inside(hole[0], s[0])]
        if around:
            min(around, key=lambda s: abs(signed_area(s[0]))).append(hole)
        else:
            shells.append([hole])
    return shells


def read_shp(raw: bytes) -> Iterator[tuple[int, list] | None]:
    """(kind, parts) per record; None for null shapes."""
    if len(raw) < 100 or struct.unpack(">i", raw[:4])[0] != 9994:
        raise ValueError("not a shapefile")
    at = 100
    while at + 8 <= len(raw):
        words = struct.unpack(">i", raw[at + 4 : at + 8])[0]
        body = raw[at + 8 : at + 8 + 2 * words]
        at += 8 + 2 * words
        kind = struct.unpack("<i", body[:4])[0] % 10
        if kind == 0:
            yield None
        elif kind == POINT:
            yield 1, [[[struct.unpack("<2d", body[4:20])]]]
        elif kind == MULTIPOINT:
            n = struct.unpack("<i", body[36:40])[0]
            yield 4, [[list(struct.iter_unpack("<2d", body[40 : 40 + 16 * n]))]]
        elif kind in (POLYLINE, POLYGON):
            parts, n = struct.unpack("<2i", body[36:44])
            starts = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), n]
            xy = list(struct.iter_unpack("<2d", body[44 + 4 * parts : 44 + 4 * parts + 16 * n]))
            rings = [xy[a:b] for a, b in zip(starts, starts[1:], strict=False) if b > a]
            if kind == POLYLINE:
                yield (2, [rings]) if len(rings) == 1 else (5, [rings])
            else:
                shells = group_rings(rings)
                yield (3, shells) if len(shells) == 1 else (6, shells)
        else:
            raise ValueError(f"shape type {kind} is not supported")


def read_dbf(raw: bytes) -> Iterator[list[tuple[str, int, str]]]:
    """Attributes per record."""
    n, head, size = struct.unpack("<IHH", raw[4:12])
    fields, at = [], 32
    while raw[at] != 0x0D:
        name = raw[at : at + 11].split(b"\0")[0].decode("latin-1")
        fields.append((name, chr(raw[at + 11]), raw[at + 16], raw[at + 17]))
        at += 32
    for i in range(n):
        row, pos, out = raw[head + i * size : head + (i + 1) * size], 1, []
        for name, kind, width, decimals in fields:
            text = row[pos : pos + width].decode("utf-8", "replace").strip().strip("\0")
            pos += width
            if kind in "NF" and text and text.strip("*"):
                whole = kind == "N" and decimals == 0 and "." not in text
                out.append((name, T_INT, str(int(text))) if whole else (name, T_DOUBLE, repr(float(text))))
            elif kind == "L" and text[:1] in "TtYyFfNn" and text:
                out.append((name, T_BOOL, "true" if text[0] in "TtYy" else "false"))
            else:
                out.append((name, T_STRING, text if text or kind == "C" else "null"))
        yield sorted(out)


class _File(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, path: str, layer: str):
        self.path, self.layer = path, layer

    def partitions(self) -> list[InputPartition]:
        found = sorted(glob.glob(os.path.join(self.path, "*.shp"))) if os.path.isdir(self.path) else [self.path]
        return [_File(p) for p in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        base = os.path.splitext(partition.value)[0]
        require_wgs84_prj(base + ".prj")
        shapes = read_shp(open(partition.value, "rb").read())
        shapes = list(shapes)
        rows = list(read_dbf(open(base + ".dbf", "rb").read())) if os.path.exists(base + ".dbf") else [[]] * len(shapes)
        if len(rows) != len(shapes):
            raise ValueError(f"{os.path.basename(base)} has {len(shapes)} shapes and {len(rows)} rows of attributes")
        seed = zlib.crc32(os.path.basename(base).encode()) << 31
        for i, (shape, props) in enumerate(zip(shapes, rows, strict=True)):
            if shape is not None:
                yield self.layer, seed + i, {"kind": shape[0], "parts": [[[{"x": x, "y": y} for x, y in r] for r in p] for p in shape[1]]}, [{"k": k, "t": t, "s": s} for k, t, s in props]


class ShapefileSource(DataSource):
    """One partition per .shp file; the path is a file or a folder on a shared mount."""

    @classmethod
    def name(cls) -> str:
        return "quadweave_shapefile"

    def schema(self) -> str:
        return FEATURE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("layer", "default"))


def read_shapefile(spark: SparkSession, path: str, layer: str) -> DataFrame:
    spark.dataSource.register(ShapefileSource)
    return spark.read.format("quadweave_shapefile").option("layer", layer).load(path)
