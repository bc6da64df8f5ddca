"""Web Mercator and tile arithmetic as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Sphere radius and half the world's width in metres, grid of a tile, buffer in grid units.
RADIUS = 6378137.0
EXTENT = 20037508.3427892
GRID = 4096
BUFFER = 4
#: The latitude at which the projected world is square.
MAX_LAT = 85.05112878


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def lon_to_x(lon) -> Column:
    return F.radians(_c(lon)) * F.lit(RADIUS)


def lat_to_y(lat, clamp: bool = False) -> Column:
    """Latitude to metres; clamp limits it to the square world, else poles run away (to -inf in the south)."""
    lat = _c(lat)
    if clamp:
        lat = F.greatest(F.lit(-MAX_LAT), F.least(F.lit(MAX_LAT), lat))
    return F.lit(RADIUS) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))


def x_to_lon(x) -> Column:
    return F.degrees(_c(x) / F.lit(RADIUS))


def y_to_lat(y) -> Column:
    return F.degrees(2 * F.atan(F.exp(_c(y) / F.lit(RADIUS))) - F.lit(math.pi / 2))


def tiles_at(z) -> Column:
    """Number of tiles along one side at a zoom."""
    return F.pow(F.lit(2.0), _c(z))


def tile_side(z) -> Column:
    return F.lit(2 * EXTENT) / tiles_at(z)


def _clamp(v: Column, z) -> Column:
    return F.least(F.greatest(F.floor(v), F.lit(0).cast("long")), (tiles_at(z) - 1).cast("long"))


def x_to_tile(x, z) -> Column:
    return _clamp((_c(x) + F.lit(EXTENT)) / F.lit(2 * EXTENT) * tiles_at(z), z)


def y_to_tile(y, z) -> Column:
    """Row counted from the north."""
    return _clamp((F.lit(EXTENT) - _c(y)) / F.lit(2 * EXTENT) * tiles_at(z), z)


def tile_bbox(z, x, y, buffer: float = 0.0) -> Column:
    """(minx, miny, maxx, maxy) of a tile in metres, grown by buffer metres."""
    side = tile_side(z)
    minx = F.lit(-EXTENT) + _c(x) * side
    maxy = F.lit(EXTENT) - _c(y) * side
    b = F.lit(float(buffer))
    return F.struct((minx - b).alias("minx"), (maxy - side - b).alias("miny"), (minx + side + b).alias("maxx"), (maxy + b).alias("maxy"))


def simplify_tolerance(z, factor: float = 1.0) -> Column:
    """One grid unit in metres, times the factor."""
    return tile_side(z) / GRID * F.lit(float(factor))


def quantize_x(x, minx, width) -> Column:
    return F.round((_c(x) - _c(minx)) / _c(width) * GRID).cast("long")


def quantize_y(y, maxy, height) -> Column:
    return F.round((_c(maxy) - _c(y)) / _c(height) * GRID).cast("long")


def zigzag(v) -> Column:
    v = _c(v).cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63)).bitwiseAND(F.lit(0xFFFFFFFF))


def command(cmd: int, count) -> Column:
    """A drawing command with its repeat count: 1 move, 2 line, 7 close."""
    return F.lit(cmd & 7).bitwiseOR(F.shiftleft(_c(count).cast("long"), 3))


def flip_row(z, row) -> Column:
    """Rows counted from the south to rows counted from the north, and back."""
    return (tiles_at(z) - 1 - _c(row)).cast("long")


def valid_address(z, x, y, max_zoom: int = 24) -> Column:
    side = tiles_at(z)
    return (_c(z).between(0, max_zoom)) & (_c(x) >= 0) & (_c(y) >= 0) & (_c(x) < side) & (_c(y) < side)
