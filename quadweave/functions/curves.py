"""Tile ids along a Hilbert curve, and a Morton key for locality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadweave.functions.mercator import EXTENT, _c

#: Bits of a Morton coordinate; bit i of x goes to 3i and of y to 3i + 1.
MORTON_BITS = 21


def zoom_base(z) -> Column:
    """Number of tiles of all lower zooms."""
    return F.floor((F.pow(F.lit(4.0), _c(z)) - 1) / 3).cast("long")


def tile_id(z, x, y) -> Column:
    """Position of a tile along the Hilbert curves of zooms 0, 1, 2, ... one after the other."""
    z, x, y = _c(z).cast("int"), _c(x).cast("long"), _c(y).cast("long")
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("long").alias("d"))

    def step(acc: Column, i: Column) -> Column:
        bit = lambda v: F.expr("1").cast("long").bitwiseAND(F.call_function("shiftright", v, i))
        side = F.call_function("shiftleft", F.lit(1).cast("long"), i)
        low = side - 1
        rx, ry = bit(acc["x"]), bit(acc["y"])
        d = acc["d"] + side * side * (3 * rx).bitwiseXOR(ry)
        lx, ly = acc["x"].bitwiseAND(low), acc["y"].bitwiseAND(low)
        mx, my = F.when(rx == 1, low - lx).otherwise(lx), F.when(rx == 1, low - ly).otherwise(ly)
        return F.struct(F.when(ry == 0, my).otherwise(lx).alias("x"), F.when(ry == 0, mx).otherwise(ly).alias("y"), d.alias("d"))

    steps = F.when(z > 0, F.sequence(z - 1, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    return zoom_base(z) + F.aggregate(steps, start, step, lambda acc: acc["d"])


def tile_id_of(z: int, x: int, y: int) -> int:
    """tile_id of plain integers."""
    d = 0
    for i in range(z - 1, -1, -1):
        side = 1 << i
        rx, ry = x >> i & 1, y >> i & 1
        d += side * side * (3 * rx ^ ry)
        x, y = x & side - 1, y & side - 1
        if ry == 0:
            if rx == 1:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
    return (4**z - 1) // 3 + d


def tile_of_id(tile: int) -> tuple[int, int, int]:
    """(z, x, y) of a tile id."""
    z = 0
    while tile >= 4**z:
        tile -= 4**z
        z += 1
    x = y = 0
    for i in range(z):
        side = 1 << i
        rx = 1 & tile >> 1
        ry = 1 & (tile ^ rx)
        if ry == 0:
            if rx == 1:
                x, y = side - 1 - x, side - 1 - y
            x, y = y, x
        x, y = x + side * rx, y + side * ry
        tile >>= 2
    return z, x, y


def spread_bits(v) -> Column:
    """Bit i of a 21-bit integer to bit 3i."""
    v = _c(v).cast("long")
    out = F.lit(0).cast("long")
    for i in range(MORTON_BITS):
        out = out + F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1).cast("long")), 3 * i)
    return out


def morton_code(minx, miny, maxx, maxy) -> Column:
    """Locality key of a box's centre in the projected world."""
    top = float((1 << MORTON_BITS) - 1)

    def cell(lo, hi) -> Column:
        mid = ((_c(lo) + _c(hi)) / 2 + F.lit(EXTENT)) / F.lit(2 * EXTENT)
        return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mid)) * top).cast("long")

    return spread_bits(cell(minx, maxx)).bitwiseOR(F.shiftleft(spread_bits(cell(miny, maxy)), 1))
