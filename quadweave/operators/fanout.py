"""Features to tiles: a join with the tile grid whose right side is generated, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadweave.functions.curves import morton_code
from quadweave.functions.geometry import bbox, coords_of
from quadweave.functions.mercator import BUFFER, GRID, simplify_tolerance, tile_bbox, tile_side, x_to_tile, y_to_tile

#: How much wider than the buffer the tight tile range is, against rounding at tile edges.
SLACK = 1.0001


def with_bbox(rows: DataFrame) -> DataFrame:
    """Add the box b of the geometry; rows without finite coordinates are left out."""
    out = rows.where(F.size(coords_of("geom")) > 0).withColumn("b", bbox("geom"))
    finite = [F.col(f"b.{c}").isNotNull() & ~F.isnan(f"b.{c}") & (F.abs(f"b.{c}") < 1e300) for c in ("minx", "miny", "maxx", "maxy")]
    return out.where(finite[0] & finite[1] & finite[2] & finite[3])


def explode_zooms(rows: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    return rows.withColumn("z", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))


def visible(factor: float = 1.0) -> Column:
    """False for boxes that are smaller than a grid unit both ways; points stay."""
    w, h = F.col("b.maxx") - F.col("b.minx"), F.col("b.maxy") - F.col("b.miny")
    tol = simplify_tolerance("z", factor)
    return ~(((w > 0) | (h > 0)) & (w < tol) & (h < tol))


def explode_tiles(rows: DataFrame, tight: bool = True) -> DataFrame:
    """Rows with b and z -> one row per tile whose buffered square may meet the box.

    tight: the range of the box grown by the buffer; else the range of the box and one tile more on each side.
    """
    if tight:
        grow = tile_side("z") * (BUFFER / GRID * SLACK)
        x0, x1 = x_to_tile(F.col("b.minx") - grow, "z"), x_to_tile(F.col("b.maxx") + grow, "z")
        y0, y1 = y_to_tile(F.col("b.maxy") + grow, "z"), y_to_tile(F.col("b.miny") - grow, "z")
    else:
        last = (F.pow(F.lit(2.0), F.col("z")) - 1).cast("long")
        zero = F.lit(0).cast("long")
        x0, x1 = F.greatest(x_to_tile(F.col("b.minx"), "z") - 1, zero), F.least(x_to_tile(F.col("b.maxx"), "z") + 1, last)
        y0, y1 = F.greatest(y_to_tile(F.col("b.maxy"), "z") - 1, zero), F.least(y_to_tile(F.col("b.miny"), "z") + 1, last)
    return rows.withColumn("x", F.explode(F.sequence(x0, x1))).withColumn("y", F.explode(F.sequence(y0, y1)))


def meets_tile(b: str = "b", tile: str = "t") -> Column:
    """Whether a box meets the tile grown by the buffer; touching counts."""
    grow = tile_side("z") * (BUFFER / GRID)
    return (F.col(f"{b}.maxx") >= F.col(f"{tile}.minx") - grow) & (F.col(f"{b}.minx") <= F.col(f"{tile}.maxx") + grow) & (F.col(f"{b}.maxy") >= F.col(f"{tile}.miny") - grow) & (F.col(f"{b}.miny") <= F.col(f"{tile}.maxy") + grow)


def fan_out(rows: DataFrame, min_zoom: int, max_zoom: int, factor: float = 1.0, tight: bool = True) -> DataFrame:
    """Projected features (geom) -> (…, b, z, x, y, t): every tile that the feature's box meets at every zoom.

    The small-feature filter stands between the two expansions, before rows multiply.
    """
    out = explode_zooms(with_bbox(rows), min_zoom, max_zoom).where(visible(factor))
    return explode_tiles(out, tight).withColumn("t", tile_bbox("z", "x", "y")).where(meets_tile())


def sort_by_morton(rows: DataFrame) -> DataFrame:
    """Projected features in ranges of their Morton key, each sorted by it: neighbours end up in the same partitions."""
    keyed = with_bbox(rows).withColumn("morton", morton_code("b.minx", "b.miny", "b.maxx", "b.maxy"))
    return keyed.repartitionByRange("morton", "fid").sortWithinPartitions("morton", "fid")
