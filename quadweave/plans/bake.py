"""Bake feature layers into tiles and archives."""

from __future__ import annotations

import shutil
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.functions.geometry import to_mercator
from quadweave.functions.values import drop_props, keep_props
from quadweave.operators.tileset import cap_features, encode_tiles, tile_pieces
from quadweave.plans.archive import shared_folder, write_archive
from quadweave.plans.config import BakeConfig
from quadweave.plans.manifest import layer_infos, manifest, manifest_json, union_box
from quadweave.sources.archive_format import Header
from quadweave.sources.geojson import require_features


def filter_fields(rows: DataFrame, cfg: BakeConfig) -> DataFrame:
    """Attributes that the settings keep, narrowed before anything is shuffled."""
    if cfg.include is not None:
        return rows.withColumn("props", keep_props("props", cfg.include))
    if cfg.exclude:
        return rows.withColumn("props", drop_props("props", cfg.exclude))
    return rows


def _layers(layers: DataFrame | dict[str, DataFrame], cfg: BakeConfig) -> tuple[DataFrame, list[str]]:
    named = layers if isinstance(layers, dict) else {cfg.layer: layers}
    rows = [require_features(df, n).withColumns({"layer": F.lit(n), "layer_ord": F.lit(i)}) for i, (n, df) in enumerate(named.items())]
    return filter_fields(reduce(DataFrame.unionByName, rows), cfg), list(named)


def bake_pieces(rows: DataFrame, cfg: BakeConfig) -> DataFrame:
    """Features in degrees -> rows per feature and tile. Projection comes before the zooms, so it is done once."""
    flat = rows.withColumn("geom", to_mercator("geom", cfg.clamp))
    pieces = tile_pieces(flat, cfg.min_zoom, cfg.max_zoom, cfg.tolerance)
    return pieces if cfg.max_features_per_tile is None else cap_features(pieces, cfg.max_features_per_tile)


def bake_tiles(layers: DataFrame | dict[str, DataFrame], cfg: BakeConfig | None = None) -> DataFrame:
    """(tile_id, z, x, y, data, features) of one layer or of several by name."""
    cfg = cfg or BakeConfig()
    rows, _ = _layers(layers, cfg)
    return encode_tiles(bake_pieces(rows, cfg), cfg.compression)


def bake(layers: DataFrame | dict[str, DataFrame], path: str, cfg: BakeConfig | None = None, name: str | None = None) -> Header:
    """Write an archive with its manifest; a layer without features is an error.

    Inputs are read once: their rows are written to the shared folder, and the manifest and the tiles read them there.
    """
    cfg = cfg or BakeConfig()
    parsed, order = _layers(layers, cfg)
    spark = parsed.sparkSession
    work = shared_folder(spark, "rows", path)
    try:
        parsed.write.parquet(f"file://{work}/rows")
        rows = spark.read.schema(parsed.schema).parquet(f"file://{work}/rows")
        infos, boxes = layer_infos(rows, order)
        bounds = union_box(boxes.values())
        doc = manifest(name or order[0], cfg, infos, bounds)
        tiles = encode_tiles(bake_pieces(rows, cfg), cfg.compression)
        return write_archive(tiles, path, manifest_json(doc), cfg.min_zoom, cfg.max_zoom, bounds, tuple(doc["center"]), cfg.compression)
    finally:
        shutil.rmtree(work, ignore_errors=True)
