"""Manifest and TileJSON documents of an archive."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame

from quadweave.operators.layer_schema import field_types, geometry_kinds, layer_bounds
from quadweave.plans.config import BakeConfig


def layer_infos(rows: DataFrame, order: Iterable[str]) -> tuple[list[dict], dict[str, tuple[float, ...]]]:
    """(layers with sorted fields and geometry kinds, bounds by layer)."""
    fields: dict[str, list] = {}
    for r in field_types(rows).collect():  # one row per attribute
        fields.setdefault(r["layer"], []).append({"name": r["name"], "type": r["type"]})
    kinds = {r["layer"]: list(r["kinds"]) for r in geometry_kinds(rows).collect()}
    boxes = {r["layer"]: (r["minx"], r["miny"], r["maxx"], r["maxy"]) for r in layer_bounds(rows).collect()}
    infos = [{"name": n, "fields": sorted(fields.get(n, []), key=lambda f: f["name"]), "geometry_types": kinds[n]} for n in order if n in kinds]
    return infos, boxes


def union_box(boxes: Iterable[tuple[float, ...]]) -> tuple[float, float, float, float]:
    b = list(boxes)
    return min(x[0] for x in b), min(x[1] for x in b), max(x[2] for x in b), max(x[3] for x in b)


def manifest(name: str, cfg: BakeConfig, layers: list[dict], bounds: tuple[float, ...]) -> dict:
    return {
        "name": name,
        "format": "mvt",
        "minzoom": cfg.min_zoom,
        "maxzoom": cfg.max_zoom,
        "bounds": list(bounds),
        "center": [(bounds[0] + bounds[2]) / 2, (bounds[1] + bounds[3]) / 2, (cfg.min_zoom + cfg.max_zoom) // 2],
        "attribution": cfg.attribution,
        "layers": layers,
    }


def manifest_json(doc: dict) -> str:
    return json.dumps(doc, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def tilejson(doc: dict, url: str) -> dict:
    """TileJSON 3.0 of a manifest; what it lacks gets the defaults of the whole world."""
    out = {
        "tilejson": "3.0.0",
        "name": doc.get("name", "tiles"),
        "tiles": [url],
        "minzoom": doc.get("minzoom", 0),
        "maxzoom": doc.get("maxzoom", 14),
        "bounds": doc.get("bounds", [-180.0, -85.0, 180.0, 85.0]),
        "center": doc.get("center", [0.0, 0.0, 2]),
        "vector_layers": [{"id": x["name"], "fields": {f["name"]: f["type"] for f in x.get("fields", [])}, "minzoom": doc.get("minzoom", 0), "maxzoom": doc.get("maxzoom", 14)} for x in doc.get("layers", [])],
    }
    if doc.get("attribution"):
        out["attribution"] = doc["attribution"]
    return out
