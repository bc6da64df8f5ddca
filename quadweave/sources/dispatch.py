"""Read a layer by the extension of its file."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quadweave.sources.crs import crs_of_file, to_wgs84
from quadweave.sources.csv_points import read_csv_points
from quadweave.sources.geojson import read_geojson, read_geojsonseq
from quadweave.sources.shapefile import read_shapefile

LINES, DOCUMENTS = (".geojsonl", ".geojsons", ".ndjson"), (".geojson", ".json")
KNOWN = (*LINES, *DOCUMENTS, ".csv", ".shp")


def layer_name(path: str) -> str:
    return os.path.splitext(os.path.basename(path.rstrip("/")))[0] or "default"


def read_layer(spark: SparkSession, path: str, name: str | None = None, crs: str | None = None) -> DataFrame:
    """Feature rows in longitude and latitude. crs: the input's code; if unset, text inputs are searched for one."""
    ext = os.path.splitext(path)[1].lower()
    name = name or layer_name(path)
    if ext in LINES:
        return to_wgs84(read_geojsonseq(spark, path, name), crs or crs_of_file(spark, path))
    if ext in DOCUMENTS:
        return to_wgs84(read_geojson(spark, path, name), crs or crs_of_file(spark, path))
    if ext == ".csv":
        return to_wgs84(read_csv_points(spark, path, name), crs)
    if ext == ".shp":
        return read_shapefile(spark, path, name)
    raise ValueError(f"{ext or path!r} is not a known input; known are {', '.join(KNOWN)} (.mbtiles and .pmtiles hold tiles: import_mbtiles, read_mbtiles, read_pmtiles)")
