"""Coordinate systems: longitude and latitude are taken as they are, Web Mercator and UTM are projected back, others are refused."""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.functions.geometry import map_coords, map_points
from quadweave.functions.mercator import x_to_lon, y_to_lat
from quadweave.functions.utm import utm_to_degrees, utm_zone
from quadweave.functions.values import detect_crs

WGS84 = ("EPSG:4326", "OGC:CRS84", "CRS84")
#: Bytes of a file in which its coordinate system is looked for.
CRS_SCAN_BYTES = 65_536
MERCATOR = ("EPSG:3857", "EPSG:900913", "EPSG:102100")


def is_wgs84(code: str) -> bool:
    return code.strip().upper() in WGS84


def crs_of_file(spark: SparkSession, path: str) -> str | None:
    """The code that a text file names near its beginning; None means longitude and latitude."""
    row = spark.range(1).select(detect_crs(F.lit(head_of_file(spark, path)))).first()
    return row[0] if row else None


def head_of_file(spark: SparkSession, path: str, size: int = CRS_SCAN_BYTES) -> str:
    """The first bytes of a file, or of the first file of a folder or pattern, unpacked where Spark would unpack it."""
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    hadoop = jvm.org.apache.hadoop
    place = hadoop.fs.Path(path)
    fs = place.getFileSystem(conf)
    shown = lambda found: sorted((x for x in found or [] if not x.getPath().getName().startswith(("_", "."))), key=lambda x: x.getPath().toString())
    found = shown(fs.globStatus(place))
    while found and found[0].isDirectory():
        found = shown(fs.listStatus(found[0].getPath())) + found[1:]
    if not found:
        raise FileNotFoundError(path)
    file = found[0].getPath()
    stream = fs.open(file)
    try:
        codec = hadoop.io.compress.CompressionCodecFactory(conf).getCodec(file)
        text = stream if codec is None else codec.createInputStream(stream)
        return bytes(text.readNBytes(size)).decode("utf-8", "replace")
    finally:
        stream.close()


def bytes_of_file(spark: SparkSession, path: str) -> int:
    """The size of a file, or of all files of a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(place).getLength()


def to_wgs84(rows: DataFrame, code: str | None) -> DataFrame:
    """Feature rows in the given system -> longitude and latitude."""
    if code is None or is_wgs84(code):
        return rows
    if code.upper() in MERCATOR:
        return rows.withColumn("geom", map_coords("geom", x_to_lon, y_to_lat))
    if (utm := utm_zone(code)) is not None:
        return rows.withColumn("geom", map_points("geom", lambda x, y: utm_to_degrees(x, y, *utm)))
    raise ValueError(f"{code} is not supported: convert the input to EPSG:4326, EPSG:3857 or a UTM zone of WGS84 first")


def require_wgs84_prj(path: str) -> None:
    """Refuse a .prj of a projected or another geographic system; a missing file means longitude and latitude."""
    if not os.path.exists(path):
        return
    text = open(path, encoding="utf-8", errors="replace").read()
    if re.match(r"\s*PROJ", text) or not re.search(r"WGS[ _]?(19)?84", text, re.I):
        raise ValueError(f"{os.path.basename(path)} is not longitude and latitude on WGS84: convert the shapefile first")
