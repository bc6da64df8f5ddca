"""MBTiles (SQLite) archives as a Python data source: one partition per zoom, rows counted from the north."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TILE_SCHEMA = "z int, x long, y long, data binary"
WORLD = (-180.0, -85.0, 180.0, 85.0)


@dataclass
class MbtilesInfo:
    name: str = "imported"
    min_zoom: int = 0
    max_zoom: int = 14
    bounds: tuple[float, ...] = WORLD
    compression: str = "none"
    metadata: dict[str, str] = field(default_factory=dict)


def _bounds(text: str | None) -> tuple[float, ...]:
    try:
        got = tuple(float(x) for x in (text or "").split(","))
    except ValueError:
        return WORLD
    return got if len(got) == 4 else WORLD


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def read_info(path: str) -> MbtilesInfo:
    with _open(path) as db:
        meta = dict(db.execute("SELECT name, value FROM metadata"))
        first = db.execute("SELECT tile_data FROM tiles LIMIT 1").fetchone()
    packed = "gzip" if first and bytes(first[0][:2]) == b"\x1f\x8b" else "none"
    whole = lambda k, d: int(meta[k]) if str(meta.get(k, "")).strip().isdigit() else d
    return MbtilesInfo(meta.get("name", "imported"), whole("minzoom", 0), whole("maxzoom", 14), _bounds(meta.get("bounds")), packed, meta)


class _Zoom(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        with _open(self.path) as db:
            return [_Zoom(z) for (z,) in db.execute("SELECT DISTINCT zoom_level FROM tiles ORDER BY 1")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        z = partition.value
        with _open(self.path) as db:
            for x, row, data in db.execute("SELECT tile_column, tile_row, tile_data FROM tiles WHERE zoom_level = ?", (z,)):
                yield z, x, (1 << z) - 1 - row, bytes(data)


class MbtilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quadweave_mbtiles"

    def schema(self) -> str:
        return TILE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read_mbtiles(spark: SparkSession, path: str) -> DataFrame:
    """(z, x, y, data): tiles as they are stored."""
    spark.dataSource.register(MbtilesSource)
    return spark.read.format("quadweave_mbtiles").load(path)
