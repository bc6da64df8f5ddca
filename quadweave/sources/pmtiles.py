"""PMTiles archives: point reads on the driver, and a Python data source over slices of the directory."""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from quadweave.functions.curves import tile_id_of, tile_of_id
from quadweave.sources import archive_format as fmt

ROW_SCHEMA = "tile_id long, z int, x long, y long, data binary"
SLICE = 20_000


class Archive:
    """One open archive file: header and root directory in memory, tiles read by range."""

    def __init__(self, path: str, dialect: str = "spec"):
        self.path, self.dialect = path, dialect
        self.file = open(path, "rb")
        self.header = fmt.Header.unpack(self.file.read(fmt.HEADER_BYTES))
        self.root = fmt.decode_directory(self._internal(self.header.root_offset, self.header.root_length), dialect)
        self.leaves: dict[int, list] = {}

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _internal(self, offset: int, length: int) -> bytes:
        return fmt.unpack_internal(self.read(offset, length), self.header.internal_compression)

    def metadata(self) -> str:
        return self._internal(self.header.metadata_offset, self.header.metadata_length).decode("utf-8")

    def tile_by_id(self, tile: int) -> bytes:
        entries = self.root
        for _ in range(4):
            e = fmt.find(entries, tile)
            if e is None:
                break
            if e[3] > 0:
                return self.read(self.header.data_offset + e[1], e[2])
            if e[1] not in self.leaves:
                self.leaves[e[1]] = fmt.decode_directory(self._internal(self.header.leaf_offset + e[1], e[2]), self.dialect)
            entries = self.leaves[e[1]]
        raise fmt.TileNotFound("/".join(map(str, tile_of_id(tile))))

    def get_tile(self, z: int, x: int, y: int) -> bytes:
        """The stored bytes of a tile; TileNotFound names the address."""
        return self.tile_by_id(tile_id_of(z, x, y))

    def entries(self) -> Iterator[tuple[int, int, int, int]]:
        return fmt.walk(self.read, self.header, self.dialect)

    def close(self) -> None:
        self.file.close()


class _Slice(InputPartition):
    pass


class _Reader(DataSourceReader):
    def __init__(self, path: str, dialect: str):
        self.path, self.dialect, self.want = path, dialect, {}

    def pushFilters(self, filters):
        """Equalities on the address or the id choose directory entries before anything is read."""
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("z", "x", "y", "tile_id"):
                self.want[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        a = Archive(self.path, self.dialect)
        w = self.want
        only = w.get("tile_id")
        if {"z", "x", "y"} <= w.keys():
            z, x, y = w["z"], w["x"], w["y"]
            inside = 0 <= z <= 31 and 0 <= x < 1 << z and 0 <= y < 1 << z
            address = tile_id_of(z, x, y) if inside else -1
            only = address if only in (None, address) else -1
        low, high = 0, 1 << 62
        if "z" in w:
            low, high = (4 ** w["z"] - 1) // 3, (4 ** (w["z"] + 1) - 1) // 3
        parts, own = [], []
        for tile, offset, length, run in a.entries():
            if only is not None:
                if not tile <= only < tile + run:
                    continue
                tile, run = only, 1
            elif tile + run <= low or tile >= high:
                continue
            own.append((tile, offset, length, run))
            if len(own) == SLICE:
                parts.append(_Slice((a.header.data_offset, own)))
                own = []
        a.close()
        return [*parts, _Slice((a.header.data_offset, own))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        base, entries = partition.value
        w = self.want
        with open(self.path, "rb") as f:
            for tile, offset, length, run in entries:
                f.seek(base + offset)
                data = f.read(length)
                for t in range(tile, tile + run):
                    z, x, y = tile_of_id(t)
                    if all(w.get(k, v) == v for k, v in (("z", z), ("x", x), ("y", y), ("tile_id", t))):
                        yield t, z, x, y, data


class PmtilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quadweave_pmtiles"

    def schema(self) -> str:
        return ROW_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("dialect", "spec"))


def read_pmtiles(spark: SparkSession, path: str, dialect: str = "spec") -> DataFrame:
    """(tile_id, z, x, y, data) of an archive on a shared mount; equalities on the address prune what is read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PmtilesSource)
    return spark.read.format("quadweave_pmtiles").option("dialect", dialect).load(os.fspath(path))


class _Leaf(InputPartition):
    pass


class _DirectoryReader(DataSourceReader):
    def __init__(self, path: str, dialect: str):
        self.path, self.dialect = path, dialect

    def partitions(self) -> list[InputPartition]:
        """The root's own entries, and one partition for each leaf directory that it names."""
        a = Archive(self.path, self.dialect)
        own = [e for e in a.root if e[3] > 0]
        leaves = [(e[1], e[2]) for e in a.root if e[3] == 0]
        a.close()
        return [_Leaf((own, None)), *[_Leaf(([], leaf)) for leaf in leaves]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        own, leaf = partition.value
        yield from own
        if leaf is None:
            return
        a = Archive(self.path, self.dialect)
        todo = [leaf]
        while todo:  # a leaf may name leaves
            offset, length = todo.pop()
            for e in fmt.decode_directory(a._internal(a.header.leaf_offset + offset, length), self.dialect):
                if e[3] > 0:
                    yield tuple(map(int, e))
                else:
                    todo.append((e[1], e[2]))
        a.close()


class DirectorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quadweave_directory"

    def schema(self) -> str:
        return "tile_id long, offset long, length long, run_length long"

    def reader(self, schema) -> DataSourceReader:
        return _DirectoryReader(self.options["path"], self.options.get("dialect", "spec"))


def read_directory(spark: SparkSession, path: str, dialect: str = "spec") -> DataFrame:
    """(tile_id, offset, length, run_length) rows of an archive, leaf by leaf."""
    spark.dataSource.register(DirectorySource)
    return spark.read.format("quadweave_directory").option("dialect", dialect).load(os.fspath(path))
