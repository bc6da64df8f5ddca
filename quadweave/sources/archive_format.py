"""The PMTiles v3 container: header, varints, directories. Bytes in, plain values out."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

#: Fixed values of the format.
MAGIC = b"PMTiles"
HEADER_BYTES = 127
ROOT_BUDGET = 16384 - HEADER_BYTES
UNKNOWN, NONE, GZIP, BROTLI, ZSTD = range(5)
COMPRESSIONS = {"unknown": 0, "none": 1, "gzip": 2, "brotli": 3, "zstd": 4}
_HEADER = struct.Struct("<7sB11Q6B4iB2i")


class ArchiveError(ValueError):
    """A damaged or foreign archive."""


class BadMagic(ArchiveError):
    pass


class UnsupportedVersion(ArchiveError):
    pass


class CorruptDirectory(ArchiveError):
    pass


class TileNotFound(KeyError):
    pass


@dataclass
class Header:
    root_offset: int = 0
    root_length: int = 0
    metadata_offset: int = 0
    metadata_length: int = 0
    leaf_offset: int = 0
    leaf_length: int = 0
    data_offset: int = 0
    data_length: int = 0
    addressed: int = 0
    entries: int = 0
    contents: int = 0
    clustered: int = 1
    internal_compression: int = GZIP
    tile_compression: int = GZIP
    tile_type: int = 1
    min_zoom: int = 0
    max_zoom: int = 0
    bounds: tuple[float, float, float, float] = (-180.0, -85.0, 180.0, 85.0)
    center: tuple[float, float, int] = (0.0, 0.0, 0)

    def pack(self) -> bytes:
        e7 = lambda v: max(-(1 << 31), min((1 << 31) - 1, int(v * 1e7)))
        return _HEADER.pack(MAGIC, 3, self.root_offset, self.root_length, self.metadata_offset, self.metadata_length, self.leaf_offset, self.leaf_length, self.data_offset, self.data_length, self.addressed, self.entries, self.contents, self.clustered, self.internal_compression, self.tile_compression, self.tile_type, self.min_zoom, self.max_zoom, *[e7(v) for v in self.bounds], int(self.center[2]), e7(self.center[0]), e7(self.center[1]))

    @classmethod
    def unpack(cls, raw: bytes) -> Header:
        if raw[:7] != MAGIC:
            raise BadMagic("not a PMTiles archive")
        if len(raw) < HEADER_BYTES:
            raise ArchiveError("the header is cut short")
        f = _HEADER.unpack(raw[:HEADER_BYTES])
        if f[1] != 3:
            raise UnsupportedVersion(f"version {f[1]}")
        b = [v / 1e7 for v in f[19:23]]
        return cls(*f[2:19], tuple(b), (f[24] / 1e7, f[25] / 1e7, f[23]))


def pack_internal(data: bytes, compression: int) -> bytes:
    return gzip.compress(data, 6, mtime=0) if compression == GZIP else data


def unpack_internal(data: bytes, compression: int) -> bytes:
    if compression in (NONE, UNKNOWN):
        return data
    if compression == GZIP:
        try:
            return gzip.decompress(data)
        except (OSError, EOFError, zlib.error) as e:
            raise ArchiveError(f"can't decompress: {e}") from e
    raise ArchiveError(f"compression {compression} is not supported inside an archive")


def write_varint(v: int) -> bytes:
    out = bytearray()
    while v > 0x7F:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, next position)."""
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise CorruptDirectory("a varint is cut short or too long")
        b = raw[at]
        at += 1
        value |= (b & 0x7F) << shift
        if b < 0x80:
            return value, at
        shift += 7


def encode_directory(ids, runs, lengths, offsets) -> bytes:
    """Columns of a directory -> its bytes; an offset of 0 says "behind the one before", others are stored plus one."""
    out = [write_varint(len(ids))]
    last = 0
    for i in ids:
        out.append(write_varint(int(i) - last))
        last = int(i)
    out += [write_varint(int(r)) for r in runs]
    out += [write_varint(int(n)) for n in lengths]
    behind = None
    for o, n in zip(offsets, lengths, strict=True):
        out.append(b"\0" if behind is not None and int(o) == behind else write_varint(int(o) + 1))
        behind = int(o) + int(n)
    return b"".join(out)


def decode_directory(raw: bytes, dialect: str = "spec") -> list[tuple[int, int, int, int]]:
    """(tile id, offset, length, run) entries. dialect "raw" reads archives whose offsets are stored as they are."""
    n, at = read_varint(raw, 0)
    if n > len(raw):
        raise CorruptDirectory(f"{n} entries in {len(raw)} bytes")
    cols = []
    for _ in range(4):
        col = []
        for _ in range(n):
            v, at = read_varint(raw, at)
            col.append(v)
        cols.append(col)
    out, tile = [], 0
    for i, (d, run, length, o) in enumerate(zip(*cols, strict=True)):
        tile += d
        if o == 0 and i > 0:
            offset = out[-1][1] + out[-1][2]
        elif dialect == "raw":
            offset = o
        elif o == 0:
            raise CorruptDirectory("the first entry has no offset")
        else:
            offset = o - 1
        out.append((tile, offset, length, run))
    return out


def find(entries: list[tuple[int, int, int, int]], tile: int) -> tuple[int, int, int, int] | None:
    """The entry that holds a tile or leads to its leaf: the last whose id is not greater."""
    lo, hi = 0, len(entries)
    while lo < hi:
        mid = (lo + hi) // 2
        if entries[mid][0] <= tile:
            lo = mid + 1
        else:
            hi = mid
    if lo == 0:
        return None
    e = entries[lo - 1]
    return e if e[3] == 0 or tile < e[0] + e[3] else None


def run_lengths(ids: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Consecutive tiles that share a blob become one entry with a run: (ids, runs, lengths, offsets)."""
    if not len(ids):
        return ids, ids, lengths, offsets
    new = np.concatenate([[True], (np.diff(ids) != 1) | (np.diff(offsets) != 0)])
    at = np.flatnonzero(new)
    return ids[at], np.diff(np.append(at, len(ids))), lengths[at], offsets[at]


def walk(read: Callable[[int, int], bytes], header: Header, dialect: str = "spec"):
    """All tile entries of an archive, leaves included, in order."""

    def level(raw: bytes, depth: int):
        for e in decode_directory(unpack_internal(raw, header.internal_compression), dialect):
            if e[3] == 0:
                if depth > 3:
                    raise CorruptDirectory("directories are nested too deep")
                yield from level(read(header.leaf_offset + e[1], e[2]), depth + 1)
            else:
                yield e

    yield from level(read(header.root_offset, header.root_length), 0)
