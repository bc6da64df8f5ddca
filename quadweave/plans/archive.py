"""Write tiles as one archive file, and look into archives."""

from __future__ import annotations

import atexit
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.functions.curves import tile_id
from quadweave.operators.directory import blob_owners
from quadweave.sources import archive_format as fmt
from quadweave.sources.mbtiles import read_info, read_mbtiles
from quadweave.sources.pmtiles import Archive, read_directory

LEAF_ENTRIES = 4096


def shared_folder(spark: SparkSession, kind: str, beside: str | None = None) -> str:
    """A new folder on the mount that driver and executors share: below spark.checkpoint.dir, which the cluster names.

    Only a run in one process may go without: its folder is beside the given path, or a temporary one that goes at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named and (named.startswith("file:") or "://" not in named):
        base = "/" + named.removeprefix("file:").lstrip("/")
    elif not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder on a mount that driver and executors share")
    elif beside:
        base = os.path.dirname(os.path.abspath(beside))
    else:
        base = tempfile.mkdtemp(prefix="quadweave-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    own = os.path.join(base, f".{kind}-{uuid.uuid4().hex}")
    os.makedirs(own)
    return own


def write_archive(tiles: DataFrame, path: str, metadata: str, min_zoom: int, max_zoom: int, bounds: tuple[float, ...], center: tuple[float, float, int], compression: str = "gzip") -> fmt.Header:
    """(tile_id, data) -> one clustered archive in which equal tiles share a blob and equal neighbours an entry.

    Executors write the distinct blobs in id order as part files and give back slim rows; the driver holds one sum
    per part and the root directory, and copies the parts behind the header. Leaf directories are encoded on
    executors too, and used as soon as the entries outgrow the root's budget.
    """
    spark = tiles.sparkSession
    work = shared_folder(spark, "tiles", path)
    try:
        stored = os.path.join(work, "tiles")
        tiles.where(F.length("data") > 0).select("tile_id", "data", F.sha2("data", 256).alias("sha")).write.parquet(f"file://{stored}")
        kept = spark.read.parquet(f"file://{stored}")
        owners = blob_owners(kept)
        blobs = kept.join(owners.select(F.col("first_id").alias("tile_id")), "tile_id", "left_semi")
        ordered = blobs.repartitionByRange("tile_id").sortWithinPartitions("tile_id")

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            part, out, at = TaskContext.get().partitionId(), [], 0
            own = os.path.join(work, f"part-{part:06d}")
            scratch = f"{own}.{uuid.uuid4().hex}"
            with open(scratch, "wb") as f:
                for b in batches:
                    for t, data, sha in zip(b.column("tile_id").to_pylist(), b.column("data"), b.column("sha").to_pylist(), strict=True):
                        raw = data.as_py()
                        f.write(raw)
                        out.append((part, t, sha, at, len(raw)))
                        at += len(raw)
            os.replace(scratch, own)
            for k in range(0, len(out), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out[k : k + 50_000], strict=True)], ["part", "first_id", "sha", "at", "length"])

        placed_at = os.path.join(work, "placed")
        ordered.mapInArrow(parts, "part long, first_id long, sha string, at long, length long").write.parquet(f"file://{placed_at}")
        placed = spark.read.parquet(f"file://{placed_at}")
        sums = {r[0]: r[1] for r in placed.groupBy("part").agg(F.sum("length")).collect()}
        base, total = {}, 0
        for p in sorted(sums):
            base[p] = total
            total += sums[p]
        bases = spark.createDataFrame(list(base.items()), "part long, base long")
        entries = kept.select("tile_id", "sha").join(placed.join(F.broadcast(bases), "part").select("sha", (F.col("base") + F.col("at")).alias("offset"), "length"), "sha").select("tile_id", "offset", "length")

        def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*[[c.to_numpy() for c in b.columns] for b in batches], strict=True)] or [np.zeros(0, np.int64)] * 3
            ids, offsets, lengths = cols
            addressed = len(ids)
            ids, runs, lengths, offsets = fmt.run_lengths(ids, offsets, lengths)
            for k in range(0, len(ids), LEAF_ENTRIES):
                s = slice(k, k + LEAF_ENTRIES)
                raw = np.stack([ids[s], runs[s], lengths[s], offsets[s]]).astype("<i8").tobytes()
                leaf = fmt.pack_internal(fmt.encode_directory(ids[s], runs[s], lengths[s], offsets[s]), fmt.GZIP)
                yield pa.RecordBatch.from_arrays([pa.array([ids[k]], pa.int64()), pa.array([len(ids[s])], pa.int64()), pa.array([addressed if k == 0 else 0], pa.int64()), pa.array([leaf], pa.binary()), pa.array([raw], pa.binary())], ["first_id", "entries", "addressed", "leaf", "raw"])

        leaves_at = os.path.join(work, "leaves")
        entries.repartitionByRange("tile_id").sortWithinPartitions("tile_id").mapInArrow(leaves, "first_id long, entries long, addressed long, leaf binary, raw binary").write.parquet(f"file://{leaves_at}")
        found = spark.read.parquet(f"file://{leaves_at}")
        n_entries, addressed, n_leaves = found.agg(F.coalesce(F.sum("entries"), F.lit(0)), F.coalesce(F.sum("addressed"), F.lit(0)), F.count("*")).first()
        root, leaf_bytes = b"", None
        if n_leaves <= 8:
            rows = sorted((r["first_id"], r["raw"]) for r in found.select("first_id", "raw").collect())
            cols = np.concatenate([np.frombuffer(r[1], "<i8").reshape(4, -1) for r in rows], axis=1) if rows else np.zeros((4, 0), np.int64)
            root = fmt.pack_internal(fmt.encode_directory(*cols), fmt.GZIP)
        if n_leaves > 8 or len(root) > fmt.ROOT_BUDGET:
            leaf_bytes = os.path.join(work, "leaf-bytes")
            ids, starts, lengths, at = [], [], [], 0
            with open(leaf_bytes, "wb") as f:
                for r in found.select("first_id", "leaf").orderBy("first_id").toLocalIterator():
                    f.write(r["leaf"])
                    ids.append(r["first_id"])
                    starts.append(at)
                    lengths.append(len(r["leaf"]))
                    at += len(r["leaf"])
            root = fmt.pack_internal(fmt.encode_directory(ids, [0] * len(ids), lengths, starts), fmt.GZIP)
        meta = fmt.pack_internal(metadata.encode(), fmt.GZIP)
        h = fmt.Header(tile_compression=fmt.COMPRESSIONS[compression], min_zoom=min_zoom, max_zoom=max_zoom, bounds=tuple(bounds), center=center, addressed=addressed, entries=n_entries, contents=placed.count())
        h.root_offset, h.root_length = fmt.HEADER_BYTES, len(root)
        h.metadata_offset, h.metadata_length = h.root_offset + len(root), len(meta)
        h.leaf_offset = h.metadata_offset + len(meta)
        h.leaf_length = os.path.getsize(leaf_bytes) if leaf_bytes else 0
        h.data_offset, h.data_length = h.leaf_offset + h.leaf_length, total
        scratch = f"{path}.{uuid.uuid4().hex}"
        with open(scratch, "wb") as out:
            out.write(h.pack() + root + meta)
            for name in ([leaf_bytes] if leaf_bytes else []) + [os.path.join(work, f"part-{p:06d}") for p in sorted(base)]:
                with open(name, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
        os.replace(scratch, path)
        return h
    finally:
        shutil.rmtree(work, ignore_errors=True)


def write_small_archive(tiles: list[tuple[int, bytes]], path: str, metadata: str = "{}", min_zoom: int = 0, max_zoom: int = 2, compression: str = "none") -> None:
    """A few tiles from the driver, for fixtures."""
    blobs: dict[bytes, int] = {}
    at, rows = 0, []
    for t, data in sorted(tiles):
        if not data:
            continue
        if data not in blobs:
            blobs[data] = at
            at += len(data)
        rows.append((t, blobs[data], len(data)))
    ids, offsets, lengths = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    ids, runs, lengths, offsets = fmt.run_lengths(ids, offsets, lengths)
    root, meta = fmt.pack_internal(fmt.encode_directory(ids, runs, lengths, offsets), fmt.GZIP), fmt.pack_internal(metadata.encode(), fmt.GZIP)
    h = fmt.Header(fmt.HEADER_BYTES, len(root), fmt.HEADER_BYTES + len(root), len(meta), 0, 0, fmt.HEADER_BYTES + len(root) + len(meta), at, len(rows), len(ids), len(blobs), tile_compression=fmt.COMPRESSIONS[compression], min_zoom=min_zoom, max_zoom=max_zoom)
    h.leaf_offset = h.data_offset
    with open(path, "wb") as f:
        f.write(h.pack() + root + meta + b"".join(blobs))


def inspect(spark: SparkSession, path: str) -> DataFrame:
    """One row about an archive; unreadable metadata shows as {}."""
    a = Archive(path)
    try:
        meta = a.metadata()
        json.loads(meta)
    except (ValueError, fmt.ArchiveError):
        meta = "{}"
    h = a.header
    a.close()
    size = lambda f: F.coalesce(f, F.lit(0)).cast("long")
    sizes = read_directory(spark, path).agg(size(F.min("length")).alias("smallest"), size(F.median("length")).alias("median"), size(F.max("length")).alias("largest"))
    known = {"min_zoom": (h.min_zoom, "int"), "max_zoom": (h.max_zoom, "int"), "addressed": (h.addressed, "long"), "entries": (h.entries, "long"), "contents": (h.contents, "long"), "bytes": (os.path.getsize(path), "long")}
    box = dict(zip(("minx", "miny", "maxx", "maxy"), h.bounds, strict=True))
    return sizes.select(*[F.lit(v).cast(t).alias(n) for n, (v, t) in known.items()], "smallest", "median", "largest", *[F.lit(v).cast("double").alias(n) for n, v in box.items()], F.lit(meta).alias("metadata"))


def import_mbtiles(spark: SparkSession, source: str, path: str) -> fmt.Header:
    """The tiles of an MBTiles file as an archive, as they are stored, with its zooms, bounds and metadata."""
    info = read_info(source)
    tiles = read_mbtiles(spark, source).select(tile_id("z", "x", "y").alias("tile_id"), "data")
    b = info.bounds
    center = ((b[0] + b[2]) / 2, (b[1] + b[3]) / 2, (info.min_zoom + info.max_zoom) // 2)
    meta = json.dumps({**info.metadata, "name": info.name}, ensure_ascii=False, sort_keys=True)
    return write_archive(tiles, path, meta, info.min_zoom, info.max_zoom, b, center, info.compression)


__all__ = ["import_mbtiles", "inspect", "shared_folder", "write_archive", "write_small_archive"]
