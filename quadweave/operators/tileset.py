"""Tiles from features: clip and simplify per tile, then encode tile by tile from a sorted stream."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.functions.curves import tile_id
from quadweave.functions.mercator import quantize_x, quantize_y, zigzag
from quadweave.functions.values import PROPS
from quadweave.operators.bulk import Drawn, descend, draw, extents, feature_bytes, grown, tile_rect
from quadweave.operators.fanout import fan_out
from quadweave.operators.mvt import Layer, coord_tuples, encode_value

PIECE = f"layer string, layer_ord int, fid long, z int, x long, y long, type int, commands array<long>, props {PROPS}"
PART = "layer string, layer_ord int, z int, x long, y long, data binary, features long"
COMPRESSIONS = ("none", "gzip", "brotli")


def compressor(name: str):
    if name == "gzip":
        return lambda b: gzip.compress(b, 1, mtime=0)
    if name == "none":
        return lambda b: b
    if name == "brotli":
        try:
            import brotli
        except ImportError as e:
            raise RuntimeError("brotli compression needs the brotli module, which is not installed") from e
        return lambda b: brotli.compress(b, quality=5)
    raise ValueError(f"unknown compression {name!r}; known are {', '.join(COMPRESSIONS)}")


#: Features whose tiles are drawn in arrays at once.
AT_ONCE = 5000
#: Zoom at which the parts of a large feature are dealt to other tasks, each of which goes on from one tile.
DEAL_ZOOM = 6
SHAPE = f"layer string, layer_ord int, fid long, z int, x long, y long, kind int, parts array<array<array<struct<x:double,y:double>>>>, w double, h double, props {PROPS}"


def tile_pieces(features: DataFrame, min_zoom: int, max_zoom: int, factor: float = 1.0, deal_zoom: int = DEAL_ZOOM) -> DataFrame:
    """Projected features (layer, layer_ord, fid, geom, props) -> one row per feature and tile with its commands.

    Single points never leave the JVM. Other kinds go down the pyramid in Arrow batches, at first to deal_zoom; what
    they leave in its tiles is dealt anew, so that a feature as large as the world is many tasks' work below it.
    """
    return _point_pieces(features, min_zoom, max_zoom, factor).unionByName(_shapes(features, min_zoom, max_zoom, factor, deal_zoom, piece_rows, PIECE))


def _point_pieces(features: DataFrame, min_zoom: int, max_zoom: int, factor: float) -> DataFrame:
    wide = fan_out(features.where("geom.kind = 1"), min_zoom, max_zoom, factor)
    w, h = F.col("t.maxx") - F.col("t.minx"), F.col("t.maxy") - F.col("t.miny")
    at = F.col("geom.parts")[0][0][0]
    qx, qy = quantize_x(at["x"], "t.minx", w), quantize_y(at["y"], "t.maxy", h)
    return wide.select("layer", "layer_ord", "fid", "z", "x", "y", F.lit(1).alias("type"), F.array(F.lit(9).cast("long"), zigzag(qx), zigzag(qy)).alias("commands"), "props")


def _shapes(features: DataFrame, min_zoom: int, max_zoom: int, factor: float, deal_zoom: int, pack: Callable[[pa.RecordBatch, Drawn], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What pack() makes of the tiles of lines, polygons and several points."""
    zero = F.lit(0).cast("long")
    whole = features.where("geom.kind <> 1").select("layer", "layer_ord", "fid", F.lit(0).alias("z"), zero.alias("x"), zero.alias("y"), F.col("geom.kind").cast("int").alias("kind"), "geom.parts", "props")
    own = ("layer", "layer_ord", "fid")

    def arrays(b: pa.RecordBatch, low: int, top: int) -> Iterator[Drawn]:
        return draw(*[b.column(c).to_numpy(zero_copy_only=False) if c != "parts" else b.column(c) for c in ("kind", "parts", "z", "x", "y", "w", "h")], low, top, factor)

    def drawing(low: int, top: int, skip_first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(k, AT_ONCE) for b in batches for k in range(0, b.num_rows, AT_ONCE)):
                b = b if skip_first else measured(b)
                for got in arrays(b, low, top):
                    if skip_first:
                        got = got.of(got.z > b.column("z").to_numpy()[got.row])
                    yield from pack(b, got)

        return run

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))
        for b in map(measured, batches):
            names = ("z", "x", "y", "kind", "parts")
            out = [(i, *t) for i, (z, x, y, kind, parts) in enumerate(zip(*[b.column(c).to_pylist() for c in names], strict=True)) for t in descend(kind, coord_tuples(parts), (z, x, y), deal_zoom) if t[0] == deal_zoom]
            for k in range(0, len(out), 5_000):
                i, z, x, y, kind, parts = zip(*out[k : k + 5_000], strict=True)
                at = pa.array(i, pa.int64())
                shapes = pa.array([[[[{"x": c[0], "y": c[1]} for c in r] for r in p] for p in g] for g in parts], kind_of)
                yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in own], pa.array(z, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(kind, pa.int32()), shapes, b.column("w").take(at), b.column("h").take(at), b.column("props").take(at)], ["layer", "layer_ord", "fid", "z", "x", "y", "kind", "parts", "w", "h", "props"])

    out = whole.mapInArrow(drawing(min_zoom, min(max_zoom, deal_zoom), False), schema)
    if max_zoom > deal_zoom:
        dealt = whole.mapInArrow(deal, SHAPE).repartition("fid", "x", "y")
        out = out.unionByName(dealt.mapInArrow(drawing(max(min_zoom, deal_zoom + 1), max_zoom, True), schema))
    return out


def measured(b: pa.RecordBatch) -> pa.RecordBatch:
    """Features with their width w and height h; those without finite coordinates are left out.

    As fanout.with_bbox(), whose columns Spark would compute anew for every condition on them.
    """
    ok, w, h = extents(b.column("parts"))
    b = b.append_column("w", pa.array(w)).append_column("h", pa.array(h))
    return b if ok.all() else b.filter(pa.array(ok))


def piece_rows(b: pa.RecordBatch, got: Drawn) -> Iterator[pa.RecordBatch]:
    """One row per feature and tile."""
    end = np.r_[0, np.cumsum(got.size)]
    for k in range(0, len(got), 20_000):
        s = slice(k, k + 20_000)
        at = pa.array(got.row[s])
        n = end[k : k + 20_001]
        commands = pa.ListArray.from_arrays(pa.array(n - n[0], pa.int32()), pa.array(got.commands[n[0] : n[-1]]))
        cols = [b.column(c).take(at) for c in ("layer", "layer_ord", "fid")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(got.z[s], pa.int32()), pa.array(got.x[s]), pa.array(got.y[s]), pa.array(got.kind[s], pa.int32()), commands, b.column("props").take(at)], ["layer", "layer_ord", "fid", "z", "x", "y", "type", "commands", "props"])


def part_rows(b: pa.RecordBatch, got: Drawn) -> Iterator[pa.RecordBatch]:
    """One row per layer and tile: its features in this batch, encoded as a tile of their own."""
    if not len(got):
        return
    names = b.column("layer").dictionary_encode()
    layer = names.indices.to_numpy()[got.row]
    got = got.of(order := np.lexsort((got.y, got.x, got.z, layer)))
    layer = layer[order]
    props = [[(p["k"], encode_value(p["t"], p["s"])) for p in row or []] for row in b.column("props").to_pylist()]
    same = np.all([c[1:] == c[:-1] for c in (layer, got.z, got.x, got.y)], axis=0)
    starts = np.flatnonzero(np.r_[True, ~same])
    layers, n_tags, tags = [], np.zeros(len(got), np.int64), []
    has = np.array([bool(p) for p in props])[got.row]
    for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(got)], strict=True):
        layers.append(now := Layer(names.dictionary[int(layer[lo])].as_py()))
        for i in np.flatnonzero(has[lo:hi]).tolist():
            own = now.tags(props[got.row[lo + i]])
            n_tags[lo + i] = len(own)
            tags += own
    raw, end = feature_bytes(got.kind, got.size, got.commands, n_tags, np.array(tags, np.int64))
    cuts = np.r_[0, end[np.r_[starts[1:], len(got)] - 1]].tolist()
    data = [now.encode(raw[i:j].tobytes()) for now, i, j in zip(layers, cuts, cuts[1:], strict=False)]
    at = pa.array(got.row[starts])
    yield pa.RecordBatch.from_arrays([b.column("layer").take(at), b.column("layer_ord").take(at), pa.array(got.z[starts], pa.int32()), pa.array(got.x[starts]), pa.array(got.y[starts]), pa.array(data, pa.binary()), pa.array(np.diff(np.r_[starts, len(got)]))], ["layer", "layer_ord", "z", "x", "y", "data", "features"])


def tile_parts(features: DataFrame, min_zoom: int, max_zoom: int, factor: float = 1.0, deal_zoom: int = DEAL_ZOOM) -> DataFrame:
    """Projected features -> tiles in parts: each task encodes the features that it holds, so that no row per feature
    and tile is ever made or shuffled and a tile may have more features than one task could hold.

    Each part is a tile with one layer, not compressed; a tile's features are those of all its parts, each once.
    """

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(c).to_numpy().astype(np.int64) for c in ("z", "x", "y", "type")]
            commands = b.column("commands")
            yield from part_rows(b, Drawn(np.arange(b.num_rows), *cols, commands.value_lengths().to_numpy().astype(np.int64), commands.flatten().to_numpy()))

    return _point_pieces(features, min_zoom, max_zoom, factor).mapInArrow(points, PART).unionByName(_shapes(features, min_zoom, max_zoom, factor, deal_zoom, part_rows, PART))


def cap_features(pieces: DataFrame, most: int) -> DataFrame:
    """The first `most` features of every layer and tile, in the order of fid."""
    w = Window.partitionBy("layer", "z", "x", "y").orderBy("fid")
    return pieces.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def tile_counts(pieces: DataFrame) -> DataFrame:
    return pieces.groupBy("layer", "z", "x", "y").agg(F.count("*").alias("features"))


def encode_tiles(pieces: DataFrame, compression: str = "gzip") -> DataFrame:
    """(tile_id, z, x, y, data, features): one row per tile, its layers in the order of layer_ord.

    Rows are sorted by tile within partitions and encoded as they stream by: a task holds one tile's bytes, not its
    rows, and the order of features (by fid) doesn't depend on partitions. Layers are concatenated before compression.
    """
    compressor(compression)
    ordered = pieces.withColumn("tile_id", tile_id("z", "x", "y")).repartition("tile_id").sortWithinPartitions("tile_id", "layer_ord", "layer", "fid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = compressor(compression)
        at, done, layer, count, held = None, [], None, 0, []
        size = 0

        def close() -> None:
            nonlocal size
            data = pack(b"".join([*done, layer.encode()]))
            size += len(data)
            held.append((*at, data, count))

        def out() -> pa.RecordBatch:
            cols = list(zip(*held, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), strict=True)], ["tile_id", "z", "x", "y", "data", "features"])

        for b in batches:
            for row in b.to_pylist():
                here = (row["tile_id"], row["z"], row["x"], row["y"])
                if here != at:
                    if at is not None:
                        close()
                        if size > 16 << 20:
                            yield out()
                            held.clear()
                            size = 0
                    at, done, layer, count = here, [], None, 0
                if layer is None or layer.name != row["layer"]:
                    if layer is not None:
                        done.append(layer.encode())
                    layer = Layer(row["layer"])
                layer.add(row["type"], row["commands"], [(p["k"], p["t"], p["s"]) for p in row["props"] or []])
                count += 1
        if at is not None:
            close()
            yield out()

    return ordered.mapInArrow(run, "tile_id long, z int, x long, y long, data binary, features long")


__all__ = ["cap_features", "compressor", "encode_tiles", "grown", "tile_counts", "tile_parts", "tile_pieces", "tile_rect"]
