"""Re-bake only the tiles that newly arrived features touch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadweave.functions.geometry import to_mercator
from quadweave.operators.tileset import encode_tiles, tile_pieces
from quadweave.plans.config import BakeConfig
from quadweave.sources.geojson import geojsonseq_rows


def start(spark: SparkSession, source: str, pieces_path: str, tiles_path: str, checkpoint: str, cfg: BakeConfig) -> StreamingQuery:
    """Stream text files of features into pieces_path (partitioned by batch) and versions of touched tiles into tiles_path.

    Each micro-batch writes its pieces under its own number, so a batch that is run again replaces itself; tiles that
    the batch touches are encoded anew from all pieces of those tiles. current_tiles() reads the newest version.
    """
    lines = spark.readStream.text(source)

    def step(batch: DataFrame, n: int) -> None:
        rows = geojsonseq_rows(batch, cfg.layer, permissive=True).withColumns({"layer": F.lit(cfg.layer), "layer_ord": F.lit(0)})
        rows = rows.withColumn("geom", to_mercator("geom", cfg.clamp))
        pieces = tile_pieces(rows, cfg.min_zoom, cfg.max_zoom, cfg.tolerance).withColumn("place", place_of("z", "x", "y"))
        pieces.write.mode("overwrite").partitionBy("place").parquet(f"{pieces_path}/batch={n}")
        fresh = spark.read.option("basePath", pieces_path).schema(pieces.schema).parquet(f"{pieces_path}/batch={n}")
        places = [r[0] for r in fresh.select("place").distinct().collect()]  # at most 64 of a zoom
        if not places:
            return
        every = spark.read.parquet(pieces_path).where((F.col("batch") <= n) & F.col("place").isin(places)).drop("batch", "place")
        touched = fresh.select("z", "x", "y").distinct()
        own = every.join(touched, ["z", "x", "y"], "left_semi").dropDuplicates(["layer", "fid", "z", "x", "y"])
        encode_tiles(own, cfg.compression).write.mode("overwrite").parquet(f"{tiles_path}/batch={n}")

    return lines.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def place_of(z: str, x: str, y: str):
    """The zoom and the tile of zoom 3 that a tile lies in: pieces are kept by it, so that a batch reads only near ones."""
    return (F.col(z) * 64 + F.expr(f"shiftright({x}, greatest({z} - 3, 0))") * 8 + F.expr(f"shiftright({y}, greatest({z} - 3, 0))")).cast("int")


def current_tiles(spark: SparkSession, tiles_path: str) -> DataFrame:
    """The newest version of every tile."""
    newest = F.max_by(F.struct("z", "x", "y", "data", "features"), "batch").alias("t")
    return spark.read.parquet(tiles_path).groupBy("tile_id").agg(newest).select("tile_id", "t.*")
