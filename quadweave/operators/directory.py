"""Content deduplication, blob offsets and directory entries of a tile archive, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blob_owners(tiles: DataFrame) -> DataFrame:
    """(sha, first_id, length) of every distinct blob; empty tiles are left out. Hashes are aggregated, blobs stay where they are."""
    slim = tiles.where(F.length("data") > 0).select("tile_id", F.sha2("data", 256).alias("sha"), F.length("data").cast("long").alias("length"))
    return slim.groupBy("sha").agg(F.min("tile_id").alias("first_id"), F.first("length").alias("length"))


def by_ranges(rows: DataFrame, key: str, groups: int = 256) -> DataFrame:
    """rows with the column _cell: the number of the range of about equally many rows that the key falls into.

    The bounds are approximate quantiles, so ranges are even however ids lie; a row finds its own in log2(groups) comparisons.
    """
    found = rows.agg(F.percentile_approx(key, [k / groups for k in range(1, groups)], 20 * groups)).first()[0]
    bounds = sorted(set(found or []))

    def place(lo: int, hi: int):
        """The cell of a key that lies behind the first lo bounds and before those from hi on."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) <= F.lit(bounds[mid]), place(lo, mid)).otherwise(place(mid + 1, hi))

    return rows.withColumn("_cell", place(0, len(bounds)))


def before_cells(rows: DataFrame, value, name: str) -> DataFrame:
    """(_cell, name): the sum of a value over all earlier cells; one row for each cell."""
    sums = rows.groupBy("_cell").agg(F.sum(value).alias("_sum"))
    w = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_cell", F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias(name))


def blob_offsets(owners: DataFrame, groups: int = 256) -> DataFrame:
    """owners with the offset at which each blob starts if blobs lie in the order of first_id.

    Two levels: sums of ranges of ids are few and are added up first, then each range is summed on its own, so no
    window holds all blobs.
    """
    placed = by_ranges(owners, "first_id", groups)
    inner = F.sum("length").over(Window.partitionBy("_cell").orderBy("first_id")) - F.col("length")
    return placed.join(F.broadcast(before_cells(placed, "length", "_base")), "_cell").select("sha", "first_id", "length", (F.col("_base") + inner).alias("offset"))


def with_previous(entries: DataFrame, groups: int = 256) -> DataFrame:
    """entries with _cell and the id, offset and length of the entry before: windows per range, and the last rows of ranges."""
    placed = by_ranges(entries, "tile_id", groups)
    row = F.struct("tile_id", "offset", "length")
    last = placed.groupBy("_cell").agg(F.max(row).alias("_last"))
    prior = last.select("_cell", F.lag("_last").over(Window.orderBy("_cell")).alias("_prior"))  # one row for each range
    own = F.lag(row).over(Window.partitionBy("_cell").orderBy("tile_id"))
    return placed.withColumn("_own", own).join(F.broadcast(prior), "_cell").withColumn("_before", F.coalesce("_own", "_prior")).drop("_own", "_prior")


def directory(tiles: DataFrame) -> DataFrame:
    """(tile_id, offset, length, sha) of every tile that isn't empty; tiles of equal content share a blob."""
    offsets = blob_offsets(blob_owners(tiles))
    slim = tiles.where(F.length("data") > 0).select("tile_id", F.sha2("data", 256).alias("sha"))
    return slim.join(offsets, "sha").select("tile_id", "offset", "length", "sha")


def with_runs(entries: DataFrame, partition: list[str] | None = None, groups: int = 256) -> DataFrame:
    """(…, tile_id, run_length, offset, length): consecutive ids that share an offset become one entry.

    Runs are numbered inside ranges of ids, or inside each value of the partition columns, and go on across ranges.
    """
    if partition:
        w = Window.partitionBy(*partition).orderBy("tile_id")
        brk = F.coalesce(((F.col("tile_id") - F.lag("tile_id").over(w)) != 1) | (F.col("offset") != F.lag("offset").over(w)), F.lit(True))
        marked = entries.withColumn("_n", F.sum(brk.cast("int")).over(w))
    else:
        b = F.col("_before")
        seen = with_previous(entries, groups).withColumn("_brk", F.coalesce((F.col("tile_id") - b["tile_id"] != 1) | (F.col("offset") != b["offset"]), F.lit(True)).cast("long"))
        inner = F.sum("_brk").over(Window.partitionBy("_cell").orderBy("tile_id"))
        marked = seen.withColumn("_n", inner).join(F.broadcast(before_cells(seen, "_brk", "_base")), "_cell").withColumn("_n", F.col("_n") + F.col("_base"))
    by = partition or []
    return marked.groupBy(*by, "_n").agg(F.min("tile_id").alias("tile_id"), F.count("*").alias("run_length"), F.min("offset").alias("offset"), F.min("length").alias("length")).drop("_n")


def delta_encode(entries: DataFrame, groups: int = 256) -> DataFrame:
    """Directory columns as they are stored: id deltas, and 0 for an offset that follows the blob before it, else offset + 1."""
    b = F.col("_before")
    stored = F.when(F.col("offset") == b["offset"] + b["length"], 0).otherwise(F.col("offset") + 1)
    return with_previous(entries, groups).select("tile_id", (F.col("tile_id") - F.coalesce(b["tile_id"], F.lit(0))).alias("delta"), "length", stored.alias("stored_offset"))


def delta_decode(stored: DataFrame, groups: int = 256) -> DataFrame:
    """Ids from their deltas, in the order of column i."""
    placed = by_ranges(stored, "i", groups)
    inner = F.sum("delta").over(Window.partitionBy("_cell").orderBy("i"))
    return placed.withColumn("_inner", inner).join(F.broadcast(before_cells(placed, "delta", "_base")), "_cell").withColumn("tile_id", F.col("_base") + F.col("_inner")).drop("_cell", "_base", "_inner")


def lookup(ids: DataFrame, entries: DataFrame, cells: int = 4096) -> DataFrame:
    """Ids (tile_id) -> the entry whose run holds each: an interval join by cells of ids, not a comparison of all.

    An entry of a long run stands in every cell that it reaches; an id looks into its own cell only.
    """
    width = F.lit(cells)
    own = entries.select(F.col("tile_id").alias("first"), "run_length", "offset", "length", F.explode(F.sequence(F.floor(F.col("tile_id") / width), F.floor((F.col("tile_id") + F.col("run_length") - 1) / width))).alias("_c"))
    asked = ids.withColumn("_c", F.floor(F.col("tile_id") / width))
    hit = (F.col("tile_id") >= F.col("first")) & (F.col("tile_id") < F.col("first") + F.col("run_length"))
    return asked.join(own, "_c").where(hit).drop("_c")


def archive_counts(entries: DataFrame) -> DataFrame:
    """Addressed tiles, and distinct contents."""
    return entries.agg(F.count("*").alias("addressed"), F.count_distinct("sha").alias("contents"))
