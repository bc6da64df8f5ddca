"""Sizes of a bake from statistics of its features: over all rows, or over a sample that the caller limits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.functions.geometry import byte_cost
from quadweave.operators.layer_schema import tag_name

#: Fixed values of the cost model: output per stored byte, bytes per feature of two indexes, features of a chunk.
OUTPUT_RATIO = 0.38
INDEX_BYTES, SORT_BYTES = 48, 128
CHUNK, GROWTH = 50_000, 1.5


def value_bytes():
    """Bytes of a value as JSON."""
    s = F.octet_length(F.col("p.s"))
    return F.when((F.col("p.t") == 1) & (F.col("p.s") != "null"), s + 2).otherwise(s)


def field_stats(rows: DataFrame, total: int | None = None) -> DataFrame:
    """(name, type, avg_bytes, presence, total_bytes), heaviest first; type is the most common one, ties by name."""
    n = rows.count()
    each = rows.select(F.explode("props").alias("p")).select(F.col("p.k").alias("name"), tag_name().alias("type"), value_bytes().alias("bytes"))
    by_type = each.groupBy("name", "type").agg(F.count("*").alias("c"), F.sum("bytes").alias("b"))
    best = by_type.groupBy("name").agg(F.min_by("type", F.struct(-F.col("c"), F.col("type"))).alias("type"), F.sum("b").alias("b"), F.sum("c").alias("c"))
    avg, presence = F.col("b") / F.col("c"), F.col("c") / F.lit(max(1, n))
    whole = (avg + F.length("name") + 4) * presence * F.lit(total if total is not None else n)
    return best.select("name", "type", avg.alias("avg_bytes"), presence.alias("presence"), whole.alias("total_bytes")).orderBy(F.desc("total_bytes"), "name")


@dataclass
class Estimate:
    """Projections of a bake; keep narrows the attributes, threads are those that encode at once."""

    count: int
    record_bytes: float
    prop_bytes: dict[str, float]

    def geometry_bytes(self) -> float:
        return max(0.0, self.record_bytes - sum(self.prop_bytes.values()))

    def store_bytes(self, keep: set[str] | None = None) -> int:
        props = sum(b for k, b in self.prop_bytes.items() if keep is None or k in keep)
        return round(self.count * (self.geometry_bytes() + props))

    def output_bytes(self, keep: set[str] | None = None) -> int:
        return round(self.store_bytes(keep) * OUTPUT_RATIO)

    def peak_bytes(self, threads: int, keep: set[str] | None = None) -> int:
        record = self.store_bytes(keep) / max(1, self.count)
        return round(self.count * (INDEX_BYTES + SORT_BYTES) + CHUNK * record * GROWTH * threads)


def estimate(rows: DataFrame) -> Estimate:
    """Over all features, in one aggregation per statistic."""
    stats = {r["name"]: r["total_bytes"] for r in field_stats(rows).collect()}
    n, geom = rows.agg(F.count("*"), F.coalesce(F.sum(byte_cost("geom")), F.lit(0))).first()
    per = {k: v / max(1, n) for k, v in stats.items()}
    return Estimate(n, geom / max(1, n) + sum(per.values()), per)


def projected_count(file_bytes: int, sampled_bytes: int, sampled_rows: int, whole: bool) -> int:
    """Rows of a file of which a sample is known; exact if the sample was all of it."""
    return sampled_rows if whole or not sampled_rows else round(file_bytes / (sampled_bytes / sampled_rows))
