"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import durable

#: Links of a round that one task handles; small inputs get few tasks.
LINKS_PER_TASK = 50_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    spread = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return spread.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links of integers -> (node, root): root is the smallest node of the component.

    Nodes without links are not in the result; null ends and loops are ignored; repeated links count once.
    Minima are pre-aggregated before each shuffle and the joins are plain equi-joins, so a node with
    many links is split by skew handling. Every round is cut by a reliable checkpoint.
    """
    now = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    now, seen = durable(now), None
    # few links need few tasks: each task of a round writes files of its own, however little is in them
    tasks = 2 + now.count() // LINKS_PER_TASK
    for _ in range(rounds):
        now = durable(_small_star(_large_star(now.coalesce(tasks)).coalesce(tasks)).coalesce(tasks).distinct().coalesce(tasks))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
