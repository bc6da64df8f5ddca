"""Layers from tables without coordinates: places are arithmetic of keys, the same in any SQL engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.functions.geometry import box, coord, line, point
from quadweave.functions.values import PROPS

KEYS = {"customer": "c_custkey", "supplier": "s_suppkey", "orders": "o_orderkey", "part": "p_partkey"}
NAMES = {"customer": "c_name", "supplier": "s_name", "part": "p_name"}


def lon_sql(k: str) -> str:
    return f"((({k})*7919)%35000)/100.0E0-175.0E0"


def lat_sql(k: str) -> str:
    return f"((({k})*104729)%16000)/100.0E0-80.0E0"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _props(name: str | None):
    if name is None:
        return F.array().cast(PROPS)
    return F.array(F.struct(F.lit("name").alias("k"), F.lit(1).cast("tinyint").alias("t"), F.col(name).alias("s")))


def point_layer(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Feature rows of a table: one point per key, with the row's name if it has one."""
    k = KEYS[name]
    return table(spark, sf_dir, name).select(F.lit(name).alias("layer"), F.col(k).cast("long").alias("fid"), point(F.expr(lon_sql(k)), F.expr(lat_sql(k))).alias("geom"), _props(NAMES.get(name)).alias("props"))


def box_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as squares around their points, 0.05 degrees of half side per unit of size."""
    x, y, h = F.expr(lon_sql("p_partkey")), F.expr(lat_sql("p_partkey")), F.col("p_size") * F.lit(0.05)
    return table(spark, sf_dir, "part").select(F.lit("part").alias("layer"), F.col("p_partkey").cast("long").alias("fid"), box(x - h, y - h, x + h, y + h).alias("geom"), _props("p_name").alias("props"))


def line_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lines through the points of their parts, in line order; orders of one line item have none."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("v")).where(F.size("v") > 1)
    place = lambda v: coord((v["l_partkey"] * 7919 % 35000) / F.lit(100.0) - F.lit(175.0), (v["l_partkey"] * 104729 % 16000) / F.lit(100.0) - F.lit(80.0))
    return items.select(F.lit("lineitem").alias("layer"), F.col("l_orderkey").cast("long").alias("fid"), line(F.transform("v", place)).alias("geom"), F.array().cast(PROPS).alias("props"))
