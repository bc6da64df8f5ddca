"""CSV files with a latitude and a longitude column as point features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.functions.geometry import point
from quadweave.functions.values import PROPS, T_DOUBLE, T_STRING

LAT, LON = ("lat", "latitude"), ("lon", "lng", "longitude")


def read_csv_points(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """Headers are lower-cased; other columns become numbers where they parse as such, else text."""
    raw = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="FAILFAST")
    return csv_rows(raw, layer)


def csv_rows(raw: DataFrame, layer: str) -> DataFrame:
    names = [c.strip().lower() for c in raw.columns]
    rows = raw.toDF(*[f"c{i}" for i in range(len(names))])
    find = lambda known: next((i for i, n in enumerate(names) if n in known), None)
    lat, lon = find(LAT), find(LON)
    if lat is None or lon is None:
        raise ValueError(f"a CSV of points needs a latitude and a longitude column; it has {', '.join(names)}")

    def number(i: int, what: str):
        v = F.trim(F.col(f"c{i}")).try_cast("double")
        return F.when(v.isNotNull(), v).otherwise(F.raise_error(F.concat(F.lit(f"not a {what}: "), F.coalesce(f"c{i}", F.lit("null")))).cast("double"))

    props = []
    for i, n in enumerate(names):
        if i in (lat, lon):
            continue
        v = F.trim(F.coalesce(f"c{i}", F.lit("")))
        d = v.try_cast("double")
        finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) != float("inf"))
        # "nan" and "inf" parse as numbers that JSON can't hold, so they are null
        props.append(F.struct(F.lit(n).alias("k"), F.when(finite, T_DOUBLE).otherwise(T_STRING).cast("tinyint").alias("t"), F.when(finite, d.cast("string")).when(d.isNotNull(), F.lit("null")).otherwise(v).alias("s")))
    made = F.array_sort(F.array(*props)) if props else F.array().cast(PROPS)
    fid = F.xxhash64(*[F.coalesce(f"c{i}", F.lit("")) for i in range(len(names))])
    return rows.select(F.lit(layer).alias("layer"), fid.alias("fid"), point(number(lon, "longitude"), number(lat, "latitude")).alias("geom"), made.alias("props"))
