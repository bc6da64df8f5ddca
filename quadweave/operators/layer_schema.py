"""Inferred schema of a layer: bounds, attribute types and geometry kinds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.functions.geometry import bbox, kind_name
from quadweave.functions.values import T_BOOL, T_DOUBLE, T_INT


def tag_name(tag: str = "p.t", text: str = "p.s"):
    """Type name of an attribute struct; text that stands for null counts as Null, other JSON text as mixed."""
    t, s = F.col(tag), F.col(text)
    return F.when(t == T_BOOL, "Boolean").when(t.isin(T_INT, T_DOUBLE), "Number").when(s == "null", "Null").otherwise("String")


def field_types(rows: DataFrame) -> DataFrame:
    """(layer, name, type): one type if all values share it, else "mixed"; null is a type of its own."""
    each = rows.select("layer", F.explode("props").alias("p")).select("layer", F.col("p.k").alias("name"), tag_name().alias("type"))
    return each.groupBy("layer", "name").agg(F.collect_set("type").alias("types")).select("layer", "name", F.when(F.size("types") == 1, F.col("types")[0]).otherwise("mixed").alias("type"))


def geometry_kinds(rows: DataFrame) -> DataFrame:
    """(layer, kinds): sorted names."""
    return rows.groupBy("layer").agg(F.sort_array(F.collect_set(kind_name("geom.kind"))).alias("kinds"))


def layer_bounds(rows: DataFrame) -> DataFrame:
    """(layer, minx, miny, maxx, maxy) in degrees, limited to the globe."""
    b = rows.select("layer", bbox("geom").alias("b"))
    low = lambda c, v: F.greatest(F.min(f"b.{c}"), F.lit(v)).alias(c)
    high = lambda c, v: F.least(F.max(f"b.{c}"), F.lit(v)).alias(c)
    return b.groupBy("layer").agg(low("minx", -180.0), low("miny", -90.0), high("maxx", 180.0), high("maxy", 90.0))


def union_bounds(bounds: DataFrame) -> DataFrame:
    """One box around all layers."""
    return bounds.agg(F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"))
