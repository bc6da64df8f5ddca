"""Attribute values: type names, value tags of the tile format, human-readable sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadweave.functions.mercator import _c

#: Tags of an attribute value: what the tile format stores it as.
T_STRING, T_DOUBLE, T_INT, T_BOOL = 1, 3, 6, 7
#: Attributes travel as sorted (name, tag, text); the text is the value's plain form.
PROPS = "array<struct<k:string,t:tinyint,s:string>>"


def json_type_name(value) -> Column:
    """Boolean, Number, String, Null or mixed-type names of a variant value."""
    s = F.schema_of_variant(_c(value))
    return (
        F.when(s == "BOOLEAN", "Boolean")
        .when((s == "BIGINT") | s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "Number")
        .when(s == "STRING", "String")
        .when(s.isin("VOID") | s.isNull(), "Null")
        .otherwise("mixed")
    )


def value_tag(value) -> Column:
    """The tag a variant is stored under: booleans, 64-bit integers, other numbers, and text for all else."""
    s = F.schema_of_variant(_c(value))
    return F.when(s == "BOOLEAN", T_BOOL).when(s == "BIGINT", T_INT).when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), T_DOUBLE).otherwise(T_STRING).cast("tinyint")


def value_text(value) -> Column:
    """The plain text of a variant: strings as they are, all else as JSON (null is "null")."""
    v = _c(value)
    s = F.schema_of_variant(v)
    number = F.variant_get(v, "$", "double").cast("string")
    return F.when(s == "STRING", F.variant_get(v, "$", "string")).when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), number).otherwise(F.coalesce(F.to_json(v), F.lit("null")))


def props_of(json_text) -> Column:
    """JSON object text -> sorted attribute structs; null or not an object gives none."""
    entries = F.map_entries(F.from_json(_c(json_text), "map<string,variant>"))
    made = F.transform(entries, lambda e: F.struct(e["key"].alias("k"), value_tag(e["value"]).alias("t"), value_text(e["value"]).alias("s")))
    return F.coalesce(F.array_sort(made), F.array().cast(PROPS))


def keep_props(props, keep: list[str]) -> Column:
    return F.filter(_c(props), lambda p: p["k"].isin(keep) if keep else F.lit(False))


def drop_props(props, exclude: list[str]) -> Column:
    return F.filter(_c(props), lambda p: ~p["k"].isin(exclude) if exclude else F.lit(True))


def human_bytes(n) -> Column:
    """Bytes in steps of 1024: three digits at most where they matter, else one decimal; halves go to the even digit."""
    n = _c(n).cast("double")
    out = F.when(n < 1024, F.concat(F.format_string("%.0f", n), F.lit(" B")))
    for i, unit in enumerate(["KB", "MB", "GB", "TB", "PB"], 1):
        v = n / F.lit(1024.0**i)
        text = F.when(v >= 100, F.format_string("%.0f", F.bround(v, 0))).otherwise(F.format_string("%.1f", F.bround(v, 1)))
        out = out.when(v < 1024, F.concat(text, F.lit(f" {unit}"))) if unit != "PB" else out.otherwise(F.concat(text, F.lit(" PB")))
    return out


def sniff_compression(data) -> Column:
    """"gzip" for bytes that start like it, else "none"."""
    return F.when(F.hex(F.substring(_c(data), 1, 2)) == "1F8B", "gzip").otherwise("none")


def parse_bounds(text) -> Column:
    """"w,s,e,n" -> four doubles; anything else is the whole world."""
    parts = F.transform(F.split(_c(text), ","), lambda p: F.trim(p).try_cast("double"))
    good = (F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull())
    return F.coalesce(F.when(good, parts), F.array(*[F.lit(v) for v in (-180.0, -85.0, 180.0, 85.0)]))


def detect_crs(text, limit: int = 65536) -> Column:
    """"EPSG:n" named by a "crs" member within the first characters, else null."""
    head = F.substring(_c(text), 1, limit)
    at = F.instr(head, '"crs"')
    tail = F.when(at > 0, F.substring(head, at, F.lit(limit)))
    code = F.regexp_extract(tail, r"EPSG:+(\d+)", 1)
    return F.when(code != "", F.concat(F.lit("EPSG:"), code))


def is_wgs84(code) -> Column:
    return F.upper(_c(code)).isin("EPSG:4326", "OGC:CRS84", "CRS84")
