"""Command line: bake inputs into an archive, inspect one, estimate sizes."""

from __future__ import annotations

import argparse
import json
import os

from pyspark.sql import SparkSession

from quadweave.functions.values import human_bytes
from quadweave.operators.estimate import estimate, field_stats, projected_count
from quadweave.plans.archive import import_mbtiles, inspect
from quadweave.plans.bake import bake
from quadweave.plans.config import BakeConfig
from quadweave.sources.crs import bytes_of_file, head_of_file
from quadweave.sources.dispatch import layer_name, read_layer


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quadweave", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("bake")
    b.add_argument("inputs", nargs="+")
    b.add_argument("-o", "--output", required=True)
    b.add_argument("--layer", "--layers", dest="layers", default="", help="names by comma; files' names where missing")
    b.add_argument("--min-zoom", type=int, default=0)
    b.add_argument("--max-zoom", type=int, default=14)
    b.add_argument("--compression", choices=("none", "gzip", "brotli"), default="gzip")
    b.add_argument("--attribution")
    b.add_argument("--tolerance", type=float, default=1.0)
    b.add_argument("--include-fields")
    b.add_argument("--exclude-fields", default="")
    b.add_argument("--crs")
    i = sub.add_parser("inspect")
    i.add_argument("archive")
    e = sub.add_parser("estimate")
    e.add_argument("input")
    e.add_argument("--threads", type=int, default=os.cpu_count() or 1)
    e.add_argument("--sample-bytes", type=int, help="read so many bytes of a line-delimited input and project its size")
    return p


def _names(text: str) -> list[str]:
    return [x.strip() for x in text.split(",") if x.strip()]


def sampled_count(spark: SparkSession, path: str, size: int) -> int:
    """Features of a line-delimited input by the whole lines of its first bytes."""
    total, head = bytes_of_file(spark, path), head_of_file(spark, path, size)
    whole = total <= size
    lines = head.splitlines(keepends=True)
    if not whole and lines and not lines[-1].endswith("\n"):
        lines.pop()
    return projected_count(total, sum(len(x.encode()) for x in lines), sum(bool(x.strip()) for x in lines), whole)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("quadweave").getOrCreate()
    if a.command == "inspect":
        row = inspect(spark, a.archive).first().asDict()
        row["metadata"] = json.loads(row["metadata"])
        print(json.dumps(row, ensure_ascii=False, indent=2))
        return 0
    if a.command == "estimate" and a.sample_bytes:
        print(json.dumps({"features": sampled_count(spark, a.input, a.sample_bytes)}))
        return 0
    if a.command == "estimate":
        rows = read_layer(spark, a.input)
        est = estimate(rows)
        field_stats(rows).withColumn("size", human_bytes("total_bytes")).show(100, truncate=False)
        print(json.dumps({"features": est.count, "store_bytes": est.store_bytes(), "output_bytes": est.output_bytes(), "peak_bytes": est.peak_bytes(a.threads)}))
        return 0
    if any(p.lower().endswith(".mbtiles") for p in a.inputs):
        if len(a.inputs) > 1:
            raise SystemExit("an .mbtiles file holds tiles and is imported alone")
        h = import_mbtiles(spark, a.inputs[0], a.output)
        print(f"{a.output}: {h.addressed} tiles, {h.contents} distinct, zoom {h.min_zoom} to {h.max_zoom}")
        return 0
    names = _names(a.layers)
    names += [layer_name(p) for p in a.inputs[len(names) :]]
    layers = {n: read_layer(spark, p, n, a.crs) for n, p in zip(names, a.inputs, strict=True)}
    cfg = BakeConfig(names[0], a.min_zoom, a.max_zoom, a.compression, a.tolerance, a.attribution, _names(a.include_fields) if a.include_fields is not None else None, _names(a.exclude_fields))
    h = bake(layers, a.output, cfg)
    print(f"{a.output}: {h.addressed} tiles, {h.contents} distinct, zoom {h.min_zoom} to {h.max_zoom}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
