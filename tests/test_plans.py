import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from quadweave.functions.curves import tile_id_of
from quadweave.functions.geometry import box, line, point, coord
from quadweave.functions.values import PROPS
from quadweave.operators import directory, fanout, kernels, layer_schema
from quadweave.operators.mvt import decode_geometry, decode_tile, encode_geometry
from quadweave.operators.tileset import cap_features, encode_tiles, grown, tile_pieces, tile_rect
from quadweave.plans import archive, bake, cli, serve
from quadweave.plans.config import BakeConfig
from quadweave.plans.manifest import tilejson
from quadweave.sources.geojson import EmptyLayer
from quadweave.sources.pmtiles import Archive, read_pmtiles
from quadweave.streaming import incremental
from tests.test_sources import TRIO


def world(spark):
    return spark.range(1).select(F.lit("world").alias("layer"), F.lit(1).cast("long").alias("fid"), box(F.lit(-180.0), F.lit(-85.0), F.lit(180.0), F.lit(85.0)).alias("geom"), F.array().cast(PROPS).alias("props"))


def cities(spark):
    df = spark.createDataFrame([(1, 0.0, 51.5, "a"), (2, 2.35, 48.8, "b"), (3, 13.4, 52.5, "c")], "fid long, x double, y double, n string")
    p = F.array(F.struct(F.lit("city").alias("k"), F.lit(1).cast("tinyint").alias("t"), F.col("n").alias("s")), F.struct(F.lit("n").alias("k"), F.lit(6).cast("tinyint").alias("t"), F.col("fid").cast("string").alias("s")))
    return df.select(F.lit("cities").alias("layer"), "fid", point("x", "y").alias("geom"), p.alias("props"))


def trio(spark):
    from quadweave.sources.geojson import features_to_rows

    return features_to_rows(spark.createDataFrame([(json.dumps(f),) for f in TRIO], "s string").select(F.parse_json("s").alias("f")), "trio")


def test_baked_archive_reads_back(spark, tmp_path):
    path = str(tmp_path / "t.pmtiles")
    h = bake.bake({"trio": trio(spark), "cities": cities(spark)}, path, BakeConfig(max_zoom=5, attribution="me"))
    a = Archive(path)
    layers = decode_tile(gzip.decompress(a.get_tile(0, 0, 0)))
    assert [x["name"] for x in layers] == ["trio", "cities"] and [len(x["features"]) for x in layers] == [3, 3]
    assert len(a.get_tile(0, 0, 0)) < 64 << 10
    doc = json.loads(a.metadata())
    assert [x["name"] for x in doc["layers"]] == ["trio", "cities"] and doc["attribution"] == "me"
    assert doc["layers"][0]["geometry_types"] == ["LineString", "Point", "Polygon"]
    assert doc["layers"][1]["fields"] == [{"name": "city", "type": "String"}, {"name": "n", "type": "Number"}]
    assert doc["bounds"] == [-10.0, -10.0, 13.4, 52.5] and doc["center"][2] == 2
    back = read_pmtiles(spark, path).collect()
    assert len(back) == h.addressed == h.entries and {a.get_tile(r.z, r.x, r.y) == bytes(r.data) for r in back} == {True}
    row = archive.inspect(spark, path).first()
    assert (row.min_zoom, row.max_zoom, row.addressed, row.contents) == (0, 5, h.addressed, h.contents)


def test_world_polygon_fills_every_tile_and_shares_blobs(spark, tmp_path):
    path = str(tmp_path / "w.pmtiles")
    h = bake.bake(world(spark), path, BakeConfig(layer="world", max_zoom=4))
    assert h.addressed == sum(4**z for z in range(5)) and h.contents < h.addressed and h.entries < h.addressed
    a = Archive(path)
    f = decode_tile(gzip.decompress(a.get_tile(4, 7, 7)))[0]["features"][0]
    assert f["type"] == 3 and {c for p in f["paths"] for c in p} == {(-4, -4), (4100, -4), (4100, 4100), (-4, 4100)}


def test_order_of_rows_does_not_matter(spark, tmp_path):
    rows = trio(spark).unionByName(cities(spark))
    bake.bake(rows.repartition(5), str(tmp_path / "a"), BakeConfig(layer="x", max_zoom=4))
    bake.bake(rows.orderBy(F.desc("fid")).coalesce(1), str(tmp_path / "b"), BakeConfig(layer="x", max_zoom=4))
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()


def test_leaf_directories(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "LEAF_ENTRIES", 40)
    tiles = spark.range(1000).select((F.col("id") * 3).alias("tile_id"), F.encode(F.concat(F.lit("t"), (F.col("id") % 700).cast("string")), "UTF-8").alias("data"))
    path = str(tmp_path / "l.pmtiles")
    h = archive.write_archive(tiles, path, "{}", 0, 6, (-1, -1, 1, 1), (0, 0, 0), "none")
    a = Archive(path)
    assert h.leaf_length > 0 and h.contents == 700 and h.addressed == 1000
    assert all(a.tile_by_id(3 * i) == f"t{i % 700}".encode() for i in range(1000))
    assert read_pmtiles(spark, path).count() == 1000


def test_field_filters_and_errors(spark, tmp_path):
    keep = bake.bake_tiles(cities(spark), BakeConfig(max_zoom=0, include=["n"])).first()
    drop = bake.bake_tiles(cities(spark), BakeConfig(max_zoom=0, exclude=["n"])).first()
    assert set(decode_tile(gzip.decompress(keep.data))[0]["features"][0]["props"]) == {"n"}
    assert set(decode_tile(gzip.decompress(drop.data))[0]["features"][0]["props"]) == {"city"}
    with pytest.raises(EmptyLayer):
        bake.bake(cities(spark).where("false"), str(tmp_path / "e"))
    for bad in ({"min_zoom": 3, "max_zoom": 2}, {"max_zoom": 31}, {"min_zoom": -1}):
        with pytest.raises(ValueError):
            BakeConfig(**bad)
    with pytest.raises((RuntimeError, ValueError)):
        encode_tiles(tile_pieces(cities(spark).withColumn("layer_ord", F.lit(0)), 0, 0), "lzw")


def flat(rows):
    from quadweave.functions.geometry import to_mercator

    return rows.withColumns({"geom": to_mercator("geom"), "layer_ord": F.lit(0)})


def test_pieces_are_the_same_however_they_are_dealt(spark):
    random.seed(3)
    lines = [(i, [(random.uniform(-170, 170), random.uniform(-80, 80)) for _ in range(4)]) for i in range(20)]
    df = spark.createDataFrame(lines, "fid long, c array<struct<x:double,y:double>>").select(F.lit("l").alias("layer"), "fid", line(F.col("c")).alias("geom"), F.array().cast(PROPS).alias("props"))
    a = {tuple(r) for r in tile_pieces(flat(df), 0, 5).select("fid", "z", "x", "y").collect()}
    b = {tuple(r) for r in tile_pieces(flat(df), 0, 5, deal_zoom=2).select("fid", "z", "x", "y").collect()}
    wide = {tuple(r) for r in fanout.fan_out(flat(df), 0, 5).select("fid", "z", "x", "y").collect()}
    assert a == b and a <= wide and len(a) > 500


def test_small_features_go_where_they_can_not_be_seen(spark):
    tiny = spark.range(1).select(F.lit("t").alias("layer"), F.lit(1).cast("long").alias("fid"), box(F.lit(1.0), F.lit(1.0), F.lit(1.01), F.lit(1.01)).alias("geom"), F.array().cast(PROPS).alias("props"))
    zooms = {r.z for r in tile_pieces(flat(tiny), 0, 8).collect()}
    assert zooms and min(zooms) == 4


def test_tight_and_padded_ranges_agree_on_edges(spark):
    side = 2 * 20037508.3427892 / 8
    xs = [(-20037508.3427892 + k * side + d) for k in range(9) for d in (0.0, side * 4 / 4096, -side * 4 / 4096, 1e-6)]
    df = spark.createDataFrame([(i, x, x) for i, x in enumerate(xs)], "fid long, x double, y double").select("fid", point("x", "y").alias("geom"))
    got = [{tuple(r) for r in fanout.fan_out(df, 0, 4, tight=t).select("fid", "z", "x", "y").collect()} for t in (True, False)]
    assert got[0] == got[1] and got[0]


def test_poles_are_refused_or_clamped(spark):
    pole = spark.range(1).select(F.lit("p").alias("layer"), F.lit(1).cast("long").alias("fid"), point(F.lit(0.0), F.lit(-90.0)).alias("geom"), F.array().cast(PROPS).alias("props"), F.lit(0).alias("layer_ord"))
    assert bake.bake_pieces(pole, BakeConfig(max_zoom=1)).count() == 0
    assert bake.bake_pieces(pole, BakeConfig(max_zoom=1, clamp=True)).count() > 0


def test_feature_cap(spark):
    pieces = tile_pieces(flat(cities(spark)), 0, 0)
    assert [r.fid for r in cap_features(pieces, 2).orderBy("fid").collect()] == [1, 2]


def test_null_and_number_are_mixed(spark):
    from quadweave.functions.values import props_of

    df = spark.createDataFrame([('{"a":1,"b":1}',), ('{"a":null,"b":2.5}',)], "s string").select(F.lit("l").alias("layer"), props_of("s").alias("props"))
    assert sorted(map(tuple, layer_schema.field_types(df).collect())) == [("l", "a", "mixed"), ("l", "b", "Number")]


def test_lookup_by_runs(spark):
    entries = spark.createDataFrame([(10, 5000, 0, 9), (6000, 1, 9, 4)], "tile_id long, run_length long, offset long, length long")
    ids = spark.createDataFrame([(9,), (10,), (5009,), (5010,), (6000,), (6001,)], "tile_id long")
    got = {r.tile_id: r.offset for r in directory.lookup(ids, entries, 64).collect()}
    assert got == {10: 0, 5009: 0, 6000: 9}


def test_responses(spark, tmp_path):
    path = str(tmp_path / "s.pmtiles")
    archive.write_small_archive([(tile_id_of(0, 0, 0), b"tile")], path, '{"name":"s","layers":[{"name":"a","fields":[{"name":"n","type":"Number"}]}]}')
    s = serve.Tilesets.open({"s": path}, origins=("https://ok",))
    get = lambda p, **h: serve.respond(s, p, {k.replace("_", "-"): v for k, v in h.items()})
    hit = get("/tiles/s/0/0/0.mvt")
    assert (hit.status, hit.body) == (200, b"tile") and "Content-Encoding" not in hit.headers
    assert hit.headers["Cache-Control"].endswith("immutable")
    assert get("/tiles/s/0/0/0", if_none_match=hit.headers["ETag"]).status == 304
    statuses = [get(p).status for p in ("/tiles/s/2/3/3", "/tiles/s/25/0/0", "/tiles/s/1/2/0", "/tiles/s/a/0/0", "/tiles/q/0/0/0", "/nothing", "/healthz", "/tilesets", "/tile.json", "/metrics")]
    assert statuses == [204, 400, 400, 400, 404, 404, 200, 200, 200, 404]
    assert get("/healthz", origin="https://ok").headers["Access-Control-Allow-Origin"] == "https://ok"
    assert "Access-Control-Allow-Origin" not in get("/healthz", origin="https://no").headers
    assert json.loads(get("/tilesets/s/tile.json").body)["vector_layers"][0]["fields"] == {"n": "Number"}
    locked = serve.Tilesets.open({"s": path}, token="t", metrics_on=True)
    assert [serve.respond(locked, "/tiles/s/0/0/0", h).status for h in ({}, {"Authorization": "Bearer x"}, {"Authorization": "Bearer t"})] == [401, 401, 200]
    assert b'status="401"} 2' in serve.respond(locked, "/metrics", {"authorization": "Bearer t"}).body
    assert tilejson({}, "u")["bounds"] == [-180.0, -85.0, 180.0, 85.0]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.csv").write_text("lat,lon,name\n1,2,x\n3,4,y\n")
    out = str(tmp_path / "o.pmtiles")
    assert cli.main(["bake", f"{tmp_path}/c.csv", "-o", out, "--max-zoom", "2", "--exclude-fields", "name"], spark) == 0
    assert cli.main(["inspect", out], spark) == 0
    shown = json.loads(capsys.readouterr().out.split("\n", 1)[1])
    assert shown["max_zoom"] == 2 and shown["metadata"]["layers"][0]["fields"] == []
    assert cli.main(["estimate", f"{tmp_path}/c.csv"], spark) == 0


def test_stream_touches_only_what_changed(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    feature = lambda x, n: json.dumps({"type": "Feature", "geometry": {"type": "Point", "coordinates": [x, 10]}, "properties": {"n": n}})
    cfg = BakeConfig(layer="s", max_zoom=2)
    run = lambda: incremental.start(spark, str(src), str(tmp_path / "pieces"), str(tmp_path / "tiles"), str(tmp_path / "cp"), cfg).awaitTermination(90)
    (src / "a.txt").write_text(feature(-100, 1) + "\nbad line\n")
    run()
    (src / "b.txt").write_text(feature(100, 2) + "\n")
    run()
    tiles = {(r.z, r.x, r.y): r.features for r in incremental.current_tiles(spark, str(tmp_path / "tiles")).collect()}
    assert tiles[0, 0, 0] == 2 and tiles[1, 0, 0] == 1 and tiles[1, 1, 0] == 1
    versions = spark.read.parquet(str(tmp_path / "tiles"))
    assert versions.where("z = 1 and x = 0").count() == 1


def test_coord_helper(spark):
    assert tuple(spark.range(1).select(coord(F.lit(1), F.lit(2)).alias("c")).first().c) == (1.0, 2.0)


def test_neighbours_share_partitions(spark):
    ordered = fanout.sort_by_morton(flat(trio(spark).unionByName(cities(spark)))).select("morton", "fid").collect()
    assert [tuple(r) for r in ordered] == sorted(map(tuple, ordered)) and len(ordered) == 6


def test_lines_and_polygons_match_clips_of_the_originals(spark):
    # every tile cut, simplified and cut again from the whole feature, not from its parent tile
    random.seed(11)
    lines = [(i, [(random.uniform(-170, 170), random.uniform(-80, 80)) for _ in range(5)]) for i in range(12)]
    shapes = spark.createDataFrame(lines, "fid long, c array<struct<x:double,y:double>>").select(F.lit("l").alias("layer"), "fid", line(F.col("c")).alias("geom"), F.array().cast(PROPS).alias("props"))
    corner = lambda k: F.lit(-170.0) + (F.col("id") * k) % 300
    boxes = spark.range(100, 112).select(F.lit("l").alias("layer"), F.col("id").alias("fid"), box(corner(37), F.lit(-60.0), corner(37) + 5 + F.col("id") % 30, F.lit(-60.0) + F.col("id")).alias("geom"), F.array().cast(PROPS).alias("props"))
    rows = flat(shapes.unionByName(boxes))
    got = {(r.fid, r.z, r.x, r.y): list(r.commands) for r in tile_pieces(rows, 0, 3).collect()}
    want = {}
    for r in rows.collect():
        parts = [[[(c.x, c.y) for c in ring] for ring in p] for p in r.geom.parts]
        for z in range(4):
            tol = 2 * 20037508.3427892 / (1 << z) / 4096
            for x in range(1 << z):
                for y in range(1 << z):
                    tile = tile_rect(z, x, y)
                    cut = kernels.clip_simplify_clip(r.geom.kind, parts, grown(tile), tol)
                    drawn = encode_geometry(*cut, tile)[1] if cut else []
                    if drawn:
                        want[r.fid, z, x, y] = drawn
    assert got.keys() == want.keys() and len(got) > 300
    shape = lambda c: sorted(map(sorted, decode_geometry(c)))
    near = lambda a, b: len(a) == len(b) and all(len(p) == len(q) and all(abs(u - v) <= 1 for m, n in zip(p, q, strict=True) for u, v in zip(m, n, strict=True)) for p, q in zip(a, b, strict=True))
    assert sum(near(shape(got[k]), shape(want[k])) for k in got) == len(got)


@pytest.mark.parametrize("groups", [1, 4, 50])
def test_directories_by_ranges(spark, groups):
    random.seed(2)
    ids = sorted(random.sample(range(300), 180) + list(range(10**9, 10**9 + 60)))
    entries, at, last = [], 0, None
    for t in ids:
        if last is None or random.random() < 0.6:
            last = (at, random.randrange(1, 9))
            at += last[1]
        entries.append((t, *last))
    df = spark.createDataFrame(random.sample(entries, len(entries)), "tile_id long, offset long, length long")
    runs = []
    for t, o, n in entries:
        if runs and runs[-1][0] + runs[-1][1] == t and runs[-1][2] == o:
            runs[-1][1] += 1
        else:
            runs.append([t, 1, o, n])
    assert sorted(map(list, directory.with_runs(df, groups=groups).select("tile_id", "run_length", "offset", "length").collect())) == runs
    want = [(t, t - (entries[i - 1][0] if i else 0), n, 0 if i and entries[i - 1][1] + entries[i - 1][2] == o else o + 1) for i, (t, o, n) in enumerate(entries)]
    stored = directory.delta_encode(df, groups)
    assert sorted(map(tuple, stored.collect())) == want
    numbered = spark.createDataFrame([(i, w[1]) for i, w in enumerate(want)], "i long, delta long")
    assert sorted((r.i, r.tile_id) for r in directory.delta_decode(numbered, groups).collect()) == list(enumerate(ids))
    owners = spark.createDataFrame([(str(o), t, n) for t, o, n in {o: (t, o, n) for t, o, n in reversed(entries)}.values()], "sha string, first_id long, length long")
    assert all(int(r.sha) == r.offset for r in directory.blob_offsets(owners, groups).collect())
