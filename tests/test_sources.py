import json
import sqlite3
import struct

import pytest

from quadweave.plans.archive import write_small_archive
from quadweave.sources import archive_format as fmt
from quadweave.sources.crs import crs_of_file, to_wgs84
from quadweave.sources.dispatch import read_layer
from quadweave.sources.geojson import EmptyLayer, read_geojsonseq, require_features
from quadweave.sources.mbtiles import read_info, read_mbtiles
from quadweave.sources.pmtiles import Archive, read_directory, read_pmtiles
from quadweave.functions.curves import tile_id_of

TRIO = [
    {"type": "Feature", "geometry": {"type": "Point", "coordinates": [0, 0, 9]}, "properties": {"name": "p", "value": 42}},
    {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[-10, -10], [10, 10]]}, "properties": {"name": "l", "kind": "x"}},
    {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[[-5, -5], [5, -5], [5, 5], [-5, 5], [-5, -5]]]}, "properties": {"name": "b", "area": 100}},
]


def rows_of(df):
    return sorted((r["geom"]["kind"], tuple((p["k"], p["s"]) for p in r["props"])) for r in df.collect())


def test_document_and_lines_agree(spark, tmp_path):
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [*TRIO, {"type": "Feature", "geometry": None, "properties": {}}]}))
    (tmp_path / "a.ndjson").write_text("\n".join(["\x1e" + json.dumps(TRIO[0]), "  ", json.dumps(TRIO[1]) + "  ", json.dumps(TRIO[2]), ""]))
    doc, lines = read_layer(spark, f"{tmp_path}/a.geojson"), read_layer(spark, f"{tmp_path}/a.ndjson")
    assert rows_of(doc) == rows_of(lines) and doc.count() == 3
    assert {r.fid for r in doc.collect()} == {r.fid for r in lines.collect()}
    assert doc.first().geom.parts[0][0][0] == (0.0, 0.0)


def test_bare_geometry_feature_and_collection(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"type":"Point","coordinates":[1,2]}')
    (tmp_path / "f.json").write_text(json.dumps(TRIO[0]))
    (tmp_path / "c.json").write_text(json.dumps({"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [1, 1]}, {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3]]]}]}, "properties": None}))
    assert rows_of(read_layer(spark, f"{tmp_path}/g.json")) == [(1, ())]
    assert read_layer(spark, f"{tmp_path}/f.json").count() == 1
    assert rows_of(read_layer(spark, f"{tmp_path}/c.json")) == [(1, ()), (5, ())]


def test_bad_lines(spark, tmp_path):
    (tmp_path / "bad.ndjson").write_text(json.dumps(TRIO[0]) + "\nnot json\n")
    with pytest.raises(Exception, match="(?i)json|malformed"):
        read_geojsonseq(spark, f"{tmp_path}/bad.ndjson", "x").collect()
    (tmp_path / "other.ndjson").write_text('{"type":"Point","coordinates":[1,2]}\n')
    with pytest.raises(Exception, match="not a Feature"):
        read_geojsonseq(spark, f"{tmp_path}/other.ndjson", "x").collect()
    assert read_geojsonseq(spark, f"{tmp_path}/bad.ndjson", "x", permissive=True).count() == 1
    (tmp_path / "empty.ndjson").write_text("\n\n")
    with pytest.raises(EmptyLayer):
        require_features(read_layer(spark, f"{tmp_path}/empty.ndjson"), "empty")


def test_csv(spark, tmp_path):
    (tmp_path / "c.csv").write_text(" LAT , Lon,name,pop\n51.5, 0 ,London,9\n48.8,2.35,Paris,nan\n")
    got = {r["props"][0]["s"]: r for r in read_layer(spark, f"{tmp_path}/c.csv").collect()}
    assert got["London"]["geom"]["parts"][0][0][0] == (0.0, 51.5)
    assert [(p["k"], p["t"], p["s"]) for p in got["London"]["props"]] == [("name", 1, "London"), ("pop", 3, "9.0")]
    assert got["Paris"]["props"][1]["s"] == "null"
    (tmp_path / "x.csv").write_text("x,y\n1,2\n")
    with pytest.raises(ValueError, match="latitude"):
        read_layer(spark, f"{tmp_path}/x.csv")
    (tmp_path / "bad.csv").write_text("lat,lon\n1,east\n")
    with pytest.raises(Exception, match="not a longitude"):
        read_layer(spark, f"{tmp_path}/bad.csv").collect()


def shp(kind, body):
    content = struct.pack("<i", kind) + body
    record = struct.pack(">2i", 1, len(content) // 2) + content
    head = struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + len(record)) // 2) + struct.pack("<2i8d", 1000, kind, *[0.0] * 8)
    return head + record


def test_shapefile(spark, tmp_path):
    shell = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0), (0.0, 0.0)]
    hole = [(2.0, 2.0), (4.0, 2.0), (4.0, 4.0), (2.0, 2.0)]
    xy = b"".join(struct.pack("<2d", *c) for c in shell + hole)
    (tmp_path / "p.shp").write_bytes(shp(5, struct.pack("<4d", 0, 0, 9, 9) + struct.pack("<2i", 2, 9) + struct.pack("<2i", 0, 5) + xy))
    fields = b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in [(b"NAME", b"C", 8, 0), (b"N", b"N", 5, 0)])
    head = struct.pack("<B3BIHH", 3, 0, 0, 0, 1, 32 + len(fields) + 1, 14) + b"\0" * 20
    (tmp_path / "p.dbf").write_bytes(head + fields + b"\r" + b" " + b"here    " + b"   42")
    row = read_layer(spark, f"{tmp_path}/p.shp").first()
    assert row["geom"]["kind"] == 3 and [len(r) for r in row["geom"]["parts"][0]] == [5, 4]
    assert [(p["k"], p["t"], p["s"]) for p in row["props"]] == [("N", 6, "42"), ("NAME", 1, "here")]
    (tmp_path / "p.prj").write_text('PROJCS["NAD83 / Washington South"]')
    with pytest.raises(Exception, match="longitude and latitude"):
        read_layer(spark, f"{tmp_path}/p.shp").collect()


def test_mbtiles(spark, tmp_path):
    path = str(tmp_path / "m.mbtiles")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata (name text, value text)")
        db.execute("CREATE TABLE tiles (zoom_level int, tile_column int, tile_row int, tile_data blob)")
        db.execute("INSERT INTO metadata VALUES ('maxzoom', '3'), ('bounds', '1,2,3')")
        db.executemany("INSERT INTO tiles VALUES (?,?,?,?)", [(0, 0, 0, b"\x1f\x8bx"), (2, 1, 0, b"y"), (2, 1, 3, b"z")])
    info = read_info(path)
    assert (info.name, info.min_zoom, info.max_zoom, info.compression, info.bounds) == ("imported", 0, 3, "gzip", (-180.0, -85.0, 180.0, 85.0))
    assert sorted(map(tuple, read_mbtiles(spark, path).collect())) == [(0, 0, 0, b"\x1f\x8bx"), (2, 1, 0, b"z"), (2, 1, 3, b"y")]


def test_crs(spark, tmp_path):
    (tmp_path / "m.geojson").write_text(json.dumps({"type": "Feature", "crs": {"properties": {"name": "EPSG:3857"}}, "geometry": {"type": "Point", "coordinates": [111319.49079327357, 0]}, "properties": {}}))
    assert crs_of_file(spark, f"{tmp_path}/m.geojson") == "EPSG:3857"
    c = read_layer(spark, f"{tmp_path}/m.geojson").first().geom.parts[0][0][0]
    assert abs(c[0] - 1) < 1e-9 and abs(c[1]) < 1e-9
    with pytest.raises(ValueError, match="EPSG:2927"):
        to_wgs84(spark.range(1), "EPSG:2927")
    with pytest.raises(ValueError, match="not a known input"):
        read_layer(spark, "x.gpkg")


def test_varints_and_headers():
    assert fmt.read_varint(b"\x01", 0) == (1, 1) and fmt.read_varint(b"\xac\x02", 0) == (300, 2)
    for v in (0, 127, 128, 2**32, 2**63 - 1):
        assert fmt.read_varint(fmt.write_varint(v), 0)[0] == v
    with pytest.raises(fmt.CorruptDirectory):
        fmt.read_varint(b"\x80\x80", 0)
    with pytest.raises(fmt.BadMagic):
        fmt.Header.unpack(b"\0" * 128)
    with pytest.raises(fmt.UnsupportedVersion):
        fmt.Header.unpack(b"PMTiles\x02" + b"\0" * 120)
    h = fmt.Header(root_offset=127, addressed=5, min_zoom=1, max_zoom=9, bounds=(-1.5, -2.5, 3.5, 4.5), center=(1.0, 1.0, 4))
    assert fmt.Header.unpack(h.pack()) == h


def test_directories_of_shared_blobs_read_back():
    ids, lengths, offsets = [0, 1, 2, 3], [10, 5, 10, 5], [0, 10, 0, 10]
    raw = fmt.encode_directory(ids, [1] * 4, lengths, offsets)
    assert [(e[0], e[1], e[2]) for e in fmt.decode_directory(raw)] == list(zip(ids, offsets, lengths, strict=True))
    assert fmt.decode_directory(fmt.write_varint(1) + b"\x05\x01\x07\x00", "raw") == [(5, 0, 7, 1)]
    with pytest.raises(fmt.CorruptDirectory):
        fmt.decode_directory(b"\x05\x01")


def test_small_archive(spark, tmp_path):
    path = str(tmp_path / "s.pmtiles")
    at = [(0, 0, 0), (1, 0, 0), (1, 0, 1), (1, 1, 1), (1, 1, 0), (2, 0, 0), (2, 2, 2)]
    write_small_archive([(tile_id_of(*t), f"tile-{t}".encode()) for t in at], path, '{"name":"s"}')
    a = Archive(path)
    assert (a.header.min_zoom, a.header.max_zoom, a.header.addressed) == (0, 2, 7)
    assert all(a.get_tile(*t) == f"tile-{t}".encode() for t in at) and a.metadata() == '{"name":"s"}'
    with pytest.raises(fmt.TileNotFound, match="2/3/3"):
        a.get_tile(2, 3, 3)
    df = read_pmtiles(spark, path)
    assert df.count() == 7
    assert [bytes(r[0]) for r in df.where("z = 2 and x = 2 and y = 2").select("data").collect()] == [b"tile-(2, 2, 2)"]
    assert df.where("z = 2 and x = 3 and y = 3").count() == 0 and df.where("z = 1").count() == 4
    assert df.where("tile_id = 2").first().z == 1


def test_runs_share_one_entry(spark, tmp_path):
    path = str(tmp_path / "r.pmtiles")
    write_small_archive([(i, b"same") for i in range(1, 5)] + [(9, b"other"), (10, b"same")], path)
    assert [tuple(r) for r in read_directory(spark, path).orderBy("tile_id").collect()] == [(1, 0, 4, 4), (9, 4, 5, 1), (10, 0, 4, 1)]
    assert {r.tile_id: bytes(r.data) for r in read_pmtiles(spark, path).collect()} == {1: b"same", 2: b"same", 3: b"same", 4: b"same", 9: b"other", 10: b"same"}


def test_crs_after_many_lines_is_found(spark, tmp_path):
    from quadweave.sources import crs

    name = '"crs": {"type": "name", "properties": {"name": "urn:ogc:def:crs:EPSG::3857"}}'
    path = tmp_path / "pretty.geojson"
    path.write_text('{"type": "FeatureCollection",\n"notes": [\n' + "0,\n" * 500 + "0],\n" + name + ',\n"features": []}')
    assert crs.crs_of_file(spark, str(path)) == "EPSG:3857"
    path.write_text('{"notes": "' + "x" * 65_536 + '",\n' + name + "}")
    assert crs.crs_of_file(spark, str(path)) is None
    (tmp_path / "empty.geojson").write_text("")
    assert crs.crs_of_file(spark, str(tmp_path / "empty.geojson")) is None


def test_crs_of_line_delimited_input(spark, tmp_path):
    feature = {"type": "Feature", "crs": {"properties": {"name": "EPSG:3857"}}, "geometry": {"type": "Point", "coordinates": [111319.49079327357, 0]}, "properties": {}}
    (tmp_path / "m.ndjson").write_text("\n".join([json.dumps(feature)] * 3))
    c = read_layer(spark, f"{tmp_path}/m.ndjson").first().geom.parts[0][0][0]
    assert (round(c.x, 9), round(c.y, 9)) == (1.0, 0.0)


def test_shapes_without_their_attributes_are_an_error(spark, tmp_path):
    ring = [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (0.0, 0.0)]
    xy = b"".join(struct.pack("<2d", *c) for c in ring)
    (tmp_path / "q.shp").write_bytes(shp(5, struct.pack("<4d", 0, 0, 9, 9) + struct.pack("<2i", 1, 4) + struct.pack("<i", 0) + xy))
    assert read_layer(spark, f"{tmp_path}/q.shp").count() == 1
    field = b"N".ljust(11, b"\0") + b"N" + b"\0" * 4 + bytes([5, 0]) + b"\0" * 14
    (tmp_path / "q.dbf").write_bytes(struct.pack("<B3BIHH", 3, 0, 0, 0, 0, 65, 6) + b"\0" * 20 + field + b"\r")
    with pytest.raises(Exception, match="1 shapes and 0 rows"):
        read_layer(spark, f"{tmp_path}/q.shp").collect()


def test_mbtiles_become_an_archive(spark, tmp_path, capsys):
    from quadweave.plans import cli
    from quadweave.sources.pmtiles import read_directory, read_pmtiles

    path, out = str(tmp_path / "n.mbtiles"), str(tmp_path / "n.pmtiles")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE metadata (name text, value text)")
        db.execute("CREATE TABLE tiles (zoom_level int, tile_column int, tile_row int, tile_data blob)")
        db.execute("INSERT INTO metadata VALUES ('name', 'towns'), ('minzoom', '0'), ('maxzoom', '2')")
        db.executemany("INSERT INTO tiles VALUES (?,?,?,?)", [(0, 0, 0, b"\x1f\x8bx"), (2, 1, 0, b"yy"), (2, 1, 3, b"yy")])
    assert cli.main(["bake", path, "-o", out], spark) == 0
    assert sorted((r.z, r.x, r.y, bytes(r.data)) for r in read_pmtiles(spark, out).collect()) == [(0, 0, 0, b"\x1f\x8bx"), (2, 1, 0, b"yy"), (2, 1, 3, b"yy")]
    assert read_directory(spark, out).count() == 3
    capsys.readouterr()
    assert cli.main(["inspect", out], spark) == 0
    shown = json.loads(capsys.readouterr().out)
    assert (shown["max_zoom"], shown["smallest"], shown["largest"], shown["contents"], shown["metadata"]["name"]) == (2, 2, 3, 2, "towns")


def test_counts_are_projected_from_a_sample(spark, tmp_path):
    from quadweave.plans.cli import sampled_count

    line = json.dumps({"type": "Feature", "geometry": None, "properties": {"a": "x" * 50}}) + "\n"
    (tmp_path / "s.ndjson").write_text(line * 200)
    assert sampled_count(spark, f"{tmp_path}/s.ndjson", 10 * len(line) + 7) == 200
    assert sampled_count(spark, f"{tmp_path}/s.ndjson", 10**6) == 200


def test_utm(spark, tmp_path):
    # the meridian's arc to 45 degrees is 4,984,944.378 m; the CN Tower by its published coordinates
    places = [(32631, 500000.0, 0.0, 3.0, 0.0, 1e-9), (32733, 500000.0, 1e7, 15.0, 0.0, 1e-9), (32601, 500000.0, 4984944.378 * 0.9996, -177.0, 45.0, 1e-8), (32617, 630084.0, 4833438.0, -79.387139, 43.642567, 2e-5)]
    for code, x, y, lon, lat, off in places:
        (tmp_path / f"{code}.ndjson").write_text(json.dumps({"type": "Feature", "crs": {"properties": {"name": f"EPSG:{code}"}}, "geometry": {"type": "Point", "coordinates": [x, y]}, "properties": {}}))
        c = read_layer(spark, f"{tmp_path}/{code}.ndjson").first().geom.parts[0][0][0]
        assert abs(c.x - lon) < off and abs(c.y - lat) < off
