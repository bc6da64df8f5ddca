import glob
import hashlib
import io

import pytest
import zstandard

from quadweave.llm import warc


def payloads(spark):
    big, small = "<p>" + "é" * 800, "x" * 999
    rows = [(1, "u1", big), (7, "u7", big), (3, None, big), (4, "u\r\n4", small), (5, "u5", small), (6, "u6", None), (8, "u8", ""), (9, "u9", "y" * 1000), (9, "u9", "y" * 1000), (None, "n", "z" * 2000), (None, "m", "z" * 2000), (10, "u", "q" * 300_000)]
    return spark.createDataFrame([(*r, "d", 5) for r in rows], "page_id long, url string, html string, digest string, keeper int")


def want(rows):
    out = []
    for r in rows:
        raw = (r.html or "").encode()
        same = [q.page_id for q in rows if q.page_id is not None and (q.html or "").encode() == raw]
        keeper = max(same, default=None) if len(raw) >= 1000 else None
        ref = keeper if keeper is not None and r.page_id != keeper else None
        out.append((r.page_id, len(raw), hashlib.sha1(raw).hexdigest(), "response" if ref is None else "revisit", ref))
    return out


def key(t):
    return tuple((x is None, x) for x in t)


def test_round_trip(spark, tmp_path):
    pages = payloads(spark)
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(spark, pages, str(tmp_path)).collect()]
    assert sorted(got, key=key) == sorted(want(pages.collect()), key=key)
    files = glob.glob(f"{tmp_path}/*.warc.zst")
    assert files and not glob.glob(f"{tmp_path}/.part*")
    assert all(open(f, "rb").read(4) == b"\x5d\x2a\x4d\x18" for f in files)


def test_payloads_come_back(spark, tmp_path):
    pages = payloads(spark)
    manifest = warc.write_archives(pages, str(tmp_path))
    got = {(r.page_id, r.url): bytes(r.payload) for r in warc.read_archives(manifest).collect() if r.record_type == "response"}
    assert got[10, "u"] == b"q" * 300_000 and got[6, "u6"] == b"" and got[4, "u%0D%0A4"] == b"x" * 999
    assert manifest.agg({"records": "sum"}).first()[0] == pages.count()


def test_empty_table(spark, tmp_path):
    assert warc.warc_round_trip(spark, payloads(spark).where("false"), str(tmp_path)).count() == 0


def test_records_are_frames_of_their_own():
    records = [warc.make_record(i, "u", (f"<html>page {i} " * 40).encode(), None, hashlib.sha1((f"<html>page {i} " * 40).encode()).hexdigest()) for i in range(300)]
    frames = list(warc.encode_archive(records))
    assert len(frames) == 301
    d = zstandard.ZstdCompressionDict(frames[0][8:])
    assert zstandard.ZstdDecompressor(dict_data=d).decompress(frames[200]) == records[199]
    assert len(b"".join(frames[1:])) < 0.5 * sum(len(zstandard.compress(r)) for r in records)
    assert list(warc.decode_archive(io.BytesIO(b"".join(frames)))) == records


def test_dictionaries_may_be_compressed_or_missing():
    record = warc.make_record(1, "u", b"hello", None, hashlib.sha1(b"hello").hexdigest())
    plain = zstandard.compress(record)
    assert list(warc.decode_archive(io.BytesIO(plain * 2))) == [record, record]
    frames = list(warc.encode_archive([record]))
    packed = zstandard.compress(frames[0][8:])
    head = frames[0][:4] + len(packed).to_bytes(4, "little") + packed
    assert list(warc.decode_archive(io.BytesIO(head + frames[1]))) == [record]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.decode_archive(io.BytesIO(plain[:-3])))


def test_damage_is_noticed():
    raw = warc.make_record(1, "u", b"hello", None, hashlib.sha1(b"other").hexdigest())
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(raw)


def test_attempts_never_share_a_file(spark, tmp_path):
    from quadweave.llm import warc

    records = [warc.make_record(i, "u", b"x" * 2000, None, "00" * 20) for i in range(3)]
    first, again = warc._write(str(tmp_path), "part-0", records), warc._write(str(tmp_path), "part-0", records[:1])
    assert first[0] != again[0]
    kept = spark.createDataFrame([first], "path string, records long, bytes long")
    with open(first[0], "rb") as f:
        assert sum(1 for _ in warc.decode_archive(f)) == 3 and kept.count() == 1


def test_record_ids_tell_rows_apart(spark, monkeypatch):
    from quadweave.llm import warc

    a, b, none = warc.record_id(1, "aa"), warc.record_id(1, "bb"), warc.record_id(None, "aa")
    assert len({a, b, none, warc.record_id(None, "aa")}) == 4 and a == warc.record_id(1, "aa")
    pages = spark.createDataFrame([(i, None, "y" * (10 if i in (2, 4) else 1500)) for i in (1, 2, 3, 4, None, 3)], "page_id long, url string, html string")
    want = sorted(map(str, warc.assign_records(pages).select("page_id", "digest", "refers_to").collect()))
    monkeypatch.setattr(warc, "MAX_BROADCAST", 0)
    assert sorted(map(str, warc.assign_records(pages).select("page_id", "digest", "refers_to").collect())) == want
