"""Dictionary-compressed WARC archives (.warc.zst): written by executors, read back frame by frame.

An archive starts with a skippable frame that holds a Zstandard dictionary built from the archive's own records;
every record then is a frame of its own, so any record can be read alone once the dictionary is known.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.llm.common import durable, shared_dir, slices, small_batches

#: Fixed values of the .warc.zst format.
DICT_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
#: Equal payloads from this size on are stored once.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of a dictionary and of the records that it is built from.
DICT_BYTES = 16 << 10
TRAIN_BYTES = 2 << 20
#: Payload bytes after which a task starts its next archive.
ARCHIVE_BYTES = 64 << 20
#: Digests of repeated payloads that are broadcast at most; beyond that payloads are shuffled to them.
MAX_BROADCAST = 200_000


def _fs(uri: str):
    """(filesystem, path) of a URI; a plain path or file:// is the shared local mount."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" in uri:
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def record_id(page_id: int | None, digest_hex: str) -> str:
    """Of a page's id and payload, so that revisits can name it; a page without an id is never named and gets a new one."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest_hex}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest_hex: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP headers only; they still state the payload's length."""
    digest = base64.b32encode(bytes.fromhex(digest_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest_hex)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest_hex)}", f"X-Refers-To-Page-ID: {refers_to}"]
    block = http if refers_to is not None else http + payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, payload (None for a revisit), and the payload's length and SHA-1; a response's are computed anew."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response":
        if len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload_bytes": stated, "payload_digest": digest, "payload": payload if kind == "response" else None}


def build_dictionary(records: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary from records; too few or too small ones give a plain content dictionary of their bytes."""
    taken, total, samples = max(1, sum(map(len, records)) // TRAIN_BYTES), 0, []
    for r in records[::taken]:
        samples.append(r[: 64 << 10])
        total += len(samples[-1])
        if total >= TRAIN_BYTES:
            break
    try:
        return zstandard.train_dictionary(min(size, max(256, total // 8)), samples, k=256, d=8, steps=1, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def encode_archive(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    """The archive's frames: the dictionary's skippable frame, then one frame per record."""
    raw = build_dictionary(records)
    yield struct.pack("<II", DICT_FRAME, len(raw)) + raw
    packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True)
    for r in records:
        yield packer.compress(r)


def decode_archive(stream) -> Iterator[bytes]:
    """Records of an archive, one frame at a time; only the piece being read is held."""
    head = stream.read(8)
    if len(head) < 8:
        return
    magic, n = struct.unpack("<II", head)
    unpack = zstandard.ZstdDecompressor()
    rest = head
    if magic == DICT_FRAME:
        raw = stream.read(n)
        if raw[:4] == struct.pack("<I", ZSTD_FRAME):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        unpack, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)), b""
    done = False
    while True:
        parts, frame = [], unpack.decompressobj()
        while not frame.eof:
            piece = rest or (b"" if done else stream.read(1 << 20))
            rest = b""
            if not piece:
                if parts or done is None:
                    raise ValueError("an archive is cut short")
                return
            parts.append(frame.decompress(piece))
            rest = frame.unused_data
        yield b"".join(parts)


def _write(folder: str, name: str, records: list[bytes]) -> tuple[str, int, int]:
    """Write under a name of this attempt's own: attempts may hold other rows, and the manifest names those of the one that counts."""
    fs, base = _fs(folder)
    fs.create_dir(base, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}.warc.zst"
    size = 0
    with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
        for frame in encode_archive(records):
            out.write(frame)
            size += len(frame)
    return f"{folder.rstrip('/')}/{name}", len(records), size


def assign_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to): which page stores each payload.

    Of equal payloads of at least REVISIT_BYTES bytes the largest page_id is the response. Rows that repeat that
    page_id with that payload are responses too; groups whose ids are all null have responses only.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    slim = rows.select("page_id", "digest", F.octet_length("payload").alias("n"))
    keepers = slim.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies")).where("copies > 1").select("digest", "keeper")
    keepers = durable(keepers)
    if keepers.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:  # payloads stay where they are
        joined = rows.join(F.broadcast(keepers), "digest", "left")
    else:  # small payloads have no keeper, and many of them can be equal
        large = F.octet_length("payload") >= REVISIT_BYTES
        joined = rows.where(large).join(keepers, "digest", "left").unionByName(rows.where(~large).withColumn("keeper", F.lit(None).cast("long")))
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, **columns: str) -> DataFrame:
    """Write one record per page into archives under folder; returns their manifest (path, records, bytes)."""
    small_batches(pages.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, held, size = TaskContext.get().partitionId(), 0, [], 0
        done: list[tuple] = []
        for b in slices(batches, 200):
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                page_id, url, payload, digest, refers_to = row
                held.append(make_record(page_id, url, payload, refers_to, digest))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    done.append(_write(folder, f"part-{part:06d}-{k:04d}", held))
                    k, held, size = k + 1, [], 0
        if held:
            done.append(_write(folder, f"part-{part:06d}-{k:04d}", held))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], ["path", "records", "bytes"])

    return durable(assign_records(pages, **columns).mapInArrow(run, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records of the archives listed in manifest.path: page_id, url, record_type, refers_to, payload_bytes, payload_digest[, payload]."""
    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"payload_bytes": pa.int64(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                fs, name = _fs(path)
                held, size = [], 0
                with fs.open_input_stream(name, compression=None) as stream:
                    for raw in decode_archive(stream):
                        held.append(parse_record(raw))
                        size += len(raw) if payloads else 200
                        if size > 8 << 20:
                            yield pack(held)
                            held, size = [], 0
                if held:
                    yield pack(held)

    def pack(held: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in held], kinds.get(n, pa.string())) for n in names], names)

    # archives are few and large: deal them evenly rather than by hash of their names
    return manifest.select("path").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism)).mapInArrow(run, schema)


def warc_round_trip(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page as a WARC record, read the archives back, and describe each record.

    Null html is an empty payload; null urls are empty; extra columns are ignored; an empty table gives no rows.
    Rows that repeat a page_id get a record each, with an id of its own unless the payload is the same too; rows
    with a null page_id are never referred to.
    """
    folder = folder or os.path.join(shared_dir(spark), f"warc-{uuid.uuid4().hex}")
    return read_archives(write_archives(pages, folder), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
