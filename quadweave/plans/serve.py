"""Answers to tile requests as a pure function of archives: status, headers and body; no server runs here."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
from collections import Counter
from dataclasses import dataclass, field

from quadweave.plans.manifest import tilejson
from quadweave.sources import archive_format as fmt
from quadweave.sources.pmtiles import Archive

ENCODINGS = {fmt.GZIP: "gzip", fmt.BROTLI: "br", fmt.ZSTD: "zstd"}


@dataclass
class Response:
    status: int
    headers: dict[str, str] = field(default_factory=dict)
    body: bytes = b""


@dataclass
class Tilesets:
    """Open archives by name, in the order given."""

    archives: dict[str, Archive]
    token: str | None = None
    origins: tuple[str, ...] = ()
    max_zoom: int = 24
    metrics_on: bool = False
    counts: Counter = field(default_factory=Counter)
    etags: dict[str, str] = field(default_factory=dict)

    @classmethod
    def open(cls, paths: dict[str, str], **settings) -> Tilesets:
        return cls({n: Archive(p) for n, p in paths.items()}, **settings)

    def etag(self, name: str) -> str:
        """From the directory and the size: both change with the content."""
        if name not in self.etags:
            a = self.archives[name]
            h = a.header
            raw = a.read(0, fmt.HEADER_BYTES) + a.read(h.root_offset, h.root_length) + a.read(h.leaf_offset, h.leaf_length) + a.read(h.data_offset, min(h.data_length, 1 << 20)) + str(os.path.getsize(a.path)).encode()
            self.etags[name] = '"' + hashlib.sha256(raw).hexdigest()[:32] + '"'
        return self.etags[name]

    def manifest(self, name: str) -> dict:
        try:
            return json.loads(self.archives[name].metadata())
        except (ValueError, fmt.ArchiveError):
            return {}


def _json(doc: object, status: int = 200) -> Response:
    return Response(status, {"Content-Type": "application/json"}, json.dumps(doc, ensure_ascii=False).encode())


def _number(text: str) -> int | None:
    return int(text) if text.isascii() and text.isdigit() and len(text) < 12 else None


def tile(sets: Tilesets, name: str, z: str, x: str, y: str, if_none_match: str | None = None) -> Response:
    """200 with the stored bytes, 204 if the tile is absent, 304 if the tag matches, 400 for a bad address, 404 for an unknown set."""
    if name not in sets.archives:
        return Response(404)
    zi, xi, yi = _number(z), _number(x), _number(y.removesuffix(".mvt"))
    if zi is None or xi is None or yi is None or zi > sets.max_zoom or xi >= 1 << zi or yi >= 1 << zi:
        return Response(400)
    tag = sets.etag(name)
    if if_none_match == tag:
        return Response(304, {"ETag": tag})
    a = sets.archives[name]
    try:
        body = a.get_tile(zi, xi, yi)
    except fmt.TileNotFound:
        return Response(204)
    except (OSError, fmt.ArchiveError):
        return Response(500)
    headers = {"Content-Type": "application/vnd.mapbox-vector-tile", "Cache-Control": "public, max-age=86400, immutable", "ETag": tag, "Vary": "Accept-Encoding"}
    if a.header.tile_compression in ENCODINGS:
        headers["Content-Encoding"] = ENCODINGS[a.header.tile_compression]
    return Response(200, headers, body)


def _route(sets: Tilesets, path: str, headers: dict[str, str], base_url: str) -> Response:
    parts = [p for p in path.split("?")[0].split("/") if p]
    match parts:
        case ["healthz"]:
            return Response(200, {"Content-Type": "text/plain"}, b"ok")
        case ["metrics"] if sets.metrics_on:
            text = "".join(f'tile_requests_total{{status="{k}"}} {v}\n' for k, v in sorted(sets.counts.items()))
            return Response(200, {"Content-Type": "text/plain"}, text.encode())
        case ["tilesets"]:
            return _json(list(sets.archives))
        case ["tile.json"] if sets.archives:
            name = next(iter(sets.archives))
            return _json(tilejson(sets.manifest(name), f"{base_url}/tiles/{name}/{{z}}/{{x}}/{{y}}"))
        case ["tilesets", name, "tile.json"] if name in sets.archives:
            return _json(tilejson(sets.manifest(name), f"{base_url}/tiles/{name}/{{z}}/{{x}}/{{y}}"))
        case ["tilesets", name, "manifest.json"] if name in sets.archives:
            return _json(sets.manifest(name))
        case ["tiles", name, z, x, y]:
            return tile(sets, name, z, x, y, headers.get("if-none-match"))
    return Response(404)


def respond(sets: Tilesets, path: str, headers: dict[str, str] | None = None, base_url: str = "") -> Response:
    """Answer a GET: a token is compared in constant time; origins are denied unless listed or "*"."""
    own = {k.lower(): v for k, v in (headers or {}).items()}
    if sets.token is not None and path != "/healthz":
        given = own.get("authorization", "").removeprefix("Bearer ")
        if not hmac.compare_digest(given.encode(), sets.token.encode()):
            sets.counts[401] += 1
            return Response(401)
    out = _route(sets, path, own, base_url)
    origin = own.get("origin")
    if origin and ("*" in sets.origins or origin in sets.origins):
        out.headers["Access-Control-Allow-Origin"] = "*" if "*" in sets.origins else origin
    sets.counts[out.status] += 1
    return out
