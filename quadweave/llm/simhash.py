"""SimHash near-duplicates found by BK-trees.

Fingerprints are 64-bit majorities of shingle hashes. Two fingerprints within a small radius agree on at least
one of radius + 1 blocks of their bits, so fingerprints are dealt into shards by (block, value), and each shard's
BK-tree is grown and asked inside the task that holds the shard. The trees are not sent through the driver:
that would collect the fingerprints of all documents. A shard that many fingerprints share is cut again by the
blocks of its other bits, as often as needed, which is exact for the same reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import Forest, durable, one_each, runs, slices, small_batches, whole_groups
from quadweave.llm.graph import components

BITS = 64
#: Rows of one shard from which it is cut into smaller ones.
HOT_SHARD = 2000
#: Bits beside those that a shard agrees on, from which on it can't have more than 2 ** SMALL_BITS members.
SMALL_BITS = 13

_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every word shingle, repeats included; fewer words make one shingle, none make an empty array."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    flat = b" ".join(parts)
    if len(parts) <= words:
        return np.array([h(flat, seed)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(parts) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((h(flat[a:b], seed) for a, b in spans), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; no hashes give zero."""
    n = len(hashes)
    if n == 0:
        return 0
    octets = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    per_byte = np.stack([np.bincount(octets[:, j], minlength=256) for j in range(8)])
    set_bits = (per_byte @ _BYTE_BITS).reshape(BITS) * 2 > n
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


class BKTree:
    """Burkhard-Keller tree of integers under Hamming distance: a child hangs on the edge of its distance."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Insert; an equal value gets no second node. Returns the node."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while True:
            d = (self.values[at] ^ value).bit_count()
            if d == 0:
                return at
            child = self.children[at].get(d)
            if child is None:
                self.values.append(value)
                self.children.append({})
                self.children[at][d] = len(self.values) - 1
                return len(self.values) - 1
            at = child

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, node) of all within the radius; only edges that the triangle inequality allows are followed."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append((d, at))
            for edge, child in self.children[at].items():
                if d - radius <= edge <= d + radius:
                    todo.append(child)
        return found


def fingerprints(docs: DataFrame, words: int = 3, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's 64 bits as a signed long. Null and blank texts have zero."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return one_each(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def block_masks(radius: int, levels: int) -> list[list[tuple[int, list[int]]]]:
    """Per level the (mask of bits that a shard agrees on, bits that are left) of every path of blocks.

    Path p of a level has the paths p * (radius + 1) + i of the next: block i of its bits that are left.
    """
    out = [[(0, list(range(BITS)))]]
    for _ in range(levels):
        row = []
        for mask, rest in out[-1]:
            for part in np.array_split(np.array(rest), radius + 1):
                own = set(part.tolist())
                row.append((mask | sum(1 << x for x in own), [x for x in rest if x not in own]))
        out.append(row)
    return out


def shard_links(distinct_fps: DataFrame, radius: int, hot: int = HOT_SHARD) -> DataFrame:
    """Distinct fp -> (a, b) links within the radius: a spanning forest of each shard, so never all pairs of a group.

    A crowded shard is cut again by blocks of the bits that its members need not agree on, which is exact for the
    same reason, until those are so few that a shard can't be large.
    """
    ways = radius + 1
    levels = 1
    while BITS * (1 - 1 / ways) ** levels > SMALL_BITS and levels < 6:
        levels += 1
    paths = block_masks(radius, levels)
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    level, out = distinct_fps.select("fp", F.lit(0).alias("path")), None
    for k in range(1, levels + 1):
        masks = F.array(*[F.lit(signed(mask)).cast("long") for mask, _ in paths[k]])
        child = level.select("fp", F.explode(F.expr(f"sequence(path * {ways}, path * {ways} + {radius})")).alias("path"))
        placed = child.withColumn("shard", F.xxhash64(F.lit(k), "path", F.col("fp").bitwiseAND(F.get(masks, F.col("path")))))
        # as small as the input / hot; the planner picks the join by its measured size
        crowded = durable(placed.groupBy("shard").count().where(F.col("count") > hot).select("shard")) if k < levels else None
        last = crowded is None or crowded.isEmpty()
        plain = (placed if last else placed.join(crowded, "shard", "left_anti")).select("fp", "shard")
        out = plain if out is None else out.unionByName(plain)
        if last:
            break
        level = durable(placed.join(crowded, "shard", "left_semi").select("fp", "path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in whole_groups(batches, "shard"):
            shard, fps = pdf["shard"].to_numpy(), pdf["fp"].to_numpy()
            one, other = [], []
            for lo, hi in zip(*runs(shard), strict=True):
                if hi - lo < 2:
                    continue
                tree, forest = BKTree(), Forest()
                for value in fps[lo:hi].view(np.uint64).tolist():
                    near = tree.within(value, radius)
                    node = tree.add(value)
                    if node == len(forest.up):
                        forest.add()
                    for _, at in near:
                        if forest.join(node, at):
                            one.append(value)
                            other.append(tree.values[at])
            if one:
                yield pa.RecordBatch.from_arrays([pa.array(np.array(x, np.uint64).view(np.int64)) for x in (one, other)], ["a", "b"])

    return out.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every document.

    fingerprint: 16 hex digits. Fingerprints that differ in at most radius bits are linked; component_id is the
    smallest doc_id reachable. Null texts count as empty and blank ones have fingerprint zero, linked like any
    other. Copies share a fingerprint and are never expanded to pairs. Rows with a null doc_id keep their row and
    are ignored by the minimum (a component of such rows only has a null id). Rows that repeat a doc_id, with the same text or another, keep their
    rows and link by their own texts. Extra columns are ignored; an empty table gives an empty result.
    """
    by_doc = durable(fingerprints(docs, words, text_col, id_col))
    kinds = durable(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")))
    tree = components(shard_links(kinds.select("fp"), radius))
    linked = durable(tree.join(kinds, tree["node"] == kinds["fp"]).select("fp", "root", "least"))
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(roots, "root").select("fp", "component_id")
    # written first, so that the last join is a plain one of two tables whose crowded fingerprints can be split
    classes = durable(kinds.join(named, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id")))
    return by_doc.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
