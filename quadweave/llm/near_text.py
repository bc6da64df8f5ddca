"""Near-duplicate texts: SimHash candidates from sharded BK-trees, confirmed by exact similarity of shingle sets.

Blocks of SimHash bits can't shard such texts: at a Jaccard similarity of 0.8 too many bits differ, and draws of
bits bring random texts together, the more the larger the corpus is. Shards here hold the texts that share one of
DRAWS least shingle hashes, which similar sets do with the probability of their similarity and others don't, so a
text is in as many shards whatever the size of the corpus. A crowded shard is split by one more of the least hashes.

In each shard a BK-tree over 128 fingerprint bits finds the pairs within the radius. Texts that such pairs join,
directly or not, form a cell; a cell's shingle sets meet once in one task, which confirms pairs by exact
similarity. Cells beyond a bound of bytes are confirmed shard by shard, and crowded shards block by block.

Pairs beyond the radius, and pairs that share none of the least hashes, are found by an exact way afterwards: of two
similar sets the first shingles, in any order that all sets share, have one in common (prefixes, Chaudhuri et al. 2006).
Only shingles that sets of different classes have in their prefixes are looked at; their sizes and the parities of
their hashes rule out most pairs without losing one, and the others are compared as sets.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.common import Forest, durable, runs, slices, small_batches, whole_groups
from quadweave.llm.graph import components
from quadweave.llm.simhash import fingerprint, shingle_hashes

#: Least hashes of a text, each by another hash function. A pair at 0.8 shares none of them in one case of 16,000.
DRAWS = 6
#: Least hashes that the key of a shard is made of at most; crowded shards get one more.
DEPTH = 3
#: Members of a shard or block, and shingles of the sets of a cell or block, that one task searches at once.
CROWDED = 4096
SHINGLES = 2_000_000
#: Standard deviations of the number of differing bits that the radius leaves room for.
SLACK = 2.5
#: Keys that are broadcast at most; beyond that the join is shuffled.
MAX_BROADCAST_IDS = 1_000_000
#: Texts of the sample that tells which shingles are frequent, the texts of it from which on one is, and how many are
#: kept. Frequent ones come last in the order of prefixes; which they are changes what is compared, not what is found.
SAMPLE = 20_000
FREQUENT = 3
MAX_FREQUENT = 200_000
#: Bits of the parities of a set's hashes.
PARITIES = 512
LEAF = 256
#: Words of 64 bits that are compared at once when pairs are confirmed.
WORDS_AT_ONCE = 1 << 20
#: Bytes of the bits of one block; sets whose bits would take more are compared one pair at a time.
MAX_BITS = 64 << 20


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def radius_of(similarity: float, bits: int = 128) -> int:
    """The bits in which fingerprints of sets of at least this Jaccard similarity mostly differ at most."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + SLACK * math.sqrt(bits * p * (1 - p)))


def within(fps: np.ndarray, radius: int, side: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All (i, j, distance) with i < j within the radius, in small pieces, by a BK-tree with leaves of up to LEAF values.

    fps: n x 2 words of 64 bits. A node's children are keyed by their distance to its pivot; a child is compared
    with those children only whose edge differs by at most the radius. Of two sides only pairs across are found.
    """

    def across(a: np.ndarray, b: np.ndarray, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for s in range(0, len(a), 256):
            part = a[s : s + 256]
            d = np.bitwise_count(fps[part, None, 0] ^ fps[None, b, 0]).astype(np.int16) + np.bitwise_count(fps[part, None, 1] ^ fps[None, b, 1])
            i, j = np.nonzero(d <= radius)
            if same:
                keep = part[i] < b[j]
                i, j = i[keep], j[keep]
            if len(i):
                x, y = part[i], b[j]
                yield np.minimum(x, y), np.maximum(x, y), d[i, j]

    if side is not None and side.any() and not side.all():
        yield from across(np.flatnonzero(side == 0), np.flatnonzero(side), False)
        return
    todo = [np.arange(len(fps))]
    while todo:
        own = todo.pop()
        if len(own) <= LEAF:
            yield from across(own, own, True)
            continue
        pivot = fps[own[0]]
        edge = np.bitwise_count(fps[own, 0] ^ pivot[0]).astype(np.int16) + np.bitwise_count(fps[own, 1] ^ pivot[1])
        order = own[np.argsort(edge, kind="stable")]
        edge = np.sort(edge, kind="stable")
        kids = [(int(edge[lo]), order[lo:hi]) for lo, hi in zip(*runs(edge), strict=True)]
        if len(kids) == 1:
            yield from across(own, own, True)
            continue
        for e, kid in kids:
            todo.append(kid)
            near = [k for f, k in kids if e < f <= e + radius]
            if near:
                yield from across(kid, np.concatenate(near), False)


def bulk_within(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """within() as three whole arrays."""
    out = list(within(fps, radius))
    z = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else (z, z, z)


class Sets:
    """The sets of one block: exact similarities of many pairs at once, by bits of those members that two sets share."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        _, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        shared = np.flatnonzero(times > 1)  # what is in one set only is in no intersection
        width = -(-max(1, len(shared)) // 64)
        self.bits = None
        if len(sets) * width * 8 <= MAX_BITS:
            number = np.full(len(times), -1, np.int64)
            number[shared] = np.arange(len(shared))
            column = number[place]
            row = np.repeat(np.arange(len(sets)), self.size)
            row, column = row[column >= 0], column[column >= 0]
            self.bits = np.zeros((len(sets), width), np.uint64)
            step = max(1, MAX_BITS // (width * 64))
            for lo in range(0, len(sets), step):
                a, b = np.searchsorted(row, [lo, lo + step])
                plane = np.zeros((min(step, len(sets) - lo), width * 64), bool)
                plane[row[a:b] - lo, column[a:b]] = True
                self.bits[lo : lo + step] = np.packbits(plane, axis=1, bitorder="little").view(np.uint64)

    def similar(self, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the pairs have at least this Jaccard similarity."""
        less, more = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        out = less >= similarity * more
        left = np.flatnonzero(out)
        same = np.zeros(len(left), np.int64)
        if self.bits is None:
            for k, (x, y) in enumerate(zip(i[left].tolist(), j[left].tolist(), strict=True)):
                same[k] = len(np.intersect1d(self.sets[x], self.sets[y], assume_unique=True))
        else:
            step = max(1, WORDS_AT_ONCE // self.bits.shape[1])
            for lo in range(0, len(left), step):
                own = left[lo : lo + step]
                same[lo : lo + step] = np.bitwise_count(self.bits[i[own]] & self.bits[j[own]]).sum(1, dtype=np.int64)
        out[left] = same / (self.size[i[left]] + self.size[j[left]] - same) >= similarity
        return out


def forest(fps: np.ndarray, radius: int, side: np.ndarray, grp: np.ndarray, sets: Sets | None = None, similarity: float = 0.0) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within the radius, and of at least the similarity where sets are given.

    grp: members of one group are joined already, so no pair of them is looked at.
    """
    root = np.unique(grp, return_inverse=True)[1]
    ties = Forest(int(root.max(initial=-1)) + 1)
    label = np.arange(len(ties.up))  # a group's root, kept whole after every piece
    out = []
    for i, j, _ in within(fps, radius, side):
        apart = label[root[i]] != label[root[j]]
        i, j = i[apart], j[apart]
        for s in range(0, len(i), 50_000):
            x, y = i[s : s + 50_000], j[s : s + 50_000]
            if s:
                apart = label[root[x]] != label[root[y]]
                x, y = x[apart], y[apart]
            if sets is not None and len(x):
                held = sets.similar(x, y, similarity)
                x, y = x[held], y[held]
            if not len(x):
                continue
            joined = [(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True) if ties.join(int(root[a]), int(root[b]))]
            if joined:
                out += joined
                label = np.array([ties.root(g) for g in range(len(label))])
    return out


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted hashes, texts) of shingles that several of a sample of the texts (doc_id, h, text) have."""
    step = max(1, docs.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["s"])

    sample = docs.where(F.pmod(F.xxhash64("doc_id", "h"), F.lit(step)) == 0).select("text").mapInArrow(run, "s long")
    often = sample.groupBy("s").count().where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "s").limit(MAX_FREQUENT)
    table = often.toArrow()
    order = np.argsort(hashes := table["s"].to_numpy().view(np.uint64))
    return hashes[order], table["count"].to_numpy()[order]


def prefix(h: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], similarity: float) -> np.ndarray:
    """32 bits of those shingles of a sorted set of which any set of at least the similarity has one in its own prefix."""
    hashes, texts = frequent
    if len(hashes):
        at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        h = h[np.argsort(np.where(hashes[at] == h, texts[at], 0), kind="stable")]
    return (h[: len(h) - math.ceil(similarity * len(h) - 1e-9) + 1] >> np.uint64(32)).astype(np.uint32).view(np.int32)


def parities(h: np.ndarray, least: int = PARITIES) -> np.ndarray:
    """For each of 2 ** k classes of hashes, at least as many and twice the hashes, whether their number is odd: as many
    differ at most as shingles do. Bytes; the halves of a longer value make a shorter one."""
    classes = max(least, 1 << (2 * len(h) - 1).bit_length() if len(h) else 1)
    return np.packbits(np.bincount((h & np.uint64(classes - 1)).astype(np.int64), minlength=classes) & 1)


def folded(odd: np.ndarray, size: int) -> np.ndarray:
    while len(odd) > size:
        odd = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
    return odd


def sketches(docs: DataFrame, words: int, similarity: float = 0.8, frequent: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(doc_id, h, kind, n, f1, f2, mins, prefix, odd, odds) of (doc_id, h, text): kind is equal for equal shingle sets of n
    shingles; f1 and f2 are 128 fingerprint bits of the set; mins are its DRAWS least hashes, null for an empty set;
    prefix and odds are prefix() and parities(), odd the latter in PARITIES bits."""
    frequent = frequent or (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    odd = np.random.default_rng(17).integers(1, 1 << 63, DRAWS, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows, mins, first, signs, short = [], [], [], [], []
            for t in b.column(2):
                h = np.unique(shingle_hashes(t.as_py(), words))
                g = _mix(h)
                rows.append((xxhash.xxh64_intdigest(h.tobytes(), 9), len(h), fingerprint(h), fingerprint(g)))
                mins.append([int((g * m).min()) - (1 << 63) for m in odd] if len(h) else None)
                first.append(prefix(h, frequent, similarity) if len(h) else None)
                signs.append(parities(h))
                short.append(folded(signs[-1], PARITIES // 8).tobytes())
            u = np.array(rows, np.uint64).reshape(len(rows), 4).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(u[:, i]) for i in range(4)], pa.array(mins, pa.list_(pa.int64())), pa.array(first, pa.list_(pa.int32())), pa.array(short, pa.binary()), pa.array([v.tobytes() for v in signs], pa.binary())], ["doc_id", "h", "kind", "n", "f1", "f2", "mins", "prefix", "odd", "odds"])

    return docs.mapInArrow(run, "doc_id long, h long, kind long, n long, f1 long, f2 long, mins array<long>, prefix array<int>, odd binary, odds binary")


def shards(kinds: DataFrame, draws: int = DRAWS, depth: int = DEPTH, crowded: int = CROWDED) -> DataFrame:
    """(kind, f1, f2, shard, parts): the shards of every kind, and the blocks of each shard. Members of a shard share
    one of the least hashes; those of a crowded shard are dealt to shards of one more hash that they share, up to
    depth hashes, beyond which a shard falls into blocks."""
    base = kinds.where("mins is not null").select("kind", "f1", "f2", "mins")
    level = base.select("kind", "f1", "f2", F.posexplode("mins").alias("t", "m")).select("kind", "f1", "f2", F.expr("shiftleft(1, t)").alias("used"), F.xxhash64("t", "m").alias("shard"))
    out = None
    for k in range(1, depth + 1):
        full = durable(level.groupBy("shard").count().where(F.col("count") > crowded).select("shard", F.ceil(F.col("count") / crowded).alias("parts")))
        empty = full.isEmpty()
        split = not empty and k < depth
        plain = level if empty else level.join(full, "shard", "left_anti") if split else level.join(full, "shard", "left")
        plain = plain.select("kind", "f1", "f2", "shard", F.lit(1).cast("long").alias("parts") if empty or split else F.coalesce("parts", F.lit(1)).alias("parts"))
        out = plain if out is None else out.unionByName(plain)
        if not split:
            return out
        deeper = level.join(full, "shard", "left_semi").select("kind", "used").join(base, "kind").withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).where("used & shiftleft(1, t) = 0")
        deeper = deeper.withColumn("used", F.expr("used | shiftleft(1, t)"))
        level = durable(deeper.select("kind", "f1", "f2", "used", F.expr("xxhash64(used, filter(mins, (m, t) -> used & shiftleft(1, t) <> 0))").alias("shard")).distinct())
    return out


def _search(placed: DataFrame, find: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """(links, classes or None) of (kind, f1, f2, shard, parts): find() is given cells of one block of a shard each, with
    cell, side and grp, and then the pairs of blocks of crowded shards, as far as classes are still apart there.

    The members of a shard's largest class stay in their block; only the others visit the other blocks.
    """
    own = placed.withColumn("block", F.pmod(F.xxhash64("kind", "shard"), F.col("parts")))
    cell = lambda b: F.xxhash64("shard", b).alias("cell")
    links = durable(find(own.select("kind", "f1", "f2", cell(F.col("block")), F.lit(0).alias("side"), F.col("kind").alias("grp"))))
    crowded = own.where("parts > 1")
    if crowded.isEmpty():
        return links, None
    stars = durable(components(links))
    held = durable(crowded.join(stars.select(F.col("node").alias("kind"), "root"), "kind", "left").select("kind", "f1", "f2", "shard", "parts", "block", F.coalesce("root", "kind").alias("grp")))
    most = held.groupBy("shard", "grp").count().groupBy("shard").agg(F.max_by("grp", F.struct("count", "grp")).alias("most"), F.count("*").alias("classes"))
    apart = held.join(most.where("classes > 1"), "shard")
    stay = apart.select("kind", "f1", "f2", cell(F.col("block")), F.lit(0).alias("side"), "grp")
    visit = apart.where("grp <> most").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).where("at <> block")
    more = durable(find(stay.unionByName(visit.select("kind", "f1", "f2", cell(F.col("at")), F.lit(1).alias("side"), "grp"))))
    if more.isEmpty():
        return links, stars
    return links.unionByName(more), None


def _cells(rows: DataFrame, radius: int, similarity: float | None = None, whole: bool = False) -> DataFrame:
    """(a, b): the forests of all cells of (kind, cell, side, grp, f1, f2[, s]). whole: each class lies in one cell, and
    b is the class's smallest kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in whole_groups(batches, "cell"):
            kind, side, grp = (pdf[c].to_numpy() for c in ("kind", "side", "grp"))
            fps = pdf[["f1", "f2"]].to_numpy().view(np.uint64)
            out = []
            for lo, hi in zip(*runs(pdf["cell"].to_numpy()), strict=True):
                if hi - lo < 2:
                    continue
                sets = None if similarity is None else Sets(list(pdf["s"].iloc[lo:hi]))
                order = lo + np.argsort(kind[lo:hi], kind="stable") if whole else np.arange(lo, hi)
                pairs = forest(fps[lo:hi], radius, side[lo:hi], grp[lo:hi], sets, similarity or 0.0)
                if whole and pairs:
                    place = np.argsort(order - lo)  # a member's rank by kind
                    ties = Forest(hi - lo)
                    for i, j in pairs:
                        ties.join(int(place[i]), int(place[j]))
                    out += [(kind[order[k]], kind[order[ties.root(k)]]) for k in sorted({int(place[x]) for p in pairs for x in p})]
                elif pairs:
                    out += [(kind[lo + i], kind[lo + j]) for i, j in pairs]
            if out:
                a, b = np.array(out, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def with_keys(rows: DataFrame, keys: DataFrame, on: list[str], how: str, bound: int = MAX_BROADCAST_IDS) -> DataFrame:
    """Join whole texts with a list of keys: broadcast within the bound, so that texts aren't shuffled; else by a shuffle."""
    few = keys.limit(bound + 1).count() <= bound
    return rows.join(F.broadcast(keys) if few else keys.hint("shuffle_merge"), on, how)


def text_key(text_col: str = "text") -> Column:
    """The hash that tells texts of one id apart."""
    return F.xxhash64(F.col(f"`{text_col}`"))


def near_duplicate_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, h, group_id, kept) of every row with an id. group_id is the smallest doc_id that confirmed links and
    equal shingle sets reach; h is the text's hash; kept marks the row of the smallest (doc_id, h) of the group.

    Similarity is the Jaccard similarity of the sets of word shingles (A-Z lowered, white space splits); shorter
    texts are one shingle. Null and blank texts have equal, empty sets and form one group. Rows with a null doc_id
    are left out. Texts that share a doc_id are texts of their own; equal rows are all marked alike. Extra columns
    are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_key(text_col).alias("h"), F.col(f"`{text_col}`").alias("text")).where("doc_id is not null")
    by_doc = durable(sketches(rows, words, similarity, frequent_shingles(rows, words)))
    least = F.min(F.struct("doc_id", "h")).alias("least")
    kinds = durable(by_doc.groupBy("kind").agg(least, *[F.first(c).alias(c) for c in ("n", "f1", "f2", "mins", "odd", "odds")]))
    radius = radius_of(similarity)
    # which texts come near to one another at all, and the cells that they form
    placed = shards(kinds, crowded=CROWDED)
    links, stars = _search(placed, lambda cells: _cells(cells, radius))
    stars = stars or components(links)
    near = durable(stars.select(F.col("node").alias("kind"), F.col("root").alias("cell")).join(kinds.select("kind", "n", "f1", "f2", "least"), "kind"))
    # their sets, each read from one text
    keys = durable(near.select("least.doc_id", "least.h", "kind"))
    repeated = not by_doc.groupBy("doc_id", "h").count().where("count > 1").isEmpty()
    sets = durable(_sets(with_keys(rows, keys, ["doc_id", "h"], "inner"), words, repeated))
    bulk = near.groupBy("cell").agg(F.sum("n").alias("bulk"), F.count("*").alias("members"))
    sized = near.join(bulk, "cell").withColumn("whole", F.expr(f"bulk <= {SHINGLES} and members <= {CROWDED}"))
    ready = sized.where("whole").select("kind", "cell", F.lit(0).alias("side"), F.col("kind").alias("grp"), "f1", "f2")
    named = durable(_cells(ready.join(sets, "kind"), radius, similarity, whole=True)).toDF("node", "root")
    large = durable(sized.where("not whole").select("kind", "n"))
    if not large.isEmpty():
        again = placed.select("kind", "f1", "f2", "shard").join(large, "kind")
        parts = again.groupBy("shard").agg(F.greatest(F.ceil(F.sum("n") / SHINGLES), F.ceil(F.count("*") / CROWDED)).alias("parts"), F.count("*").alias("members")).where("members > 1")
        again = durable(again.join(parts, "shard").select("kind", "f1", "f2", "shard", "parts"))
        named = named.unionByName(components(_search(again, lambda cells: _cells(cells.join(sets, "kind"), radius, similarity))[0]))
    held = durable(kinds.select("kind", "n", "least", "odd").join(named.select(F.col("node").alias("kind"), "root"), "kind", "left").withColumn("root", F.coalesce("root", "kind")))
    rest = _rest(rows, by_doc, kinds, held, words, similarity, repeated)
    if rest is not None:
        held = held.join(components(rest).select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").withColumn("root", F.coalesce("to", "root"))
    named = held.select("kind", "root", "least")
    named = named.join(named.groupBy("root").agg(F.min("least").alias("first")), "root").select("kind", "first")
    classes = kinds.select("kind", "least").join(named, "kind", "left").select("kind", F.coalesce("first", "least").alias("first"))
    out = by_doc.select("doc_id", "h", "kind").join(durable(classes), "kind")
    return out.select("doc_id", "h", F.col("first.doc_id").alias("group_id"), (F.struct("doc_id", "h") == F.col("first")).alias("kept"))


def _rest(rows: DataFrame, by_doc: DataFrame, kinds: DataFrame, held: DataFrame, words: int, similarity: float, repeated: bool) -> DataFrame | None:
    """(a, b): classes (roots of held) that a pair of similar sets joins, every such pair looked at; None without any."""
    one = by_doc.select("doc_id", "h", "kind", "prefix").join(held.select("kind", "root", "least"), "kind").where("struct(doc_id, h) = least")
    tokens = one.select("kind", "root", F.explode("prefix").alias("token"))
    same = Window.partitionBy("token")
    mixed = tokens.withColumns({"lo": F.min("root").over(same), "hi": F.max("root").over(same), "m": F.count("*").over(same)}).where("lo <> hi")
    mixed = durable(mixed.select("token", "kind", "root", F.ceil(F.col("m") / CROWDED).alias("parts")))
    # members of a crowded token in blocks: each pair of blocks is a cell, in which only pairs across are looked at
    block = mixed.withColumn("block", F.pmod(F.xxhash64("kind", "token"), F.col("parts"))).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    cells = block.select("kind", "root", F.xxhash64("token", F.least("block", "with"), F.greatest("block", "with")).alias("cell"), (F.col("block") > F.col("with")).cast("int").alias("side"), (F.col("block") == F.col("with")).alias("own"))
    cells = cells.join(held.select("kind", "n", "odd"), "kind")
    apart = (1 - similarity) / (1 + similarity)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in whole_groups(batches, "cell"):
            kind, root, n, side, own = (pdf[c].to_numpy() for c in ("kind", "root", "n", "side", "own"))
            odd = np.frombuffer(b"".join(pdf["odd"]), np.uint64).reshape(len(pdf), -1)
            out = []
            for lo, hi in zip(*runs(pdf["cell"].to_numpy()), strict=True):
                step = max(1, 100_000 // (hi - lo))
                for s in range(lo, hi, step):
                    i, j = np.nonzero((root[s : min(s + step, hi), None] != root[None, lo:hi]) & (np.arange(s, min(s + step, hi))[:, None] < np.arange(lo, hi)))
                    i, j = i + s, j + lo
                    some = (own[i] | (side[i] != side[j])) & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9)
                    i, j = i[some], j[some]
                    some = np.bitwise_count(odd[i] ^ odd[j]).sum(1, dtype=np.int64) <= apart * (n[i] + n[j]) + 1e-9
                    i, j = i[some], j[some]
                    if len(i):
                        turn = kind[i] > kind[j]
                        i, j = np.where(turn, j, i), np.where(turn, i, j)
                        out.append(np.array([kind[i], kind[j], root[i], root[j]]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(out, axis=1)], ["a", "b", "ra", "rb"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = (b.column("na").to_numpy() + b.column("nb").to_numpy()) * apart + 1e-9
            both = [[np.frombuffer(v.as_py(), np.uint8) for v in b.column(c)] for c in ("oa", "ob")]
            differ = [int(np.bitwise_count(folded(x, len(y)) ^ folded(y, len(x))).sum(dtype=np.int64)) for x, y in zip(*both, strict=True)]
            yield b.select(["a", "b", "ra", "rb"]).filter(pa.array(np.array(differ, np.int64) <= size))

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x, y = b.column("sa"), b.column("sb")
            met = np.array([len(np.intersect1d(u.values.to_numpy(), v.values.to_numpy(), assume_unique=True)) for u, v in zip(x, y, strict=True)], np.int64)
            size = x.value_lengths().to_numpy().astype(np.int64) + y.value_lengths().to_numpy()
            yield b.select(["ra", "rb"]).filter(pa.array(met / (size - met) >= similarity))

    pairs = durable(cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(find, "a long, b long, ra long, rb long").distinct())
    if pairs.isEmpty():
        return None
    # the longer parities before the sets, which are many times their size
    of = kinds.select("kind", "n", "odds")
    pairs = durable(pairs.join(of.toDF("a", "na", "oa"), "a").join(of.toDF("b", "nb", "ob"), "b").mapInArrow(near, "a long, b long, ra long, rb long"))
    if pairs.isEmpty():
        return None
    asked = pairs.select(F.col("a").alias("kind")).unionByName(pairs.select(F.col("b").alias("kind"))).distinct()
    keys = durable(asked.join(held, "kind").select("least.doc_id", "least.h", "kind"))
    sets = durable(_sets(with_keys(rows, keys, ["doc_id", "h"], "inner"), words, repeated))
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("ra", "rb", "sa", "sb")
    links = durable(both.mapInArrow(similar, "ra long, rb long").distinct().toDF("a", "b"))
    return None if links.isEmpty() else links


def _sets(rows: DataFrame, words: int, repeated: bool) -> DataFrame:
    """(kind, s) of (kind, text): the sorted set of shingle hashes, once for each kind. repeated: rows may be equal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], ["kind", "s"])

    made = rows.select("kind", "text").mapInArrow(run, "kind long, s array<long>")
    return made.dropDuplicates(["kind"]) if repeated else made


def one_of_equal_rows(docs: DataFrame, equal: DataFrame, on: list[str]) -> DataFrame:
    """docs with one row for each of the keys of equal; only rows of those keys are shuffled."""
    if equal.isEmpty():
        return docs
    once = with_keys(docs, equal, on, "left_semi").dropDuplicates(on)
    return with_keys(docs, equal, on, "left_anti").unionByName(once)


def drop_near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group: that of the smallest doc_id, of several such rows that of the least hash of its text.

    Rows with a null doc_id stay. Texts that share a doc_id are compared as any others, so that distinct ones stay;
    of equal rows one stays. Columns stay as they are.
    """
    groups = durable(near_duplicate_groups(docs, words, similarity))
    gone = durable(groups.where("not kept").select("doc_id", F.col("h").alias("_h")).distinct())
    equal = durable(groups.where("kept").groupBy("doc_id", F.col("h").alias("_h")).count().where("count > 1").select("doc_id", "_h"))
    out = with_keys(docs.withColumn("_h", text_key()), gone, ["doc_id", "_h"], "left_anti")
    return one_of_equal_rows(out, equal, ["doc_id", "_h"]).select(*docs.columns)
