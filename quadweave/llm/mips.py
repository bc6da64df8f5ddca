"""Exact top-k inner products by norm-bucketed retrieval (Teflioudi et al., LEMP, 2015).

Vectors are sorted by length and cut into buckets. A query's k-th best score so far, divided by its own length and
the bucket's greatest one, is the cosine that a vector of the bucket must reach: if it is over 1 the whole bucket is
skipped; if it is high, partial products over the query's largest coordinates rule vectors out (coordinate pruning);
else vectors are ruled out by their own length (length pruning). What remains is verified by exact products.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.common import durable, runs

#: Vectors in a bucket, vectors of the buckets and queries that one task compares, and the longest vectors that give
#: the first thresholds.
BUCKET = 4096
GROUP = 16_384
QUERY_BLOCK = 16_384
SEEDS = 1024
#: Stands for a null id, behind all others.
NO_ID = int(np.iinfo(np.int64).max)
#: From this cosine on a bucket's vectors are ruled out by coordinates, below it by length.
COORDINATE_COSINE = 0.6
FOCUS = 8


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """(vec_id, v, norm): floor(scale * x) of every component; rows whose vector is null or holds null or non-finite components are left out."""
    e = F.col(f"`{vec_col}`")
    whole = e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(whole).select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v"))
    return rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def exact_products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer products. Doubles are exact while every partial sum stays under 2**53; longs serve beyond that."""
    reach = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    if reach < 2.0**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


class Block:
    """A batch of queries with their running top-k over the buckets that one task sees."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.k = ids, q, k
        self.size = np.sqrt((q.astype(float) ** 2).sum(1))
        self.floor = floor.copy()
        # what already reached the first thresholds is found again in its bucket, so lists start empty
        self.best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def keep(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, v = np.concatenate([self.best[i][0], scores]), np.concatenate([self.best[i][1], ids])
        order = np.lexsort((v, -s))[: self.k]
        self.best[i] = s[order], v[order]
        if len(order) == self.k:
            self.floor[i] = max(self.floor[i], s[order[-1]])

    def bucket(self, ids: np.ndarray, v: np.ndarray, norm: np.ndarray) -> None:
        """v sorted by falling norm. No vector that could reach a query's floor is ruled out; slack covers rounding."""
        top = norm[0] if len(norm) else 0.0
        reach = self.size * top
        active = np.flatnonzero(reach * (1 + 1e-9) + 1e-6 >= self.floor)
        if not len(active):
            return
        need = np.divide(self.floor[active], reach[active], out=np.full(len(active), -1.0), where=reach[active] > 0)
        high = need >= COORDINATE_COSINE
        by_length = active[~high]
        if len(by_length):
            # the least length that any of these queries still needs
            least = np.min(np.divide(self.floor[by_length], self.size[by_length], out=np.full(len(by_length), -np.inf), where=self.size[by_length] > 0))
            n = int(np.searchsorted(-norm, -(least * (1 - 1e-9) - 1e-6), side="right"))
            if n:
                scores = exact_products(self.q[by_length], v[:n])
                for row, i in zip(scores, by_length, strict=True):
                    self.pick(i, row, ids[:n])
        if high.any():
            vf = v.astype(float)
            squares = vf * vf
            for i in active[high]:
                q = self.q[i].astype(float)
                focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
                rest_q = np.sqrt(max(0.0, self.size[i] ** 2 - (q[focus] ** 2).sum()))
                rest_v = np.sqrt(np.maximum(0.0, norm**2 - squares[:, focus].sum(1)))
                bound = vf[:, focus] @ q[focus] + rest_q * rest_v
                left = np.flatnonzero(bound * (1 + 1e-9) + 1e-6 * (1 + np.abs(bound)) >= self.floor[i])
                if len(left):
                    self.pick(i, exact_products(self.q[i : i + 1], v[left])[0], ids[left])

    def pick(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        good = (scores >= self.floor[i]) & (ids != self.ids[i])
        if good.sum() > 4 * self.k:  # ties at the cut stay in
            cut = np.partition(scores[good], -self.k)[-self.k]
            good &= scores >= cut
        if good.any():
            self.keep(i, scores[good], ids[good])


def top_products(vectors: DataFrame, queries: F.Column | str = "vec_id % 100 = 0", k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, query_block: int = QUERY_BLOCK, bucket: int = BUCKET, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k greatest integer inner products with every row but itself.

    queries: a condition over vec_id. Ties go to the smaller vec_id. Vectors of another length than the query's are
    no candidates; null or non-finite ones take no part. "Itself" is by vec_id, so repeated rows of an id are all
    left out of its own list and appear as repeated candidates in others'; of several vectors of one id the smallest
    asks. A null vec_id is a candidate without a place in ties, put last. Products beyond 2**63 are not defined.
    Extra columns are ignored; empty tables give no rows.

    One job compares blocks of queries with groups of buckets; a query goes to those groups only whose greatest
    length can reach its first threshold. The driver holds that length of every group, and SEEDS vectors.
    """
    rows = quantised(vectors, id_col, vec_col, scale)
    rows = rows.withColumn("dim", F.size("v"))
    total = rows.count()
    spark = vectors.sparkSession
    parts = max(1, min(1_000_000, -(-total // group)))
    # lengths are often equal, so the id breaks ties: one hot length spreads over groups too
    kept = durable(rows.repartitionByRange(parts, "dim", F.desc("norm"), F.col("vec_id")).withColumn("grp", F.spark_partition_id()))
    tops: dict[int, list[tuple[int, float]]] = {}
    for d, g, top in kept.groupBy("dim", "grp").agg(F.max("norm")).orderBy("dim", "grp").collect():
        tops.setdefault(d, []).append((g, top))
    seeds: dict[int, list] = {}
    for i, v in kept.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).select("vec_id", "v").collect():
        seeds.setdefault(len(v), []).append((NO_ID if i is None else i, v))
    held = spark.sparkContext.broadcast((tops, {d: (np.array([i for i, _ in s], np.int64), np.array([v for _, v in s], np.int64).reshape(len(s), d)) for d, s in seeds.items()}))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, seeds = held.value
        for b in batches:
            for part, d, ids, q, size in _of_one_length(b, "query_id"):
                floor = np.full(len(ids), -np.inf)
                if d in seeds and len(seeds[d][0]) > k:
                    own, v = seeds[d]
                    s = exact_products(q, v).astype(float)
                    s[own[None, :] == ids[:, None]] = -np.inf
                    floor = np.partition(s, -k, axis=1)[:, -k]
                numbers, greatest = map(np.array, zip(*tops[d], strict=True))
                can = (size[:, None] * greatest[None, :]) * (1 + 1e-9) + 1e-6 >= floor[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(ids), part.column("v"), part.column("norm"), part.column("dim"), pa.array(floor), pa.array([numbers[c].tolist() for c in can], pa.list_(pa.int32()))], ["query_id", "v", "norm", "dim", "floor", "grps"])

    asked = kept.where(queries).where("vec_id is not null").groupBy("vec_id").agg(F.min(F.struct("dim", "v", "norm")).alias("x")).select(F.col("vec_id").alias("query_id"), "x.v", "x.norm", "x.dim")
    asked = durable(asked.mapInArrow(ask, "query_id long, v array<long>, norm double, dim int, floor double, grps array<int>"))
    blocks = max(1, -(-asked.count() // query_block))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block")
    sought = asked.select(F.explode("grps").alias("grp"), block, F.lit(1).alias("asks"), F.col("query_id").alias("vec_id"), "v", "norm", "dim", "floor")
    stored = kept.select("grp", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.lit(0).alias("asks"), "vec_id", "v", "norm", "dim", F.lit(0.0).alias("floor"))
    cells = stored.unionByName(sought).withColumn("cell", F.xxhash64("grp", "block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, lists, lengths = None, {}, {}
        for b in batches:
            cell = b.column("cell").to_numpy()
            for lo, hi in zip(*runs(cell * 2 + b.column("asks").to_numpy()), strict=True):
                own = b.slice(lo, hi - lo)
                if cell[lo] != at:
                    at, lists, lengths = cell[lo], {}, {}
                for part, d, ids, v, norm in _of_one_length(own, "vec_id"):
                    if not own.column("asks")[0].as_py():
                        lists.setdefault(d, []).append((ids, v, norm))
                        continue
                    if d not in lengths:
                        lengths[d] = [np.concatenate(x) for x in zip(*lists.get(d, []), strict=True)]
                    if not lengths[d]:
                        continue
                    asks = Block(ids, v, part.column("floor").to_numpy(), k)
                    for s in range(0, len(lengths[d][0]), bucket):
                        asks.bucket(*[x[s : s + bucket] for x in lengths[d]])
                    out = [(i, s, x) for i, (s, x) in zip(ids, asks.best, strict=True) if len(s)]
                    if out:
                        q = np.repeat([o[0] for o in out], [len(o[1]) for o in out])
                        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(np.concatenate([o[2] for o in out]), pa.int64()), pa.array(np.concatenate([o[1] for o in out]), pa.int64())], ["query_id", "vec_id", "score"])

    found = cells.repartition("cell").sortWithinPartitions("cell", "asks", F.desc("norm"), "vec_id").mapInArrow(run, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    last = F.when(F.col("vec_id") != F.lit(NO_ID), F.col("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), last.alias("vec_id"), "score")


def _of_one_length(b: pa.RecordBatch, id_col: str) -> Iterator[tuple[pa.RecordBatch, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, length, ids, vectors, norms) of each vector length of a batch, in the order of its rows."""
    dims = b.column("dim").to_numpy(zero_copy_only=False)
    for d in np.unique(dims).tolist():
        part = b if len(dims) and (dims == d).all() else b.filter(pa.array(dims == d))
        ids = part.column(id_col).fill_null(NO_ID).to_numpy(zero_copy_only=False)
        yield part, d, ids, part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), d), part.column("norm").to_numpy(zero_copy_only=False)
