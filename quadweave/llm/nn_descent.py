"""Near-duplicate embeddings by NN-descent (Dong et al., 2011) over equal labels.

Every round brings vectors together that are neighbours in fresh random orders, joins the neighbours of every node
with one another and keeps the best of each list. An audit with probes that no audit asked before then compares them
with all vectors; rounds go on, with longer lists, until it finds nearly all of their links in the graph. Links that
an audit supplied never count as found. Lists that are saturated, being full of links, are enlarged to all members of
their component: counted exactly, cell by cell around leaders, where angles to the leaders decide most pairs of tight
or long components unseen. If the rounds end below the asked recall, all vectors are compared in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.llm.common import Forest, durable, runs, whole_groups
from quadweave.llm.graph import components

#: First length of neighbour lists, orders of a round, rows of a block of an order, members of a completion block,
#: probes among all nodes and among those with links, rounds.
NEIGHBOURS = 10
ORDERS = 6
WINDOW = 256
BLOCK = 512
PROBES = 1024
MAX_ROUNDS = 8
#: The recall that the audit asks for.
RECALL = 0.99
#: Members of a large component for each of its leaders, and leaders of all components that are broadcast at most.
PER_LEADER = 128
MAX_LEADERS = 50_000
#: What rounding may add to an angle.
MARGIN = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _matrix(col) -> np.ndarray:
    """List column (Arrow or pandas) of equal lengths as a matrix."""
    return np.array(list(col), dtype=np.float64)


def _edges(a, b, c) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.float64())], ["a", "b", "cos"])


_EDGE = "a long, b long, cos double"


def nodes_of(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """(all rows, nodes): equal vectors of equal labels are one node (node, grp, v, copies, least).

    grp is the label and the vector's length: vectors of other lengths have no cosine. Rows that link with nothing
    are in the first table only.
    """
    e = F.col(f"`{vec_col}`")
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), e.alias("v"), F.col(f"`{label_col}`").cast("string").alias("label"))
    v = F.col("v")
    good = v.isNotNull() & F.col("label").isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = rows.withColumn("good", F.coalesce(good, F.lit(False))).withColumn("grp", F.when(F.col("good"), F.concat_ws("|", "label", F.size("v").cast("string"))))
    nodes = rows.where("good").groupBy("grp", "v").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    # numbers are fixed by the checkpoint that they are written to
    return rows, durable(nodes.withColumn("node", F.monotonically_increasing_id()))


def first_graph(nodes: DataFrame, k: int, orders: int = ORDERS, window: int = WINDOW, seed: int = 5) -> DataFrame:
    """Links between vectors that stand near one another in the order of a signature; several orders, overlapping blocks."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            pdf = b.to_pandas()
            if len(pdf):
                size = pdf["v"].map(len).to_numpy()
                sig = np.zeros((len(pdf), orders), np.int64)
                for d in np.unique(size).tolist():
                    at = np.flatnonzero(size == d)
                    if d not in planes:
                        planes[d] = np.random.default_rng(seed).standard_normal((d, 62 * orders))
                    bits = (_matrix(pdf["v"].iloc[at]) @ planes[d] > 0).reshape(len(at), orders, 62)
                    sig[at] = (bits.astype(np.int64) << np.arange(61, -1, -1)).sum(2)
                yield pa.RecordBatch.from_arrays([pa.array(pdf["node"].to_numpy()), pa.array(sig.tolist(), pa.list_(pa.int64()))], ["node", "sigs"])

    signed = nodes.select("node", "v").mapInArrow(sign, "node long, sigs array<long>").select("node", F.posexplode("sigs").alias("t", "sig"))
    rows = nodes.select("node", "grp", "v").join(signed, "node").select("t", "grp", "sig", "node", "v")
    parts = max(2, nodes.sparkSession.sparkContext.defaultParallelism)
    ordered = rows.repartitionByRange(max(parts, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "t", "grp", "sig", "node").sortWithinPartitions("t", "grp", "sig", "node")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        tail = None
        for b in batches:
            pdf = b.to_pandas()
            if tail is not None:  # blocks overlap across batches
                pdf = pd.concat([tail, pdf], ignore_index=True)
            tail = pdf.iloc[-(window // 2) :]
            key = pd.factorize(pdf["t"].astype(str) + "|" + pdf["grp"])[0] if len(pdf) else np.zeros(0, int)
            for lo, hi in zip(*runs(key), strict=True):
                if hi - lo < 2:
                    continue
                unit, node = _unit(_matrix(pdf["v"].iloc[lo:hi])), pdf["node"].to_numpy()[lo:hi]
                out_a, out_b, out_c = [], [], []
                for s in range(0, max(1, hi - lo - window // 2), window // 2):
                    u, n = unit[s : s + window], node[s : s + window]
                    cos = u @ u.T
                    np.fill_diagonal(cos, -2)
                    cos[n[:, None] == n[None, :]] = -2
                    m = min(k, len(n) - 1)
                    if m < 1:
                        continue
                    near = np.argpartition(-cos, m - 1, axis=1)[:, :m]
                    c = np.take_along_axis(cos, near, 1)
                    out_a.append(np.repeat(n, m))
                    out_b.append(n[near].ravel())
                    out_c.append(c.ravel())
                if out_a:
                    c = np.concatenate(out_c)
                    yield _edges(np.concatenate(out_a)[c > -2], np.concatenate(out_b)[c > -2], c[c > -2])

    return ordered.mapInArrow(link, _EDGE)


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest of every node; ties go to the smaller node. A pair is new only if all its mentions are."""
    once = edges.groupBy("a", "b").agg(F.max("cos").alias("cos"), F.min("new").alias("new"))
    w = Window.partitionBy("a").orderBy(F.desc("cos"), "b")
    return once.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def join_round(nodes: DataFrame, graph: DataFrame, k: int) -> DataFrame:
    """Neighbours of neighbours: for every node, compare those on its list and those that list it, where one is new."""
    low = graph.groupBy("a").agg(F.when(F.count("*") >= k, F.min("cos")).alias("low"))
    fwd = graph.select(F.col("a").alias("p"), F.col("b").alias("n"), "new")
    back = graph.select(F.col("b").alias("p"), F.col("a").alias("n"), "new")
    # of the lists that name a node as many are drawn at random as a list is long; others come in later rounds
    w = Window.partitionBy("p").orderBy(F.desc("new"), F.xxhash64("p", "n"))
    back = back.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
    around = fwd.unionByName(back).groupBy("p", "n").agg(F.max("new").alias("new"))
    active = around.where("new").select("p").distinct()
    full = around.join(active, "p").join(nodes.select(F.col("node").alias("n"), "v"), "n").join(low.select(F.col("a").alias("n"), "low"), "n", "left")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in whole_groups(batches, "p"):
            p = pdf["p"].to_numpy()
            node, new = pdf["n"].to_numpy(), pdf["new"].to_numpy()
            low_of = pdf["low"].fillna(-2.0).to_numpy()
            unit = _unit(_matrix(pdf["v"]))
            out: list[tuple] = []
            for lo, hi in zip(*runs(p), strict=True):
                if hi - lo < 2:
                    continue
                u = unit[lo:hi]
                cos = u @ u.T
                np.fill_diagonal(cos, -3)
                ok = (new[lo:hi, None] | new[None, lo:hi]) & (cos > low_of[lo:hi, None])
                i, j = np.nonzero(ok)
                out.append((node[lo + i], node[lo + j], cos[i, j]))
            if out:
                yield _edges(*[np.concatenate(x) for x in zip(*out, strict=True)])

    return full.select("p", "n", "new", "v", "low").repartition("p").sortWithinPartitions("p").mapInArrow(local, _EDGE)


def complete(nodes: DataFrame, stars: DataFrame, threshold: float, block: int = BLOCK, per_leader: int = PER_LEADER) -> DataFrame:
    """(node, links): how many rows every node of a component links with, its copies left out; all pairs are decided.

    Members of a large component go to their nearest leader. With angles D between two leaders and r to their
    farthest members, all pairs of two cells are links if D + r + r is within the threshold's angle, and none is if
    D - r - r is beyond it; only the other pairs of cells are compared.
    """
    members = stars.join(nodes.select("node", "v", "copies"), "node")
    sizes = durable(stars.groupBy("root").agg(F.count("*").alias("m")))
    small = members.join(sizes.where(F.col("m") <= block), "root").select("node", "v", "copies", F.lit(0).alias("side"), F.xxhash64("root").alias("cell"))
    counted = _count_cells(small, threshold, block)
    large = sizes.where(F.col("m") > block)
    total = large.agg(F.sum("m")).first()[0]
    if not total:
        return counted
    large = durable(members.join(large, "root"))
    every = max(per_leader, -(-2 * total // MAX_LEADERS))
    drawn = large.where((F.col("node") == F.col("root")) | (F.pmod(F.xxhash64("node", F.lit(13)), F.lit(every)) == 0)).select("root", "node", "v")
    leaders: dict[int, list] = {}
    for root, node, v in drawn.collect():  # bounded by MAX_LEADERS and the number of large components
        leaders.setdefault(root, []).append((node, v))
    held = nodes.sparkSession.sparkContext.broadcast({r: (np.array([x[0] for x in own]), _unit(_matrix([x[1] for x in own]))) for r, own in leaders.items()})
    least = float(np.arccos(min(1.0, threshold)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pdf = b.to_pandas()
            lead, angle = np.zeros(len(pdf), np.int64), np.zeros(len(pdf))
            for root, own in pdf.groupby("root"):
                names, units = held.value[root]
                unit = _unit(_matrix(own["v"]))
                for k in range(0, len(own), 1024):
                    cos = unit[k : k + 1024] @ units.T
                    near = cos.argmax(1)
                    at = own.index.to_numpy()[k : k + 1024]
                    lead[at], angle[at] = names[near], np.arccos(np.clip(cos.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), pa.array(lead), pa.array(angle)], ["node", "root", "lead", "angle"])

    placed = durable(large.select("node", "root", "v").mapInArrow(assign, "node long, root long, lead long, angle double"))
    cells = durable(placed.join(nodes.select("node", "copies"), "node").groupBy("root", "lead").agg(F.max("angle").alias("r"), F.sum("copies").alias("rows")))
    radius = {x[0]: x[1] for x in cells.select("lead", "r").collect()}  # one row for each leader
    reach = nodes.sparkSession.sparkContext.broadcast(radius)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for root, lead in zip(b.column("root").to_pylist(), b.column("lead").to_pylist(), strict=True):
                names, units = held.value[root]
                r = np.array([reach.value.get(x, -1.0) for x in names.tolist()])
                me = int(np.flatnonzero(names == lead)[0])
                apart = np.arccos(np.clip(units @ units[me], -1, 1))
                apart[me] = 0.0
                some = (r >= 0) & (apart - r - r[me] <= least + MARGIN)
                all_of = some & (apart + r + r[me] <= least - MARGIN)
                other = np.flatnonzero(some)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(other), lead)), pa.array(names[other]), pa.array(all_of[other])], ["lead", "other", "whole"])

    pairs = durable(cells.select("root", "lead").mapInArrow(decide, "lead long, other long, whole boolean"))
    rows_of = cells.select(F.col("lead").alias("other"), "rows")
    bulk = pairs.where("whole").join(rows_of, "other").groupBy("lead").agg(F.sum("rows").alias("rows"), F.max((F.col("lead") == F.col("other")).cast("int")).alias("own"))
    in_bulk = placed.join(bulk, "lead").join(nodes.select("node", "copies"), "node").select("node", (F.col("rows") - F.col("own") * F.col("copies")).alias("links"))
    # each pair of cells is compared once, where the members of both meet
    seen = pairs.where("not whole").select("lead", F.least("lead", "other").alias("x"), F.greatest("lead", "other").alias("y"))
    members = placed.select("node", "lead").join(nodes.select("node", "v", "copies"), "node")
    compared = members.join(seen, "lead").select("node", "v", "copies", (F.col("lead") != F.col("x")).cast("int").alias("side"), F.xxhash64("x", "y").alias("cell"))
    return counted.unionByName(in_bulk).unionByName(_count_cells(compared, threshold, block)).groupBy("node").agg(F.sum("links").alias("links"))


def _count_cells(cells: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, links) of (node, v, copies, side, cell): links of every node inside its cell; of two sides only across."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in whole_groups(batches, "cell"):
            cell, node, side, copies = (pdf[c].to_numpy() for c in ("cell", "node", "side", "copies"))
            got = np.zeros(len(pdf), np.int64)
            for lo, hi in zip(*runs(cell), strict=True):
                u, s, c = _unit(_matrix(pdf["v"].iloc[lo:hi])), side[lo:hi], copies[lo:hi]
                two = s.min() != s.max()
                for k in range(0, hi - lo, block):
                    linked = u[k : k + block] @ u.T >= threshold
                    if two:
                        linked &= s[k : k + block, None] != s[None, :]
                    at = np.arange(len(linked))
                    linked[at, k + at] = False
                    got[lo + k : lo + k + len(linked)] = linked @ c
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(got)], ["node", "links"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(count, "node long, links long")


def every_link(nodes: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b): all vectors of a label compared in pairs of blocks; of each pair of blocks a spanning forest of its links."""
    sizes = nodes.groupBy("grp").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("nb"))
    placed = nodes.select("grp", "node", "v").join(sizes, "grp").withColumn("i", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    cells = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    cells = cells.select("node", "v", F.xxhash64("grp", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "grp")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in whole_groups(batches, "cell"):
            node, cell = pdf["node"].to_numpy(), pdf["cell"].to_numpy()
            for lo, hi in zip(*runs(cell), strict=True):
                for _, own in pdf.iloc[lo:hi].groupby("grp"):  # cells of two labels could share a hash
                    at = own.index.to_numpy()
                    u = _unit(_matrix(own["v"]))
                    i, j = np.nonzero(np.triu(u @ u.T >= threshold, 1))
                    ties = Forest(len(at))
                    keep = [k for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)) if ties.join(x, y)]
                    a, b = node[at[i[keep]]], node[at[j[keep]]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(link, "a long, b long").distinct()


def audit(nodes: DataFrame, stars: DataFrame, threshold: float, probes: int = PROBES, seed: int = 3, asked: DataFrame | None = None) -> tuple[DataFrame, int, DataFrame]:
    """(missed links (a, b), links seen, probes) of probes against every vector: half of them drawn from nodes with links.

    asked: the probes of earlier audits. They are not drawn again, and their links don't count, as they were added.
    """
    draw = lambda d: d.orderBy(F.xxhash64("node", F.lit(seed)), "node").limit(probes)
    # probes of all nodes show links of small components, those of linked nodes make the share exact where links are rare
    fresh = nodes if asked is None else nodes.join(F.broadcast(asked), "node", "left_anti")
    chosen = draw(fresh).unionByName(draw(fresh.join(stars.select("node"), "node", "left_semi"))).dropDuplicates(["node"]).select("node", "grp", "v").collect()
    held = nodes.sparkSession.sparkContext.broadcast([(r[0], r[1], np.array(r[2], float) / np.sqrt(np.square(np.array(r[2], float)).sum())) for r in chosen])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list] = {}
        for n, g, v in held.value:
            by.setdefault(g, []).append((n, v))
        for b in batches:
            pdf = b.to_pandas()
            for g, own in pdf.groupby("grp"):
                if g not in by:
                    continue
                ids = np.array([x[0] for x in by[g]])
                cos = _unit(_matrix(own["v"])) @ np.stack([x[1] for x in by[g]]).T
                node = own["node"].to_numpy()
                i, j = np.nonzero((cos >= threshold) & (node[:, None] != ids[None, :]))
                if len(i):
                    yield _edges(ids[j], node[i], cos[i, j])

    seen = durable(fresh.select("node", "grp", "v").mapInArrow(run, _EDGE))
    a = stars.select(F.col("node").alias("a"), F.col("root").alias("ra"))
    b = stars.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    missed = durable(seen.join(a, "a", "left").join(b, "b", "left").where("ra is null or rb is null or ra <> rb").select("a", "b", "cos"))
    drawn = nodes.sparkSession.createDataFrame([(r[0],) for r in chosen], "node long")
    return missed, seen.count(), drawn if asked is None else asked.unionByName(drawn)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.93, k: int = NEIGHBOURS, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept, audit_recall) for every row.

    Vectors link at a cosine of at least the threshold if their labels are equal and not null. Rows whose vector is
    null, empty, zero or holds null or non-finite components, or whose label is null, link with nothing. Equal
    vectors are one node and count as links of each other. n_links counts the other rows linked directly;
    component_id is the smallest vec_id reachable; kept marks that row. Rows of repeated ids keep their rows.
    audit_recall is the share of the last audit's links that the graph had before that audit's additions, and 1 if
    all vectors were compared in the end. Of repeated ids every row is a vector of its own. Extra columns are
    ignored. An empty table gives no rows.
    """
    rows, nodes = nodes_of(vectors, id_col, vec_col, label_col)
    both = lambda d: d.select("a", "b", "cos").unionByName(d.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    once = lambda d: d.where(F.col("cos") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    new = lambda d: d.select("a", "b", "cos", F.lit(True).alias("new"))
    graph = links = missed = asked = added = None
    for n in range(MAX_ROUNDS):
        start = durable(first_graph(nodes, k, seed=5 + n))
        more = new(start) if graph is None else graph.unionByName(new(start))
        if missed is not None:  # missed links are new neighbours of both their ends
            more = more.unionByName(new(both(missed)))
        graph = durable(_best(more, k))
        found = durable(join_round(nodes, graph, k))
        seen_links = once(start).unionByName(once(found))
        links = durable((seen_links if links is None else links.unionByName(seen_links)).distinct())
        graph = graph.withColumn("new", F.lit(False)).unionByName(new(found))
        stars = durable(components(links))
        missed, seen, asked = audit(nodes, stars, threshold, seed=3 + n, asked=asked)
        recall = 1.0 if seen == 0 else 1 - missed.count() / seen
        # kept apart from the links that the rounds found, or the next audit would count them as found
        added = once(missed) if added is None else added.unionByName(once(missed))
        if recall >= RECALL:
            if not added.isEmpty():
                stars = durable(components(links.unionByName(added).distinct()))
            break
        k += NEIGHBOURS
    else:  # the rounds ended below the asked recall
        stars, recall = durable(components(links.unionByName(added).unionByName(every_link(nodes, threshold)).distinct())), 1.0
    full = complete(nodes, stars, threshold)
    least = stars.join(nodes.select("node", "least"), "node")
    named = least.join(least.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    per_node = nodes.join(named, "node", "left").join(full, "node", "left").select("grp", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    linked = rows.where("good").join(durable(per_node), ["grp", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"), F.lit(float(recall)).alias("audit_recall"))
