import math
import random

import numpy as np
import pytest

from quadweave.llm import mips, nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, node int, grp string, v string, norm double, dim int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, "g", "v", 1.0, 2) for i, v, y in rows], SCHEMA)


def sample(n=400, d=16, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((12, d))
    rows = []
    for i in range(n):
        v = rng.standard_normal(d) if i % 3 else centres[rng.integers(12)] + 0.12 * rng.standard_normal(d)
        rows.append((i, [float(np.float32(x)) for x in v / np.linalg.norm(v)], int(rng.integers(3)) if i % 17 else None))
    return rows


ODD = [(9001, None, 1), (9002, [], 1), (9003, [0.0] * 16, 1), (9004, [float("nan")] + [0.1] * 15, 1), (9005, [None] + [0.1] * 15, 1), (9006, [float("inf")] + [0.1] * 15, 1), (9007, [0.5] * 3, 1), (9008, [1.0] * 16, 2), (9009, [1.0] * 16, 2), (9010, [2.0] * 16, 2), (None, [1.0] * 16, 2)]


def good(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows):
    ok = [i for i, (_, v, y) in enumerate(rows) if y is not None and good(v) and any(v)]
    links = []
    for a in range(len(ok)):
        for b in range(a):
            (_, u, x), (_, v, y) = rows[ok[a]], rows[ok[b]]
            if x == y and len(u) == len(v):
                p, q = np.array(u, float), np.array(v, float)
                if p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.93:
                    links.append((ok[a], ok[b]))
    return links


def brute_components(rows):
    links = brute_links(rows)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    n = [0] * len(rows)
    for a, b in links:
        n[a] += 1
        n[b] += 1
        up[root(a)] = root(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(rows[i][0])
    least = [min((x for x in groups[root(i)] if x is not None), default=None) for i in range(len(rows))]
    return sorted(((rows[i][0], n[i], least[i], rows[i][0] is not None and rows[i][0] == least[i]) for i in range(len(rows))), key=str)


def test_links_match_brute_force(spark):
    rows = sample() + ODD
    got = nn_descent.near_duplicate_vectors(table(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute_components(rows)
    assert min(r.audit_recall for r in got) >= 0.9


def test_a_large_clique_and_copies(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal(16)
    rows = [(i, [float(x) for x in (centre + 0.05 * rng.standard_normal(16)).astype(np.float32)], 1) for i in range(1100)]
    rows += [(5000 + i, rows[0][1], 1) for i in range(30)]
    got = {r.vec_id: r for r in nn_descent.near_duplicate_vectors(table(spark, rows)).collect()}
    m = np.array([r[1] for r in rows], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    n = ((m @ m.T) >= 0.93).sum(1) - 1
    assert all(got[r[0]].n_links == k and got[r[0]].component_id == 0 for r, k in zip(rows, n, strict=True))


def test_no_vectors(spark):
    empty = table(spark, sample(5)).where("false")
    assert nn_descent.near_duplicate_vectors(empty).count() == 0
    assert mips.top_products(empty).count() == 0
    assert nn_descent.near_duplicate_vectors(table(spark, ODD[:6])).where("n_links > 0").count() == 0


def test_audits_ask_other_probes_and_low_recall_ends_in_a_full_comparison(spark, monkeypatch):
    rows = sample(300)
    df = table(spark, rows)
    monkeypatch.setattr(nn_descent, "MAX_ROUNDS", 3)
    audits, audit, nothing = [], nn_descent.audit, lambda *a, **b: spark.createDataFrame([], "a long, b long, cos double")

    def kept(*a, **b):
        audits.append(audit(*a, probes=20, **b))
        return audits[-1]

    # a graph that finds no link: what an audit added must not count as found by the next
    monkeypatch.setattr(nn_descent, "first_graph", nothing)
    monkeypatch.setattr(nn_descent, "join_round", nothing)
    monkeypatch.setattr(nn_descent, "audit", kept)
    got = nn_descent.near_duplicate_vectors(df).collect()
    assert len(audits) == nn_descent.MAX_ROUNDS
    probes = [r.node for r in audits[-1][2].collect()]
    assert len(probes) == len(set(probes)) == 20 * nn_descent.MAX_ROUNDS
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == brute_components(rows)
    assert {r.audit_recall for r in got} == {1.0}


def test_rounds_go_on_until_an_audit_passes(spark, monkeypatch):
    rounds, join = [], nn_descent.join_round
    monkeypatch.setattr(nn_descent, "first_graph", lambda nodes, k, seed, first=nn_descent.first_graph: first(nodes, 2, 1, 4, seed))
    monkeypatch.setattr(nn_descent, "join_round", lambda *a: rounds.append(1) or join(*a))
    rows = sample(300)
    got = nn_descent.near_duplicate_vectors(table(spark, rows), k=2).collect()
    assert len(rounds) > 1
    want = brute_components(rows)
    assert sum(x == y for x, y in zip(sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str), want, strict=True)) >= 0.98 * len(want)


def test_isolated_pairs_are_found_and_the_audit_says_so(spark):
    rng = np.random.default_rng(8)
    a = rng.standard_normal((10_000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    e = rng.standard_normal((10_000, 64))
    e -= (e * a).sum(1)[:, None] * a
    e /= np.linalg.norm(e, axis=1)[:, None]
    t = np.arccos(rng.uniform(0.932, 0.96, 10_000))[:, None]
    both = np.concatenate([a, np.cos(t) * a + np.sin(t) * e])
    rows = [(i, v, 1) for i, v in enumerate(both.tolist())]
    got = {r.vec_id: r for r in nn_descent.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    found = sum(got[i + 10_000].component_id == i for i in range(10_000)) / 10_000
    assert found >= 0.985
    assert abs(got[0].audit_recall - found) <= 0.01


@pytest.mark.parametrize("noise", [0.004, 0.05, 0.3])
def test_cells_decide_every_pair(spark, noise):
    # tight clusters, a chain, and one where most pairs must be compared
    rng = np.random.default_rng(2)
    t = np.linspace(0, 2, 700)[:, None]
    chain = np.concatenate([np.cos(t), np.sin(t), np.zeros((700, 6))], 1) + noise / 4 * rng.standard_normal((700, 8))
    ball = rng.standard_normal(8) + noise * rng.standard_normal((500, 8))
    rows = [(i, [float(x) for x in np.float32(v)], 1 + (i >= 700)) for i, v in enumerate(np.concatenate([chain, ball]))]
    nodes = spark.createDataFrame([(i, v, 1 + i % 3) for i, v, _ in rows], "node long, v array<float>, copies long")
    stars = spark.createDataFrame([(i, 0 if y == 1 else 700) for i, _, y in rows], "node long, root long")
    m = np.array([v for _, v, _ in rows], float)
    m /= np.linalg.norm(m, axis=1)[:, None]
    copies = np.array([1 + i % 3 for i in range(1200)])
    linked = (m @ m.T >= 0.93) & (np.arange(1200)[:, None] // 700 == np.arange(1200)[None, :] // 700)
    np.fill_diagonal(linked, False)
    got = {}
    for r in nn_descent.complete(nodes, stars, 0.93, block=64, per_leader=16).collect():
        got[r.node] = r.links
    assert [got.get(i, 0) for i in range(1200)] == (linked @ copies).tolist()


def brute_top(rows, k, every):
    vs = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in vs:
        if i is None or i % every:
            continue
        s = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j) for j, v in vs if j != i and len(v) == len(q)))[:k]
        out += [(i, r + 1, j, -x) for r, (x, _, j) in enumerate(s)]
    return sorted(out)


def lists(df):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("settings", [{}, {"bucket": 16, "query_block": 3, "group": 64}])
def test_top_lists_match_brute_force(spark, settings):
    random.seed(2)
    rows = [(i, [x * random.choice([0.2, 1, 3]) for x in v], y) for i, v, y in sample(300)] + [(i, v, y) for i, v, y in ODD if i]
    assert lists(mips.top_products(table(spark, rows), "vec_id % 10 = 0", **settings)) == brute_top(rows, 10, 10)


def test_ties_and_few_rows(spark):
    rows = [(i, [0.5, 0.25], 0) for i in range(30)] + [(100, [0.5], 0)]
    assert lists(mips.top_products(table(spark, rows), "vec_id % 10 = 0", 4)) == brute_top(rows, 4, 10)
    assert lists(mips.top_products(table(spark, rows[:3]), "vec_id % 10 = 0", 10)) == brute_top(rows[:3], 10, 10)


def test_of_repeated_ids_the_smallest_vector_asks(spark):
    rows = [(0, [0.5, 0.5], 1), (0, [0.25, 1.0], 1), (0, [-0.5, 0.5], 1), (1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1)]
    got = lists(mips.top_products(table(spark, rows).repartition(3), "vec_id = 0"))
    assert got == [(0, 1, 1, 512 * 1024), (0, 2, 2, 512 * 1024), (0, 3, 1, -512 * 1024)]


def test_both_prunings_are_used_and_exact():
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(32)
    near = centre + 0.02 * rng.standard_normal((200, 32))
    v = np.floor(1024 * np.concatenate([near / np.linalg.norm(near, axis=1)[:, None], rng.standard_normal((800, 32)) * rng.uniform(0.01, 0.2, (800, 1))])).astype(np.int64)
    norm = np.sqrt((v.astype(float) ** 2).sum(1))
    order = np.argsort(-norm, kind="stable")
    v, norm, ids = v[order], norm[order], order
    q = v[[0, 5, 900]]
    block = mips.Block(ids[[0, 5, 900]], q, np.full(3, -np.inf), 10)
    for s in range(0, 1000, 250):
        block.bucket(ids[s : s + 250], v[s : s + 250], norm[s : s + 250])
    for i, asked in enumerate(ids[[0, 5, 900]]):
        scores = q[i] @ v.T
        want = sorted((-int(x), int(j)) for x, j in zip(scores, ids, strict=True) if j != asked)[:10]
        assert [(-int(s), int(j)) for s, j in zip(*block.best[i], strict=True)] == want


def test_large_components_use_integers():
    q = np.array([[1 << 30, -3]], np.int64)
    assert mips.exact_products(q, np.array([[(1 << 30) + 1, 7]], np.int64))[0, 0] == (1 << 30) * ((1 << 30) + 1) - 21
