import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quadweave.llm import near_text, simhash
from quadweave.llm.graph import components


def slow_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, links):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_fingerprints_match_the_definition(odd_docs):
    got = simhash.simhash_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    want = Counter((r.doc_id, f"{slow_fingerprint(r.text):016x}") for r in odd_docs.collect())
    assert Counter((r.doc_id, r.fingerprint) for r in got) == want


def test_components_match_brute_force(spark):
    random.seed(4)
    base = [random.choices("abcdefghijklmnopqrstuvwxyz", k=60) for _ in range(12)]
    rows = []
    for i in range(150):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 0, 1, 2, 5])):
            w[random.randrange(60)] = random.choice("abcdefghijklmnopqrstuvwxyz") * 2
        rows.append((1000 - i, " ".join(w)))
    rows += [(2000, None), (7, ""), (8, "\t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.simhash_components(df).collect()}
    fp = {i: slow_fingerprint(t) for i, t in rows}
    links = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2]
    assert got == roots(fp, links) and got[2000] == 7


def test_crowded_shards_are_cut_exactly(spark):
    random.seed(6)
    fps = {0x0123456789ABCDEF}
    while len(fps) < 300:
        fps.add(random.choice(list(fps)) ^ (1 << random.randrange(64)))
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    links = [(x, y) for x in fps for y in fps if x < y and (x ^ y).bit_count() <= 2]
    want = roots(fps, links)
    for hot in (2000, 20, 3):
        made = [(a % 2**64, b % 2**64) for a, b in simhash.shard_links(df, 2, hot).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in made)
        assert roots(fps, made) == want


def test_paths_of_blocks_cover_all_bits():
    for radius in (1, 2, 3):
        levels = simhash.block_masks(radius, 3)
        for k, row in enumerate(levels):
            assert len(row) == (radius + 1) ** k
            assert all(mask | sum(1 << b for b in rest) == 2**64 - 1 and mask & sum(1 << b for b in rest) == 0 for mask, rest in row)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 255), min_size=1, max_size=40), st.integers(0, 255), st.integers(0, 8))
def test_tree_finds_all_within_the_radius(values, asked, radius):
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    assert sorted(tree.values[at] for _, at in tree.within(asked, radius)) == sorted({v for v in values if (v ^ asked).bit_count() <= radius})


def test_bulk_tree_matches_all_pairs(monkeypatch):
    monkeypatch.setattr(near_text, "LEAF", 8)
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, (120, 2), dtype=np.uint64)
    fps[60:] = fps[:60] ^ (np.uint64(1) << rng.integers(0, 60, (60, 2)).astype(np.uint64))
    i, j, d = near_text.bulk_within(fps, 40)
    dist = np.bitwise_count(fps[:, None] ^ fps[None]).sum(2)
    want = {(a, b) for a in range(120) for b in range(a + 1, 120) if dist[a, b] <= 40}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and all(dist[a, b] == c for a, b, c in zip(i, j, d, strict=True))


def test_empty_table(no_docs):
    assert simhash.simhash_components(no_docs).count() == 0
    assert near_text.near_duplicate_groups(no_docs).count() == 0
    assert near_text.drop_near_duplicates(no_docs).count() == 0


def near_texts(seed=8, n=200):
    random.seed(seed)
    vocab = [f"w{i}" for i in range(500)]
    base = [random.choices(vocab, k=random.randint(30, 200)) for _ in range(40)]
    rows = []
    for i in range(n):
        w = list(random.choice(base))
        for _ in range(random.choice([0, 1, 1, 2, 3, 6])):
            w[random.randrange(len(w))] = random.choice(vocab)
        rows.append((i, " ".join(w)))
    return rows


def brute_groups(rows):
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in rows}
    j = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    return roots(sets, [(a, b) for a in sets for b in sets if a < b and j(a, b) >= 0.8])


@pytest.mark.parametrize("bounds", [{}, {"CROWDED": 3, "DEPTH": 1}, {"SHINGLES": 300, "CROWDED": 3, "MAX_BITS": 1}])
def test_near_duplicate_groups_match_brute_force(spark, monkeypatch, bounds):
    for name, value in bounds.items():  # crowded shards are split, then cut into blocks; large cells are confirmed by shards
        monkeypatch.setattr(near_text, name, value)
    rows = near_texts()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.group_id for r in near_text.near_duplicate_groups(df).collect()}
    want = brute_groups(rows)
    same = sum(got[i] == want[i] for i in got)
    assert same >= 0.99 * len(got)
    for a in got:  # nothing is joined that isn't linked
        assert want[a] == want[got[a]]


@pytest.mark.parametrize("bounds", [{}, {"CROWDED": 3, "SAMPLE": 20}, {"FREQUENT": 1, "MAX_FREQUENT": 300}])
def test_pairs_that_the_search_misses_are_found(spark, monkeypatch, bounds):
    # one least hash and a radius of 13 bits: most pairs are missed, and the exact way has to find them all
    for name, value in ({"DRAWS": 1, "SLACK": -3.0} | bounds).items():
        monkeypatch.setattr(near_text, name, value)
    common = " ".join(f"every{i}" for i in range(30))
    rows = near_texts() + [(5000 + i, f"{common} " + " ".join(random.Random(i).choices(["p", "q", "r", "s"], k=6))) for i in range(40)]
    got = {r.doc_id: r.group_id for r in near_text.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_groups(rows)


def test_prefixes_of_similar_sets_meet_and_parities_bound_their_difference():
    rng = np.random.default_rng(3)
    for n in [1, 2, 4, 5, 9, 10, 50, 251]:
        for _ in range(40):
            a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
            out = rng.integers(0, n // 9 + 2)
            b = np.unique(np.concatenate([rng.choice(a, max(1, len(a) - out), replace=False), rng.integers(0, 1 << 63, rng.integers(0, n // 9 + 2), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            often = np.unique(rng.choice(np.union1d(a, b), rng.integers(0, len(a) + 1)))
            often = often, rng.integers(1, 4, len(often))
            if both / (len(a) + len(b) - both) >= 0.8:
                assert np.intersect1d(near_text.prefix(a, often, 0.8), near_text.prefix(b, often, 0.8)).size
            x, y = (near_text.parities(v, least=8) for v in (a, b))
            assert np.bitwise_count(near_text.folded(x, len(y)) ^ near_text.folded(y, len(x))).sum() <= len(a) + len(b) - 2 * both
            assert near_text.folded(near_text.parities(a, least=1024), 16).tolist() == near_text.folded(near_text.parities(a, least=128 * 4), 16).tolist()


def test_deeper_shards_and_blocks_lose_no_pair(spark):
    # kinds that share all hashes but one, in turn
    rows = [(k, 0, 0, [k * 100 + t if t == k % 6 else t for t in range(6)]) for k in range(40)]
    kinds = spark.createDataFrame(rows, "kind long, f1 long, f2 long, mins array<long>")
    for crowded, depth in ((100, 3), (10, 1), (10, 3), (2, 3)):
        out = near_text.shards(kinds, depth=depth, crowded=crowded).collect()
        by = {}
        for r in out:
            by.setdefault(r.shard, set()).add(r.kind)
        assert {(a, b) for s in by.values() for a in s for b in s} == {(a, b) for a in range(40) for b in range(40)}
        assert all(r.parts == max(1, -(-len(by[r.shard]) // crowded)) for r in out)


def test_exact_similarities_in_bulk(monkeypatch):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))) for _ in range(80)]
    i, j = map(np.array, zip(*[(a, b) for a in range(80) for b in range(a)], strict=True))
    want = [len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.5 for a, b in zip(i, j, strict=True)]
    for most in (64 << 20, 3000, 1):
        monkeypatch.setattr(near_text, "MAX_BITS", most)
        assert near_text.Sets(sets).similar(i, j, 0.5).tolist() == want


def test_texts_that_share_an_id_are_texts_of_their_own(spark):
    texts = [" ".join(random.Random(i).choices([f"w{j}" for j in range(900)], k=60)) for i in range(4)]
    rows = [(1, texts[0], "x"), (1, texts[1], "x"), (1, texts[1], "x"), (2, texts[1].upper(), "x"), (2, texts[2], "x"), (0, texts[3], "x"), (None, texts[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, h string")
    got = [(r.doc_id, r.text) for r in near_text.drop_near_duplicates(df).collect()]
    assert sorted(got, key=str) == sorted([(1, texts[0]), (1, texts[1]), (2, texts[2]), (0, texts[3]), (None, texts[3])], key=str)


def _three(seed, *swaps):
    """Texts of 94 words that differ from one another in the given places."""
    base = [f"w{seed}x{i}" for i in range(94)]
    return [(n, " ".join(f"{tag}{k}" if k in at else w for k, w in enumerate(base))) for n, (tag, at) in enumerate(swaps)]


def test_a_forest_of_which_nothing_holds_does_not_end_the_search(spark):
    # 0-1 and 1-2 have the nearest sketches and Jaccard 0.78; 0-2 has 0.80
    rows = _three(97, ("x", [20]), ("y", [45, 46]), ("z", [70]))
    got = near_text.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in got} == {0: 0, 1: 1, 2: 0}


def test_the_next_member_is_asked_after_a_rejected_one(spark):
    # 1 and 2 are a group; 1 has the nearer sketch to 0 and Jaccard 0.78, 2 has 0.80
    rows = _three(10, ("x", [20]), ("y", [45, 46]), ("y", [45]))
    got = near_text.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.group_id for r in got} == {0: 0, 1: 0, 2: 0}


def test_one_of_each_group_stays(odd_docs):
    kept = near_text.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x))
    assert ids == [1, 4, 7, 8, 9, 10, 11, None]


def test_component_steps(spark):
    random.seed(2)
    links = [(random.randrange(300), random.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = roots({x for p in real for x in p}, real)
    assert got == want
