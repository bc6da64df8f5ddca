import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quadweave.llm import mixing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 6)), min_size=1, max_size=8, unique_by=lambda x: x[0]), st.integers(0, 400))
def test_fit_is_as_near_as_can_be(hist, budget):
    lengths, counts = zip(*hist, strict=True)
    got = mixing.fit_budget(list(lengths), list(counts), budget)
    assert all(0 <= got[n] <= c for n, c in hist)
    have = sum(n * k for n, k in got.items())
    sums = {0}
    for n, c in hist:
        sums = {s + n * k for s in sums for k in range(c + 1)}
    best = min(abs(s - budget) for s in sums)
    assert abs(have - budget) <= best + max(lengths)  # shares are fixed first
    if budget >= sum(n * c for n, c in hist):
        assert have == max(sums)


def test_fit_hits_large_budgets_exactly():
    random.seed(1)
    lengths = sorted(random.sample(range(1, 20_000), 3000))
    counts = [random.randint(1, 50) for _ in lengths]
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    for share in (0.1, 0.5, 0.93):
        got = mixing.fit_budget(lengths, counts, int(total * share))
        assert sum(n * k for n, k in got.items()) == int(total * share)
        assert all(got[n] <= c for n, c in zip(lengths, counts, strict=True))


def water_fill(sizes, weights, share, cap):
    left, targets, active = share * sum(sizes), [0.0] * len(sizes), list(range(len(sizes)))
    while active:
        total = sum(weights[i] for i in active)
        over = [i for i in active if left * weights[i] / total > cap * sizes[i]]
        for i in over or active:
            targets[i] = float(cap * sizes[i]) if over else left * weights[i] / total
        if not over:
            break
        left -= sum(targets[i] for i in over)
        active = [i for i in active if i not in over]
    return targets


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1000, 10, 10], [0, 0], [], [7, 0, 300, 40, 41, 1000, 2, 3]])
def test_targets(spark, sizes):
    names = [f"s{i:02d}" for i in range(len(sizes) - 1)] + [None] * bool(sizes)
    df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, s long")
    got = {r.source: r.t for r in mixing._targets(df, (3, 1, 2), 1.5, 2).collect()}
    want = water_fill(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5, 2)
    assert [got[n] for n in names] == pytest.approx(want)


def test_equal_rows_are_split_exactly(spark):
    docs = [(None, "w w w", "a")] * 301 + [(5, "x y z", "a")] * 200 + [(i, "q r s", "b") for i in range(9)] + [(6, "one", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(5)
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == len(docs)
    check(rows, df.collect())
    again = mixing.mix_sources(df.repartition(3)).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, again), key=str)


def test_fits_beyond_any_table_size():
    # lengths whose sums pass 2**24 words, and long documents only
    lengths = [1_000_003 + 17 * i for i in range(40)]
    got = mixing.fit_budget(lengths, [3] * 40, sum(lengths) + 12345)
    assert abs(sum(n * k for n, k in got.items()) - sum(lengths) - 12345) <= 1_000_003 / 2


def check(rows, docs):
    size = {}
    for d in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        size.setdefault(d.source, []).append(n)
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    targets = dict(zip(order, water_fill([sum(size[s]) for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5, 2), strict=True))
    taken = {}
    for r in rows:
        assert r.source_size == sum(size[r.source]) and r.target == pytest.approx(targets[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        assert abs(taken[s] - targets[s]) <= max(size[s]) / 2 + 1
    return taken


def test_odd_documents(odd_docs, no_docs):
    rows = mixing.mix_sources(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    check(rows, odd_docs.collect())
    assert mixing.mix_sources(no_docs).count() == 0


def test_hot_lengths_and_reruns(spark):
    random.seed(3)
    docs = [(i, " ".join(["w"] * (7 if i % 3 else random.randint(0, 40))), ["x", "y", "z", None, "é"][min(4, i % 9)]) for i in range(4000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    a = mixing.mix_sources(df).collect()
    b = mixing.mix_sources(df.repartition(7)).collect()
    assert sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)
    taken = check(a, df.collect())
    by = {r.source: r.target for r in a}
    assert all(abs(taken[s] - by[s]) <= 1 for s in by)
