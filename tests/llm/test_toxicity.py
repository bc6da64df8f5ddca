import random
import zlib

import numpy as np

from quadweave.llm import toxicity

BAD = ["blorgh", "snarfle", "grumbax", "vexnor", "dralk"]


def corpus(n=900, seed=1):
    random.seed(seed)
    vocab = ["".join(random.choice("aeioubcdfgklmnprst") for _ in range(random.randint(2, 8))) for _ in range(800)]
    rows = []
    for i in range(n):
        w = random.choices(vocab, k=random.randint(20, 120))
        toxic = int(i % 8 == 0)
        for _ in range(3 * toxic):
            w[random.randrange(len(w))] = random.choice(BAD)
        rows.append((i, " ".join(w), toxic))
    return rows


def frames(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1.0, 7) for i, t, _ in rows], "doc_id long, text string, toxic string, score double, h int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i % 2 == 0] + [(None, 1, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_held_out_accuracy(spark):
    rows = corpus()
    docs, labels = frames(spark, rows)
    got = toxicity.score_toxicity(docs, labels).collect()
    truth = {i: y for i, _, y in rows}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in out) >= 0.97 * len(out)
    near = next(r for r in out if r.predicted == 1)
    assert near.evidence and near.evidence[0].toxic == 1 and 0 < near.evidence[0].cosine <= 1 + 1e-9


def test_held_out_labels_are_not_learned(spark):
    rows = corpus(300)
    docs, labels = frames(spark, rows)
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(toxicity.F.col("doc_id")), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a = sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, labels).collect())
    assert a == sorted((r.doc_id, r.score) for r in toxicity.score_toxicity(docs, turned).collect())


def sample_index(n=1500, words=300, seed=2, topics=1):
    rng = np.random.default_rng(seed)
    names = [f"w{i}" for i in range(words)]
    share = 1 / (1 + np.arange(words))  # a few words are in most texts
    per = words // topics  # each text is of one topic, whose words it takes

    def make():
        topic, p = rng.integers(topics), share[:per] / share[:per].sum()
        return {names[topic * per + i]: int(rng.integers(1, 4)) for i in rng.choice(per, rng.integers(3, 40), replace=False, p=p)}

    examples = [(i, int(rng.integers(2)), make()) for i in range(n)]
    df = np.array([sum(w in c for *_, c in examples) for w in names], float)
    weight = toxicity.term_weights(df, n, df / 2, df / 2, n // 2, n - n // 2)
    index = toxicity.Index({w: k for k, w in enumerate(names)}, weight)
    texts = [(np.array([index.at[w] for w in c]), np.array(list(c.values()))) for *_, c in examples]
    return index.build(np.array([i for i, *_ in examples]), np.array([y for _, y, _ in examples]), texts), examples, make


def test_search_is_exact():
    index, examples, make = sample_index()
    assert (index.column >= 0).sum() > 20 and len(index.posts) > 1000  # both kinds of lists are there
    dense = np.zeros((len(examples), len(index.weight)))
    where = {int(i): k for k, i in enumerate(index.ids)}
    for i, _, c in examples:
        at, w = index.vector(c)
        dense[where[i], at] = w
    for _ in range(80):
        at, w = index.vector(make())
        q = np.zeros(len(index.weight))
        q[at] = w
        cos = dense @ q
        want = sorted(((-round(c, 9), k) for k, c in enumerate(cos) if c > 0))[: toxicity.NEIGHBOURS]
        got = index.nearest([(at, w), (at[:0], w[:0])])
        assert np.allclose([s for s, _ in got[0]], [-s for s, _ in want]) and got[1] == []
        assert index.nearest([(at, w)], without=[got[0][0][1]])[0] == index.nearest([(at, w)], toxicity.NEIGHBOURS + 1)[0][1:]


def test_blocks_are_skipped():
    index, examples, _ = sample_index(4000, topics=4)
    index.nearest([index.vector(c) for _, _, c in examples[:200]])
    assert index.blocks_asked < 0.4 * index.blocks_met


def test_like_examples_share_blocks():
    rng = np.random.default_rng(1)
    rows = np.zeros((512, 8))
    kind = rng.integers(0, 4, 512)
    rows[np.arange(512), kind] = 1
    order = toxicity.halves(rows, np.arange(512))
    assert sorted(order.tolist()) == list(range(512))
    assert sum(len(set(kind[order[k : k + 64]].tolist())) for k in range(0, 512, 64)) <= 14


def test_odd_documents_and_no_labels(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score_toxicity(odd_docs, none).collect()
    assert len(got) == odd_docs.count() and {r.predicted for r in got} == {0}
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    some = spark.createDataFrame([(1, 1), (5, 0), (8, 0), (9, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(odd_docs, some).count() == odd_docs.count()
    assert toxicity.score_toxicity(no_docs, some).count() == 0


def test_copies_count_once():
    rows = [(5, 1, 10, 20), (3, 1, 10, 21), (9, 1, 11, 21), (4, 0, 10, 22), (7, 1, 12, 23)]
    assert toxicity.one_of_copies(rows) == [(3, 1), (4, 0), (7, 1)]


def test_every_word_of_the_examples_counts(spark):
    # a word of 4 toxic examples and of no clean one, beside more than 20,000 others
    random.seed(4)
    vocab = ["".join(random.choices("abcdefghijklmnop", k=9)) for _ in range(8000)]
    learned = [i for i in range(700) if zlib.crc32(str(i).encode()) % 5]
    toxic = set(learned[:48])
    docs = [(i, " ".join(random.choices(vocab, k=60) + ["vexnor"] * (i in learned[:4]))) for i in learned]
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in learned], "doc_id long, toxic int")
    index = toxicity.fit(spark.createDataFrame(docs, "doc_id long, text string"), labels)[0].value
    assert set(index.at) == {w for _, t in docs for w in t.split()}
    assert index.weight[index.at["vexnor"]] > 2 * np.log(701 / 5)


def test_a_draw_of_both_labels_stands_for_all(spark):
    rows = corpus(400)
    docs, labels = frames(spark, rows)
    index = toxicity.fit(docs, labels, max_examples=40)[0].value
    assert index.labels.sum() == 20 and len(index.labels) == 40
    assert index.share[0] > 3 * index.share[1] >= 3
    assert abs(index.prior - 1 / 4) < 0.1  # every second row has a label, every eighth is toxic


def test_texts_that_share_an_id(spark):
    rows = corpus(120)
    docs = spark.createDataFrame([(i % 60, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 8 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs.withColumn("h", toxicity.F.length("text")), labels, keep=["h"])
    assert got.count() == 120 and "h" in got.columns
