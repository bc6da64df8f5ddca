"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Every word of the examples is a dimension. Its weight is its inverse document frequency, raised where labelled
examples show that it leans towards toxic texts, so that such words decide which examples are near. The index keeps
examples in blocks. Words that many examples have are bounded by their greatest weight in each block; the lists of
the others are read whole. Blocks are then asked in the order of their bounds until none can hold a nearer example.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadweave.llm.common import Forest, durable, one_each, slices, small_batches
from quadweave.llm.simhash import shingle_hashes

#: Bound of the labelled texts that examples are drawn from (by hash, half of them of each label as far as there are),
#: and of the characters of such a text; longer ones are scored like any other, but are no examples.
MAX_EXAMPLES = 5000
MAX_EXAMPLE_CHARS = 1 << 16
#: How much the standard score of a word's log-odds ratio towards toxic examples raises its weight.
LEAN = 1.0
#: Share of the examples from which on a word is bounded by blocks.
FREQUENT = 0.04
#: Examples in a block of the index, blocks that are asked at first, neighbours that vote, and texts searched at a time.
BLOCK = 64
FIRST_BLOCKS = 4
NEIGHBOURS = 15
AT_ONCE = 128
#: Weight of the prior among the votes.
PRIOR_WEIGHT = 0.05
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> Counter:
    """Counts of the lower-cased words of a whole text."""
    return Counter(_WORD.findall((text or "").lower()))


def one_of_copies(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(doc_id, label, key, key) -> (doc_id, label) of one row for each label of rows that share a key, directly or not."""
    forest, seen = Forest(len(rows)), {}
    for n, (_, _, *keys) in enumerate(rows):
        for k, key in enumerate(keys):
            forest.join(n, seen.setdefault((k, key), n))
    firsts: dict[tuple[int, int], int] = {}
    for n, (i, y, *_) in enumerate(rows):
        at = forest.root(n), y
        firsts[at] = min(i, firsts.get(at, i))
    return sorted((i, y) for (_, y), i in firsts.items())


def term_weights(df: np.ndarray, total: int, toxic: np.ndarray, clean: np.ndarray, n1: int, n0: int, lean: float = LEAN) -> np.ndarray:
    """Weight of every word: ln((total + 1) / (df + 1)), the more of it the more the word leans towards toxic examples.

    df of total documents have the word; toxic of n1 and clean of n0 examples have it.
    """
    idf = np.log((total + 1) / (np.minimum(df, total) + 1))
    a, b = toxic + 0.5, clean + 0.5
    a1, b1 = n1 + 1 - a, n0 + 1 - b
    z = (np.log(a / a1) - np.log(b / b1)) / np.sqrt(1 / a + 1 / a1 + 1 / b + 1 / b1)
    return idf * (1 + lean * np.maximum(z, 0))


@dataclass
class Index:
    """Examples as unit TF-IDF vectors, in blocks of like ones.

    dense holds the weights of the frequent words as (example, word, weight), of which matrices() makes a matrix and
    the greatest in each block; the other words have lists of (example, weight), one after the other, from starts[word] on.
    """

    at: dict[str, int]
    weight: np.ndarray
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))
    dense: tuple = (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32), (0, 0))
    column: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))  # of a word among the frequent ones, or -1
    starts: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    posts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    post_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    share: tuple[float, float] = (1.0, 1.0)  # labelled texts that an example of label 0 and of label 1 stands for
    prior: float = 0.1
    empty: float = 0.1
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(0), np.zeros(0))
    blocks_asked: int = 0
    blocks_met: int = 0
    _matrices: tuple[np.ndarray, np.ndarray] | None = None

    def vector(self, counts: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
        """(words, unit weights) of those of the counts that the index knows and that have a weight."""
        known = [(self.at[w], n) for w, n in counts.items() if w in self.at]
        if not known:
            return np.zeros(0, np.int64), np.zeros(0)
        return self.weighed(*map(np.array, zip(*known, strict=True)))

    def weighed(self, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, unit weights) of words that are there n times; those without weight are left out."""
        w = (1 + np.log(n)) * self.weight[at]
        size = np.sqrt((w * w).sum())
        at, w = at[w > 0], w[w > 0]
        return (at, w / size) if len(at) else (at, w)

    def build(self, ids: np.ndarray, labels: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]], frequent: float = FREQUENT) -> Index:
        """texts: the (words, counts) of every example. Weights are kept in single precision."""
        vectors = [self.weighed(*t) for t in texts]
        n, f = len(vectors), len(self.weight)
        size = np.array([len(v[0]) for v in vectors], np.int64)
        row = np.repeat(np.arange(n, dtype=np.int32), size)
        word = np.concatenate([v[0] for v in vectors]).astype(np.int32) if n else np.zeros(0, np.int32)
        value = np.concatenate([v[1] for v in vectors]).astype(np.float32) if n else np.zeros(0, np.float32)
        del vectors
        times = np.bincount(word, minlength=f)
        often = np.flatnonzero(times > max(BLOCK, frequent * n))
        self.column = np.full(f, -1, np.int32)
        self.column[often] = np.arange(len(often))
        inside = self.column[word] >= 0
        common = np.zeros((n, len(often)), np.float32)
        common[row[inside], self.column[word[inside]]] = value[inside]
        order = halves(common, np.arange(n))
        del common
        place = np.argsort(order).astype(np.int32)
        self.ids, self.labels = ids[order].astype(np.int64), labels[order].astype(np.int8)
        self.dense = place[row[inside]], self.column[word[inside]].astype(np.int32), value[inside], (n, len(often))
        row, word, value = place[row[~inside]], word[~inside], value[~inside]
        by_word = np.lexsort((row, word))
        self.posts, self.post_weights = row[by_word], value[by_word]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(word, minlength=f))])
        return self

    def matrices(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights of the frequent words, their greatest in each block), made where the index is used: it travels without."""
        if self._matrices is None:
            row, column, value, shape = self.dense
            common = np.zeros(shape)
            common[row, column] = value
            starts = range(0, shape[0], BLOCK)
            self._matrices = common, np.stack([common[k : k + BLOCK].max(0) for k in starts]) if shape[0] else np.zeros(shape)
        return self._matrices

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_matrices": None}

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], k: int = NEIGHBOURS, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """Of every vector the k examples of greatest cosine over 0, exactly. Ties go to the smaller place in the index.

        The blocks of the greatest bounds are asked first, then those whose bound reaches the k-th best so far. A block
        is read once for all vectors that ask it. without: an example that is left out, for each vector.
        """
        n, m = len(self.ids), len(vectors)
        if not n or not m:
            return [[] for _ in vectors]
        blocks = -(-n // BLOCK)
        frequent, most = self.matrices()
        score, common = np.zeros((m, n)), np.zeros((m, frequent.shape[1]))
        for d, (at, w) in enumerate(vectors):
            column = self.column[at]
            rare = column < 0
            common[d, column[~rare]] = w[~rare]
            lows = self.starts[at[rare]]
            sizes = self.starts[at[rare] + 1] - lows
            if sizes.any():
                read = np.repeat(lows - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                score[d] = np.bincount(self.posts[read], self.post_weights[read] * np.repeat(w[rare], sizes), n)
        bound = np.maximum.reduceat(score, np.arange(0, n, BLOCK), axis=1) + common @ most.T
        first = np.zeros((m, blocks), bool)
        np.put_along_axis(first, np.argpartition(-bound, min(FIRST_BLOCKS, blocks) - 1, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        first &= bound > 0
        whole = np.full((m, n), -1.0)

        def ask(which: np.ndarray) -> None:
            self.blocks_asked += int(which.sum())
            for b in np.flatnonzero(which.any(0)):
                d, own = np.flatnonzero(which[:, b]), slice(b * BLOCK, min(n, (b + 1) * BLOCK))
                whole[d, own] = score[d, own] + common[d] @ frequent[own].T
            if without is not None:
                whole[np.arange(m), without] = -1.0

        ask(first)
        least = np.partition(whole, max(0, n - k), axis=1)[:, max(0, n - k)]
        ask(~first & (bound > 0) & (bound >= least[:, None] - 1e-12))
        self.blocks_met += m * blocks
        out = []
        for d in range(m):
            row = whole[d]
            found = np.flatnonzero(row >= max(least[d], 1e-300))
            best = found[np.lexsort((found, -row[found]))[:k]]
            out.append(list(zip(row[best].tolist(), best.tolist(), strict=True)))
        return out

    def vote(self, found: list[tuple[float, int]]) -> float:
        """The toxic share of the neighbours, by the square of their cosine and by what each stands for."""
        toxic = total = PRIOR_WEIGHT
        toxic *= self.prior
        for s, i in found:
            y = self.labels[i]
            got = s * s * self.share[y]
            total += got
            toxic += got * y
        return toxic / total

    def votes(self, examples: list[tuple[int, int, dict[str, int]]]) -> list[tuple[float, int]]:
        """(vote, label) of examples of the index, each left out in its turn; without those that have no neighbour."""
        place = {(int(i), int(y)): k for k, (i, y) in enumerate(zip(self.ids, self.labels, strict=True))}
        own = [x for x in examples if x[:2] in place]
        every = self.nearest([self.vector(c) for *_, c in own], without=[place[i, y] for i, y, _ in own])
        return [(self.vote(found), y) for found, (_, y, _) in zip(every, own, strict=True) if found]

    def calibrate(self, pairs: list[tuple[float, int]]) -> Index:
        """Isotonic steps from the votes on all examples."""
        pools: list[list[float]] = []  # votes, labels, rows
        for v, y in sorted(pairs):
            u = self.share[y]
            pools.append([v * u, y * u, u])
            while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
                a = pools.pop()
                pools[-1] = [p + q for p, q in zip(pools[-1], a, strict=True)]
        self.steps = (np.array([p[0] / p[2] for p in pools]), np.array([(p[1] + 0.1 * self.prior) / (p[2] + 0.1) for p in pools]))
        return self

    def score(self, texts: list[dict[str, int]]) -> list[tuple[float, list[tuple[float, int]]]]:
        """(calibrated score, neighbours) of every text's counts; one that shares no word with any example has the rate of empty ones."""
        out = []
        for found in self.nearest([self.vector(c) for c in texts]):
            v = self.vote(found)
            out.append((self.empty if not found else float(np.interp(v, *self.steps)) if len(self.steps[0]) else v, found))
        return out


def halves(rows: np.ndarray, own: np.ndarray, size: int = BLOCK) -> np.ndarray:
    """The rows' numbers in an order that keeps like ones together: halved along their leading direction down to a block."""
    done: list[np.ndarray] = []
    todo = [own]
    while todo:
        own = todo.pop()
        if len(own) <= size or rows.shape[1] == 0:
            done.append(own)
            continue
        part = rows[own] - rows[own].mean(0)
        d = np.ones(rows.shape[1]) + np.arange(rows.shape[1]) % 7
        for _ in range(6):
            d = part.T @ (part @ d)
            d /= max(float(np.linalg.norm(d)), 1e-300)
        order = own[np.argsort(part @ d, kind="stable")]
        cut = -(-len(own) // (2 * size)) * size
        todo += [order[cut:], order[:cut]]
    return np.concatenate(done) if done else own


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id's text leaves no remainder by 5; labels of such rows are never learned from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_examples: int = MAX_EXAMPLES) -> tuple[Broadcast, tuple[np.ndarray, np.ndarray]]:
    """(broadcast index, calibration), learned from rows that are labelled and not held out; document frequencies are over all documents."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic") > 0).cast("int").alias("toxic"))
    # one of each text, so that copies don't count as evidence again; then a bounded draw of each label by hash
    texts = rows.where(F.coalesce(F.length("text"), F.lit(0)) <= MAX_EXAMPLE_CHARS).select("doc_id", "h")
    distinct = durable(known.join(texts, "doc_id").groupBy("h", "toxic").agg(F.min("doc_id").alias("doc_id")).groupBy("doc_id", "toxic").agg(F.min("h").alias("h")))
    size = dict(distinct.groupBy("toxic").count().collect())
    ones = min(size.get(1, 0), max(max_examples // 2, max_examples - size.get(0, 0)))
    mine = lambda y, most: distinct.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "h").limit(most)
    drawn = durable(mine(1, ones).unionByName(mine(0, max_examples - ones)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 100):
            out = []
            for i, h, y, t in zip(*[c.to_pylist() for c in b.columns], strict=True):
                s = shingle_hashes(t, 5).view(np.int64)
                k = (int(s.min()), int((s * np.int64(0x1E3779B97F4A7C15)).min())) if len(s) else (0, 0)
                c = words_of(t)
                out.append((i, h, y, *k, list(c), list(c.values())))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "h", "toxic", "k1", "k2", "words", "counts"])

    joined = rows.join(F.broadcast(drawn), ["doc_id", "h"]).select("doc_id", "h", "toxic", "text")
    made = durable(joined.mapInArrow(read, "doc_id long, h long, toxic int, k1 long, k2 long, words array<string>, counts array<long>").dropDuplicates(["doc_id", "h", "toxic"]))
    table = made.toArrow().sort_by("doc_id")  # one row for each example, bounded by max_examples
    # near copies mostly share one of two least shingles; they count once too, or all their words would look toxic
    taken = set(one_of_copies(list(zip(*[table[n].to_pylist() for n in ("doc_id", "toxic", "k1", "k2")], strict=True))))
    table = table.filter(pa.array([key in taken for key in zip(table["doc_id"].to_pylist(), table["toxic"].to_pylist(), strict=True)], pa.bool_()))
    ids, label = table["doc_id"].to_numpy(), table["toxic"].to_numpy()
    lists, times = table["words"].combine_chunks(), table["counts"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy()) if len(ids) else np.zeros(0, np.int64)
    flat = lists.flatten().dictionary_encode()
    names = flat.dictionary.to_pylist()
    word, times = flat.indices.to_numpy(), times.flatten().to_numpy()
    del table, lists, flat
    n, n1 = len(ids), int(label.sum())
    of = np.repeat(label, sizes)
    a, b = (np.bincount(word[of == y], minlength=len(names)).astype(float) for y in (1, 0))
    at = {w: k for k, w in enumerate(names)}
    held = spark.sparkContext.broadcast(at)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seen, total = held.value, np.zeros(len(held.value) + 1, np.int64), 0
        for batch in slices(batches):
            for t in batch.column(0):
                words = set(_WORD.findall((t.as_py() or "").lower()))
                seen[[at[w] for w in words if w in at]] += 1
            total += batch.num_rows
        seen[-1] = total
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(seen[own])], ["word", "n"])

    counts = rows.select("text").mapInArrow(frequencies, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(names) + 1, np.int64)
    df[counts["word"].to_numpy()] = counts["n"].to_numpy()
    held.destroy()
    prior = (size.get(1, 0) + 0.1) / (sum(size.values()) + 1)
    out = Index(at, term_weights(df[:-1], int(df[-1]), a, b, n1, n - n1), prior=prior)
    out.share = (size.get(0, 0) / max(1, n - n1), size.get(1, 0) / max(1, n1))
    blank = [int(((sizes == 0) & (label == y)).sum()) for y in (0, 1)]
    out.empty = (blank[1] * out.share[1] + prior) / (blank[0] * out.share[0] + blank[1] * out.share[1] + 1)
    ends = np.cumsum(sizes)
    ready = spark.sparkContext.broadcast(out.build(ids, label, [(word[e - k : e], times[e - k : e]) for k, e in zip(sizes, ends, strict=True)]))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, AT_ONCE):
            rows = [(i, y, dict(zip(w, c, strict=True))) for i, y, w, c in zip(*[b.column(n).to_pylist() for n in ("doc_id", "toxic", "words", "counts")], strict=True)]
            got = ready.value.votes(rows)
            yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in got], pa.float64()), pa.array([y for _, y in got], pa.int32())], ["vote", "toxic"])

    voted = made.select("doc_id", "toxic", "words", "counts").mapInArrow(vote, "vote double, toxic int").collect()  # one row for each example
    return ready, out.calibrate([tuple(r) for r in voted]).steps


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", max_examples: int = MAX_EXAMPLES, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) of every whole text, and the columns named by keep.

    evidence: the nearest labelled examples as (doc_id, cosine, label). Null and empty texts, and texts that share
    no word with an example, get the rate of empty examples (the prior, if there are none). Without labels every
    score is the prior. Rows with a null doc_id are scored and count as not held out. Repeated rows give repeated
    results; extra columns are ignored; an empty table gives no rows. Several labels of one doc_id count as toxic if
    one is, and a label holds for every text of its doc_id. The broadcast index is bounded by max_examples texts of
    MAX_EXAMPLE_CHARS characters: it holds all of their words.
    """
    held, steps = fit(docs, labels, text_col, id_col, max_examples)
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        own.steps = steps  # found after the index was sent
        for b in slices(batches, AT_ONCE):
            scores, why = [], []
            for s, found in own.score([words_of(t.as_py()) for t in b.column(1)]):
                scores.append(s)
                why.append([{"doc_id": int(own.ids[i]), "cosine": c, "toxic": int(own.labels[i])} for c, i in found])
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(scores, pa.float64()), pa.array(why, kind), *b.columns[2:]], ["doc_id", "score", "evidence", *keep])

    slim = one_each(docs, id_col, text_col, *keep)
    schema = StructType.fromDDL("doc_id long, score double, evidence array<struct<doc_id long, cosine double, toxic int>>")
    out = slim.mapInArrow(run, StructType([*schema.fields, *slim.schema.fields[2:]]))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence", *keep)
