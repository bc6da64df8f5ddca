"""Count-only Viterbi over a unigram vocabulary: Aho-Corasick matches, best score and piece count, no pieces kept.

Scores add up in double precision; of equal scores the match that starts earliest wins, an unknown character
scores the least piece less 10 and a run of unknown characters is one piece, or its UTF-8 bytes where the
vocabulary has byte pieces: the rules of the public `tokenizers` library's Unigram model.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadweave.llm.common import one_each, slices, small_batches, tokenizer_path

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Chunks that a worker keeps.
KEPT_CHUNKS = 800_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) in the order of ids, from a .model file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]


class Counter:
    """Piece counts and best scores under a unigram vocabulary."""

    def __init__(self, vocab: list[tuple[str, float]]):
        self.low = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.known = {p: s for p, s in vocab}
        self.by_bytes = all(f"<0x{b:02X}>" in self.known for b in range(256))
        self.auto = ahocorasick.Automaton()
        for p, s in self.known.items():
            if p:
                self.auto.add_word(p, (len(p), s))
        self.auto.make_automaton()
        # pieces never hold the mark after another character: words then count alone, up to sums of doubles,
        # which are exact where scores are whole numbers
        inside = any(SPACE in p.lstrip(SPACE) for p in self.known)
        whole = all(float(s).is_integer() for s in self.known.values())
        self.chunks = re.compile("(?s).+" if inside or not whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.kept: dict[str, tuple[int, float, bool, bool]] = {}

    def viterbi(self, text: str) -> tuple[int, float, bool, bool]:
        """(pieces, score, whether the first and the last piece are unknown); unknown runs are one piece, or bytes.

        Every place carries the best score of the text before it and that path's number of pieces; no path is kept.
        """
        n = len(text)
        best: list[float] = [0.0] * (n + 1)
        pieces: list[int] = [0] * (n + 1)
        hits: dict[int, list[tuple[int, float]]] = {}
        for end, hit in self.auto.iter(text):
            hits.setdefault(end + 1, []).append(hit)
        low = self.low
        odd = bytearray(n + 1)  # whether the best piece that ends here is an unknown character
        lead = bytearray(n + 1)  # whether the first piece of the best path to here is
        for e in range(1, n + 1):
            found, single = hits.get(e), False
            score = start = None
            if found is not None:
                # earlier starts come first, and only a higher score replaces
                for size, s in sorted(found, reverse=True) if len(found) > 1 else found:
                    single |= size == 1
                    got = best[e - size] + s
                    if score is None or got > score:
                        score, start = got, e - size
            if not single:
                got = best[e - 1] + low
                if score is None or got > score:
                    before = e - 1
                    best[e], odd[e] = got, 1
                    lead[e] = lead[before] if before else 1
                    pieces[e] = pieces[before] + (len(text[before].encode("utf-8", "surrogatepass")) if self.by_bytes else not odd[before])
                    continue
            best[e], pieces[e] = score, pieces[start] + 1
            lead[e] = lead[start] if start else 0
        return pieces[n], best[n], bool(lead[n]), bool(odd[n])

    def count(self, text: str) -> tuple[int, float]:
        """(pieces, score) of a text whose spaces are already marked."""
        kept = self.kept
        pieces, score, open_run = 0, 0.0, False
        for c in self.chunks.findall(text):
            got = kept.get(c)
            if got is None:
                if len(kept) >= KEPT_CHUNKS:
                    kept.clear()
                got = self.viterbi(c)
                if len(c) < 64:
                    kept[c] = got
            pieces += got[0] - (open_run and got[2] and not self.by_bytes)
            score += got[1]
            open_run = got[3]
        return pieces, score

    def text(self, text: str | None) -> tuple[int, float]:
        """(pieces, score) of a raw text: spaces become marks and one mark leads, as Metaspace does."""
        if not text:
            return 0, 0.0
        marked = text.replace(" ", SPACE)
        return self.count(marked if marked.startswith(SPACE) else SPACE + marked)


@lru_cache(maxsize=2)
def load(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_tokens(docs: DataFrame, model: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, n_tokens, score) of every whole text.

    Null and empty texts have no tokens and score 0. Extra columns are ignored, repeated rows give repeated
    results, an empty table gives no rows. model: path of a .model file on every worker, read for its pieces and
    scores.
    """
    small_batches(docs.sparkSession)
    path = model or tokenizer_path("piece_bpe_32k.model")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path)
        for b in slices(batches):
            got = [own.text(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(np.array([g[0] for g in got], np.int64)), pa.array(np.array([g[1] for g in got], np.float64))], ["doc_id", "n_tokens", "score"])

    return one_each(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, score double")
