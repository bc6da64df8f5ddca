import hashlib
import random

import pytest
import sentencepiece
from tokenizers import Tokenizer, models, pre_tokenizers

from quadweave.llm import bpe, unigram
from quadweave.llm.common import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")
HARD = ["", " ", "  a", " a ", "▁a", "\n", "\n\n a\tb", "a▁b", "日本 x😀", "　", "<s> </s> <0x41>", "\r\n", "a  b   c", "é́ ﬁ ①", "\x00a\x01", "x" * 3000, "ab" * 800 + " " * 99, "don't e.g. it's_x2 (a) Привет мирé 3.14%", "word,word.Word;\"q\""]


def noise(n, seed=1):
    random.seed(seed)
    return ["".join(random.choice("abcdeé .,_(\n▁日ж1²  ") for _ in range(random.randint(1, 80))) for _ in range(n)]


def test_agenda_equals_the_library():
    own, lib = bpe.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = HARD + noise(500)
    want = lib.encode(texts, add_eos=True)
    assert own.encode(texts) == want
    assert own.decode(want) == lib.decode(want)


def test_heap_and_list_agendas_agree(monkeypatch):
    own = bpe.load(PATH)
    for t in noise(200, 3):
        short = own.pieces(t)
        monkeypatch.setattr(bpe, "SHORT", 0)
        assert own.pieces(t) == short
        monkeypatch.undo()


def letters(n, seed=1):
    random.seed(seed)
    return ["".join(random.choices("etaoinshrdlu" + "ABCéß", k=random.randint(1, 50))) for _ in range(n)]


def test_many_chunks_are_encoded_in_arrays(monkeypatch):
    """One agenda for each chunk took more than the CPU budget; only chunks that don't fit are encoded by themselves."""
    own, lib = bpe.Agenda(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    texts = [" ".join(letters(40, k)) for k in range(20)]
    alone, plain = [], own.chunk_ids
    monkeypatch.setattr(own, "chunk_ids", lambda c: alone.append(c) or plain(c))
    assert own.encode(texts + HARD) == lib.encode(texts + HARD, add_eos=True)
    assert len(own.kept) > 700
    assert all(len(c) > bpe.SHORT or any(x not in own.ids for x in c) for c in alone)


@pytest.mark.parametrize("bits", [19, 4])
def test_agendas_in_arrays_agree_with_plain_ones(monkeypatch, bits):
    monkeypatch.setattr(bpe.Pairs, "BITS", bits)  # with few slots most pairs share one
    own = bpe.Agenda(PATH)
    words = [w for w in letters(500, 5) if all(c in own.ids for c in w)]
    ids, counts = own.pairs.encode(own.pairs.symbols[[ord(c) for w in words for c in w]], bpe.np.array([len(w) for w in words]))
    assert [x.tolist() for x in bpe.np.split(ids, counts.cumsum()[:-1])] == [list(own.chunk_ids(w)) for w in words]


def test_ties_of_arrays_go_to_the_left():
    rng = random.Random(6)
    for _ in range(30):
        rank = {c: 9.0 for c in "abc"} | {"".join(rng.choices("abc", k=rng.randint(2, 4))): float(rng.randint(0, 2)) for _ in range(12)}
        own = bpe.Agenda.__new__(bpe.Agenda)
        own.rank = rank
        pairs, names = bpe.Pairs(rank, {p: i for i, p in enumerate(rank)}), list(rank)
        words = ["".join(rng.choices("abc", k=rng.randint(1, 14))) for _ in range(100)]
        ids, counts = pairs.encode(pairs.symbols[[ord(c) for w in words for c in w]], bpe.np.array([len(w) for w in words]))
        assert [[names[i] for i in x] for x in bpe.np.split(ids, counts.cumsum()[:-1])] == [own.pieces(w) for w in words]


def test_chunks_are_cut_as_the_pattern_says():
    own = bpe.Agenda(PATH)
    made = [own.lib.normalize(t) for t in HARD + noise(300, 7)]
    codes, ends = [ord(c) for t in made for c in t], bpe.np.cumsum([len(t) for t in made])
    cuts = [*own.cuts(made, bpe.np.array(codes, "uint32"), ends), len(codes)]
    assert ["".join(map(chr, codes[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)] == [c for t in made for c in own.chunks.findall(t)]


def test_a_wrong_merge_in_arrays_is_noticed():
    own = bpe.Agenda(PATH)
    texts = [" ".join(letters(40, k)) for k in range(20)]
    pairs = own.pairs
    pairs.rank[pairs.rank < pairs.none] = 0  # the leftmost pair first, whatever its score
    with pytest.raises(ValueError, match="differ"):
        own.encode(texts)


def test_texts_without_chunks():
    own = bpe.Agenda(PATH)
    assert own.encode([]) == []
    assert own.encode(["", ""]) == [[own.eos], [own.eos]]


def test_kept_chunks_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 50)
    own, lib = bpe.Agenda(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for k in range(0, 200, 20):
        texts = noise(20, k)
        assert own.encode(texts) == lib.encode(texts, add_eos=True)


def test_a_wrong_merge_is_noticed(monkeypatch):
    own = bpe.Agenda(PATH)
    monkeypatch.setattr(own, "chunk_ids", lambda c: (5,))
    with pytest.raises(ValueError, match="differ"):
        own.encode(["hello"])


def test_documents(odd_docs, no_docs):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = bpe.encode_documents(odd_docs).collect()
    want = []
    for r in odd_docs.collect():
        ids = lib.encode(r.text or "", add_eos=True)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)), ids))
    assert [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids) for r in got] == want
    assert bpe.encode_documents(no_docs).count() == 0
    assert bpe.encode_documents(odd_docs, keep_ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def reference(vocab, **more):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, **more))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    return t


@pytest.mark.parametrize("by_bytes", [True, False])
def test_counts_equal_the_library(by_bytes):
    vocab = [v for v in unigram.vocabulary(PATH) if by_bytes or not v[0].startswith("<0x")]
    own, ref = unigram.Counter(vocab), reference(vocab, byte_fallback=by_bytes)
    texts = [t for t in HARD + noise(300) if t]
    assert [own.text(t)[0] for t in texts] == [len(e.ids) for e in ref.encode_batch(texts, add_special_tokens=False)]


def test_ties_follow_the_library():
    random.seed(9)
    for _ in range(40):
        pieces = {"".join(random.choice("abc") for _ in range(random.randint(1, 4))) for _ in range(12)}
        vocab = [("<unk>", 0.0), *((p, float(random.choice([-1, -2, -3, -2.5]))) for p in sorted(pieces)), ("▁", -2.0), ("▁a", -1.0)]
        own, ref = unigram.Counter(vocab), reference(vocab)
        for _ in range(20):
            t = "".join(random.choice("abcx ") for _ in range(random.randint(1, 30)))
            assert own.text(t)[0] == len(ref.encode(t).ids), (vocab, t)


def test_scores_are_the_best_of_all_segmentations():
    vocab = [("<unk>", 0.0), ("a", -3.0), ("b", -3.0), ("ab", -4.0), ("ba", -5.0), ("aba", -8.0), ("▁", -1.0)]
    own, scores = unigram.Counter(vocab), dict(vocab)

    def best(t):
        if not t:
            return 0.0
        return max(scores[t[:n]] + best(t[n:]) for n in range(1, 4) if t[:n] in scores)

    for t in ("ab", "aba", "abab", "bbaab", "babaab"):
        assert own.text(t)[1] == scores["▁"] + best(t)


def test_counted_documents(odd_docs, no_docs):
    got = unigram.count_tokens(odd_docs).collect()
    ref = reference(unigram.vocabulary(PATH), byte_fallback=True)
    assert [(r.doc_id, r.n_tokens) for r in got] == [(r.doc_id, len(ref.encode(r.text).ids) if r.text else 0) for r in odd_docs.collect()]
    assert unigram.count_tokens(no_docs).count() == 0


@pytest.mark.parametrize("parted", [True, False])
def test_a_wrong_agenda_is_caught(parted):
    own = bpe.Agenda(PATH)
    if not parted:  # as for a vocabulary whose chunks can't be asked alone
        own.alone, own.chunks = False, bpe.re.compile("(?s).+")
    texts = ["the quick brown fox", "a\nb", ""]
    assert own.encode(texts) == own.lib.encode(texts, add_eos=True)
    own.kept.clear()
    del own.rank["▁the"], own.rank["the"]
    with pytest.raises(ValueError, match="differ"):
        own.encode(["the end", "other"])


def test_counts_follow_the_best_path():
    rng = random.Random(4)
    vocab = [("▁", -1.0), *{(("".join(rng.choices("abc", k=rng.randint(1, 4)))), -float(rng.randint(1, 9))) for _ in range(30)}]
    own = unigram.Counter(vocab)
    for _ in range(300):
        text = "".join(rng.choices("abcx▁", k=rng.randint(1, 12)))

        def best(end):
            """(score, pieces, whether the last is unknown) of the first n characters, earliest start on ties."""
            if end == 0:
                return 0.0, 0, False
            out, single = None, False
            for start in range(end):
                s = own.known.get(text[start:end])
                if s is not None:
                    single |= end - start == 1
                    b = best(start)
                    if out is None or b[0] + s > out[0]:
                        out = b[0] + s, b[1] + 1, False
            if not single:
                b = best(end - 1)
                if out is None or b[0] + own.low > out[0]:
                    out = b[0] + own.low, b[1] + (not b[2]), True
            return out

        want = best(len(text))
        got = own.viterbi(text)
        assert (got[0], got[3]) == (want[1], want[2]) and got[1] == pytest.approx(want[0])
