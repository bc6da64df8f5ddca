"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda of symbol pairs.

No piece of a vocabulary trained with white space as a prefix holds the space mark after another character, and
some characters (such as a line feed) are in no piece at all. A merge across such a place can't exist, so a text
falls into chunks that merge alone, and a chunk's pieces can be kept. This is checked when the model is loaded;
other vocabularies are encoded as one chunk per text. The agendas of a batch's new chunks are worked on together,
in arrays. Every chunk's pieces are checked against the library in the Arrow batch that meets it first.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadweave.llm.common import one_each, small_batches, tokenizer_path

SPACE = "▁"
#: Latin letters, which vocabularies tend not to join with anything else; whether that holds is checked.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Up to this length a chunk's agenda is a plain list, which is faster there than a heap.
SHORT = 40
#: Chunks that a worker keeps in each of two generations, and texts that it encodes at a time.
KEPT_CHUNKS = 120_000
AT_ONCE = 256
#: From so many new chunks on their agendas are arrays, in groups by length, up to so many in an array; so many are checked
#: at a time.
TOGETHER = 64
WIDTHS = (4, 8, 12, 16, 24, SHORT)
MOST = 20_000
CHECKED = 64
#: Kinds of characters that chunks are cut by.
MARK, ALONE, LETTER, OTHER = range(4)


class TwoAges(dict):
    """Recent entries, and behind them those of one generation before: what is asked for again becomes recent."""

    def __init__(self) -> None:
        super().__init__()
        self.old: dict = {}

    def found(self, keys: list) -> list:
        """The entries of different keys, None for what neither generation has."""
        out = list(map(self.get, keys))
        if self.old:
            rest = [i for i, x in enumerate(out) if x is None]
            for i, x in zip(rest, map(self.old.get, [keys[i] for i in rest]), strict=True):
                if x is not None:
                    out[i] = self[keys[i]] = x
        return out

    def age(self, most: int) -> None:
        if len(self) > most:
            self.old = dict(self)
            self.clear()


class Pairs:
    """The agendas of many chunks at once. A row of an array is a chunk, and each place holds the rank of the pair
    that begins there; a round merges the best pair of every row, the leftmost of equal ones.

    Symbols are numbers: 0 is none, the others are pieces and the characters of pieces.
    """

    BITS = 19

    def __init__(self, rank: dict[str, float], ids: dict[str, int]):
        names = list(dict.fromkeys([*rank, *(c for p in rank for c in p)]))
        number = {p: i for i, p in enumerate(names, 1)}
        order = {r: i for i, r in enumerate(sorted(set(rank.values())))}
        self.none = len(order)
        self.rank = np.array([self.none] + [order[rank[p]] if p in rank else self.none for p in names], np.int32)
        self.ids = np.array([-1] + [ids.get(p, -1) for p in names], np.int32)
        #: symbols of code points that are pieces, else 0
        self.symbols = np.zeros(0x110000, np.int32)
        for p in names:
            if len(p) == 1 and p in ids:
                self.symbols[ord(p)] = number[p]
        self.size = np.uint64(len(names) + 1)
        made = {}
        for p in rank:
            for k in range(1, len(p)):
                x, y = number.get(p[:k]), number.get(p[k:])
                if x and y:
                    made[x * int(self.size) + y] = number[p]
        keys = np.fromiter(sorted(made), np.uint64, len(made))
        into = np.fromiter((made[k] for k in sorted(made)), np.int32, len(made))
        # a slot holds one pair; those that find theirs taken are looked for in a sorted list
        self.key, self.into = np.zeros(1 << self.BITS, np.uint64), np.zeros(1 << self.BITS, np.int32)
        at = self.slots(keys)
        self.key[at] = keys
        lost = self.key[at] != keys
        self.into[at[~lost]] = into[~lost]
        self.crowded = np.zeros(1 << self.BITS, bool)
        self.crowded[at[lost]] = True
        self.spare, self.spare_into = np.append(keys[lost], np.uint64(2**64 - 1)), np.append(into[lost], np.int32(0))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.BITS)

    def merges(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The symbol that two make, 0 where they make none."""
        keys = left.astype(np.uint64) * self.size + right.astype(np.uint64)
        at = self.slots(keys)
        out = np.where(self.key[at] == keys, self.into[at], 0)
        rest = np.flatnonzero((out == 0) & self.crowded[at])
        if len(rest):
            i = np.searchsorted(self.spare, keys[rest])
            out[rest] = np.where(self.spare[i] == keys[rest], self.spare_into[i], 0)
        return out

    def encode(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks whose symbols lie one after another, and how many each has."""
        m, w = len(lens), int(lens.max()) + 2  # a place without symbol at both ends
        sym = np.zeros(m * w, np.int32)
        sym[np.arange(len(symbols)) + np.repeat(np.arange(m) * w + 1 - (np.cumsum(lens) - lens), lens)] = symbols
        to = np.zeros(m * w, np.int32)
        to[:-1] = self.merges(sym[:-1], sym[1:])
        rank = self.rank[to]
        rows = rank.reshape(m, w)
        after, before = np.arange(1, m * w + 1), np.arange(-1, m * w - 1)
        live = np.arange(m)
        while len(live):
            p = live * w + rows[live].argmin(axis=1)
            go = rank[p] < self.none
            live, p = live[go], p[go]
            c = after[p]
            e, q = after[c], before[p]
            sym[p], sym[c], rank[c] = to[p], 0, self.none
            after[p], before[e] = e, p
            at = np.concatenate([q, p])
            to[at] = self.merges(sym[at], np.concatenate([sym[p], sym[e]]))
            rank[at] = self.rank[to[at]]
        left = sym > 0
        return self.ids[sym[left]], left.reshape(m, w).sum(axis=1)


class Agenda:
    """A merge-type vocabulary with the library's tie rule: the highest score first, then the leftmost pair."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.rank: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes = [sp.unk_id()] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.ids[piece] = i
                self.rank[piece] = -sp.get_score(i)
        self.numbers = np.array(range(n), object)
        self.eos = sp.eos_id()
        self.unknown = sp.unk_id()
        self.by_bytes = any(sp.is_byte(i) for i in range(n))
        alone = "".join(re.escape(c) for c in "\t\n\r\x0b\x0c" if not any(c in p for p in self.ids))
        edge = re.compile(f"[{LETTERS}][^{LETTERS}]|[^{LETTERS}][{LETTERS}]")
        self.parted = not (any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(sp.is_unused(i) for i in range(n)))
        self.alone = self.parted and not any("\n" in p for p in self.ids)
        if not self.parted:
            self.chunks = re.compile("(?s).+")
        elif any(edge.search(p.lstrip(SPACE)) for p in self.ids):
            self.chunks = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone}]" if alone else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        else:
            self.chunks = re.compile(f"{SPACE}*[{LETTERS}]+|{SPACE}*[^{SPACE}{LETTERS}{alone}]+|{SPACE}+" + (f"|[{alone}]" if alone else ""))
        #: the same cuts by kinds of characters
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        if self.alone:
            if LETTERS in self.chunks.pattern:
                self.kinds[[ord(c) for c in map(chr, range(0x250)) if re.match(f"[{LETTERS}]", c)]] = LETTER
            self.kinds[[ord(c) for c in "\t\n\r\x0b\x0c" if re.escape(c) in alone]] = ALONE
            self.kinds[ord(SPACE)] = MARK
        self.kept = TwoAges()

    @cached_property
    def pairs(self) -> Pairs:
        return Pairs(self.rank, self.ids)

    def pieces(self, chunk: str) -> list[str]:
        """Merge adjacent symbols in the order of the agenda until no pair is a piece."""
        rank = self.rank
        sym = list(chunk)
        n = len(sym)
        if n < 2:
            return sym
        if n <= SHORT:
            none = float("inf")
            agenda = [rank.get(a + b, none) for a, b in zip(sym, sym[1:], strict=False)]
            while agenda and (best := min(agenda)) != none:
                i = agenda.index(best)  # the leftmost of equal ones
                sym[i] += sym.pop(i + 1)
                agenda.pop(i)
                if i:
                    agenda[i - 1] = rank.get(sym[i - 1] + sym[i], none)
                if i < len(agenda):
                    agenda[i] = rank.get(sym[i] + sym[i + 1], none)
            return sym
        nxt, prv = list(range(1, n)) + [-1], list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            s = rank.get(sym[i] + sym[i + 1])
            if s is not None:
                agenda.append((s, i, i + 1, len(sym[i]) + len(sym[i + 1])))
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if not sym[a] or not sym[b] or nxt[a] != b or len(sym[a]) + len(sym[b]) != size:
                continue
            sym[a] += sym[b]
            sym[b] = ""
            c = nxt[a] = nxt[b]
            if c >= 0:
                prv[c] = a
                s = rank.get(sym[a] + sym[c])
                if s is not None:
                    heapq.heappush(agenda, (s, a, c, len(sym[a]) + len(sym[c])))
            p = prv[a]
            if p >= 0:
                s = rank.get(sym[p] + sym[a])
                if s is not None:
                    heapq.heappush(agenda, (s, p, a, len(sym[p]) + len(sym[a])))
        return [x for x in sym if x]

    def chunk_ids(self, chunk: str) -> tuple[int, ...]:
        ids, out = self.ids, []
        for p in self.pieces(chunk):
            i = ids.get(p)
            if i is not None:
                out.append(i)
            elif self.by_bytes:
                out.extend(self.bytes[x] for x in p.encode("utf-8"))
            else:
                out.append(self.unknown)
        return tuple(out)

    def cuts(self, texts: list[str], codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where chunks begin in the code points of all texts."""
        starts = ends - np.fromiter(map(len, texts), np.int64, len(texts))
        if not self.alone:
            return np.fromiter((s + m.start() for s, t in zip(starts.tolist(), texts, strict=True) for m in self.chunks.finditer(t)), np.int64)
        kind = self.kinds[codes]
        new = kind == ALONE
        new[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != MARK)
        new[starts[starts < ends]] = True
        return np.flatnonzero(new)

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts with the end id, one after another, and where each text's end; checked against the library
        chunk by chunk."""
        made = [self.lib.normalize(t) if t else "" for t in texts]
        data = "".join(made).encode("utf-32-le")
        codes = np.frombuffer(data, "<u4")
        ends = np.cumsum(np.fromiter(map(len, made), np.int64, len(made)))
        cuts = self.cuts(made, codes, ends)
        at = np.append(cuts, len(codes)) * 4
        chunks = pa.Array.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(at), pa.py_buffer(data)]).dictionary_encode()
        known = self.known(values(chunks.dictionary))
        pool = np.frombuffer(b"".join(known), np.int32)
        lens = np.fromiter(map(len, known), np.int64, len(known)) // 4
        which = chunks.indices.to_numpy()
        last = np.append(0, np.cumsum(lens[which]))[np.searchsorted(cuts, ends)]
        out = np.insert(ranges(pool, np.cumsum(lens) - lens, lens, which), last, self.eos)
        last = last + np.arange(1, len(texts) + 1)
        if not self.alone:  # chunks can't be asked by themselves
            for t, own, lib in zip(texts, self.parts(out, last), self.lib.encode(texts, add_eos=True, num_threads=1), strict=True):
                if own != lib:
                    raise ValueError(f"the agenda and the library differ on {t[:80]!r}")
        return out, last

    def parts(self, ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
        """Lists that share their numbers, which take less memory than numbers of their own."""
        return [self.numbers[x].tolist() for x in np.split(ids, ends[:-1])] if len(ends) else []

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.parts(*self.encode_flat(texts))

    def known(self, chunks: list[bytes]) -> list[bytes]:
        """Ids (four bytes each) of different chunks, given in UTF-32; new ones are encoded and checked."""
        kept = self.kept
        kept.age(KEPT_CHUNKS)
        out = kept.found(chunks)
        new = [i for i, x in enumerate(out) if x is None]
        if new:
            order = [chunks[i] for i in new]
            for i, c, x in zip(new, order, self.make(order), strict=True):
                out[i] = kept[c] = x
        return out

    def make(self, order: list[bytes]) -> list[bytes]:
        data = b"".join(order)
        lens = np.fromiter(map(len, order), np.int64, len(order)) // 4
        ends = np.cumsum(lens).tolist()
        whole = data.decode("utf-32-le")
        texts = [whole[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        made: list = [None] * len(order)
        if len(order) >= TOGETHER:
            symbols = self.pairs.symbols[np.frombuffer(data, "<u4")]
            first = np.cumsum(lens) - lens
            fit = np.logical_and.reduceat(symbols > 0, first)
            low = 0
            for high in WIDTHS:
                fitting = np.flatnonzero(fit & (lens > low) & (lens <= high))
                low = high
                for k in range(0, len(fitting), MOST):
                    group = fitting[k : k + MOST]
                    ids, counts = self.pairs.encode(ranges(symbols, first, lens, group), lens[group])
                    own, ends = ids.tobytes(), (np.cumsum(counts) * 4).tolist()
                    for i, a, b in zip(group.tolist(), [0, *ends[:-1]], ends, strict=True):
                        made[i] = own[a:b]
        made = [np.array(self.chunk_ids(c), np.int32).tobytes() if x is None else x for c, x in zip(texts, made, strict=True)]
        self.check(texts, made)
        return made

    def check(self, order: list[str], made: list[bytes]) -> None:
        """Raise if the library encodes a chunk in another way. Chunks are asked behind a line feed, which no piece holds;
        where a chunk can't be asked like that, whole texts are compared."""
        if not self.alone:
            return
        head = self.lib.encode("\n")
        feed = np.array(self.lib.encode("\n\n")[len(head) :], np.int32).tobytes()
        start = np.array(head, np.int32).tobytes()
        groups = range(0, len(order), CHECKED)
        asked = self.lib.encode(["\n" + "\n".join(order[k : k + CHECKED]) for k in groups], num_threads=1)
        for k, lib in zip(groups, asked, strict=True):
            if np.array(lib, np.int32).tobytes() == start + feed.join(made[k : k + CHECKED]):
                continue
            for c, x in zip(order[k : k + CHECKED], made[k : k + CHECKED], strict=True):
                own, one = np.frombuffer(x, np.int32).tolist(), self.lib.encode("\n" + c)[len(head) :]
                if own != one:
                    raise ValueError(f"the agenda and the library differ on {c!r}: {own} and {one}")

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.lib.decode(ids, num_threads=1)


def ranges(pool: np.ndarray, starts: np.ndarray, lens: np.ndarray, which: np.ndarray, block: int = 500_000) -> np.ndarray:
    """The named ranges of pool one after another; a block of them at a time bounds the memory for long texts."""
    out = [pool[:0]]
    for k in range(0, len(which), block):
        w = which[k : k + block]
        n = lens[w]
        upto = np.cumsum(n)
        out.append(pool[np.repeat(starts[w] - (upto - n), n) + np.arange(upto[-1])])
    return np.concatenate(out)


def values(array: pa.LargeBinaryArray) -> list[bytes]:
    """What to_pylist() gives for an array without nulls, sooner."""
    _, ends, data = array.buffers()
    at = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1].tolist()
    whole = data.to_pybytes() if data else b""
    return [whole[a:b] for a, b in zip(at, at[1:], strict=False)]


def decimals(n: int) -> np.ndarray:
    """The numbers below n in decimal, each with a space behind it and filled up with zero bytes."""
    width = len(str(n)) + 1
    return np.array([f"{i} " for i in range(n)], f"S{width}")


def joined(words: np.ndarray) -> bytes:
    """One byte string of decimals(), without the last space."""
    data = words.view(np.uint8)
    return data[data != 0][:-1].tobytes()


@lru_cache(maxsize=2)
def load(path: str) -> Agenda:
    return Agenda(path)


def encode_documents(docs: DataFrame, model: str | None = None, text_col: str = "text", id_col: str = "doc_id", keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every whole text.

    Null texts count as empty: the end id only, decoded to nothing. Extra columns are ignored, repeated rows give
    repeated results, an empty table gives no rows. model: path of a merge-type .model file on every worker.
    """
    small_batches(docs.sparkSession, AT_ONCE)
    path = model or tokenizer_path("piece_bpe_32k.model")
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = load(path)
        words = decimals(own.lib.get_piece_size())
        for whole in batches:
            for k in range(0, whole.num_rows, AT_ONCE):
                b = whole.slice(k, AT_ONCE)
                flat, ends = own.encode_flat([t or "" for t in b.column(1).to_pylist()])
                ids = np.split(flat, ends[:-1])
                back = own.decode(own.parts(flat, ends))
                cols = [b.column(0).cast(pa.int64()), pa.array(np.diff(ends, prepend=0), pa.int64()), pa.array([hashlib.sha256(joined(words[x])).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string())]
                if keep_ids:
                    cols += [pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat, pa.int32())), pa.array(back, pa.string())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return one_each(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids)
