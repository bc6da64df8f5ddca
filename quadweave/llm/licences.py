"""Licence scans: notice phrases and identifier tags by Aho-Corasick, expressions by a shunting-yard parser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadweave.llm.common import one_each, slices, small_batches

#: Base phrases and their labels, as words.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notices that the method adds. Fixed wording of the licences themselves.
NOTICES = {
    "permission is hereby granted free of charge to any person": "mit",
    "licensed under mit": "mit",
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "redistribution and use in source and binary forms": "bsd",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "creative commons attribution sharealike": "cc-by-sa",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
}
#: Identifiers of licences that ask for no more than notices. Fixed names of the SPDX list.
PERMISSIVE = frozenset("0bsd afl-3.0 apache-1.1 apache-2.0 artistic-2.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent bsd-3-clause bsd-3-clause-clear bsl-1.0 cc-by-3.0 cc-by-4.0 cc0-1.0 curl ecl-2.0 ftl hpnd icu ijg isc libpng mit mit-0 mulanpsl-2.0 ncsa openssl php-3.01 postgresql psf-2.0 python-2.0 tcl unicode-3.0 unicode-dfs-2016 unlicense upl-1.0 w3c wtfpl x11 zlib zpl-2.1".split())
TAG = "spdx license identifier"
RAW_TAG = "spdx-license-identifier"
_AFTER_TAG = re.compile(r"[ \t]*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[a-z0-9.+:\-]+")
#: Binding strengths of the operators, weakest first.
STRENGTH = {"or": 1, "and": 2, "with": 3}

_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def split_words(text: str | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z lowered, as UTF-8."""
    return (text or "").encode("utf-8", "replace").lower().translate(_TABLE).split()


def shunting_yard(expression: str) -> list[str] | None:
    """Licence expression -> its tokens in postfix order; None if it is not well-formed. WITH binds before AND before OR."""
    out: list[str] = []
    stack: list[str] = []
    want_name = True
    for t in _TOKEN.findall(expression.lower()):
        if t == "(":
            if not want_name or (stack and stack[-1] == "with"):  # an exception is one name
                return None
            stack.append(t)
        elif t == ")":
            if want_name:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif t in STRENGTH:
            if want_name:
                return None
            while stack and stack[-1] != "(" and STRENGTH[stack[-1]] >= STRENGTH[t]:
                out.append(stack.pop())
            stack.append(t)
            want_name = True
        else:
            if not want_name:
                return None
            out.append(t)
            want_name = False
    if want_name or "(" in stack:
        return None
    return out + stack[::-1]


def evaluate(postfix: list[str], allowed: frozenset[str]) -> tuple[bool, frozenset[str]]:
    """(whether a choice of the expression needs allowed licences only, the licences that every choice needs).

    OR is met by either side and needs what both need; AND is met by both and needs what either needs; WITH ties an
    exception to the licences before it, and is allowed where they are. One pass, however many choices there are.
    """
    stack: list[tuple[bool, set[str]]] = []
    for t in postfix:
        if t not in STRENGTH:
            stack.append((t in allowed, {t}))
            continue
        (met2, b), (met1, a) = stack.pop(), stack.pop()
        if t == "with":
            exception = next(iter(b))  # the grammar has one name there
            stack.append((met1, {f"{x}-with-{exception}" for x in a}))
            continue
        if len(a) < len(b):
            a, b = b, a
        if t == "or":
            stack.append((met1 or met2, b & a))
        else:
            a |= b
            stack.append((met1 and met2, a))
    return stack[0][0], frozenset(stack[0][1])


def well_formed(raw: str) -> int:
    """The length of the longest well-formed beginning of a tag's text, found in one pass."""
    end = depth = 0
    want_name, last = True, ""
    for m in _TOKEN.finditer(raw.lower()):
        t = m[0]
        if t == "(" and last == "with":
            break
        last = t
        if want_name != (t not in STRENGTH and t != ")"):
            break
        if t == ")" and not depth:
            break
        depth += (t == "(") - (t == ")")
        want_name = t in STRENGTH or t == "("
        if not want_name and not depth:
            end = m.end()
    return end


def names(postfix: list[str]) -> set[str]:
    """All licences that a postfix expression names; WITH ties the first name of its right side to those of its left side."""
    stack: list[tuple[str, set[str]]] = []
    for t in postfix:
        if t not in STRENGTH:
            stack.append((t, {t}))
            continue
        (second, b), (first, a) = stack.pop(), stack.pop()
        if t == "with":
            stack.append((f"{first}-with-{second}", {f"{n}-with-{second}" for n in a}))
            continue
        if len(a) < len(b):
            a, b = b, a
        a |= b
        stack.append((first, a))
    return stack[0][1]


def expression_labels(raw: str) -> set[str]:
    """All licences that a tag's expression names; the longest well-formed beginning counts, as notices go on after it."""
    postfix = shunting_yard(raw[: well_formed(raw)])
    return {x.strip(".-") for x in names(postfix)} if postfix else set()


@lru_cache(maxsize=1)
def _tags():
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word(RAW_TAG, len(RAW_TAG))
    a.make_automaton()
    return a


def tags(text: str) -> Iterator[str]:
    """What stands behind every identifier tag, to the end of its line, with A-Z lowered."""
    low = text.lower()
    for end, _ in _tags().iter(low):
        if m := _AFTER_TAG.match(low, end + 1):
            yield m[1]


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (phrase, label, base) in enumerate([(p, v, True) for p, v in BASE.items()] + [(p, v, False) for p, v in NOTICES.items()] + [(TAG, "", False)]):
        a.add_word(f" {phrase} ", (k, len(phrase), phrase.count(" ") + 1, label, base))
    a.make_automaton()
    return a


def scan(text: str | None) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, required, permitted) of one text."""
    words = split_words(text)
    if not words:
        return 0, 0, None, None, "", "", 0.0, [], "", None
    flat = f" {b' '.join(words).decode('utf-8', 'replace')} "
    base, labels, starts, certain, tagged = set(), set(), [], 0.0, False
    n_base = 0
    seen, at = 0, 0  # spaces before position `seen`
    for end, (_, size, _, label, is_base) in _automaton().iter(flat):
        begin = end - size - 1
        if not label:
            tagged = True
            continue
        labels.add(label)
        certain = max(certain, 0.9 if size >= 30 else 0.8)
        if is_base:
            at += flat.count(" ", seen, begin) if begin >= seen else -flat.count(" ", begin, seen)
            seen = begin
            base.add(label)
            starts.append(at)
            n_base += 1
    expressions, required, permitted = [], set(), None
    if tagged:
        for raw in tags(text or ""):
            end = well_formed(raw)
            postfix = shunting_yard(raw[:end])
            if postfix:
                expressions.append(raw[:end].strip())
                labels |= {x.strip(".-") for x in names(postfix)}
                met, needs = evaluate(postfix, PERMISSIVE)
                permitted = met if permitted is None else permitted and met
                required |= needs
                certain = 1.0
    score = certain if not labels else min(1.0, certain + 0.02 * (len(labels) - 1))
    return len(words), n_base, min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, expressions, ",".join(sorted(required)), permitted


def scan_licences(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Licences named in every whole text: words, base-phrase places, labels, a score and the tags' expressions.

    required: what every choice of the tags' expressions needs; permitted: whether they can be met by PERMISSIVE
    licences alone (null without a tag).

    Null texts count as empty: no words, no labels, score 0. Places may overlap and all count. Extra columns are
    ignored; repeated rows give repeated results; an empty table gives no rows. labels holds base labels, those of
    further notices, and every licence that a well-formed SPDX expression names.
    """
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("required", pa.string()), ("permitted", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [scan(t.as_py()) for t in b.column(1)]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 10
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[1:], strict=True)]], schema=schema)

    return one_each(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, required string, permitted boolean")
