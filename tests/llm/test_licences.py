import random
import re

import pytest

from quadweave.llm import licences


def slow(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for phrase, label in licences.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = ["", None, "Released under the MIT License.", "under the mit license under the mit license", "xunder the mit license", "Apache License, Version 2.0 and CC BY-NC 4.0; cc-by nc", "under the\nMIT\tLICENSE é under—the mit license", "CC BY NC CC BY NC", "İunder the mit license ÄPACHE", "0under the mit license 9 cc by nc2"]


@pytest.mark.parametrize("text", TEXTS)
def test_base_places(text):
    assert licences.scan(text)[:5] == slow(text)


def test_expressions():
    assert licences.shunting_yard("MIT OR Apache-2.0 AND BSD-3-Clause") == ["mit", "apache-2.0", "bsd-3-clause", "and", "or"]
    assert licences.shunting_yard("(MIT OR Apache-2.0) AND ISC") == ["mit", "apache-2.0", "or", "isc", "and"]
    assert licences.shunting_yard("GPL-2.0 WITH Classpath-exception-2.0 OR MIT") == ["gpl-2.0", "classpath-exception-2.0", "with", "mit", "or"]
    for bad in ("", "OR MIT", "MIT OR", "(MIT", "MIT)", "MIT Apache", "()", "MIT WITH (a OR b)"):
        assert licences.shunting_yard(bad) is None
    assert licences.expression_labels("MIT WITH (a OR b)") == {"mit"}
    assert licences.evaluate(["a", "b", "or", "c", "and"], frozenset("bc")) == (True, frozenset("c"))
    assert licences.evaluate(["a", "x", "with", "c", "and"], frozenset("c")) == (False, frozenset(["a-with-x", "c"]))


def choices(postfix):
    """All sets of licences that meet an expression."""
    stack = []
    for t in postfix:
        if t in licences.STRENGTH:
            b, a = stack.pop(), stack.pop()
            stack.append(a + b if t == "or" else [x | y for x in a for y in b] if t == "and" else [{f"{n}-with-{next(iter(b[0]))}" for n in x} for x in a])
        else:
            stack.append([{t}])
    return stack[0]


def test_evaluation_matches_all_choices():
    rng = random.Random(9)
    seen = 0
    for _ in range(4000):
        postfix = licences.shunting_yard(" ".join(rng.choices(["a", "b", "c", "d", "and", "or", "(", ")"], [3, 3, 3, 3, 5, 5, 2, 2], k=rng.randint(1, 11))))
        if postfix:
            seen += 1
            allowed = frozenset(rng.sample("abcd", 2))
            every = choices(postfix)
            assert licences.evaluate(postfix, allowed) == (any(x <= allowed for x in every), frozenset(set.intersection(*every)))
    assert seen > 100


def brute_labels(text):
    """Labels, required licences and permission by regular expressions over each line."""
    low = (text or "").lower()
    flat = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))) + " "
    labels = {label for table in (licences.BASE, licences.NOTICES) for phrase, label in table.items() if f" {phrase} " in flat}
    needs, met = set(), []
    for raw in re.findall(r"(?=spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*))", low):
        tokens = re.findall(r"[()]|[a-z0-9.+:\-]+", raw)
        postfix = next((p for n in range(len(tokens), 0, -1) if (p := licences.shunting_yard(" ".join(tokens[:n])))), None)
        if postfix:
            every = choices(postfix)
            labels |= {x.strip(".-") for c in every for x in c}
            needs |= set.intersection(*map(set, every))
            met.append(any(all(x.split("-with-")[0] in licences.PERMISSIVE for x in c) for c in every))
    return ",".join(sorted(labels)), ",".join(sorted(needs)), all(met) if met else None


@pytest.mark.parametrize("text", [*TEXTS, "SPDX-License-Identifier: MIT OR GPL-2.0-only\nx spdx-license-identifier:(ISC) SPDX-License-Identifier : GPL-3.0 WITH x AND MIT", "spdx license identifier GPL; SPDX-License-Identifier: AND", "Boost Software License. SPDX-License-Identifier:\tApache-2.0 WITH LLVM-exception */ and more"])
def test_labels_match_brute_force(text):
    got = licences.scan(text)
    assert (got[5], got[8], got[9]) == brute_labels(text)
    assert licences.expression_labels("MIT OR (Apache-2.0 WITH LLVM-exception) */ more words") == {"mit", "apache-2.0-with-llvm-exception"}


def test_long_expressions_are_whole():
    many = [f"licence-{i}" for i in range(3000)]
    assert licences.expression_labels(" AND ".join(many)) == set(many)
    assert licences.expression_labels("(" * 60 + "MIT" + ")" * 60 + " OR ISC more words") == {"mit", "isc"}
    nested = " AND (".join(many) + ")" * (len(many) - 1)
    assert licences.expression_labels(nested) == set(many)
    text = "SPDX-License-Identifier: " + " AND ".join(many[:14]) + "\nmore"
    got = licences.scan(text)
    assert set(got[5].split(",")) == set(many[:14]) and got[7] == [" and ".join(many[:14])] and len(got[8].split(",")) == 14


def test_beginnings_match_trying_all():
    rng = random.Random(3)
    for _ in range(3000):
        tokens = rng.choices(["mit", "isc", "x", "and", "or", "with", "(", ")"], [4, 4, 4, 4, 4, 1, 2, 2], k=rng.randint(1, 12))
        want = next((p for n in range(len(tokens), 0, -1) if (p := licences.shunting_yard(" ".join(tokens[:n])))), None)
        got = licences.expression_labels(" ".join(tokens))
        if want is None or "with" not in want:
            assert got == ({x for s in choices(want) for x in s} if want else set())
        else:
            assert got == licences.names(want)


def test_documents(odd_docs, no_docs):
    got = licences.scan_licences(odd_docs).collect()
    assert [(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got] == [(r.doc_id, *slow(r.text)) for r in odd_docs.collect()]
    tagged = next(r for r in got if r.doc_id == 10)
    assert set(tagged.labels.split(",")) == {"mit", "apache-2.0", "bsd-3-clause"} and tagged.score == 1.0
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in got)
    assert licences.scan_licences(no_docs).count() == 0
