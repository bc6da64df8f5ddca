import pytest

LONG = "lorem ipsum dolor sit amet " * 4000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from all of the other animals here", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog and runs away from all of the other animals here", "en", "a"),
    (3, "the QUICK brown\tfox jumps over the lazy dog and runs away from all of the other animals  here", "de", "b"),
    (4, None, None, None),
    (5, "", "en", "b"),
    (6, " \t\n ", "en", "c"),
    (7, "one", "fr", "c"),
    (8, LONG, "en", "a"),
    (9, "日本語 текст ünïcödé 😀 \x00 　 end", "ja", "é"),
    (9, "日本語 текст ünïcödé 😀 \x00 　 end", "ja", "é"),
    (None, "a row without an id", "en", "a"),
    (10, "Under the MIT License. SPDX-License-Identifier: (MIT OR Apache-2.0) AND BSD-3-Clause */", "en", "b"),
    (11, "a b c a b c a b c a b c", "en", "b"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Documents with nulls, blanks, repeats and columns whose names the operators use themselves."""
    rows = [(i, t, lang, s, len(t) if t else 0, "x", 1, 2.0, "y", 3) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, kind int, score double, shard string, size int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
