"""Tables of awkward rows."""

from __future__ import annotations

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, score string, m string, c0 int, h bigint, key string, copies int"
LONG = " ".join(f"word{i % 977} stone" for i in range(60_000))


def awkward_rows():
    plain = "The quick brown fox jumps over the lazy dog while seven wizards quietly mix boxes of jade paint and some more words follow here"
    rows = [
        (1, plain, "en", "a"),
        (1, plain, "en", "a"),
        (2, plain + " end", "en", "a"),
        (3, None, None, None),
        (None, plain, "en", None),
        (None, None, None, "b"),
        (4, "", "en", "b"),
        (5, " \t\n\x0b\f\r ", "de", "b"),
        (6, "one two", "en", "a"),
        (7, "ONE two", "en", None),
        (8, LONG, "en", "a"),
        (9, "\x00\u00e9\u4e2d\U0001f600 \\ ' \" % _", "fr", "c"),
        (10, "12345 !!! ### $$$", None, "c"),
        (11, "line\nline\nline\n\nline", "en", "c"),
    ]
    return [(*r, len(r[1] or ""), "x", "y", None, 7, 1, "k", 3) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), DOCS).repartition(3).persist()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog while seven wizards"), (2, "one two"), (3, None), (4, ""), (None, "jade paint"), (1, "quick brown fox jumps over the lazy dog while seven wizards")], "item_id bigint, text string")
