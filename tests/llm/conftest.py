from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, host string, rule string, length long, kept boolean"
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards mix " * 8


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns named like results."""
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, None, None, None), (4, "", "en", "a"), (None, PROSE + "end", "en", "a"),
        (5, " \t\n ", "en", "b"), (6, "one", "de", "b"), (7, "ONE", None, "b"), (8, "word " * 60_000, "en", None), (9, "é" * 50_000, "en", "c"),
        (10, "a\x0bb\x0cc  d", "en", "c"), (11, "a b c d", "en", "c"), (None, None, "en", "c"), (12, "Grüße an alle, Straße 7!", "de", "c"),
    ]
    return spark.createDataFrame([(*r, "h", "r", 5, True) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
