"""Edge-case rows that every operator on documents must take."""

from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.01"

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows, extra columns with clashing names."""
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "a", 0),
        (3, " \t\n ", "en", None, 4),
        (4, "one", "en", "b", 3),
        (5, "One Two", "en", "b", 7),
        (6, "one two", "en", "b", 7),
        (None, "a null key has words too", "en", None, 24),
        (7, "same row " * 20, "en", "c", 180),
        (7, "same row " * 20, "en", "c", 180),
        (8, "long word " * 40_000, "en", "d", 400_000),
        (9, "naïve Ünïcode \x1f\x85 text\u2003kept together", "de", "d", 30),
    ]
    df = spark.createDataFrame(rows, DOCS)
    return df.selectExpr("*", "1 as size", "2 as fp", "3 as row_id", "'x' as key", "4 as n", "5 as h", "6 as rank", "7 as taken", "8 as node", "9 as component")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
