"""Small tables with the odd rows that every operator must take."""

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, score double"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, blank and long texts, repeated rows and ids, clashing names."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog", "en", "a", 43, "x", 0.5),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a", 43, "x", 0.5),
        (2, "The quick brown fox jumps over the lazy dog", "en", "a", 43, "x", 0.5),
        (3, "", "en", "b", 0, None, None),
        (4, None, None, None, None, None, None),
        (5, " \t\n ", "fr", "b", 4, "y", 1.0),
        (6, long, "en", "a", len(long), "y", 1.0),
        (7, "two words", "en", "c", 9, "z", 2.0),
        (None, "no id has this text", "en", "c", 19, "z", 2.0),
        (None, "two words", "en", "c", 9, "z", 2.0),
        (2, "another text under a used id", "de", "b", 28, "z", 2.0),
        (8, "É😀 ünïcode <|endoftext|> don't", "fr", None, 30, "q", 3.0),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (6, 1, 0), (7, 0, 1), (99, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
