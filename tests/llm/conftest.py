import pytest

LONG = "word " * 60_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and columns whose names operators might use."""
    text = "Ten plain words stand here and nobody minds them at all, they say. " * 3
    rows = [
        (1, text, "en", "s", 1, 0, "x"),
        (1, text, "en", "s", 1, 0, "x"),
        (2, text, None, None, None, None, None),
        (3, None, "en", "s", 0, 1, "y"),
        (4, "", "fr", "s", 0, 1, "y"),
        (5, " \t\n ", "fr", "s", 0, 1, "y"),
        (None, text, "en", "s", 1, 0, "x"),
        (None, None, None, None, None, None, None),
        (6, LONG, "en", "s", 1, 0, "x"),
        (7, "é😀 " * 30, "de", "s", 1, 0, "x"),
        (8, "x" * 200_000, "de", "s", 1, 0, "x"),
        (9, "\n".join(["same line of six words here"] * 50), "de", "s", 1, 0, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_shingles int, key long, spans string")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
