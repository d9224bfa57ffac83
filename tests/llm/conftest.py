import pytest

ODD_TEXTS = [None, "", " ", "\n\n", "a", "a a", "Ünïcödé wörd ▁▁  x ", "same line here\n" * 9, "word " * 3000, "x" * 5000]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns with the names operators use."""
    rows = [(k, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s1", 7, "x") for k, t in enumerate(ODD_TEXTS)]
    rows += [(None, "a text without an id, and some more words to read here", "en", "s1", 1, "y")] * 2
    rows += [(3, "\n\n", None, "s1", 7, "x"), (50, "the same text twice " * 12, "en", "s1", 1, "z"), (50, "the same text twice " * 12, "en", "s1", 1, "z")]
    rows += [(51, "the same text twice " * 12, "en", None, 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rank int, __found string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
