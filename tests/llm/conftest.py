import pytest

EDGE = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n", None, None), (4, "One two three four", "en", "a"), (5, "One two three four", "en", "a"), (5, "One two three four", "en", "a"),
    (None, "no id here", "fr", None), (6, "word " * 9000, "en", "hot"), (7, 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "en", "hot"), (8, "é😀 नमस्ते <|endoftext|> it's", None, "b"),
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty, blank and long texts, ties, a repeated row, and columns with names that operators use inside."""
    rows = [(*r, len(r[1] or ""), 1, 2, "x", 3) for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, fp int, `_chunk` string, piece int")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
