import pytest

EDGE = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, "   \n\t ", None, None),
    (4, "Hello World", "en", "a"),
    (5, "hello world", "en", "a"),
    (5, "hello world", "en", "b"),
    (None, "HELLO world", "en", "a"),
    (None, None, None, None),
    (6, "Éa éa ÉA it's 123 <|endoftext|> 'll 　x", "fr", "b"),
    (7, "word " * 4000 + "é" * 300, "en", "b"),
    (8, "x" * 5000, "en", "b"),
    (9, "the cat sat on the mat and the dog ran to the end of the road by the river", "en", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [(i, t, lang, src, len(t or ""), 1, "k", 2, "n") for i, t, lang, src in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, key string, _row int, `count` string")


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
