import pytest

LONG = "word " * 30000 + "ünïcödé " * 500 + "=" * 3000

EDGE_ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. It's 12 o'clock!\n\nNew part.", "en", "a"),
    (1, "The quick brown fox jumps over the lazy dog. It's 12 o'clock!\n\nNew part.", "en", "a"),
    (2, None, None, None),
    (3, "", "en", "b"),
    (4, " \n\t ", None, "b"),
    (5, LONG, "en", "a"),
    (None, "no id here, but words and more words", "en", "a"),
    (6, "漢字 é \U0001f642 <|endoftext|> tail", "xx", None),
    (7, "one two three", "en", "c"),
    (8, "one two three", "en", "c"),
    (9, "ONE two three", "en", "c"),
]
# columns that are named like those the operators make
EXTRA = "score double, size int, ids string, n int, `class` string, h int, copies int, `key` int"


@pytest.fixture(scope="session")
def edge(spark):
    """Documents with nulls, blanks, repeats, a long text and clashing columns."""
    rows = [(*row, 0.5, 1, "x", 2, "y", 3, 4, 5) for row in EDGE_ROWS]
    schema = f"doc_id bigint, text string, lang string, source string, {EXTRA}"
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def nothing(edge):
    return edge.limit(0)
