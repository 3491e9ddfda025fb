import pytest

LONG = "word " * 30_000


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows, and extra columns whose names clash with internal ones."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"), (2, None, "en", "a"), (3, "", "en", None), (4, LONG, "en", "a"),
        (None, "Some text without an id that is long enough to be seen by all.", None, None), (5, "Some text that occurs twice in the table, row by row, as it is.", "fr", ""),
        (5, "Some text that occurs twice in the table, row by row, as it is.", "fr", ""), (6, "!!! ??? ...", "de", "b"), (7, "\t\n  ", None, "b"), (8, "x", "de", "b"),
        (9, "The quick brown fox jumps over the lazy dog near the river bank today.", None, "c"), (10, "日本語 текст 😀 mixed", "xx", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    return df.selectExpr("*", "length(text) as n_chars", "7 as size", "'q' as score", "1 as row", "2 as node", "3 as copies", "4 as _size", "5 as `a b`", "6 as hits", "8 as rejected")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id = -1")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
