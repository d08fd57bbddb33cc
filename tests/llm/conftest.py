import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows."""
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", "a", 4), (4, "one", "en", None, 3),
        (5, "word " * 40_000, "en", "a", 200_000), (6, "x" * 300_000, "en", "a", 300_000), (7, "the cat sat on the mat " * 8, "en", "a", 1),
        (8, "the cat sat on the mat " * 8, "fr", "a", 1), (8, "the cat sat on the mat " * 8, "fr", "a", 1), (9, "你好 \U0001f600 <|endoftext|> é", None, "a", 5),
        (10, "12 34 !!", "de", "a", 8), (None, "a text without an id", "en", "a", 20), (None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as key", "2 as start", "3 as fp", "4 as h", "5 as piece")
