import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases: nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [(1, "One two  three four.", "en", "a", 9), (2, "One two three four.", "en", "a", 9), (2, "One two three four.", "en", "a", 9),
            (3, None, None, None, None), (4, "", "en", "b", 0), (None, "odd éè <|endoftext|> it's", None, "b", 1), (5, "!!! 123", "de", "c", 2),
            (6, "word " * 30_000, "en", "c", 3), (7, "x" * 20_000, "en", "c", 3), (8, "one two three four. five", "en", "a", 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return table.selectExpr("*", "'x' AS id", "1 AS score", "2 AS run", "'y' AS label", "3 AS block")


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
