import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls everywhere, empty and long texts, ties, repeated rows and columns that clash with internal names."""
    long_text = " ".join(f"word{i % 977} of line {i // 40}" for i in range(30_000))
    rows = [
        (1, "alpha beta gamma delta epsilon zeta eta theta", "a"), (2, "Alpha beta  gamma\ndelta epsilon zeta eta theta", "a"), (3, "something else entirely with other words in it", "b"),
        (4, "", "b"), (5, None, None), (6, long_text, "b"), (7, long_text, None), (None, "no id here at all but some words", "c"), (None, None, None), (9, "tie", "c"), (9, "tie", "c"), (10, "   \n\t ", "a"),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return base.selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS LONG) AS n_chars", "1 AS id", "2L AS fp", "'x' AS key", "3 AS k", "'y' AS row", "0 AS times", "9 AS size", "0.5D AS score", "1 AS component", "'z' AS spans", "7 AS sid")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
