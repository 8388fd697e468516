import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, an empty and a long text, ties, repeated rows, a column named like an output."""
    long = "lorem ipsum dolor " * 20000
    rows = [(None, None, None, None, None, 1), (1, "", "en", "s", 0, 2), (2, long, "en", "s", 9, 3), (3, "A b c d e.", None, "s", 1, 4), (3, "A b c d e.", None, "s", 1, 4), (4, "A b c d e.", "fr", None, 1, 5), (5, " \n\t ", "fr", "s", 1, 6), (6, "x" * 5000, "de", "s", 1, 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, shard int")


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
