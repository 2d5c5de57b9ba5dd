import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"word{i % 977}x{i % 31}" for i in range(60_000))
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", None, 0), (3, " \n\t", None, "a", 3),
        (4, long, "en", "a", len(long)), (5, long, "en", "b", len(long)), (5, long, "en", "b", len(long)),
        (None, "a text without an id that is long enough to count as one line", "en", "b", 1),
        (6, "short one", "de", "c", 9), (6, "another text under the same id, of some more words", "de", "c", 9),
        (7, "Zeile\n\n\nZeile\n", "de", "c", 9), (8, "!!! ??? 12345 \U0001f600", "de", "c", 9),
        (9, "z" * 300_000, "de", "c", 300_000),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
