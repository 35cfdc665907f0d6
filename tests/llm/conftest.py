import pytest

SCHEMA = "lang string, doc_id bigint, text string, source string, n_chars bigint, id string, words int, row string, h string, key string, span string"

ODD_TEXTS = [None, "", "   \n\t ", "a", "é", "a b c", "x" * 5000, "word " * 4000, "?!. ... \n\n", "\u0000 \u2581 \u2581\u2581"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, repeated rows, nulls in every column, and extra columns with clashing names."""
    rows = [("en", i, t, "s", 1, "i", 2, "r", "h", "k", "p") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[-1], rows[7], (None, None, "a text without an id. And more of it here.", None, None, None, None, None, None, None, None), (None,) * 11]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts):
        rows = texts.items() if isinstance(texts, dict) else enumerate(texts)
        return spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id bigint, text string, source string")

    return make


@pytest.fixture(scope="session")
def sample(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
