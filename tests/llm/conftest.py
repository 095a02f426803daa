import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return DATA


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns whose names operators use too."""

    def make(texts):
        rows = [(i, t, "en", "src", 0, "x", 1.5, "y") for i, t in texts]
        schema = "doc_id long, text string, lang string, source string, n_chars long, node string, score double, bucket string"
        return spark.createDataFrame(rows, schema)

    return make


LONG = "word" * 20_000
ODD = [
    (1, "the quick brown fox jumps over the lazy dog"),
    (2, None),
    (None, "a text without an id, long enough to be cut somewhere in the middle of it all"),
    (3, ""),
    (4, " \n\t "),
    (5, LONG),
    (5, LONG),
    (6, "one"),
    (7, "the quick brown fox jumps over the lazy dog"),
    (8, "ümläut ß 中文 \U0001f600 don't  stop\r\n\r\n 's 12 34"),
    (None, None),
]


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD).repartition(3)


@pytest.fixture(scope="session")
def none(make_docs):
    return make_docs([])
