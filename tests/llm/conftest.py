import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_shingles long, file string"


@pytest.fixture
def documents(spark):
    """A table of (doc_id, text, source) with columns more, some of whose names operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, s, None, 7, "x") for i, t, s in ((*r, None)[:3] for r in rows)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def small_texts(small_docs):
    return [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").orderBy("doc_id").collect()]
