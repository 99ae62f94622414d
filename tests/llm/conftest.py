import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents-like tables from (doc_id, text) pairs, with columns of clashing names."""

    def make(rows):
        rows = [(i, t, "en", "src0", None if t is None else len(t), f"k{n}", 1) for n, (i, t) in enumerate(rows)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n int")

    return make
