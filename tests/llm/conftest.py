import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """Builds documents from (doc_id, text[, lang[, source]]) rows."""

    def make(rows):
        full = [(*r, *(["en", "a"][len(r) - 2 :]), len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
