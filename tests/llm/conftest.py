import pytest


@pytest.fixture
def docs(spark):
    """Makes a documents table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(*r, "en", "s")[:4] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in full], "doc_id bigint, text string, lang string, source string, n_chars bigint")

    return make
