import pytest


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows, with an extra column that clashes with internal names."""

    def build(rows):
        full = [(i, t, *(r + ["en", "src0"][len(r) :]), len(t or ""), "clash") for i, t, *r in ((x[0], x[1], *x[2:]) for x in rows)]
        return spark.createDataFrame([(a, b, c, d, e, f) for a, b, c, d, e, f in full], "doc_id long, text string, lang string, source string, n_chars long, shard string")

    return build
