import pytest

DOCS = "doc_id bigint, text string, source string, digest int, norm int, n int"


@pytest.fixture
def docs(spark):
    """Texts with a source each; the extra columns clash with names that operators use."""

    def make(rows):
        return spark.createDataFrame([(i, t, s, 1, 2, 3) for i, t, s in rows], DOCS)

    return make
