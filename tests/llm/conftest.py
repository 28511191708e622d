import pytest


@pytest.fixture
def docs_of(spark):
    """A documents table of (doc_id, text) pairs, with a clashing extra column."""

    def build(pairs):
        return spark.createDataFrame([(i, x, "k") for i, x in pairs], "doc_id long, text string, bucket string")

    return build
