import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame from (doc_id, text) pairs, with an extra column."""

    def build(rows):
        return spark.createDataFrame([(i, t, None, f"s{k}", None if t is None else len(t)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")

    return build
