import pytest

from hitmill.llm.shipping import ship


@pytest.fixture(scope="session")
def llm(spark):
    return ship(spark)


@pytest.fixture(scope="session")
def rows(llm):
    """DataFrame of (doc_id, text, ...) tuples."""

    def make(data, schema="doc_id long, text string"):
        return llm.createDataFrame(data, schema)

    return make
