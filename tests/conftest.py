import pytest

from gleaner.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests", spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from {doc_id: text}; the id doubles as path."""
    from pyspark.sql import functions as F

    from gleaner.sources.corpus import as_documents

    def build(texts: dict[str, str]):
        rows = [(doc_id, doc_id, text) for doc_id, text in texts.items()]
        df = spark.createDataFrame(rows, "doc_id string, path string, raw_text string")
        return as_documents(df).orderBy(F.col("doc_id"))

    return build
