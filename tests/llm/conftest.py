import duckdb
import pytest

FOLDER = "/root/testdata/sf0.01"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text) of the small documents table."""
    return duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture
def frame(spark):
    """A documents table from (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame(
        [(i, t, "en", "src", None) for i, t in rows], DOCUMENTS
    )
