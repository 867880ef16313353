import duckdb
import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    return FOLDER


@pytest.fixture(scope="session")
def given():
    """Rows of a given table as dictionaries, for brute force."""

    def read(name):
        cursor = duckdb.connect().execute(f"SELECT * FROM '{FOLDER}/{name}.parquet'")
        names = [d[0] for d in cursor.description]
        return [dict(zip(names, row, strict=True)) for row in cursor.fetchall()]

    return read
