"""Every registered query against its SQL oracle on the given tables."""

import os
from pathlib import Path

import duckdb
import pytest

from tallyweave.queries import ORACLES, QUERIES

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    yield con
    con.close()


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((repr([row[i] for i in order]) for row in rows))


DUCK_TYPES = {
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "VARCHAR": "string",
    "BOOLEAN": "boolean",
    "TIMESTAMP": "timestamp",
    "FLOAT": "float",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, duck, name):
    got = QUERIES[name](spark, FOLDER)
    rows = [tuple(r) for r in got.collect()]
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    types = {r[0]: r[1] for r in duck.execute(f"DESCRIBE {ORACLES[name]}").fetchall()}
    assert sorted(got.columns) == sorted(names)
    assert {c: t.replace("timestamp_ntz", "timestamp") for c, t in got.dtypes} == {
        c: DUCK_TYPES.get(str(t), str(t)) for c, t in types.items()
    }
    assert len(rows) > 0
    assert len(rows) == len(want)
    assert canonical(rows, got.columns) == canonical(want, names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
