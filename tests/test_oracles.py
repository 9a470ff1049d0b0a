"""Every query with an oracle against DuckDB on the smallest test tables."""

import os

import pytest

from docframe.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"create view \"{file.split('.')[0]}\" as select * from '{FOLDER}/{file}'")
    return connection


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return repr(round(value, 6))
    return str(value)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, FOLDER)
    want = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in order) for r in got.collect())
    assert rows == sorted(tuple(plain(v) for _, v in sorted(zip(names, r, strict=True))) for r in want.fetchall())
