"""Every query of the training-data operators that has SQL, against DuckDB on the smallest test tables."""

import os

import pytest

from docframe.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for file in os.listdir(FOLDER):
        connection.execute(f"create view \"{file.split('.')[0]}\" as select * from '{FOLDER}/{file}'")
    want = connection.execute(queries.ORACLES[name])
    names = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(n) for n in names]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == names
    plain = lambda v: repr(round(v, 6)) if isinstance(v, float) else str(v)
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
