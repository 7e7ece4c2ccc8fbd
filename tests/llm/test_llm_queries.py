"""The queries of the training-data operators over the smallest tables, with SQL where there is some."""

import os
from collections import Counter

import pytest

from stratalog.llm import queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, db, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = Counter(tuple(r[c] for c in columns) for r in df.collect())
    if name in queries.ORACLE:
        cur = db.execute(queries.ORACLE[name])
        named = [d[0] for d in cur.description]
        assert sorted(named) == columns and rows == Counter(tuple(r[named.index(c)] for c in columns) for r in cur.fetchall())
    assert rows or name in ("p7_found", "p8_found", "p8_edited")
