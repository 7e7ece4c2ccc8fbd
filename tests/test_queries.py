"""Every query with SQL against DuckDB, over the smallest tables."""

import math
import os
from collections import Counter

import pytest

import __spark_entry__
from stratalog import shared
from stratalog.plans import core_queries, corpus_queries, search_queries, service_queries

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
PARTS = (core_queries, search_queries, corpus_queries, service_queries)
NAMES = [n for p in PARTS for n in p.QUERIES]


def plain(v):
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test data")
    c = duckdb.connect()
    for f in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    df = __spark_entry__.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = __spark_entry__.oracle_sql().get(name)
    if sql:
        cur = db.execute(sql)
        named = [d[0] for d in cur.description]
        assert sorted(named) == columns
        assert rows == Counter(tuple(plain(r[named.index(c)]) for c in columns) for r in cur.fetchall())


def test_tables_in_the_shared_folder(spark, tmp_path):
    real = shared.shared_dir
    shared.shared_dir = lambda _: f"file://{tmp_path}"
    try:
        df = shared.written(spark.range(3), "numbers")
        assert df.count() == 3 and any(p.name.startswith("numbers-") for p in tmp_path.iterdir())
        shared.release(spark)
        assert not list(tmp_path.iterdir())
    finally:
        shared.shared_dir = real


def test_entry(spark, db):
    assert __spark_entry__.entry(spark).columns == ["group_rank", "text", "occurrence_count", "first_rank", "row_ids"]
