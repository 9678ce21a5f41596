"""Each query against its SQL on the smallest tables, as the driver compares them."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillon import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, db, name):
    got = queries.QUERIES[name](spark, SF)
    rows = got.collect()
    if name in queries.ORACLE_SQL:
        want = db.sql(queries.ORACLE_SQL[name])
        assert sorted(got.columns) == sorted(want.columns)
        order = [want.columns.index(c) for c in got.columns]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted((key(map(plain, r)) for r in rows)) == sorted(key(plain(r[i]) for i in order) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0 and set(queries.QUERIES) <= set(entry.queries())
