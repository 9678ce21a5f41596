"""Each query of the subpackage that has SQL against it on the smallest tables."""

import math

import duckdb
import pytest

from quillon.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda v: (None if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    got, want = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    rows = sorted(tuple(str(plain(x)) for x in r) for r in got.collect())
    assert rows == sorted(tuple(str(plain(r[i])) for i in order) for r in want.fetchall()) and rows
