"""Each query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from refrain.catalogue import ORACLE_SQL, QUERIES


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf, db, name):
    found = QUERIES[name](spark, sf)
    names = sorted(found.columns)
    got = sorted(tuple(plain(r[c]) for c in names) for r in found.collect())
    cursor = db.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    assert got == sorted(tuple(plain(r[columns.index(c)]) for c in names) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_have_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
