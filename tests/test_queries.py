"""Every query against its SQL in DuckDB, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from postloom.plans import data, feeds, mail

SQL = {k: s for part in (mail, data, feeds) for k, s in part.SQL.items()}
QUERIES = {k: f for part in (mail, data, feeds) for k, f in part.Q.items()}


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float) or hasattr(v, "quantize"):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(name, spark, con, small):
    df = QUERIES[name](spark, small)
    want = con.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0
