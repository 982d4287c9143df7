"""Every query with SQL gives the same rows in DuckDB, at the smallest scale."""

from __future__ import annotations

import datetime
import os

import duckdb
import pytest

from betaloom.plans import queries as q

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v: object) -> str:
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(float(v)) if type(v).__name__ in ("float", "Decimal") else str(v)


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = q.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(q.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*columns).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(q.queries()) - set(q.oracle_sql())))
def test_other_queries_run(spark, name):
    assert q.queries()[name](spark, DATA).count() > 0


def test_entry_lists_them_all(spark):
    import __spark_entry__ as e

    assert set(q.queries()) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["accession", "sample_id", "n_probes", "total"]
