"""Every query of the reference's operators beside its SQL in DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from quern.catalog import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == columns
    key = lambda r: tuple((x is None, str(x)) for x in r)
    mine = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=key)
    theirs = sorted((tuple(norm(r[found.columns.index(c)]) for c in columns) for r in found.fetchall()), key=key)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
