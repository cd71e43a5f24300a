"""Every registered core query against its SQL on the smallest data."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
from loomdex.plans import cleaning, knowledge

QUERIES = {**knowledge.QUERIES, **cleaning.QUERIES}
ORACLE = {**knowledge.ORACLE, **cleaning.ORACLE}


def canonical(columns, rows):
    def show(v):
        if v is None or v != v:
            return None
        return f"{v:.5f}" if isinstance(v, float) else str(int(v)) if isinstance(v, bool) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(show(r[i]) for i in order) for r in rows), key=str)


@pytest.fixture(scope="module")
def con(sf):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLE[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert canonical(got.columns, [tuple(r) for r in got.collect()]) == canonical(columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() >= 0


def test_contract(spark):
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert entry_module.entry(spark).columns
