from __future__ import annotations

import os

import pytest

from loomdex.llm.catalogue import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, sf, name):
    import duckdb

    got = QUERIES[name](spark, sf)
    rows = sorted(map(tuple, got.collect()), key=str)
    if name in ORACLE:
        con = duckdb.connect()
        for f in os.listdir(sf):
            con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
        want = con.execute(ORACLE[name])
        at = [[d[0] for d in want.description].index(c) for c in got.columns]
        assert rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=str)
