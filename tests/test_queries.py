"""Every keyed-table query against its SQL."""

from __future__ import annotations

import math

import duckdb
import pytest

from keyloom import queries as tables

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in NAMES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(rows):
    shown = [tuple("null" if x is None or isinstance(x, float) and math.isnan(x) else f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in rows]
    return sorted(shown)


@pytest.mark.parametrize("name", list(tables.QUERIES))
def test_query(spark, duck, name):
    got = tables.queries()[name](spark, SF)
    if name not in tables.oracle_sql():  # tested in test_tables.py
        assert got.count() > 0
        return
    want = duck.sql(tables.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(duck.sql(f"select {picked} from ({tables.oracle_sql()[name]})").fetchall())
