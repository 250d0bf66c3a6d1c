"""Queries that take the whole of their tables, checked without SQL."""

from __future__ import annotations

from collections import Counter

from keyloom import queries as tables

SF = "/root/testdata/sf0.001"


def test_brands_over_all_lines(spark):
    brands = {r.p_partkey: r.p_brand for r in spark.read.parquet(f"{SF}/part.parquet").collect()}
    own = {b: set() for b in ("Brand#12", "Brand#23")}
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_partkey", "l_suppkey").collect():
        if brands.get(r.l_partkey) in own:
            own[brands[r.l_partkey]].add(r.l_suppkey)
    a, b = own.values()
    assert a and b
    assert [tuple(r) for r in tables.queries()["q69_compare_brands"](spark, SF).collect()] == [(len(a & b), len(a - b), len(b - a))]


def test_segments_over_all_nations(spark):
    want = Counter((r.c_mktsegment, r.c_nationkey) for r in spark.read.parquet(f"{SF}/customer.parquet").collect())
    nations = [r.n_nationkey for r in spark.read.parquet(f"{SF}/nation.parquet").collect()]
    got = tables.queries()["q70_transpose_segments"](spark, SF)
    assert sorted(got.columns) == sorted(["segment", *map(str, nations)]) and len(nations) == 25
    rows = [r.asDict() for r in got.collect()]
    assert {r["segment"] for r in rows} == {s for s, _ in want}
    assert all(r[str(n)] == want[r["segment"], n] for r in rows for n in nations)
