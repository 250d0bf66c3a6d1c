"""Text sources, streaming, tasks and the corners of operators, on small tables."""

from __future__ import annotations

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame, keyed
from keyloom.functions import sequence
from keyloom.functions import text as fn
from keyloom.operators import aggregates, filters, intervals, joins, ranks, shape
from keyloom.plans import associations as assoc
from keyloom.plans import entities, tasks
from keyloom.plans.associations import KnowledgeBase
from keyloom.plans.rules import Ids, Only, Rule, Var, assignments, traverse
from keyloom.plans.tasks import Task
from keyloom.sources import text
from keyloom.streaming import tables as streams


def rows(df, *order):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_header():
    options, names = text.parse_header(["#: :type=:flat#:merge=true#:n=3", "#Key\tA\tB (x)"])
    assert options == {"type": "flat", "merge": True, "n": 3} and names == ["Key", "A", "B (x)"]
    assert text.parse_options(text.format_options(options)) == options
    assert text.parse_open_string("K~A,B#:type=:list") == {"type": "list", "key_field": "K", "fields": ["A", "B"]}


def test_open_and_write(spark, tmp_path):
    own = tmp_path / "t.tsv"
    own.write_text("#: :type=:double\n#Id\tA\tB\nk1|k2\ta1|a2\tb1|b2\nk1\ta3\t\nk3\t\tb9\n")
    merged = text.open_table(spark, str(own))
    assert rows(merged.df) == [("k1", ["a1", "a2", "a3"], ["b1", "b2"]), ("k2", ["a1", "a2"], ["b1", "b2"]), ("k3", [], ["b9"])]
    zipped = text.open_table(spark, str(own), how="zipped", fields=["A"])
    assert rows(zipped.df)[:2] == [("k1", ["a1", "a3"]), ("k2", ["a2"])]
    text.write_table(merged, str(tmp_path / "out"))
    again = text.open_table(spark, str(tmp_path / "out"), key_field="Id", fields=["A", "B"])
    assert {r.value for r in spark.read.text(str(tmp_path / "out")).collect()} >= {"#Id\tA\tB", "k1\ta1|a2|a3\tb1|b2"}
    assert again.shape in ("double", "list")
    plain = tmp_path / "l.tsv"
    plain.write_text("#Id\tA\tB\nx\t12abc\t3\nx\t9\t9\ny\tz\t\n")
    listed = text.open_table(spark, str(plain), shape="list", cast="long")
    assert rows(listed.df) == [("x", 12, 3), ("y", 0, None)]
    assert rows(text.open_table(spark, str(plain), shape="single", grep="^y").df) == [("y", "z")]


def test_field_names(spark):
    t = keyed(spark.createDataFrame([(1, 2, 3)], "`Id` int, `A (long)` int, b int"), "Id")
    assert t.field("A") == "A (long)" and t.field("1") == "b" and t.field(None) == "Id"
    with pytest.raises(KeyError):
        t.field("missing")


def double(spark):
    data = [("a", ["x", "y"], ["1", "2"]), ("b", ["x", "x"], ["3", "3"]), ("c", [], []), ("d", None, None)]
    return KeyedFrame(spark.createDataFrame(data, "k string, n array<string>, v array<string>"), "k", ["n", "v"], "double")


def test_shapes(spark):
    t = double(spark)
    assert rows(shape.remove_duplicates(t).df)[1] == ("b", ["x"], ["3"])
    assert rows(shape.unzip(t, "n").df) == [("a:x", ["1"]), ("a:y", ["2"]), ("b:x", ["3", "3"])]
    back = shape.zip_keys(shape.unzip(t, "n"), "n")
    assert rows(back.df) == [("a", ["x", "y"], ["1", "2"]), ("b", ["x", "x"], ["3", "3"])]
    assert rows(shape.rekey(t, "n", ["v"], zipped=True).df) == [("x", ["1", "3", "3"]), ("y", ["2"])]
    assert rows(shape.records(t).where("k = 'a'")) == [("a", 0, "x", "1"), ("a", 1, "y", "2")]
    assert rows(shape.to_list(t).df)[2] == ("c", None, None)


def test_filters(spark):
    t = double(spark)
    picked = lambda what, invert=False: [r.k for r in filters.select(t, what, invert).df.orderBy("k").collect()]
    assert picked(["y", "c"]) == ["a", "c"]
    assert picked(re.compile("^x")) == ["a", "b"]
    assert picked({"v": ">2"}) == ["b"] and picked({"v": ">2"}, True) == ["a", "c", "d"]
    assert picked({"n": 2}) == ["a", "b"] and picked({"n": "!x"}) == ["a"]
    assert rows(filters.field_index(t, "n")) == [("x", ["a", "b"]), ("y", ["a"])]
    assert rows(aggregates.value_index(t, ["n", "v"], ordered=True))[-2:] == [("x", "a"), ("y", "a")]
    stack = filters.FilterStack(t).add("n", "x").add("v", "2")
    assert rows(stack.ids()) == [("a",)] and rows(stack.pop().ids()) == [("a",), ("b",)] and stack.reset().rows().df.count() == 4


def test_attach(spark):
    a = double(spark)
    b = KeyedFrame(spark.createDataFrame([("x", ["p"]), ("y", ["q", "r"])], "n string, w array<string>"), "n", ["w"], "double")
    assert rows(joins.attach(a, b).df.select("k", "w")) == [("a", ["p", "q", "r"]), ("b", ["p", "p"]), ("c", []), ("d", [])]
    index = spark.createDataFrame([("a", "y"), ("c", "x"), ("c", "none")], "k string, n string")
    assert rows(joins.attach(a, b, ["w"], index=index).df.select("k", "w")) == [("a", ["q", "r"]), ("b", []), ("c", ["p"]), ("d", [])]


def test_undirected(spark):
    """Each direction once, and the edges are made once and spread over all
    partitions, however few bytes they have."""
    rows = [(1, 2, "a"), (2, 1, "b"), (3, 3, "c"), (4, 5, "d"), (None, 7, "e")]
    e = spark.createDataFrame(rows, "source int, target long, info string")
    out = assoc.undirected(e)
    assert out.columns == e.columns
    got = {(r.source, r.target): r.info for r in out.collect()}
    assert set(got) == {(1, 2), (2, 1), (3, 3), (4, 5), (5, 4), (None, 7)} and out.count() == 6
    assert got[1, 2] in "ab" and got[2, 1] in "ab" and got[5, 4] == "d"
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
    assert out.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_intervals_of_very_different_lengths(spark, monkeypatch):
    """Short ones don't meet at the level of long ones, and a key with many
    pairs is dealt over parts."""
    shorts = [("g", 3 * i, 3 * i + 1) for i in range(300)]
    long = [("g", i, 200_000 + i) for i in range(3)]
    a = spark.createDataFrame(shorts, "g string, a_start long, a_end long")
    b = spark.createDataFrame([*shorts, *long], "g string, b_start long, b_end long")
    want = sorted((s, e, s2, e2) for _, s, e in shorts for _, s2, e2 in [*shorts, *long] if s <= e2 and s2 <= e)
    for most in (intervals.PAIRS, 50):
        monkeypatch.setattr(intervals, "PAIRS", most)
        got = intervals.overlaps(a, b, ["g"], 4).select("a_start", "a_end", "b_start", "b_end")
        assert sorted(tuple(r) for r in got.collect()) == want
        met = intervals._meeting(a, b, ["g"], 4, None)
        assert len(want) <= met.count() < 2 * len(want)
        keys = ["g", "_level", "_bin", "_kind", "_part"]
        assert met.groupBy(*keys).count().agg({"count": "max"}).first()[0] <= 2 * most
    assert met.select("_part").distinct().count() > 3


def test_points_of_one_task_are_spread(spark):
    """The pairs of points that one task reads are made in several."""
    points = spark.range(0, 2000, 1, 1).select(F.col("id").alias("pos"))
    ranges = points.select(F.col("pos").alias("b_start"), (F.col("pos") + 9).alias("b_end"))
    hit = intervals.points_in(points, ranges, [], 4, longest=9)
    assert hit.count() == sum(min(10, p + 1) for p in range(2000))
    assert hit.select(F.spark_partition_id()).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_intervals(spark):
    r = spark.createDataFrame([("g", 1, 5), ("g", 5, 9), ("g", 20, 30), ("h", 1, 1), ("g", 2, 3)], "g string, start long, end long")
    assert rows(intervals.collapse(r, ["g"])) == [("g", 1, 9), ("g", 20, 30), ("h", 1, 1)]
    assert rows(intervals.depth(r, ["g"])) == [("g", 1, 5, 0), ("g", 2, 3, 1), ("g", 20, 30, 0), ("g", 5, 9, 1), ("h", 1, 1, 0)]
    a = r.toDF("g", "a_start", "a_end")
    want = {(x.a_start, x.a_end, y.a_start, y.a_end) for x in a.collect() for y in a.collect() if x.g == y.g and x.a_start <= y.a_end and y.a_start <= x.a_end}
    long = r.unionByName(spark.createDataFrame([("g", 0, 100_000), ("g", 7, 9_000), (None, 1, 5), ("g", None, 5)], r.schema))
    a = long.toDF("g", "a_start", "a_end")
    held = [x for x in a.collect() if x.g is not None and x.a_start is not None]
    want = {(x.a_start, x.a_end, y.a_start, y.a_end) for x in held for y in held if x.g == y.g and x.a_start <= y.a_end and y.a_start <= x.a_end}
    for width in (1, 4, 100):
        got = [tuple(x) for x in intervals.overlaps(a, long.toDF("g", "b_start", "b_end"), ["g"], width).select("a_start", "a_end", "b_start", "b_end").collect()]
        assert set(got) == want and len(got) == len(want) + (len(got) - len(set(got)))
        at = spark.createDataFrame([("g", p) for p in (0, 3, 25, 8_999, 50_000, 200_000)], "g string, pos long")
        hit = intervals.points_in(at, long.toDF("g", "b_start", "b_end"), ["g"], width).select("pos", "b_start", "b_end")
        ranges = {(x.a_start, x.a_end) for x in held if x.g == "g"}
        assert {tuple(x) for x in hit.collect()} == {(p, *x) for p in (0, 3, 25, 8_999, 50_000, 200_000) for x in ranges if x[0] <= p <= x[1]}
    a = r.toDF("g", "a_start", "a_end")
    want = {(x.a_start, x.a_end, y.a_start, y.a_end) for x in a.collect() for y in a.collect() if x.g == y.g and x.a_start <= y.a_end and y.a_start <= x.a_end}
    for width in (1, 4, 100):
        got = [tuple(x) for x in intervals.overlaps(a, r.toDF("g", "b_start", "b_end"), ["g"], width).select("a_start", "a_end", "b_start", "b_end").collect()]
        assert set(got) == want and len(got) == len(want) + (0 if len(set(got)) == len(got) else -1)
    dense = spark.range(400).select((F.col("id") % 3).alias("g"), F.pmod(F.xxhash64("id"), F.lit(900)).alias("start"), F.pmod(F.hash("id"), F.lit(25)).cast("long").alias("n")).select("g", "start", (F.col("start") + F.col("n")).alias("end"))
    data = [tuple(x) for x in dense.collect()]
    deep = sorted((g, s, e, sum(h == g and s2 < s and e2 >= s for h, s2, e2 in data)) for g, s, e in data)
    for width in (None, 7, 64, 10_000):
        assert sorted(tuple(x) for x in intervals.depth(dense, ["g"], width=width).collect()) == deep
        assert rows(intervals.collapse(dense, ["g"], width=width)) == rows(intervals.collapse(dense, ["g"]))
    islands = {g: [] for g in range(3)}
    for g, s, e in sorted(data):
        own = islands[g]
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    assert sorted(tuple(x) for x in intervals.collapse(dense, ["g"], width=64).collect()) == sorted((g, *x) for g in islands for x in islands[g])
    l = spark.createDataFrame([(1, "u", 5), (2, "u", 100), (3, "v", 5), (4, "u", 7)], "i int, u string, t long")
    right = spark.createDataFrame([("u", 5, "x"), ("u", 7, "y")], "u string, t long, w string")
    hit = intervals.as_of(l, right, "u", "t", ["w"], 4)
    assert rows(hit.select("i", "_hit.w")) == [(1, "x"), (2, "y"), (3, None), (4, "y")]
    assert rows(intervals.as_of(l, right, "u", "t", ["w"], 4, strict=True).select("i", "_hit.w")) == [(1, None), (2, "y"), (3, None), (4, "x")]
    less = l.unionByName(spark.createDataFrame([(5, None, 9), (6, "u", None), (7, None, None)], l.schema))
    none = right.unionByName(spark.createDataFrame([(None, 1, "n"), ("u", None, "m")], right.schema))
    assert rows(intervals.as_of(less, none, "u", "t", ["w"], 4).select("i", "_hit.w")) == [(1, "x"), (2, "y"), (3, None), (4, "y"), (5, None), (6, None), (7, None)]


def test_numbered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"))
    got = [r.x for r in aggregates.numbered(df, ["x"]).orderBy("_n").collect()]
    assert got == sorted(got) and len(got) == 1000


def test_numbered_wide_rows(spark):
    """Wide rows over partitions that Spark joins again by their size."""
    n = 1_000_000
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
    try:
        df = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("x"), "id", F.repeat(F.lit("p"), 128).alias("wide"))
        out = aggregates.numbered(df, ["x", "id"])
        got = out.agg(F.count(F.lit(1)), F.count_distinct("_n"), F.min("_n"), F.max("_n")).first()
        assert tuple(got) == (n, n, 1, n)
        low, high = (out.where(F.col("_n") == k).first() for k in (1, n))
        assert low.x == df.agg(F.min("x")).first()[0] and high.x == df.agg(F.max("x")).first()[0]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_medians(spark):
    data = [("a", float(i % 17)) for i in range(200)] + [("b", 1.0), ("b", 4.0), ("c", None), (None, 2.0), (None, 5.0), (None, 9.0)]
    df = spark.createDataFrame(data, "g string, v double")
    want = {g: float(np.median([v for k, v in data if k == g and v is not None])) for g in ("a", "b", None)}
    assert {r.g: r["median"] for r in aggregates.medians(df, "g", "v").collect()} == want
    assert {r.g: r["median"] for r in aggregates.statistics(df, "g", "v").collect()} == want | {"c": None}


def test_enrichment(spark):
    pairs = spark.createDataFrame([(i, "t" if i < 4 else "u") for i in range(10)], "item int, term string")
    chosen = spark.createDataFrame([(0,), (1,), (2,)], "item int")
    got = {r.term: r for r in aggregates.enrichment(pairs, "item", "term", chosen).collect()}
    assert (got["t"].k, got["t"].good, got["t"].drawn, got["t"].total) == (3, 4, 3, 10)
    assert abs(got["t"].p_value - 4 / 120) < 1e-9 and got["u"].p_value == pytest.approx(1)


def test_hypergeometric():
    exact = lambda k, drawn, good, total: sum(math.comb(good, i) * math.comb(total - good, drawn - i) for i in range(k, min(good, drawn) + 1)) / math.comb(total, drawn)
    for case in ((3, 3, 4, 10), (0, 5, 5, 10), (7, 50, 60, 500), (40, 90, 100, 300), (10, 10, 10, 10), (11, 10, 20, 40)):
        assert aggregates.hypergeometric_tail(*case) == pytest.approx(exact(*case), rel=1e-8, abs=1e-12)
    assert 0.4 < aggregates.hypergeometric_tail(5_000_000, 10_000_000, 50_000_000, 100_000_000) < 0.6


def test_rules(spark):
    e = spark.createDataFrame([("a", "b", "hi"), ("b", "c", "lo"), ("a", "c", "hi"), ("c", "c", "hi")], "source string, target string, w string")
    kb = KnowledgeBase().register("e", lambda: e)
    x, y, z = Var("x"), Var("y"), Var("z")
    assert rows(traverse(kb, [Rule(x, "e", y, {"w": "hi"}), Rule(y, "e", z)])) == sorted([("b", "a", "c"), ("c", "a", "c"), ("c", "c", "c")])
    assert rows(traverse(kb, [Rule("a", "e", y)])) == [("b",), ("c",)]
    assert rows(traverse(kb, [Rule(x, "e", x)])) == [("c",)]
    ids = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(traverse(kb, [Ids(x, "e", ids), Rule(x, "e", y, {"w": "!hi"})])) == [("b", "c")]
    assert rows(traverse(kb, [Rule(x, "e", y, {"w": "hi"}), Only(y, (Rule(y, "e", z, {"w": "lo"}),))]).select("x", "y")) == [("a", "b")]
    assert rows(traverse(kb, [Rule(x, Var("db"), y, {"w": "lo"})]).select("x", "db")) == [("b", "e")]
    own = assignments(kb, [Rule(x, "e", y, {"w": "hi"}), Rule(y, "e", z)])
    assert rows(own["x"]) == [("a",), ("c",)] and rows(own["z"]) == [("c",)]
    with pytest.raises(ValueError):
        traverse(kb, [Rule(x, "e", y), Rule(Var("p"), "e", Var("q"))])


def test_associations(spark):
    t = KeyedFrame(spark.createDataFrame([("g1", ["g2", "g3"], ["up", "down"]), ("g2", ["g1"], ["up"])], "SG string, TG array<string>, Effect array<string>"), "SG", ["TG", "Effect"], "double")
    spec = assoc.Spec(["SG", "TG", "Effect"], target=assoc.End("SG")).filled()
    assert (spec.source.column, spec.target.column, spec.info, spec.undirected) == ("TG", "SG", ["Effect"], False)
    names = spark.createDataFrame([("g1", "N1"), ("g2", "N2")], "id string, name string")
    e = assoc.database(t, assoc.Spec(["SG", "TG", "Effect"], assoc.End("SG", names, "name"), assoc.End("TG", names, "name"), undirected=False))
    assert rows(e) == [("N1", "N2", "up"), ("N2", "N1", "up")]
    kb = KnowledgeBase(keep=True).register_table("t", t)
    assert kb.describe("t") == {"source": "SG", "target": "TG", "undirected": False, "info": ["Effect"]}
    assert rows(kb.index("t").where("source = 'g1'")) == [("g1", "g2", "up"), ("g1", "g3", "down")]
    pair = spark.range(1).select(assoc.pair_key(F.lit("a~b"), F.lit("c")).alias("p"))
    assert [r.p for r in pair.collect()] == ["a-..-b~c"] and tuple(pair.select(*assoc.pair_ends(F.col("p"))).first()) == ("a~b", "c")


def test_entities(spark):
    kinds = entities.Formats({"Ensembl": "Gene"})
    df = kinds.mark(spark.createDataFrame([("a", 1)], "`Name (Ensembl)` string, n int"))
    assert entities.Formats.of(df.schema) == {"Name (Ensembl)": "Gene"}
    ids = spark.createDataFrame([("a",), ("bb",), ("a",), (None,)], "id string")
    size = entities.Property("size", single=F.length)
    cache = spark.createDataFrame([("a", 100)], "id string, value int")
    got, new = size.kept(ids, "id", cache)
    assert rows(got) == sorted([("a", 100), ("a", 100), ("bb", 2), (None, None)], key=str) and rows(new) == [("bb", 2)]
    own = spark.createDataFrame([("x", ["p", "q"], "hs"), ("x", ["p", "q"], "hs"), ("y", [], None)], "id string, l array<string>, o string").select("id", F.struct("l", "o").alias("notes"))
    table = entities.notes_table(own, ["l", "o"])
    assert rows(table) == [("x#1", "x", "Array:p|q", "hs"), ("x#2", "x", "Array:p|q", "hs"), ("y#1", "y", "Array:", None)]
    back = {(r.id, tuple(r.notes.l.list), r.notes.o.text) for r in entities.load_notes(table, ["l", "o"]).collect()}
    assert back == {("x", ("p", "q"), "hs"), ("y", ("",), None)}
    assert entities.unique(own).count() == 2 and entities.without(own, own.where("id = 'x'")).count() == 1


def test_tasks(spark, tmp_path):
    made = []

    def base(inputs):
        made.append("base")
        return spark.range(inputs["n"])

    a = Task("base", base, inputs=("n",))
    b = Task("double", lambda inputs, x: x.select((F.col("id") * 2).alias("id")), [a])
    for _ in range(2):
        assert rows(b.run(spark, str(tmp_path), {"n": 3})) == [(0,), (2,), (4,)]
    assert made == ["base"] and [t.name for t in b.closure()] == ["base", "double"]
    assert rows(b.run(spark, str(tmp_path), {"n": 3}, {"base": spark.range(1)})) == [(0,)]


def test_streams(spark, tmp_path):
    spark.range(20).select((F.col("id") % 3).alias("k"), "id").repartition(4).write.parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    stream = streams.tail(spark, str(tmp_path / "in"), like, 2)
    streams.traverse_into(stream, str(tmp_path / "out"), str(tmp_path / "c1"), lambda df: df.where("k = 1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7
    streams.collapse_into(stream, "k", "id", str(tmp_path / "sums"), str(tmp_path / "c2")).awaitTermination()
    total = spark.read.parquet(str(tmp_path / "sums")).groupBy("k").agg(F.sum("id"))
    assert rows(total) == [(0, 63), (1, 70), (2, 57)]


def test_tee_and_windows(spark, tmp_path):
    spark.range(20).select("id", F.timestamp_seconds(F.col("id") * 60).alias("at"), (F.col("id") % 2).alias("k")).repartition(4).write.parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    stream = streams.tail(spark, str(tmp_path / "in"), like, 1)
    sinks = {str(tmp_path / "a"): lambda d: d.where("k = 0"), str(tmp_path / "b"): lambda d: d.where("k = 1")}
    streams.tee_into(stream, sinks, str(tmp_path / "c1")).awaitTermination()
    assert [spark.read.parquet(p).count() for p in sinks] == [10, 10]
    windows = streams.windowed_counts(stream, "at", "k", "10 minutes", "1 day")
    query = windows.writeStream.format("memory").queryName("windows").outputMode("update").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    query.awaitTermination()
    best = spark.table("windows").groupBy("start", "k").agg(F.max("n").alias("n"))
    assert sorted(r.n for r in best.collect()) == [5, 5, 5, 5]
    seen, watch = streams.watched(spark.range(7), "rows", n=F.count(F.lit(1)))
    assert seen.count() == 7 and watch.get == {"n": 7}


def test_sources(spark, tmp_path):
    own = tmp_path / "t.tsv"
    own.write_text("#: :type=:list\n#Id A B\nk1  1 x\nk2 2   y\nk3 3 z\n")
    opened = text.open_table(spark, str(own), sep="/ +/", head=2)
    assert rows(opened.df) == [("k1", "1", "x"), ("k2", "2", "y")]
    assert rows(text.open_table(spark, str(own), sep="/ +/", spec="B~A#:cast=:to_i", select=lambda v: ~v.startswith("k3"), fix=lambda v: F.regexp_replace(v, "1", "7")).df) == [("x", 7), ("y", 2)]
    plain = tmp_path / "c.csv"
    plain.write_text("a,b\nc,\"d\ne\"\na,f\n")
    assert rows(text.read_csv(spark, str(plain), header=False).df) == [("row-0", "a", "b"), ("row-1", "c", "d\ne"), ("row-2", "a", "f")]
    assert rows(text.open_source(spark, {"k": [["x", "y"], ["z"]]}).df) == [("k", ["x", "y"], ["z"])]
    for kind, value in (("integer", 7), ("float", 1.5), ("boolean", True), ("string", "s")):
        text.save_result(spark, str(tmp_path / kind), kind, value)
        assert text.load_result(spark, str(tmp_path / kind), kind) == value
    t = keyed(spark.createDataFrame([("b", 1), ("a", 2)], "Id string, n int"), "Id")
    text.save_result(spark, str(tmp_path / "tsv"), "tsv", t)
    files = sorted(p.name for p in (tmp_path / "tsv").glob("part-*"))
    assert (tmp_path / "tsv" / files[0]).read_text().startswith("#: :type=:list\n#Id\tn")
    assert text.info(t)["rows"] == 2 and list(text.lines(t))[:2] == ["#: :type=:list", "#Id\tn"]


def test_notation(spark):
    dna = {"c.1-124C>T": "T", "c.464-2_465delAGTG": "----", "c.184_185ins?": "?(c.184_185ins?)", "c.?_?insCT": "+CT", "c.2289_?del(7236)": "?(c.2289_?del(7236))", "c.1050-?": "?(c.1050-?)"}
    protein = {"p.Arg2459Gly": "R2459G", "p.E279Z": "E279Z", "p.M552_W557>Z": "M552Indel", "p.T310_?insKAAQRGA": "T310Indel", "p.E746_A750delELREA": "E746Indel", "p.P14fs*?": "P14Frameshift", "p.?fs": None, "p.WQQSYLD25?": None, "p.0?": None, "p.?_?insXXXX": None, "p.*757?": "*757?"}
    got = spark.createDataFrame([(k,) for k in dna], "h string").select("h", sequence.dna_change(F.col("h")).alias("s"))
    assert {r.h: r.s for r in got.collect()} == dna
    got = spark.createDataFrame([(k,) for k in protein], "h string").select("h", sequence.protein_change(F.col("h")).alias("s"))
    assert {r.h: r.s for r in got.collect()} == protein
    cases = [(10, "AT", "A"), (10, "A", "AT,AG"), (10, "-", "TT"), (10, "ACG", "<DEL>"), (10, "AC", "GT"), (10, "A", "G")]
    own = spark.createDataFrame(cases, "p long, r string, a string").select(sequence.corrected_alleles(F.col("p"), F.col("r"), F.col("a")).alias("x"), sequence.corrected_vcf(F.col("p"), F.col("r"), F.col("a")).alias("y"))
    assert [(r.x.position, r.x.alleles) for r in own.collect()] == [(11, ["-"]), (11, ["+T", "+G"]), (10, ["+TT"]), (10, ["---"]), (10, ["--GT"]), (10, ["G"])]
    assert [(r.y.position, r.y.alleles) for r in own.collect()] == [(11, ["-"]), (10, ["+T", "+G"]), (10, ["+TT"]), (10, ["---"]), (10, ["--GT"]), (10, ["G"])]
    icgc = spark.createDataFrame([("A", "-AC"), ("-", "TT"), ("A", "G")], "r string, a string").select(sequence.corrected_icgc(F.col("r"), F.col("a")).alias("x"))
    assert [r.x for r in icgc.collect()] == ["--", "+TT", "G"]


def smith_waterman(a, b, match=2, mismatch=2, gap=3):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (match if a[i - 1] == b[j - 1] else -mismatch), table[i - 1][j] - gap, table[i][j - 1] - gap)
    return max(map(max, table))


def test_local_alignment(spark):
    r = np.random.default_rng(3)
    pairs = [("".join(r.choice(list("ACGT"), r.integers(0, 30))), "".join(r.choice(list("ACGT"), r.integers(0, 30)))) for _ in range(60)] + [("AAACCC", "AAATCCC"), (None, "A")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for x in df.select("a", "b", sequence.local_alignment(F.col("a"), F.col("b")).alias("x")).collect():
        if x.a is None:
            assert x.x is None or x.x.score is None
            continue
        assert x.x.score == smith_waterman(x.a, x.b)
        same = sum(x.a[p.q] == x.b[p.t] for p in x.x.pairs)
        gaps = (x.x.q_end - x.x.q_start - len(x.x.pairs)) + (x.x.t_end - x.x.t_start - len(x.x.pairs))
        assert x.x.score == 2 * same - 2 * (len(x.x.pairs) - same) - 3 * gaps


def test_models(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 3)) @ np.array([[3.0, 1.0, 0.0], [0.0, 1.0, 0.5], [0.0, 0.0, 0.2]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, a double, b double, c double")
    assert np.allclose(aggregates.covariance(df, ["a", "b", "c"]), np.cov(x.T))
    got = np.array([(r_.pc1, r_.pc2) for r_ in aggregates.components(df, ["a", "b", "c"], 2).orderBy("i").collect()])
    values, vectors = np.linalg.eigh(np.cov(x.T))
    want = (x - x.mean(0)) @ vectors[:, np.argsort(-values)[:2]]
    assert np.allclose(np.abs(got), np.abs(want))
    m = np.array([[1.0, 0.9, -0.9], [0.9, 1.0, 0.9], [-0.9, 0.9, 1.0]])
    assert np.linalg.eigvalsh(aggregates.nearest_psd(m)).min() > -1e-9
    line = spark.createDataFrame([("g", float(i), None if i == 3 else 2.0 * i + 1) for i in range(6)] + [("h", 1.0, 5.0), (None, 0.0, 1.0), (None, 1.0, 2.0)], "g string, x double, y double")
    filled = {(p.g, p.x): (p.prediction, p.filled) for p in aggregates.predicted(line, "g", "y", "x").collect()}
    assert filled["g", 3.0] == pytest.approx((7.0, 7.0)) and filled["h", 1.0] == (None, 5.0) and filled[None, 1.0][0] == pytest.approx(2.0)
    two = spark.createDataFrame([("g", float(v)) for v in np.concatenate((r.normal(0, 1, 800), r.normal(12, 1, 500)))], "g string, v double")
    peaks = sorted(p["mode"] for p in aggregates.modes(two, "g", "v", -5.0, 20.0).where("density > 0.02").collect())
    assert len(peaks) == 2 and abs(peaks[0]) < 1 and abs(peaks[1] - 12) < 1


def test_order(spark):
    m = spark.createDataFrame([(x,) for x in ("1:100:A", "1:20:A", "10:20:A", "2:300:A", "M:1:T", "M:1:T", "nothing")], "m string")
    assert [r.m for r in ranks.mutation_lines(m, "m").collect()] == ["1:20:A", "1:100:A", "10:20:A", "2:300:A", "MT:1:T"]
    assert [r.m for r in ranks.mutation_lines(m, "m", "strict").collect()] == ["1:20:A", "1:100:A", "2:300:A", "10:20:A", "MT:1:T"]
    lines = spark.createDataFrame([("b",), ("#h",), ("a",)], "value string")
    assert [r.value for r in ranks.sort_lines(lines).collect()] == ["#h", "a", "b"]
    assert ranks.draw(spark.range(10), 50, ["id"], 3).count() == 50
    names = spark.createDataFrame([("chr10",), ("chrX",), ("2",)], "n string")
    assert [r.n for r in names.orderBy(ranks.chromosome_order(F.col("n"))).collect()] == ["2", "chr10", "chrX"]


def test_freshness(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    for extra in ({}, {}, {"expiration": 1e6}, {"expiration": -1.0}, {"update": True}):
        tasks.persist(spark, str(tmp_path), "r", {}, make, **extra)
    assert len(made) == 3
    memo = tasks.Memo()
    assert memo.get("x", lambda: 1) == memo.get("x", lambda: 2) == 1


def test_attach_nulls(spark):
    a = KeyedFrame(spark.createDataFrame([("a", ["x"], ["1"]), (None, ["y", "x"], ["2"]), ("c", None, ["3"])], "k string, n array<string>, v array<string>"), "k", ["n", "v"], "double")
    b = KeyedFrame(spark.createDataFrame([("x", ["p"]), ("y", ["q"]), (None, ["z"])], "n string, w array<string>"), "n", ["w"], "double")
    assert rows(joins.attach(a, b).df) == sorted([("a", ["x"], ["1"], ["p"]), (None, ["y", "x"], ["2"], ["q", "p"]), ("c", None, ["3"], [])], key=str)
    index = spark.createDataFrame([("x", "X")], "a string, b string")
    assert rows(joins.translate(a, "n", index, "m").df) == sorted([("a", ["X"], ["1"]), (None, [None, "X"], ["2"]), ("c", [], ["3"])], key=str)
    other = KeyedFrame(spark.createDataFrame([("a", ["7"]), ("z", ["8"])], "k string, v array<string>"), "k", ["v"], "double")
    assert rows(joins.attach(a, other, ["v"], complete=True).df.select("k", "v")) == sorted([("a", ["1", "7"]), ("c", ["3"]), (None, ["2"]), ("z", ["8"])], key=str)


def test_shapes_of_lists(spark):
    one = spark.createDataFrame([([[1, 2], [3]], [4, 5])], "l array<array<int>>, n array<int>")
    assert one.select(shape.append_zipped(F.col("l"), F.col("n"))).first()[0] == [[1, 2, 4], [3, 5]]
    assert one.select(shape.append_zipped(F.array().cast("array<array<int>>"), F.col("n"))).first()[0] == [[4], [5]]
    t = double(spark)
    assert shape.detach(t, KeyedFrame(t.df, "k", ["v"])).fields == ["v"]
    assert rows(shape.flat_to_double(KeyedFrame(t.df.select("k", "n"), "k", ["n"], "flat")).df)[:2] == [("a", "x|y"), ("b", "x|x")]


def test_text_functions(spark):
    one = spark.createDataFrame([("HTMLTag name", "http://A.b/x?q=1&r&q=2#f", "run 'a b' c")], "a string, u string, t string")
    got = one.select(fn.snake_case(F.col("a")), fn.url_host(F.col("u")), fn.query_map(F.col("u")), fn.tokens(F.col("t")), fn.format_seconds(F.lit(3723))).first()
    assert tuple(got) == ("html_tag_name", "a.b", {"q": "1", "r": None}, ["run", "a b", "c"], "01:02:03")
