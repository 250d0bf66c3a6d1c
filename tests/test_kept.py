"""Stored indices and results, running tables, models, matrices, identifiers,
alignments, densities and headers, against plain versions."""

from __future__ import annotations

import math
import os
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom import queries as tables
from keyloom.frame import KeyedFrame, keyed
from keyloom.functions import sequence
from keyloom.operators import aggregates, alignment, density, filters, joins, models, sparse
from keyloom.plans import entities, identifiers, indices, tasks
from keyloom.sources import text
from keyloom.streaming import state
from keyloom.streaming import tables as streams

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files_read(df):
    """How many files the scans of a frame have read, by Spark's metrics."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.finalPhysicalPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    total, left = 0, [plan]
    while left:
        node = left.pop()
        name = node.getClass().getSimpleName()
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numFiles").value()
        if name.endswith("QueryStageExec"):
            left.append(node.plan())
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return total


# Headers -------------------------------------------------------------------------


def test_marks(spark, tmp_path):
    own = tmp_path / "percent.tsv"
    own.write_text("%: :type=:list\n% first remark\n%Key\tA\n#k2\tx\nk1\ty\n% later remark\tz\n")
    t = text.open_table(spark, str(own), mark="%")
    assert t.key == "Key" and t.shape == "list" and rows(t.df) == [("#k2", "x"), ("k1", "y")]
    assert text.preamble(spark, str(own), mark="%") == {"options": {"type": "list"}, "names": ["Key", "A"], "preamble": ["% first remark"]}
    plain = tmp_path / "plain.tsv"
    plain.write_text("Key\tA\n#k2\tx\nKey\tA\nk1\ty\n")
    for mark in ("", True):
        t = text.open_table(spark, str(plain), mark=mark, shape="list")
        assert t.key == "Key" and rows(t.df) == [("#k2", "x"), ("Key", "A"), ("k1", "y")]
    none = text.open_table(spark, str(plain), mark=False, shape="list", how="first")
    assert none.key == "ID" and rows(none.df) == [("#k2", "x"), ("Key", "A"), ("k1", "y")]


def test_headers_of_each_file(spark, tmp_path):
    folder = tmp_path / "a folder"
    folder.mkdir()
    (folder / "a.tsv").write_text("#: :sep2=','\n#Id\tA\tB\nk1\ta1,a2\tb1\n")
    (folder / "b.tsv").write_text("#: :sep=';'#:sep2=','\n#Id;C;A\nk2;c2;a3\nk1;c1;a4\n")
    (folder / "c.tsv").write_text("k3\ta5\tb5\n")
    t = text.open_table(spark, str(folder))
    assert t.fields == ["A", "B", "C"]
    assert rows(t.df) == [("k1", ["a1", "a2", "a4"], ["b1"], ["c1"]), ("k2", ["a3"], [], ["c2"]), ("k3", ["a5"], ["b5"], [])]
    listed = text.open_table(spark, str(folder), shape="list", key_field="A", fields=["Id", "C"])
    assert rows(listed.df) == [("a1,a2", "k1", None), ("a3", "k2", "c2"), ("a4", "k1", "c1"), ("a5", "k3", None)]
    with pytest.raises(KeyError):
        text.open_table(spark, str(folder), fields=["Z"])
    (folder / "empty.tsv").write_text("")
    assert text.open_table(spark, str(folder)).df.count() == 3
    (tmp_path / "nothing.tsv").write_text("")
    assert text.open_table(spark, str(tmp_path / "nothing.tsv")).df.count() == 0


def test_unmarked_headers_of_each_file(spark, tmp_path):
    folder = tmp_path / "plain"
    folder.mkdir()
    (folder / "a.tsv").write_text("Id\tA\nk1\ta1\nId\tA\n")
    (folder / "b.tsv").write_text("A\tId\na2\tk2\nId\tA\n")
    t = text.open_table(spark, str(folder), mark=True, shape="list", key_field="Id")
    assert rows(t.df) == [("A", "Id"), ("Id", "A"), ("k1", "a1"), ("k2", "a2")]


def test_long_strings(spark, tmp_path):
    said = "\n".join(f" line {i} " for i in range(5000)) + "\n\n"
    text.save_result(spark, str(tmp_path / "s"), "string", said)
    assert text.load_result(spark, str(tmp_path / "s"), "string") == said
    text.save_result(spark, str(tmp_path / "n"), "integer", 42)
    text.save_result(spark, str(tmp_path / "b"), "boolean", True)
    assert text.load_result(spark, str(tmp_path / "n"), "integer") == 42 and text.load_result(spark, str(tmp_path / "b"), "boolean") is True


# Stored results --------------------------------------------------------------------


def test_results_follow_their_inputs(spark, tmp_path):
    path, root, made = str(tmp_path / "in"), str(tmp_path / "root"), []
    spark.range(3).write.parquet(path)

    def read(given):
        made.append("read")
        return spark.read.parquet(given["path"])

    def double(given, df):
        made.append("double")
        return df.select((F.col("id") * given.get("times", 2)).alias("id"))

    first = tasks.Task("read", read, paths=("path",))
    task = tasks.Task("double", double, [first], inputs=("times",))
    run = lambda **more: task.run(spark, root, {"path": path, **more})
    assert run().count() == 3 and run().count() == 3 and made == ["read", "double"]
    spark.range(10).write.mode("overwrite").parquet(path)
    old = run()
    assert old.count() == 10 and made == ["read", "double"] * 2
    # One file more, and then one less, of many.
    spark.range(5).coalesce(1).write.mode("append").parquet(path)
    assert run().count() == 15 and old.count() == 10
    newest = max((f for f in os.listdir(path) if f.endswith(".parquet")), key=lambda f: os.path.getmtime(f"{path}/{f}"))
    os.remove(f"{path}/{newest}")
    assert run().count() == 10
    made.clear()
    assert {r.id for r in run(times=3).collect()} == set(range(0, 30, 3)) and made == ["double"]
    # Other code for one step makes that step and what depends on it anew.
    other = tasks.Task("double", lambda given, df: df.select((F.col("id") + 100).alias("id")), [first], inputs=("times",))
    made.clear()
    assert {r.id for r in other.run(spark, root, {"path": path}).collect()} == set(range(100, 110)) and made == []
    assert tasks.code_digest(lambda x: x + 1) == tasks.code_digest(lambda x: x + 1) != tasks.code_digest(lambda x: x + 2)


def test_a_failing_run_leaves_the_old_result(spark, tmp_path):
    root = str(tmp_path)
    keep = lambda make, **more: tasks.persist(spark, root, "r", {}, make, **more)
    assert keep(lambda: spark.range(4)).count() == 4

    def breaks():
        return spark.range(8).withColumn("x", F.when(F.col("id") == 7, F.raise_error(F.lit("stop"))).otherwise(F.lit("a")))

    with pytest.raises(Exception, match="stop"):
        keep(breaks, update=True)
    assert keep(breaks).count() == 4
    assert keep(lambda: spark.range(6), update=True).count() == 6
    assert keep(lambda: spark.range(9), expiration=-1).count() == 9
    held = keep(lambda: spark.range(20).withColumn("even", F.col("id") % 2 == 0), update=True, shards=["even"])
    assert files_read(held.where("even")) < files_read(held) and held.columns == ["id", "even"]


def test_store_asks_once(spark, tmp_path):
    asked = []

    def fetch(lacking):
        ids = [r.id for r in lacking.collect()]
        asked.append(sorted(ids))
        return lacking.where("id <> 'none'").withColumn("value", F.length("id").cast("long"))

    path = str(tmp_path / "store")
    store = tasks.Store(spark, path, "id string, value long", "id")
    frame = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id string")
    assert rows(store.get(frame("a", "bb", "a", None), fetch)) == [("a", 1), ("bb", 2)]
    assert rows(store.get(frame("bb", "none"), fetch)) == [("bb", 2)]
    assert rows(tasks.Store(spark, path, "id string, value long", "id").get(frame("none", "a", "ccc"), fetch)) == [("a", 1), ("ccc", 3)]
    assert asked == [["a", "bb"], ["none"], ["ccc"]]

    def breaks(lacking):
        raise RuntimeError("no answer")

    with pytest.raises(RuntimeError):
        store.get(frame("dddd"), breaks)
    assert rows(store.rows()) == [("a", 1), ("bb", 2), ("ccc", 3)]
    store.compact(1)
    assert rows(store.get(frame("a", "none", "ccc"), breaks)) == [("a", 1), ("ccc", 3)]
    size = entities.Property("size", single=lambda c: F.length(c).cast("long"))
    assert rows(size.stored(frame("ccc", "eeeee", None), "id", store)) == [("ccc", 3), ("eeeee", 5), (None, None)]


# Stored indices ---------------------------------------------------------------------


def test_field_index(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(indices, "BLOCK", 16)
    rng = random.Random(3)
    data = [(i if i % 41 else None, [rng.choice("abcdefgh") if i % 3 else "a" for _ in range(rng.randrange(3))], [str(rng.randrange(50))]) for i in range(1000)]
    t = KeyedFrame(spark.createDataFrame([(*r,) for r in data], "k long, n array<string>, v array<string>"), "k", ["n", "v"], "double")
    indices.write_field_index(t, path := str(tmp_path / "index"), buckets=8)
    index = indices.FieldIndex(spark, path)
    holds = lambda r, wanted, way: r[0] is not None and way(any(x in vals for x in r[1 if f == "n" else 2]) for f, vals in wanted.items())
    for wanted in ({"n": ["a"]}, {"n": ["a", "b"], "v": ["1", "2", "3"]}, {"v": [7], "n": ["zz"]}, {"v": []}):
        said = {f: [str(x) for x in v] for f, v in wanted.items()}
        assert sorted(r.k for r in index.select(wanted).collect()) == sorted(r[0] for r in data if holds(r, said, all))
        assert sorted(r.k for r in index.select(wanted, every=False).collect()) == sorted(r[0] for r in data if holds(r, said, any))
    counts = Counter(x for r in data if r[0] is not None for x in set(r[1]))
    assert dict(rows(index.counts("n"))) == counts
    # A value with a third of all keys has many short lists.
    sizes = [len(r["keys"]) for r in index.lists("n", ["a"]).collect()]
    assert len(sizes) > 10 and max(sizes) < 60
    every = spark.read.parquet(f"{path}/lists")
    assert files_read(index.lists("v", ["7"])) < files_read(every) / 8
    with pytest.raises(KeyError):
        index.lists("other", ["x"])


def test_range_index(spark, tmp_path):
    rng = random.Random(4)
    data = [(rng.choice("xy"), s := rng.randrange(100_000), s + rng.choice([0, 5, 300, 40_000]), i) for i in range(800)]
    frame = spark.createDataFrame(data, "g string, b_start long, b_end long, id long")
    index = indices.RangeIndex(spark, str(tmp_path / "a range"), ["g"], 64)
    with pytest.raises(FileNotFoundError):
        index.over(1, g="x")
    index.append(frame.where("id < 500"), files=24)
    index.append(frame.where("id >= 500").unionByName(spark.createDataFrame([(None, 1, 2, -1), ("x", None, 2, -2), ("x", 9, 3, -3)], frame.schema)), files=24)
    for low, high in ((0, 0), (50_000, 50_000), (20_000, 20_400), (0, 200_000), (99_999, 150_000)):
        for g in "xy":
            got = [r.id for r in index.over(low, high, g=g).collect()]
            assert sorted(got) == sorted(i for o, s, e, i in data if o == g and s <= high and e >= low)
    assert sorted(r.id for r in index.over(50_000, 50_010).collect()) == sorted(i for _, s, e, i in data if s <= 50_010 and e >= 50_000)
    every = len(index.files(-(10**9), 10**9))
    assert 0 < len(index.files(50_000, 50_000, g="x")) < every / 2 and index.files(10**8, 10**8) == []
    points = spark.createDataFrame([("x", p, p) for p in range(0, 100_000, 991)], "g string, pos long, p long")
    got = sorted((r.p, r.id) for r in index.points(points).collect())
    assert got == sorted((p, i) for p in range(0, 100_000, 991) for o, s, e, i in data if o == "x" and s <= p <= e)


# Running tables -----------------------------------------------------------------------


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", state.ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_state_goes_on_after_restarts(spark, tmp_path, rocks):
    rng = random.Random(6)
    data = [(rng.choice("abc"), i, rng.randrange(100), None if i % 7 == 0 else f"v{i}") for i in range(120)]
    rng.shuffle(data)
    schema = "k string, at long, n long, v string"
    src = str(tmp_path / "in")
    runs = {
        "sum": lambda s, p, c: state.running(s, "k", p, c, n=F.sum("n"), rows=F.count(F.lit(1))),
        "first": lambda s, p, c: state.first_wins(s, "k", ["at", "v"], ["at"], p, c),
        "merge": lambda s, p, c: state.merge(s, "k", ["at", "v"], ["at"], p, c),
    }
    for part in range(3):
        spark.createDataFrame(data[part * 40 : (part + 1) * 40], schema).repartition(2).write.mode("append").parquet(src)
        for name, run in runs.items():
            # A new query each time, which goes on from the checkpoint.
            run(streams.tail(spark, src, spark.createDataFrame([], schema), 1), f"{tmp_path}/{name}", f"{tmp_path}/{name}-state").awaitTermination()
        seen = data[: (part + 1) * 40]
        groups = defaultdict(list)
        for k, at, n, v in seen:
            groups[k].append((at, n, v))
        assert {r.k: (r.n, r.rows) for r in state.present(spark, f"{tmp_path}/sum", "k").collect()} == {k: (sum(x[1] for x in g), len(g)) for k, g in groups.items()}
        assert {r.k: tuple(r["first"]) for r in state.present(spark, f"{tmp_path}/first", "k").collect()} == {k: (min(g)[0], min(g)[2]) for k, g in groups.items()}
        assert {r.k: (r.at, r.v) for r in state.present(spark, f"{tmp_path}/merge", "k").collect()} == {k: ([x[0] for x in sorted(g)], [x[2] for x in sorted(g, key=lambda x: x[0])]) for k, g in groups.items()}


def test_many_results_of_a_batch(spark, tmp_path):
    spark.range(10).write.parquet(src := str(tmp_path / "in"))
    wide = lambda df: df.where("id % 2 = 0").select(F.explode(F.array("id", F.col("id") + 100)).alias("x"))
    state.traversed(streams.tail(spark, src, spark.range(1), 100), out := str(tmp_path / "out"), str(tmp_path / "c"), wide).awaitTermination()
    assert sorted(r.x for r in spark.read.parquet(out).collect()) == sorted([*range(0, 10, 2), *range(100, 110, 2)])
    state.traversed(streams.tail(spark, src, spark.range(1), 100), str(tmp_path / "none"), str(tmp_path / "d"), lambda df: None).awaitTermination()
    assert not os.path.exists(tmp_path / "none")


# Density -------------------------------------------------------------------------------


def numpy_modes(x):
    x = np.sort(np.asarray(x, float))
    n, sd = len(x), x.std(ddof=1) if len(x) > 1 else 0.0
    q = lambda p: x[math.ceil(p * n) - 1]
    iqr = (q(0.75) - q(0.25)) / 1.34
    scale = min(sd, iqr) if min(sd, iqr) > 0 else sd if sd > 0 else abs(x[0]) or 1.0
    bw = 0.9 * scale * n**-0.2
    at = np.arange(x[0] - 6 * bw, x[-1] + 6 * bw, bw / 64)
    d = np.array([np.exp(-0.5 * ((p - x) / bw) ** 2).sum() for p in at]) / (n * bw * math.sqrt(2 * math.pi))
    top = [i for i in range(1, len(at) - 1) if d[i] > d[i - 1] and d[i] >= d[i + 1]]
    return bw, [(at[i], d[i]) for i in top]


def test_modes_without_a_range(spark):
    rng = np.random.default_rng(8)
    groups = {"two": np.concatenate([rng.normal(0, 1, 400), rng.normal(10, 2, 300)]), "far": np.concatenate([rng.normal(0, 1, 200), [1e6] * 40]), "few": [1.0, 2.0, 4.0], "one": [7.0], "same": [3.0] * 20, None: rng.normal(-5, 0.1, 50)}
    data = [(g, float(v)) for g, x in groups.items() for v in x] + [("two", None), ("two", float("nan")), ("two", float("inf"))]
    got = defaultdict(list)
    for r in density.modes(spark.createDataFrame(data, "g string, v double"), "g", "v").collect():
        got[r.g].append((r["mode"], r.density))
    for g, x in groups.items():
        if g == "far":  # too wide for a plain grid
            assert any(abs(m - 1e6) < 1 for m, _ in got[g]) and any(abs(m) < 1 for m, _ in got[g])
            continue
        bw, want = numpy_modes(x)
        assert len(got[g]) == len(want), g
        for (m, d), (wm, wd) in zip(sorted(got[g]), want):
            assert abs(m - wm) < bw / 16 and abs(d - wd) < 2e-3 * wd, g


def test_values_far_out_leave_a_peak(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.1, 0.9, 1.0, 50.0, 50.0, 50.1, 49.9)], "g string, v double")
    every = sorted(round(r["mode"]) for r in density.modes(df, "g", "v").collect())
    assert every == [1, 50]
    inside = density.modes(df, "g", "v", 0.0, 10.0).collect()
    whole = [r for r in density.modes(df, "g", "v").collect() if r["mode"] < 10]
    assert [tuple(r) for r in inside] == [tuple(r) for r in whole]


# Models --------------------------------------------------------------------------------


def test_linear_models(spark):
    rng = np.random.default_rng(9)
    data, plain = [], {}
    for g in ("a", "b", None):
        x = rng.normal([1e6, 0, -3], [1, 2, 5], (60, 3))
        y = 4 + x @ [1.5, -2, 0.3] + rng.normal(0, 0.5, 60)
        plain[g] = x, y
        data += [(g, *map(float, r), float(v)) for r, v in zip(x, y)]
    data += [("a", None, 1.0, 1.0, 1.0), ("a", 1.0, float("nan"), 1.0, 1.0), ("none", 1.0, 1.0, 1.0, None)]
    df = spark.createDataFrame(data, "g string, x1 double, x2 double, x3 double, y double")
    xs = ["x1", "x2", "x3"]
    fits = models.linear(df, "g", "y", xs)
    got = {r._by: r for r in fits.collect()}
    assert set(got) == {"a", "b", None}
    out = defaultdict(list)
    for kind in ("confidence", "prediction"):
        for r in models.predict(df, fits, "g", xs, kind).collect():
            out[r.g, kind].append(r)
    for g, (x, y) in plain.items():
        a = np.column_stack([np.ones(60), x - x.mean(0)])
        b, rest, *_ = np.linalg.lstsq(a, y, rcond=None)
        sigma = math.sqrt(rest[0] / 56)
        assert np.allclose(got[g].coefficients, b[1:], rtol=1e-6) and abs(got[g].sigma - sigma) < 1e-6 and got[g].freedom == 56
        inverse, t = np.linalg.inv(a.T @ a), 1.6725  # t(0.95, 56)
        for kind, extra in (("confidence", 0), ("prediction", 1)):
            rows_ = {(r.x1, r.x2): r for r in out[g, kind]}
            for i in range(60):
                r, se = rows_[x[i][0], x[i][1]], sigma * math.sqrt(extra + a[i] @ inverse @ a[i])
                assert abs(r.fit - a[i] @ b) < 1e-6 and abs(r.upper - r.fit - t * se) < 1e-4 and abs(r.fit - r.lower - t * se) < 1e-4
    assert all(r.fit is None for r in out["none", "confidence"])
    # Predictors that depend on each other, and too few rows.
    twin = df.where("g = 'b'").withColumn("x4", F.col("x2") * 2)
    fit = models.linear(twin, None, "y", ["x2", "x4", "x3"]).first()
    assert abs(fit.coefficients[0] + 2 * fit.coefficients[1] - np.linalg.lstsq(np.column_stack([np.ones(60), plain["b"][0][:, 1:]]), plain["b"][1], rcond=None)[0][1]) < 1e-6
    assert models.linear(twin.limit(2), None, "y", ["x2", "x3"]).first().sigma is None
    assert models.linear(df.limit(0), "g", "y", xs).collect() == []


def test_quantiles_of_t():
    # Published tables.
    for freedom, p, want in ((1, 0.95, 6.313752), (2, 0.95, 2.919986), (3, 0.975, 3.182446), (10, 0.95, 1.812461), (30, 0.975, 2.042272), (120, 0.95, 1.657651), (301, 0.975, 1.967877)):
        assert abs(models.t_quantile(p, freedom) - want) < 2e-6 * want
        assert abs(models.t_quantile(1 - p, freedom) + want) < 2e-6 * want
    assert abs(models.t_quantile(0.9, 300) - models.t_quantile(0.9, 301)) < 1e-5


def test_logistic_models(spark):
    rng = np.random.default_rng(10)
    data, want = [], {}
    for g, b in (("a", (0.5, 1.0, -2.0)), ("b", (-1.0, 0.3, 0.0))):
        x = rng.normal([0, 100], [1, 0.5], (400, 2))
        p = 1 / (1 + np.exp(-(b[0] + b[1] * x[:, 0] + b[2] * (x[:, 1] - 100))))
        y = (rng.random(400) < p).astype(int)
        a = np.column_stack([np.ones(400), x[:, 0], x[:, 1] - 100])
        fit = np.zeros(3)
        for _ in range(30):
            q = 1 / (1 + np.exp(-a @ fit))
            fit += np.linalg.solve((a * (q * (1 - q))[:, None]).T @ a, a.T @ (y - q))
        want[g] = fit
        data += [(g, *map(float, r), int(v)) for r, v in zip(x, y)]
    data += [("split", float(i), float(i % 3), int(i > 5)) for i in range(12)]
    df = spark.createDataFrame(data, "g string, x1 double, x2 double, y int")
    fits = models.logistic(df, "g", "y", ["x1", "x2"])
    got = {r._by: r for r in fits.collect()}
    for g, fit in want.items():
        assert got[g].converged and np.allclose(got[g].coefficients, fit[1:], atol=1e-6) and abs(got[g].intercept - (fit[0] - 100 * fit[2])) < 1e-4
    assert not got["split"].converged
    some = models.chances(df, fits, "g", ["x1", "x2"]).where("g = 'a'").collect()
    assert all(abs(r.chance - 1 / (1 + math.exp(-(want["a"] @ [1, r.x1, r.x2 - 100])))) < 1e-6 for r in some)


def test_chained_imputation(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(0, 1, (200, 3)) @ [[1, 0.8, 0.2], [0, 0.5, 0.3], [0, 0, 0.4]]
    gone = rng.random((200, 3)) < 0.2
    data = [(i, *(None if gone[i, j] else float(x[i, j]) for j in range(3)), 5) for i in range(200)]
    got = sorted(models.imputed(spark.createDataFrame(data, "id long, a double, b double, c double, fit int"), None, ["a", "b", "c"], 4).collect())
    held = np.where(gone, np.nan, x)
    full = np.where(gone, np.nanmean(held, 0), x)
    for _ in range(4):
        for j in range(3):
            others = [k for k in range(3) if k != j]
            a = np.column_stack([np.ones(200), full[:, others]])
            b = np.linalg.lstsq(a[~gone[:, j]], x[~gone[:, j], j], rcond=None)[0]
            full[gone[:, j], j] = a[gone[:, j]] @ b
    assert np.allclose([[r.a_filled, r.b_filled, r.c_filled] for r in got], full, atol=1e-9) and all(r.fit == 5 for r in got)
    bare = models.imputed(spark.createDataFrame([(1, 1.0, None), (2, 2.0, None)], "id long, a double, b double"), None, ["a", "b"], 2).collect()
    assert all(r.b_filled is None and r.a_filled == r.a for r in bare)


def test_tails_of_many_cases():
    rng = random.Random(12)
    cases = [(rng.randrange(0, 30), rng.randrange(1, 60), rng.randrange(1, 60), rng.randrange(60, 400)) for _ in range(300)]
    got = aggregates.hypergeometric_tails(*(np.array(c, np.int64) for c in zip(*cases)))
    for (k, drawn, good, total), p in zip(cases, got):
        want = sum(math.comb(good, i) * math.comb(total - good, drawn - i) for i in range(k, min(good, drawn) + 1)) / math.comb(total, drawn)
        assert abs(p - want) < 1e-9 * max(want, 1e-12) + 1e-12


# Matrices, identifiers ------------------------------------------------------------------


def test_sparse_incidence(spark, monkeypatch):
    monkeypatch.setattr(sparse, "SIDE", 8)
    rng = random.Random(13)
    data = [(f"s{rng.randrange(30)}", rng.randrange(500), float(rng.randrange(-3, 4))) for _ in range(900)]
    df = spark.createDataFrame([*data, (None, 1, 1.0), ("s1", None, 1.0), ("s1", 501, None)], "s string, t long, v double")
    own = sparse.incidence(df, "s", "t", "v")
    want = {}
    for s, t, v in data:
        want[s, t] = max(v, want.get((s, t), v))
    assert {(r.source, r.target): r.value for r in own.long().collect()} == want
    assert {(r.source, r.target): r.value for r in own.of(["s1", "s2"]).collect()} == {k: v for k, v in want.items() if k[0] in ("s1", "s2")}
    both = defaultdict(float)
    by_target = defaultdict(list)
    for (s, t), v in want.items():
        by_target[t].append((s, v))
    for held in by_target.values():
        for s, v in held:
            for o, w in held:
                both[s, o] += v * w
    got = {(r.source, r.target): r.value for r in own.product(own.transposed()).long().collect()}
    assert got == {k: v for k, v in both.items() if v}
    assert {r.target: r.value for r in own.sums().collect()} == {t: sum(v for _, v in held) for t, held in by_target.items()}


def test_a_hundred_thousand_columns(spark):
    pairs = spark.range(100_000).select((F.col("id") % 50).alias("s"), F.col("id").alias("t"))
    own = sparse.incidence(pairs, "s", "t")
    assert own.columns.count() == 100_000 and own.entries().count() == 100_000 and len(own.blocks.columns) == 5
    shared = own.product(own.transposed()).long().collect()
    assert {(r.source, r.target, r.value) for r in shared} == {(s, s, 2000.0) for s in range(50)}


def test_equivalence(spark):
    rng = random.Random(14)
    pools = {"gene": 60, "name": 60, "code": 60}
    pick = lambda f: None if rng.random() < 0.1 else f"{f[0]}{rng.randrange(pools[f])}"
    shapes = [("gene", "name"), ("name", "code"), ("code", "gene"), ("name",)]
    data = [[tuple(pick(f) for f in s) for _ in range(18)] for s in shapes]
    frames = [spark.createDataFrame(d, ", ".join(f"{f} string" for f in s)) for s, d in zip(shapes, data)]
    formats = ["code", "gene", "name"]

    def plain(upto):
        parent = {}

        def find(x):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x

        for s, d in list(zip(shapes, data))[:upto]:
            for r in d:
                nodes = [(formats.index(f), v) for f, v in zip(s, r) if v]
                for n in nodes:
                    a, b = sorted((find(nodes[0]), find(n)))
                    parent[b] = a
        return {n: find(n) for n in list(parent)}

    whole = identifiers.equivalence(frames, formats)
    grown = identifiers.equivalence(frames[:1], formats).grown(frames[1:2]).grown(frames[2:])
    want = plain(4)
    for e in (whole, grown):
        got = {((r.node.rank, r.node.id)): (r.root.rank, r.root.id) for r in e.members.collect()}
        assert got == want and e.members.count() == len(want)
    classes = defaultdict(set)
    for n, root in want.items():
        classes[root].add(n)
    index = {r["gene"]: r["name"] for r in whole.index("gene", "name").collect()}
    assert index == {i: min(x for q, x in classes[want[f, i]] if q == 2) for f, i in want if f == 1 and any(q == 2 for q, _ in classes[want[f, i]])}
    clashes = {(r.canonical, r.format): r.n for r in whole.conflicts().collect()}
    assert clashes == {(root[1], formats[f]): n for root, c in classes.items() for f in range(3) if (n := sum(q == f for q, _ in c)) > 1}
    assert identifiers.equivalence([frames[0].limit(0)], formats).members.count() == 0


def test_an_id_of_many_rows(spark):
    """A third of all rows share an id, and the rest are one long chain."""
    a = spark.range(300).select(F.col("id").alias("x"), F.when(F.col("id") % 3 == 0, F.lit("hub")).otherwise(F.concat(F.lit("y"), F.floor(F.col("id") / 2).cast("string"))).alias("y"))
    b = spark.range(299).select(F.col("id").alias("x"), F.concat(F.lit("z"), F.col("id").cast("string")).alias("z"))
    c = spark.range(299).select((F.col("id") + 1).alias("x"), F.concat(F.lit("z"), F.col("id").cast("string")).alias("z"))
    e = identifiers.equivalence([a, b, c], ["x", "y", "z"])
    assert {r.canonical for r in e.canonical().collect()} == {"0"}


# Alignment -------------------------------------------------------------------------------


def test_banded_alignment_equals_the_whole_table():
    rng = random.Random(15)
    letters = lambda s: np.frombuffer(s.encode("utf-32-le"), "<u4")
    for _ in range(60):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 40)))
        b = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 40)))
        score, qs, qe, ts, te, _ = sequence._aligned(a, b, 2, 2, 3)
        got = alignment.banded(letters(a), letters(b), -len(b), len(a), 2, 2, 3)
        assert got[0] == score
        if score:
            again = sequence._aligned(a[got[1] : got[2]], b[got[3] : got[4]], 2, 2, 3)
            assert again[0] == score


def test_many_bands_at_a_time():
    rng = random.Random(17)
    letters = lambda s: np.frombuffer(s.encode("utf-32-le"), "<u4")
    pairs = [tuple("".join(rng.choice("AC") for _ in range(rng.randrange(0, 30))) for _ in range(2)) for _ in range(80)]
    low = np.array([rng.randrange(-25, 25) for _ in pairs])
    got = alignment.best_scores([letters(a) for a, _ in pairs], [letters(b) for _, b in pairs], low, 9, 2, 2, 3)
    assert got.tolist() == [alignment.banded(letters(a), letters(b), int(d), int(d) + 8, 2, 2, 3)[0] if a else 0 for (a, b), d in zip(pairs, low)]


def test_hits_of_a_stated_identity(spark):
    """Queries that are cuts of targets with few differences are all found with
    the score of aligning all pairs."""
    rng = random.Random(16)
    targets = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(80, 200))) for _ in range(40)] + ["A" * 150, "ACGT" * 30]
    queries = []
    for i in range(30):
        t = rng.randrange(len(targets))
        at = rng.randrange(len(targets[t]) - 60)
        cut = list(targets[t][at : at + 60])
        for _ in range(5):
            p = rng.randrange(len(cut))
            cut[p : p + 1] = rng.choice([[rng.choice("ACGT")], [], [cut[p], rng.choice("ACGT")]])
        queries.append("".join(cut))
    q = spark.createDataFrame([*enumerate(queries), (99, None), (98, "ACG")], "q_id long, sequence string")
    t = spark.createDataFrame(list(enumerate(targets)), "t_id long, sequence string").repartition(3)
    best = {r.q_id: r for r in alignment.best_hits(alignment.hits(q, t, "q_id", "t_id", least=40), "q_id", "t_id").collect()}
    for i, s in enumerate(queries):
        scores = [sequence._aligned(s, x, 2, 2, 3)[0] for x in targets]
        assert best[i].score == max(scores) and scores[best[i].t_id] == max(scores)
        assert 70 <= best[i].percent <= 100
    assert not {98, 99} & set(best)


def test_strands_against_all_pairs(spark):
    import hashlib

    got = {r.s_suppkey: r for r in tables.queries()["q144_best_alignment"](spark, SF).collect()}
    strand = lambda k: hashlib.md5(f"c{k}".encode()).hexdigest().translate(str.maketrans("0123456789abcdef", "ACGT" * 4))
    customers = [r.c_custkey for r in spark.read.parquet(f"{SF}/customer.parquet").collect()]
    for r in spark.read.parquet(f"{SF}/supplier.parquet").collect():
        own = strand(r.s_suppkey)
        own = own[:15] + own[15].translate(str.maketrans("ACGT", "CGTA")) + own[16:]
        scores = {c: sequence._aligned(own, strand(c), 2, 2, 3)[0] for c in customers}
        best = max(scores, key=lambda c: (scores[c], -c))
        assert (got[r.s_suppkey].c_custkey, got[r.s_suppkey].score) == (best, scores[best])


# What SQL doesn't check ----------------------------------------------------------------


def test_intervals_of_balances(spark):
    got = {r.c_custkey: r for r in tables.queries()["q136_prediction_intervals"](spark, SF).collect()}
    held = spark.read.parquet(f"{SF}/customer.parquet").collect()
    a = np.array([[1, r.c_nationkey, len(r.c_mktsegment)] for r in held], float)
    y = np.array([r.c_acctbal for r in held])
    b, rest, *_ = np.linalg.lstsq(a, y, rcond=None)
    sigma, inverse, t = math.sqrt(rest[0] / (len(y) - 3)), np.linalg.inv(a.T @ a), models.t_quantile(0.95, len(y) - 3)
    for r, x in zip(held, a):
        se = sigma * math.sqrt(1 + x @ inverse @ x)
        assert abs(got[r.c_custkey].fit - x @ b) < 1e-6 and abs(got[r.c_custkey].upper - (x @ b + t * se)) < 1e-5


def test_logistic_of_returns(spark):
    got = {r.l_suppkey: r for r in tables.queries()["q137_logistic"](spark, SF).collect()}
    held = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/lineitem.parquet").collect():
        held[r.l_suppkey].append((r.l_quantity, r.l_extendedprice, r.l_returnflag == "R"))
    for k, data in held.items():
        x = np.array([[1, q / 50, p / 50_000] for q, p, _ in data])
        y, fit = np.array([f for *_, f in data], float), np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ fit))
            fit += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p))
        assert got[k].converged and np.allclose([got[k].intercept, got[k].coefficients[0] * 50, got[k].coefficients[1] * 50_000], fit, atol=1e-5)


def test_filled_lines(spark):
    got = tables.queries()["q138_imputed"](spark, SF).collect()
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len(got) == lines and all(r.price_filled is not None and r.quantity_filled is not None for r in got)
    assert all(r.price_filled == r.price for r in got if r.price is not None)
    x = np.array([[np.nan if r.price is None else r.price, np.nan if r.quantity is None else r.quantity, r.l_discount] for r in got])
    gone, full = np.isnan(x), np.where(np.isnan(x), np.nanmean(x, 0), x)
    for _ in range(3):
        for j in range(3):
            a = np.column_stack([np.ones(len(x)), full[:, [k for k in range(3) if k != j]]])
            b = np.linalg.lstsq(a[~gone[:, j]], x[~gone[:, j], j], rcond=None)[0]
            full[gone[:, j], j] = a[gone[:, j]] @ b
    assert np.allclose([[r.price_filled, r.quantity_filled] for r in got], full[:, :2], rtol=1e-6)


def test_kept_filter_ids(spark, tmp_path):
    path = str(tmp_path / "a table")
    spark.createDataFrame([(i, "xy"[i % 2]) for i in range(20)], "k long, f string").write.parquet(path)
    stack = lambda: filters.FilterStack(keyed(spark.read.parquet(path), "k")).add("f", "x")
    root = str(tmp_path / "root")
    assert stack().stored_ids(root).count() == 10 and files_read(stack().stored_ids(root)) >= 1
    spark.createDataFrame([(99, "x")], "k long, f string").write.mode("append").parquet(path)
    assert stack().stored_ids(root).count() == 11


def test_a_missing_list_loses_no_other(spark):
    from keyloom.operators import joins, load

    rows_ = [("a", 1, ["x"], None), ("a", 2, None, ["p"]), ("a", 3, ["y", "z"], []), ("b", 4, None, ["q"])]
    df = spark.createDataFrame(rows_, "k string, o int, v array<string>, w array<string>")
    assert rows(load.merge(df, "k", ["v", "w"], ["o"]).df) == [("a", ["x", "y", "z"], ["p"]), ("b", None, ["q"])]
    left = KeyedFrame(spark.createDataFrame([("l", ["m", "n", "none"])], "k string, id array<string>"), "k", ["id"], "double")
    right = KeyedFrame(spark.createDataFrame([("m", None), ("n", ["v1", "v2"])], "id string, v array<string>"), "id", ["v"], "double")
    assert rows(joins.attach(left, right).df) == [("l", ["m", "n", "none"], ["v1", "v2"])]
    index = spark.createDataFrame([("l", "m"), ("l", "n")], "k string, id string")
    assert rows(joins.attach(left, right, ["v"], index=index).df.select("k", "v")) == [("l", ["v1", "v2"])]


# What holds at size -----------------------------------------------------------------------


def test_best_hits_by_long_runs_first(spark):
    """The same as the best of all hits, also for queries that only short runs
    lead to; random runs of k letters are not paired for the others."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    targets = [letters(40) for _ in range(300)]
    queries = []
    for i in range(60):
        own = list(targets[rng.randrange(300)])
        for _ in range(i % 8):
            at = rng.randrange(len(own))
            own[at : at + 1] = rng.choice([[rng.choice("ACGT")], [], [own[at], rng.choice("ACGT")]])
        queries.append("".join(own))
    q = spark.createDataFrame([*enumerate(queries), (97, letters(30)), (98, "ACG"), (99, None)], "q_id long, sequence string")
    t = spark.createDataFrame([*enumerate(targets), (300, targets[0]), (301, None)], "t_id long, sequence string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(alignment.best(q, t, "q_id", "t_id", least=18)) == rows(alignment.best_hits(alignment.hits(q, t, "q_id", "t_id", least=18), "q_id", "t_id"))
    assert rows(alignment.best(q.where("q_id > 97"), t, "q_id", "t_id")) == []


def test_products_follow_entries(spark, monkeypatch):
    """Entries spread over all blocks: block by block this would be 490,000
    products of 256 by 256 numbers. And sums over several lists and flushes."""
    n = 20_000
    own = sparse.incidence(spark.range(n).select(F.col("id").alias("s"), (F.col("id") * 7919 % n).alias("t")), "s", "t")
    began = time.monotonic()
    assert {(r.source, r.target, r.value) for r in own.product(own.transposed()).long().collect()} == {(s, s, 1.0) for s in range(n)}
    assert time.monotonic() - began < 120
    monkeypatch.setattr(sparse, "LIST", 7)
    monkeypatch.setattr(sparse, "PRODUCTS", 50)
    hub = sparse.incidence(spark.range(300).select(F.col("id").alias("s"), (F.col("id") % 2).alias("t")), "s", "t")
    assert {(r.source, r.target, r.value) for r in hub.product(hub.transposed()).long().collect()} == {(a, b, 1.0) for a in range(300) for b in range(a % 2, 300, 2)}
    none = hub.product(sparse.incidence(spark.createDataFrame([], "s long, t long"), "s", "t", rows=hub.columns))
    assert none.long().collect() == []


def test_products_are_not_dealt_out(spark, monkeypatch):
    """3000 columns of 40 rows each: 4,800,000 products of 240,000 entries."""
    monkeypatch.setattr(sparse, "PRODUCTS", 1 << 17)
    pairs = spark.range(120_000).select((F.col("id") % 3000).alias("t"), F.pmod(F.xxhash64("id"), F.lit(400)).alias("s"))
    own = sparse.incidence(pairs, "s", "t")

    def written():
        held = spark.sparkContext._jsc.sc().statusStore().executorList(True)
        return sum(held.apply(i).totalShuffleWrite() for i in range(held.size()))

    began = written()
    got = {(r.source, r.target): r.value for r in own.product(own.transposed()).long().collect()}
    assert written() - began < 8e6
    by_column, want = defaultdict(set), defaultdict(int)
    for r in pairs.collect():
        by_column[r.t].add(r.s)
    for rows in by_column.values():
        for a in rows:
            for b in rows:
                want[a, b] += 1
    assert got == want


def test_index_lists_are_gathered_once(spark):
    """Keys with the same other keys share one list. Each of 20,000 keys has the
    same list of 200,000 letters here: gathered for each they are 4 GB of shuffle."""
    n = 20_000
    a = keyed(spark.range(n).select(F.col("id").alias("k")), "k", [])
    index = spark.range(n).where("id <> 9").select("id", (F.col("id") % 2).alias("o")).union(spark.createDataFrame([(3, 0), (3, None), (3, 7)], "id long, o long"))
    b = keyed(spark.createDataFrame([(0, "x"), (0, "w"), (1, "y"), (None, "z")], "o long, v string").withColumn("v", F.repeat("v", F.lit(200_000))), "o", ["v"])
    found = joins.attach(a, b, ["v"], index=index).df
    began = time.monotonic()
    got = {r.k: r.v for r in found.select("k", F.transform("v", lambda x: F.left(x, F.lit(1))).alias("v")).collect()}
    assert got == {k: [] if k == 9 else ["w", "x", "y"] if k == 3 else ["w", "x"] if k % 2 == 0 else ["y"] for k in range(n)}
    assert time.monotonic() - began < 60


def test_one_group_is_not_dealt_by_its_key(spark, monkeypatch):
    """Imputation without groups sorts no rows by a constant, and each column's
    fit is made once."""
    plans = []
    keep = models.materialize
    monkeypatch.setattr(models, "materialize", lambda df, tag, **b: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or keep(df, tag, **b))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(60).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 2.0).alias("a"), (F.col("id") * 3.0).alias("b"))
        got = models.imputed(df, None, ["a", "b"], 2).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert all(abs(r.a_filled - 2 * r.id) < 1e-6 and r.b_filled == 3 * r.id for r in got) and len(got) == 60
    assert [tag for tag, _ in plans].count("fits") == 4 and not any("SortMergeJoin" in plan for _, plan in plans)


def test_stars_need_no_further_round(spark, monkeypatch):
    tags = []
    keep = identifiers.materialize
    monkeypatch.setattr(identifiers, "materialize", lambda df, tag, **b: tags.append(tag) or keep(df, tag, **b))
    edges = lambda own: spark.createDataFrame(own, "u long, v long")
    assert rows(identifiers.components(edges([(i, i % 2) for i in range(2, 9)]))) == [(i, i % 2) for i in range(2, 9)]
    assert tags == ["stars"]
    assert rows(identifiers.components(edges([(3, 3)]))) == []
    assert rows(identifiers.components(edges([(5, 4), (4, 3), (3, 5), (9, 8), (8, 7), (7, 6)]))) == [(4, 3), (5, 3), (7, 6), (8, 6), (9, 6)]
