"""Ranked search, centroid clustering and sharding against plain versions, and
on nulls, ties, repeated rows, empty tables and clashing names."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import centroids, lexical, sharding
from keyloom.llm import queries as corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same_as_sql(got, duck, name):
    columns = sorted(got.columns)
    picked = ", ".join(f'"{c}"' for c in columns)
    assert sorted(tuple(r) for r in got.select(*columns).collect()) == sorted(duck.sql(f"select {picked} from ({corpus.oracle_sql()[name]})").fetchall())


# Ranked search ----------------------------------------------------------------


def test_ranked_search(spark, duck):
    same_as_sql(corpus.op11_ranked_search(spark, SF), duck, "op11_ranked_search")


def plain_search(docs, items, k):
    term = re.compile(lexical.TERM)
    words = lambda t: term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, words(t)) for i, t in docs if i is not None and words(t)]
    n, total = len(held), sum(len(w) for _, w in held)
    df = Counter(t for _, w in held for t in set(w))
    wanted: dict = {}
    for i, t in items:
        if i is not None:
            wanted.setdefault(i, set()).update(words(t))
    out = []
    for item, terms in wanted.items():
        scored = []
        for i, w in held:
            tf, m = Counter(w), 10 + (90 * len(w) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m)) for t in terms if tf[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


DOCS = [(1, None), (2, ""), (3, " .,!"), (4, "Alpha beta ALPHA"), (5, "alpha beta alpha"), (5, "alpha beta alpha"), (None, "alpha"), (6, "ÄLPHA Élan élan"), (7, "gamma " * 5000 + "delta"), (8, "gamma delta"), (9, "beta")]
ITEMS = [(1, "alpha BETA"), (1, "gamma"), (2, "Élan"), (3, None), (4, "nowhere"), (None, "alpha"), (5, "delta delta gamma"), (6, "beta"), (6, "beta")]


@pytest.mark.parametrize("block", [1, 3, lexical.BLOCK])
def test_search_cases(spark, block, monkeypatch):
    monkeypatch.setattr(lexical, "MATCHES", 4)
    docs = spark.createDataFrame([(i, t, 1, 2, "x", 3, 4) for i, t in DOCS], "doc_id long, text string, n long, item_id int, terms string, score int, rank int")
    items = spark.createDataFrame([(i, t, 7, "y") for i, t in ITEMS], "item_id long, text string, doc_id long, term string")
    for k in (1, 2, 10):
        got = lexical.ranked(docs, items, "doc_id", "text", "item_id", "text", k, block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(tuple(r) for r in got.collect()) == plain_search(DOCS, ITEMS, k)
    assert lexical.ranked(docs.limit(0), items, "doc_id", "text", "item_id", "text").collect() == []
    assert lexical.ranked(docs, items.limit(0), "doc_id", "text", "item_id", "text").collect() == []


def test_many_tied_documents(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same words here").alias("text")).repartition(7)
    got = lexical.ranked(docs, spark.createDataFrame([("a", "words"), ("b", "the same")], "item_id string, text string"), "doc_id", "text", "item_id", "text").collect()
    # Every document has the term, so its weight is 0 there and nothing scores.
    assert got == []
    more = docs.unionByName(spark.createDataFrame([(-1, "others")], "doc_id long, text string"))
    rare = lexical.ranked(more, spark.createDataFrame([("c", "others"), ("d", "none")], "item_id string, text string"), "doc_id", "text", "item_id", "text").collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in rare] == [("c", 1, -1)]
    half = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "even one").otherwise("odd one").alias("text")).repartition(7)
    tied = lexical.ranked(half, spark.createDataFrame([("e", "even")], "item_id string, text string"), "doc_id", "text", "item_id", "text")
    assert [r.doc_id for r in tied.orderBy("rank").collect()] == list(range(0, 20, 2))


def test_radix_order():
    rng = np.random.default_rng(1)
    for high in (1, 1 << 15, 1 << 17, 1 << 40):
        keys = rng.integers(0, high, 5000, dtype=np.uint64)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
        found, sums = lexical.sums_by_key(keys, np.ones(5000, np.int64))
        assert dict(zip(found.tolist(), sums.tolist())) == Counter(keys.tolist())


# Centroid clustering -----------------------------------------------------------


def test_clusters(spark, duck):
    same_as_sql(corpus.op12_yinyang(spark, SF), duck, "op12_yinyang")


def plain_clusters(vectors, k, rounds, scale=1024, salt=3):
    x = np.array([[math.floor(scale * c) for c in v] for _, v in vectors], np.int64)
    order = sorted(range(len(x)), key=lambda i: (hashlib.sha256(f"{salt}:{vectors[i][0]}".encode()).hexdigest(), x[i].tolist()))
    centres = x[order[:k]].tolist()
    near = lambda: [min(((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centres)))[1] for v in x.tolist()]
    for _ in range(rounds):
        own = near()
        for j in range(len(centres)):
            members = x[[i for i, o in enumerate(own) if o == j]]
            if len(members):
                centres[j] = [int(s) // len(members) for s in members.sum(0)]
    return near(), centres


@pytest.mark.parametrize(("k", "rounds", "dims"), [(1, 3, 2), (5, 0, 3), (13, 6, 4), (40, 12, 2)])
def test_clusters_of_any_number(spark, k, rounds, dims):
    rng = np.random.default_rng(k)
    # Few distinct values, so that ties and empty clusters occur.
    data = [(i, (rng.integers(-3, 4, dims) / 4).tolist()) for i in range(150)]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in data], "id long, e array<double>, cluster int, upper double").repartition(5)
    found, centres = centroids.clustered(frame, "id", "e", k, rounds, dims, keep=["id", "cluster", "upper"])
    own, want = plain_clusters(data, k, rounds)
    assert centres.tolist() == want
    rows = {r.id: r for r in centroids.summary(found, centres).collect()}
    assert [rows[i].cluster for i in range(150)] == own
    far = [sum((math.floor(1024 * a) - c) ** 2 for a, c in zip(v, want[own[i]])) for i, v in data]
    assert [rows[i].distance for i in range(150)] == far and {r.inertia for r in rows.values()} == {sum(far)}
    assert all(rows[i].cluster_inertia == sum(f for f, o in zip(far, own) if o == own[i]) for i in range(150))
    assert all(r.centroid_sha256 == hashlib.sha256(",".join(map(str, want[r.cluster])).encode()).hexdigest() for r in rows.values())


def test_bounds_spare_distances():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c * 100, 3, (400, 8)) for c in range(12)]).astype(np.int64)
    centres = x[:: len(x) // 24].copy()
    groups = centroids.grouped(centres, 6)
    assert sorted(np.concatenate(groups).tolist()) == list(range(len(centres)))
    own, upper, lower = np.zeros(len(x), np.int64), np.full(len(x), np.inf), np.zeros((len(x), len(groups)))
    moved, taken = np.zeros(len(centres)), []
    for _ in range(8):
        own, upper, lower, n = centroids.assigned(x, own, upper, lower, centres, moved, groups)
        taken.append(n)
        d = ((x[:, None, :] - centres[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (upper >= root[np.arange(len(x)), own] * (1 - 1e-9)).all()
        for g, members in enumerate(groups):
            others = np.where(members[None, :] == own[:, None], np.inf, root[:, members]).min(1)
            assert (lower[:, g] <= others * (1 + 1e-9) + 1e-9).all()
        new = np.array([x[own == c].sum(0) // max(1, (own == c).sum()) if (own == c).any() else centres[c] for c in range(len(centres))])
        moved, centres = np.sqrt(((new - centres) ** 2.0).sum(1)) * (1 + centroids.MARGIN), new
    assert taken[-1] < len(x) * len(centres) / 8


def test_cluster_cases(spark):
    bad = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, [])]
    good = [(7, [0.5, -0.5]), (7, [0.5, -0.5]), (8, [1e300, 0.0]), (None, [-0.1, 0.1])]
    schema = "id long, e array<double>, row int, v int, was string"
    frame = spark.createDataFrame([(i, v, 1, 2, "w") for i, v in bad + good], schema)
    found = centroids.clustered(frame, "id", "e", 8, 4, 2, keep=["id", "row", "v", "was"])
    got = centroids.summary(*found).collect()
    assert Counter(r.id for r in got) == {7: 2, 8: 1, None: 1} and len(found[1]) == 4
    assert {r.distance for r in got} == {0} and {(r.row, r.v, r.was) for r in got} == {(1, 2, "w")}
    for nothing in (frame.limit(0), frame.where("id < 7")):
        assert centroids.summary(*centroids.clustered(nothing, "id", "e", 8, 4, 2)).collect() == []


# Sharding -------------------------------------------------------------------


def check_shards(rows, n, shards):
    sizes = Counter(r.shard for r in rows)
    assert len(rows) == n and [sizes[s] for s in range(shards)] == [n // shards + (s < n % shards) for s in range(shards)]
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


def test_sharding(spark, duck):
    got = corpus.op13_sharding(spark, SF).collect()
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    check_shards(got, len(texts), 8)
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        own = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(own) + 1, zlib.crc32(own), "rows", None)
    assert sorted(map(tuple, corpus.op13_sharding(spark, SF).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_shard_cases(spark, tmp_path):
    data = [(None, None), (1, ""), (1, "same"), (1, "same"), (2, "é" * 100_000), (3, None)]
    frame = spark.createDataFrame([(i, t, 5, 6, 7, "r") for i, t in data], "doc_id long, text string, shard int, slot int, g int, row string")
    for shards in (1, 4, 9):
        got = sharding.shuffled(frame, shards).collect()
        check_shards(got, len(data), shards)
        assert Counter((r.doc_id, r.text) for r in got) == Counter(data) and {(r.g, r.row) for r in got} == {(7, "r")}
    assert sharding.shuffled(frame.limit(0)).collect() == []
    rows = sharding.summary(sharding.shuffled(frame), "doc_id", "text").collect()
    assert sorted(r["size"] for r in rows) == [1, 1, 1, 5, 5, 200_001] and {r.text_crc32 for r in rows if r["size"] == 1} == {0}
    # Files of any number and size, and rows that aren't a table as it is read.
    spark.range(1000).repartition(13).write.parquet(path := str(tmp_path / "many"))
    check_shards(got := sharding.shuffled(spark.read.parquet(path), 7, as_read=True).collect(), 1000, 7)
    assert {r.id for r in got} == set(range(1000))
    with pytest.raises(ValueError):
        sharding.shuffled(spark.read.parquet(path).where("id % 7 <> 1"), 7, as_read=True)


def test_too_many_files(spark, tmp_path, monkeypatch):
    spark.range(60).repartition(6).write.parquet(path := str(tmp_path / "files"))
    monkeypatch.setattr(sharding, "FILES", 4)
    check_shards(got := sharding.shuffled(spark.read.parquet(path), 8, as_read=True).collect(), 60, 8)
    assert {r.id for r in got} == set(range(60))


def test_slots_are_in_order_within_partitions(spark):
    got = sharding.shuffled(spark.range(5000), 3).withColumn("p", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    rows = got.orderBy("at").collect()
    for a, b in zip(rows, rows[1:]):
        assert a.p != b.p or (a.shard, a.slot) < (b.shard, b.slot)


def test_matrix_sums_and_chances():
    rng = random.Random(5)
    for _ in range(50):
        sources = [rng.randrange(0, 40) for _ in range(rng.randrange(1, 9))]
        n = sum(sources)
        shards = [n // 3 + (s < n % 3) for s in range(3)]
        matrix = sharding.communication(sources, shards, rng.randrange(1 << 30))
        assert [sum(r) for r in matrix] == sources and [sum(c) for c in zip(*matrix)] == (shards if matrix else [0] * 3)
    drawn = Counter(sharding.hypergeometric(rng, 7, 20, 9) for _ in range(40_000))
    for k in range(8):
        want = math.comb(7, k) * math.comb(13, 9 - k) / math.comb(20, 9)
        assert abs(drawn[k] / 40_000 - want) < 5 * (want * (1 - want) / 40_000) ** 0.5 + 1e-9
    large = [sharding.hypergeometric(rng, 10**9, 10**10, 10**6) for _ in range(200)]
    assert abs(np.mean(large) - 1e5) < 5 * 300 / 200**0.5


def test_shuffle_is_uniform(spark):
    """Where rows stand before says nothing about shard and slot, nor about the
    neighbour: counts over tenths of both are as even as by chance."""
    n, shards = 6000, 3
    got = sharding.shuffled(spark.range(n).coalesce(1), shards).collect()
    at = {(r.shard, r.slot): r.id for r in got}
    spots = Counter((r.id * 10 // n, r.shard, r.slot * 10 * shards // n) for r in got)
    pairs = Counter((at[s, k] * 10 // n, at[s, k + 1] * 10 // n) for s in range(shards) for k in range(n // shards - 1))
    for counts, cells in ((spots, 300), (pairs, 100)):
        mean = sum(counts.values()) / cells
        chi = sum((counts[c] - mean) ** 2 for c in counts) / mean + (cells - len(counts)) * mean
        assert abs(chi - cells) < 5 * (2 * cells) ** 0.5
    other = {r.id: (r.shard, r.slot) for r in sharding.shuffled(spark.range(n).coalesce(1), shards, seed=14).collect()}
    assert sum(other[r.id] == (r.shard, r.slot) for r in got) < 12


def test_permutation_of_any_size(spark):
    for n in (1, 2, 3, 5, 17, 100, 1000, 4097):
        got = sharding.permuted(spark.range(n), "p", F.col("id"), F.lit(n).cast("long"), [F.lit(1)]).collect()
        assert sorted(r.p for r in got) == list(range(n))
        assert n < 100 or sum(r.p == r.id for r in got) < 12


def test_plan_has_one_exchange_of_rows(spark):
    plan = corpus.op13_sharding(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "Python" not in plan and "Pandas" not in plan
