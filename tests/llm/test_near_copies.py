"""The pipeline's near copies against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import near_copies, simhash

SF = "/root/testdata/sf0.001"


def shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_all_pairs(texts):
    """Of each key the smallest one that pairs of similarity 0.8 lead to."""
    sets = {k: shingles(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or x and y and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and len(x & y) / len(x | y) >= 0.8:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {k: find(k) for k in keys}


def copies():
    """Texts of 30 to 300 words, each with copies of which some words differ."""
    rng = random.Random(7)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(30, 300))]
        texts.append(" ".join(words))
        for n in range(6):
            own = list(words)
            for _ in range(n * len(own) // 120):
                own[rng.randrange(len(own))] = f"w{rng.randrange(3000)}"
            texts.append(" ".join(own))
    return dict(enumerate(texts))


@pytest.mark.parametrize("name", ["copies", "documents"])
def test_all_pairs(spark, name):
    texts = copies() if name == "copies" else {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = by_all_pairs(texts)
    assert {r.doc_id: r.component_id for r in near_copies.groups(df).collect()} == want
    left = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()}
    assert left == set(want.values())


def test_beyond_the_bits_of_op8(spark):
    words = [f"w{i}" for i in range(200)]
    other = [f"x{i}" if i in (40, 90, 150) else w for i, w in enumerate(words)]
    a, b = " ".join(words), " ".join(other)
    x, y = shingles(a), shingles(b)
    assert len(x & y) / len(x | y) > 0.8 and (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count() > 3
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string")
    assert [r.doc_id for r in simhash.one_of_each(df).collect()] == [1]


def test_one_large_group(spark):
    """Copies of one text that differ in one place each, or not at all."""
    words = [f"w{i}" for i in range(150)]
    texts = [(k, " ".join([*words[: k % 150], f"x{k}", *words[k % 150 + 1 :]])) for k in range(400)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert {r.component_id for r in near_copies.groups(df).collect()} == {0}


def test_rare_shingles_lose_no_pair(spark):
    """All similar pairs of other roots, and in a group of texts that share
    less than that no pair at all."""
    texts = copies()
    sets = {k: near_copies.shingle_set(t) for k, t in texts.items()}
    rows = [(f"{k:04}", len(s), f"{k:04}", s.view(np.int64).tolist()) for k, s in sets.items()]
    held = spark.createDataFrame(rows, "node string, n int, root string, shingles array<long>")
    got = {(int(r.a), int(r.b)) for r in near_copies._sharing_rare(held.drop("shingles"), held.select("node", "shingles"), 0.8).collect()}
    real = {k: shingles(t) for k, t in texts.items()}
    want = {(a, b) for a in real for b in real if a < b and real[a] != real[b] and len(real[a] & real[b]) >= 0.8 * len(real[a] | real[b])}
    assert len(want) > 300 and want <= got
    rng = np.random.default_rng(5)
    common = rng.integers(-(2**62), 2**62, 170)
    apart = [(f"{k:04}", 200, f"{k:04}", [*common.tolist(), *rng.integers(-(2**62), 2**62, 30).tolist()]) for k in range(300)]
    held = spark.createDataFrame(apart, "node string, n int, root string, shingles array<long>")
    assert near_copies._sharing_rare(held.drop("shingles"), held.select("node", "shingles"), 0.8).isEmpty()


def test_band_keys_pass_over_few():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(2000):  # 160 of 200 in common
        own = rng.integers(0, 2**64, 200, np.uint64)
        sets += [own[:180], own[20:]]
    keys = near_copies.band_keys(sets).reshape(-1, 2, near_copies.BANDS)
    assert (keys[:, 0] == keys[:, 1]).any(1).all()


def test_one_id_on_two_texts(spark):
    """A text without any copy stays, whatever else has its id."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, one), (5, one), (5, two), (5, two), (6, three), (6, three.upper()), (7, None), (7, two + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = sorted((r.doc_id, (r.text or "").lower()) for r in simhash.one_of_each(df).collect())
    assert left == [(1, one), (5, two), (6, three), (7, "")]


def test_met_along_chains(spark):
    """All pairs of alone standing fingerprints within the bits, no other; the
    pipeline takes its candidates from them."""
    rng = np.random.default_rng(11)
    prints = []
    for _ in range(300):  # each with one other, up to seven bits away
        a = int(rng.integers(0, 2**64, dtype=np.uint64))
        prints += [a, a ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(0, 8)), replace=False))]
    rows = [(f"{k:03}", 9, int(np.uint64(p).view(np.int64))) for k, p in enumerate(prints)]
    nodes = spark.createDataFrame(rows, "node string, n int, fp long")
    for bits in (3, near_copies.BITS, 5):
        got = {tuple(sorted((int(r.a), int(r.b)))) for r in simhash.met(nodes, bits).collect()}
        want = {(k, k + 1) for k in range(0, 600, 2) if (prints[k] ^ prints[k + 1]).bit_count() <= bits}
        assert len(want) > 100 and got == want


def test_simhash_finds_what_bands_miss(spark):
    """Without any band, texts within the bits are found along the chains."""
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join([*words[:k], "x", *words[k + 1 :]]) for k in (5, 1500, 2900)]
    df = spark.createDataFrame([*enumerate(texts), (3, " ".join(f"y{i}" for i in range(3000)))], "doc_id long, text string")
    signed = near_copies.signatures(df, "doc_id", "text").withColumn("bands", F.expr("array_repeat(0L, 0)"))
    found = {r.node: r.root for r in near_copies.roots(signed, df, "doc_id", "text").collect()}
    held = {r.doc_id: found.get(r.node) for r in signed.collect()}
    assert held[0] and held[0] == held[1] == held[2] and held[3] is None


def test_fingerprint_is_of_the_set():
    text = " ".join(f"w{i}" for i in range(80))
    assert simhash.majority(near_copies.shingle_set(text).astype(">u8").view(np.uint8).reshape(-1, 8)) == simhash.fingerprint(text, near_copies.WORDS)
