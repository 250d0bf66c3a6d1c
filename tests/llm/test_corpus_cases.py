"""Nulls, empty and very long texts, repeated rows, empty tables and columns
with clashing names, for every corpus operator and pipeline stage."""

from __future__ import annotations

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from keyloom.llm import byte_bpe, hnsw, language_id, license_scan, packing, quality_rules, reply_trees, simhash, toxicity, url_lists, vectext
from keyloom.llm import queries as corpus
from keyloom.llm.common import lowest_by_hash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, node long, n_words long, task long, _text string, _row string, count long, kept boolean, score double"
LONG = "The quick brown fox is under the MIT license today. " * 4000
TEXTS = [(1, None), (2, ""), (3, "   \n\t"), (4, "one word."), (4, "one word."), (5, LONG), (6, LONG), (None, "no id here."), (None, "no id here."), (7, "ünïcode → \U0001f600 naïve"), (8, "12345 !!!")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, None if k == 3 else "en", None, None, 1, 2, 3, 4, "x", "y", 5, True, 0.5) for k, t in TEXTS], SCHEMA)


def both(df, run):
    """The rows, and that an empty table gives none."""
    assert run(df.limit(0)).collect() == []
    return run(df).collect()


def test_quality(docs):
    got = both(docs, quality_rules.quality)
    assert len(got) == len(TEXTS)
    assert all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert {r.n_words for r in got if r.doc_id in (1, 2, 3)} == {0}
    kept = both(docs, lambda d: quality_rules.cleaned(d, "text", "n_chars"))
    assert all(len(r) == len(docs.columns) for r in kept)


def test_toxicity(docs):
    net = toxicity.train(["you are vile filth", "a fine day"] * 20, [1, 0] * 20)
    got = both(docs, lambda d: toxicity.score(d, net, "text", ["doc_id"]))
    assert len(got) == len(TEXTS) and all(r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert both(docs, lambda d: toxicity.clean(d, None, "text")) == docs.collect()
    # With a network: rows under the threshold stay as they are, whatever else they hold.
    scores = {r._text: r.score for r in toxicity.score(docs.select("text", F.col("text").alias("_text")), net, "text", ["_text"]).collect()}
    assert sorted(both(docs, lambda d: toxicity.clean(d, net, "text")), key=str) == sorted((r for r in docs.collect() if scores[r.text] < 0.5), key=str)
    assert toxicity.train([], []) is None and toxicity.train(["a"], [1]) is None


def test_simhash(docs):
    got = both(docs.where("doc_id is not null"), simhash.near_duplicates)
    by_id = {r.doc_id: (r.fingerprint, r.component_id) for r in got}
    assert by_id[1] == by_id[2] == by_id[3] == ("0" * 16, 1) and by_id[5] == by_id[6]
    assert sum(r.doc_id == 4 for r in got) == 2
    left = Counter(r.doc_id for r in both(docs, simhash.one_of_each))
    assert left[1] == left[4] == left[5] == 1 and not left[2] and not left[6] and left[None] == 2


def test_packing(docs):
    got = both(docs, lambda d: packing.pack(d, "doc_id", "text", corpus.WORD_BPE))
    assert {(r.piece, r.start, r.length) for r in got if r.doc_id in (1, 2)} == {(0, 0, 1)}
    assert sum(r.doc_id == 4 for r in got) == 2
    places = Counter(r.sequence_id for r in got)
    for s in places:
        at = 0
        for offset, length in sorted((r.offset, r.length) for r in got if r.sequence_id == s):
            assert offset == at
            at += length
        assert at <= 4096


def test_language(docs):
    model = language_id.fit(docs, "doc_id", "text", "lang", F.lit(True))
    got = both(docs, lambda d: language_id.predict(d, model, "text", ["doc_id"]))
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 8)} == {"und"} and len(got) == len(TEXTS)
    assert language_id.fit(docs.limit(0), "doc_id", "text", "lang", F.lit(True)) is None
    assert {r.lang_pred for r in language_id.predict(docs, None, "text", ["doc_id"]).collect()} == {"und"}


def test_byte_bpe(docs):
    got = both(docs, lambda d: byte_bpe.round_trip_digests(d, "doc_id", "text", corpus.BYTE_BPE, public_tokenizers.PATTERN))
    assert len(got) == len(TEXTS) and {r.n_tokens for r in got if r.doc_id in (1, 2)} == {0}
    ids = byte_bpe.encode(docs, "text", corpus.BYTE_BPE, public_tokenizers.PATTERN, ["doc_id", "text"])
    back = byte_bpe.decode(ids, "ids", corpus.BYTE_BPE, public_tokenizers.PATTERN, ["doc_id", "text"]).collect()
    assert all(r.decoded.decode() == (r.text or "") for r in back)


def test_license(docs):
    run = lambda d: license_scan.summary(license_scan.scan(d, "text", ["doc_id"]), ["doc_id"])
    got = both(docs, run)
    assert {r.n_base for r in got if r.doc_id == 5} == {4000}
    assert {(r.n_words, r.first_word, r.labels, r.score) for r in got if r.doc_id in (1, 2, 3)} == {(0, None, "", 0.0)}


def test_neighbours(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (50, [0.0, 0.0]), (100, [1.0, None]), (150, None), (200, [float("nan"), 1.0]), (250, []), (300, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(k, v, 7) for k, v in rows], "vec_id long, embedding array<float>, rank int")
    got = both(df, lambda d: hnsw.nearest(d, d.where("vec_id % 50 = 0"), "vec_id", "embedding", 5))
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert [round(r.score, 12) for r in sorted(got, key=lambda r: r.rank)] == [1, 1, 0]


def test_conversations(spark):
    rows = [(1, 0, None, None), (1, 1, "assistant", "<|end|>\\b"), (1, 1, "assistant", "<|end|>\\b"), (2, None, "user", ""), (None, 0, "user", "x")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, root long")
    got = {r.conv_id: r for r in both(df, lambda d: reply_trees.digests(reply_trees.conversations(d)))}
    assert got[1].n_turns == 3 and got[1].loss_chars == 2 * len("<|end|>\\b") and got[2].n_turns == 1
    assert got[None].n_turns == 1


def test_url_lists(spark):
    captures = spark.createDataFrame([(1, "http://a.b.com/x", 10), (2, "http://a.b.com/x", 21), (3, "HTTPS://u@B.com:80", 5), (4, None, 5), (5, "no url", 5), (6, "http://c.org", None), (6, "http://c.org", None)], "id int, url string, day long")
    entries = spark.createDataFrame([("b.com", 5, True), ("b.com", 20, False), ("a.b.com", 10, True), ("a.b.com", 10, False), (None, 1, True), ("c.org", None, True)], "name string, day long, listed boolean")
    run = lambda c, e: sorted((r.id, r.blocked, r.n_entries, r.entry, r.listed_since) for r in url_lists.evaluate(c, e, "url", "day", ["id"]).collect())
    none = (False, 0, None, None)
    assert run(captures, entries) == [(1, True, 2, "a.b.com", 10), (2, True, 1, "a.b.com", 10), (3, True, 1, "b.com", 5), (4, *none), (5, *none), (6, *none), (6, *none)]
    assert run(captures.limit(0), entries) == [] and all(not r[1] for r in run(captures, entries.limit(0)))
    extra = {c: F.lit("x") for c in ("host", "name", "since", "until", "slice", "fetched", "blocked", "entry")}
    assert run(captures.withColumns(extra), entries.withColumns({c: F.lit(1) for c in ("host", "slice", "since", "until", "fetched")})) == run(captures, entries)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns, name
    assert 0 < len({r.doc_id for r in corpus_pipeline.run(spark, sf).collect()}) < docs.count()


def test_packed_nothing(spark, docs):
    import corpus_pipeline

    assert corpus_pipeline.packed(spark, docs.limit(0), "").collect() == []


def test_language_repeats(spark):
    """An id with two languages isn't learned from; repeats of an id count once."""
    rows = [(i, f"the and of {'abc'[i % 3]}", "en") for i in range(6)] + [(i, f"der und die {'xyz'[i % 3]}", "de") for i in range(6, 12)]
    rows += [(0, "the and of a", "en")] * 50 + [(20, "the and of", "de"), (20, "the and of", "en")] + [(7, "another und text", "de")]
    own = lowest_by_hash(spark.createDataFrame(rows, "k long, t string, lang string"), "k", "lang", 1000).collect()
    assert sorted((r.k, r.lang) for r in own) == [(i, "en" if i < 6 else "de") for i in range(12)]
    model = language_id.fit(spark.createDataFrame(rows, "k long, t string, lang string"), "k", "t", "lang", F.lit(True))
    assert model.languages == ["de", "en"] and model.temperature == 1.0


def test_lowest_by_hash(spark):
    df = spark.range(20_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    got = lowest_by_hash(df, "id", "y", 300).collect()
    assert Counter(r.y for r in got) == {0: 300, 1: 300}
    for y in (0, 1):
        order = [r.id for r in df.where(f"y = {y}").orderBy(F.pmod(F.xxhash64("id"), F.lit(1 << 30)), F.xxhash64("id"), "id").limit(300).collect()]
        assert [r.id for r in sorted((r for r in got if r.y == y), key=lambda r: r.turn)] == order


def alternating(n):
    """A word and its complement whose hashes agree, whatever the multiplier."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_one_hash():
    a, b = alternating(4096)
    block = vectext.Block([a, b])
    assert len(set(block.hashes(block.starts, block.ends).tolist())) == 1
    texts = [a, b, f"{b} {a}", f"{a}x", b]
    ids, counts = byte_bpe.codec(corpus.BYTE_BPE, public_tokenizers.PATTERN).encode_block(texts)
    assert byte_bpe.codec(corpus.BYTE_BPE, public_tokenizers.PATTERN).decode_block(ids, counts) == [t.encode() for t in texts]
    whole = Tokenizer.from_file(corpus.WORD_BPE)
    assert [x.tolist() for x in packing.TextIds(corpus.WORD_BPE).encode_block(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
    cache = vectext.WordCache(lambda words: (np.array([ord(w[0]) for w in words]), np.ones(len(words), int)), np.int64)
    for one in (vectext.Block([a, b, a]), vectext.Block([b, "q", a])):
        at, _ = cache.lookup(one, one.starts, one.ends)
        assert [chr(x) for x in cache.pool[at]] == [t[0] for t in one.text().split("\n")[1:4]]


def test_toxicity_of_words_of_one_hash():
    a, b = alternating(4096)
    net = toxicity.train([f"{a} fine day"] * 20 + [f"{b} vile filth"] * 20, [0] * 20 + [1] * 20)
    apart = [toxicity.Scorer(net).scores([t])[0] for t in (a, b)]
    assert np.allclose(toxicity.Scorer(net).scores([a, b]), apart) and np.allclose(toxicity.Scorer(net).scores([b, a])[::-1], apart)


def test_toxicity_of_very_long_text():
    """Windows scored in slices give what they give together."""
    net = toxicity.train(["you are vile filth", "a fine day"] * 20, [1, 0] * 20)
    words = np.random.default_rng(1).choice("you are vile filth a fine day it was".split(), 20_000)
    texts = [" ".join(words), " ".join(words[:100]), ""]
    whole, sliced = toxicity.Scorer(net), toxicity.Scorer(net)
    whole.TOGETHER, sliced.TOGETHER = 1 << 20, 50
    assert np.allclose(whole.scores(texts), sliced.scores(texts)) and whole.scores(texts)[2] == 0


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -np.inf)
    return s


def test_neighbours_over_shards(spark):
    """Four shards of 128 components, merged, against all rows."""
    x = np.random.default_rng(8).standard_normal((4096, 128)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
    got = hnsw.nearest(df, df.where("vec_id % 50 = 0"), "vec_id", "embedding", 5, shard=1024).collect()
    assert hnsw.build_index(df, "vec_id", "embedding", 5, 1024).count() == 4
    s = brute(x.astype(float), 5)
    found = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert len(found) == len(range(0, 4096, 50)) and all(len(v) == 5 for v in found.values())
    hits = sum(len(v & set(np.argsort(-s[q])[:5].tolist())) for q, v in found.items())
    assert hits >= 0.95 * 5 * len(found)


def test_neighbours_that_tie(spark):
    """Scaled copies tie at cosine 1 in every shard: the smallest ids win; and
    components are kept in double precision."""
    rows = [(i, [2.0 ** (i % 20), 2.0 ** (i % 20 + 1)]) for i in range(40)] + [(100 + i, [1.0, -float(i)]) for i in range(40)]
    rows += [(200, [1.0, 1e-12]), (201, [1.0, 2e-12]), (250, [1.0, 3e-12])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(df, df.where("vec_id in (30, 200)"), "vec_id", "embedding", 5, shard=25).collect()
    own = {q: [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in (30, 200)}
    assert own[30] == [0, 1, 2, 3, 4] and {201, 250, 100} <= set(own[200])


def test_addresses_and_long_histories(spark):
    captures = spark.createDataFrame([(1, "http://[::1]:80/x", 10), (2, "http://1.2.3.4/", 10), (3, "http://u:p@1.2.3.4:8080/a?b", 10), (4, "http://a.co.uk/", 500), (5, "http://b.a.co.uk/", 501)], "id int, url string, day long")
    changes = [("a.co.uk", d, d % 2 == 0) for d in range(0, 2001)] + [("a.co.uk", 500, False), ("co.uk", 0, True)]
    entries = spark.createDataFrame([("[::1]", 1, True), ("3.4", 1, True), ("1.2.3.4", 2, True), *changes], "name string, day long, listed boolean")
    got = {r.id: (r.host, r.n_entries, r.entry, r.listed_since) for r in url_lists.evaluate(captures, entries, "url", "day", ["id"]).collect()}
    assert got == {1: ("[::1]", 1, "[::1]", 1), 2: ("1.2.3.4", 1, "1.2.3.4", 2), 3: ("1.2.3.4", 1, "1.2.3.4", 2), 4: ("a.co.uk", 2, "a.co.uk", 500), 5: ("b.a.co.uk", 1, "co.uk", 0)}


def test_loss_spans(spark):
    turns = [("user", "a<b|c"), ("assistant", "x\\y"), ("assistant", ""), ("user", None), ("assistant", "<|end|>z")]
    df = spark.createDataFrame([(1, i, *t) for i, t in enumerate(turns)], "conv_id long, turn long, role string, text string")
    row = reply_trees.conversations(df).first()
    covered = [row.formatted[s.start : s.start + s["size"]] for s in row.loss_spans]
    for code, plain in (("\\p", "|"), ("\\l", "<"), ("\\b", "\\")):
        covered = [c.replace(code, plain) for c in covered]
    assert covered == ["x\\y", "", "<|end|>z"]
    parts = row.formatted.split("<|end|>")
    assert [parts[s.turn][s["at"] : s["at"] + s["size"]] for s in row.loss_spans] == [row.formatted[s.start : s.start + s["size"]] for s in row.loss_spans]


def test_one_long_conversation(spark):
    df = spark.range(3000).select(F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), "id").alias("text"))
    got = reply_trees.digests(reply_trees.conversations(df)).first()
    assert got.n_turns == 3000 and got.loss_chars == sum(len(f"t{i}") for i in range(1, 3000, 2))


def test_repeated_messages(spark):
    rows = [(1, None, 1.0, "user", "q"), (2, 1, 1.0, "assistant", "b"), (2, 1, 1.0, "assistant", "a"), (2, 1, 1.0, "assistant", "a")]
    own = reply_trees.unique(spark.createDataFrame(rows, "id long, parent long, score double, role string, text string"))
    shown = reply_trees.format_paths(reply_trees.paths(own), own).select(reply_trees.read_back("formatted").alias("t")).collect()
    assert [[tuple(x) for x in r.t] for r in shown] == [[("user", "q"), ("assistant", "a")]]


#: A sentence of each script, with its own last mark where it has one.
SCRIPTS = {
    "Hindi": "यह एक साधारण वाक्य है जो यहाँ लिखा गया है।",
    "Arabic": "هل هذه جملة عادية مكتوبة هنا في هذا النص؟",
    "Urdu": "یہ ایک عام جملہ ہے جو یہاں لکھا گیا ہے۔",
    "Armenian": "Սա սովորական նախադասություն է որ գրված է այստեղ։",
    "Thai": "นี่ คือ ประโยค ธรรมดา ที่ เขียน ไว้ ใน ข้อความ นี้",
    "Lao": "ນີ້ ແມ່ນ ປະໂຫຍກ ທຳມະດາ ທີ່ ຂຽນ ໄວ້ ທີ່ ນີ້",
    "Amharic": "ይህ እዚህ የተጻፈ ተራ ዓረፍተ ነገር ነው።",
    "Burmese": "ဤ စာကြောင်း သည် သာမန် စာကြောင်း တစ်ခု ဖြစ် သည်။",
    "Japanese": "これ は ここ に 書かれ た 普通 の 文 です。",
    "Khmer": "នេះ ជា ប្រយោគ ធម្មតា ដែល បាន សរសេរ នៅ ទីនេះ។",
    "Russian": "Это обычное предложение которое здесь написано!",
    "English": "This is a plain sentence that is written here.",
}


def test_quality_in_many_scripts(spark):
    """Prose stays in any script, and the same lines without their mark go in
    those scripts that have one."""
    lines = {k: "\n".join(" ".join(f"{i}{w}" for w in v.split()) for i in range(10)) for k, v in SCRIPTS.items()}
    bare = {k: "\n".join(x[:-1] + "," for x in v.split("\n")) for k, v in lines.items() if k not in ("Thai", "Lao")}
    df = spark.createDataFrame([*((k, "whole", v) for k, v in lines.items()), *((k, "bare", v) for k, v in bare.items())], "doc_id string, kind string, text string")
    got = quality_rules.quality(df, "text", ["doc_id", "kind"]).collect()
    assert all(not r.base_failed for r in got)
    assert {r.doc_id for r in got if r.kind == "whole" and r.kept} == set(SCRIPTS)
    assert not any(r.kept for r in got if r.kind == "bare")


def test_simhash_without_ids(spark):
    rows = [(None, "a lone text without any id"), (None, "shared words of one text"), (4, "shared words of one text"), (2, "quite another text here"), (None, None), (9, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    by_print = {}
    for r in got:
        by_print.setdefault(r.fingerprint, set()).add(r.component_id)
    assert by_print["0" * 16] == {9} and {frozenset(v) for v in by_print.values()} == {frozenset([9]), frozenset([None]), frozenset([4]), frozenset([2])}


def test_a_dense_head_meets_strangers_only(spark):
    """Many fingerprints of one component and one stranger in the same heads:
    the links are those of all pairs."""
    base = 0x0123456789ABCDEF
    prints = sorted({base ^ (1 << i) ^ (1 << j) for i in range(16, 64) for j in range(16, 64)} | {base, base ^ 0xFFFF_0000, 0x0123_4567_0000_0000})
    signed = [p - (1 << 64) if p >= 1 << 63 else p for p in prints]
    nodes = spark.createDataFrame(list(enumerate(signed)), "node long, fp long")
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 3:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    found = {r.node: r.root for r in simhash.linked(nodes).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == [find(i) for i in range(len(prints))]
