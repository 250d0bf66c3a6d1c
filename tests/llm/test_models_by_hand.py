"""The two classifiers against plain loops: what they see of a text, what they
make of it, and how they learn."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import language_id, toxicity

# Language identification --------------------------------------------------------


def plain_buckets(text: str) -> list[int]:
    """Each n-gram's bucket, found character by character."""
    mask = (1 << 64) - 1
    codes = []
    for c in text:
        low = c.lower()
        codes.append((ord(low) if len(low) == 1 else ord(c)) if c.isalpha() else 32)
    one = lambda c: int(language_id._mix(np.array([c], np.uint32))[0])
    out = []
    for n in language_id.ORDERS:
        for i in range(len(codes) - n + 1):
            g = codes[i : i + n]
            if any(a == b == 32 for a, b in zip(g, g[1:])) or g == [32]:
                continue
            h = 0
            for c in g:
                h = (h * 0x9FB21C651E98DF25 + one(c)) & mask
            out.append(((h * 0x9E3779B97F4A7C15) & mask) >> (64 - language_id.BUCKET_BITS))
    return out


TEXTS = ["Der schnelle Fuchs springt über den Zaun.", "The quick brown fox jumps over it!", "  ", "", "ÀÉ ñandú 42", "БЫСТРЫЙ ΛΌΓΟΣ 日本 \U0001f600", "a"]


def test_grams_are_those_of_a_plain_count():
    block, found, letters = language_id.grams(TEXTS)
    for i, t in enumerate(TEXTS):
        got = sorted(int(b) for at, buckets in found for a, b in zip(at.tolist(), buckets.tolist()) if block.starts[i] <= a < block.ends[i])
        assert got == sorted(plain_buckets(t)) and letters[i] == sum(c.isalpha() for c in t)
    upper, lower = (language_id.grams([x])[1] for x in ("БЫСТРЫЙ ΛΌΓΟΝ", "быстрый λόγον"))
    assert all((a == c).all() and (b == d).all() for (a, b), (c, d) in zip(upper, lower))


def test_probabilities_by_hand():
    rng = np.random.default_rng(3)
    weights = rng.normal(0, 1, (language_id.BUCKETS, 3)).astype(np.float32)
    model = language_id.Model(["de", "en", "fr"], weights, np.array([0.1, -0.2, 0.3]), 1.7)
    got, _ = model.probabilities(TEXTS)
    for t, row in zip(TEXTS, got):
        buckets = plain_buckets(t)
        z = [(sum(float(weights[b][k]) for b in buckets) / max(1, len(buckets)) + model.bias[k]) / 1.7 for k in range(3)]
        e = [math.exp(x - max(z)) for x in z]
        assert np.allclose(row, [x / sum(e) for x in e], atol=1e-5)


def test_learning_by_hand(monkeypatch):
    monkeypatch.setattr(language_id, "BUCKETS", 12)
    rng = np.random.default_rng(4)
    samples = [(np.sort(rng.choice(12, 4, replace=False)), rng.random(4) * 3, int(rng.integers(3))) for _ in range(30)]
    got, bias = language_id.ftrl(samples, 3)
    z = [[0.0] * 3 for _ in range(13)]
    n = [[0.0] * 3 for _ in range(13)]
    alpha, beta, l1, l2 = language_id.ALPHA, language_id.BETA, language_id.L1, language_id.L2

    def weight(i, k):
        own = l1 if i < 12 else 0.0
        if abs(z[i][k]) <= own:
            return 0.0
        return -(z[i][k] - math.copysign(own, z[i][k])) / ((beta + math.sqrt(n[i][k])) / alpha + l2)

    for _ in range(language_id.EPOCHS):
        for b, x, y in samples:
            values = [*zip(b.tolist(), x.tolist()), (12, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in values for k in range(3)}
            s = [sum(w[i, k] * v for i, v in values) for k in range(3)]
            e = [math.exp(a - max(s)) for a in s]
            for i, v in values:
                for k in range(3):
                    g = v * (e[k] / sum(e) - (k == y))
                    step = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / alpha
                    z[i][k] += g - step * w[i, k]
                    n[i][k] += g * g
    assert np.allclose(got, [[weight(i, k) for k in range(3)] for i in range(12)], atol=1e-9)
    assert np.allclose(bias, [weight(12, k) for k in range(3)], atol=1e-9)


def test_document_frequencies_by_hand(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, TEXTS[0]]], "text string").repartition(3)
    got, total = language_id.document_frequencies(rows, "text")
    want = np.zeros(language_id.BUCKETS, int)
    for t in [*TEXTS, TEXTS[0]]:
        for b in set(plain_buckets(t)):
            want[b] += 1
    assert total == 8 and (got == want).all()


def test_temperature_is_the_best():
    rng = np.random.default_rng(5)
    logits = rng.normal(0, 4, (200, 3))
    labels = np.array([rng.choice(3, p=p) for p in language_id.softmax(logits / 3)])
    loss = lambda t: -np.log(np.maximum(language_id.softmax(logits / t)[np.arange(200), labels], 1e-12)).mean()
    best = language_id.temperature(logits, labels)
    assert all(loss(best) <= loss(t) + 1e-6 for t in np.exp(np.linspace(-1, 4, 400)))


# Toxicity ------------------------------------------------------------------------


@pytest.fixture()
def net():
    r = np.random.default_rng(6)
    own = toxicity.Network.start(6)
    own.words[:] = r.normal(0, 0.5, own.words.shape)
    own.grams[:] = r.normal(0, 0.5, own.grams.shape)
    own.into_bias[:] = r.normal(0, 0.2, own.into_bias.shape)
    own.look_bias[:] = r.normal(0, 0.2, own.look_bias.shape)
    own.out_bias[:] = 0.3
    return own


def plain_words(text):
    """Runs of letters and digits in lower case, one character after another."""
    out, run = [], ""
    for c in text:
        if c.isalnum():
            low = c.lower()
            run += low if len(low) == 1 else c
        elif run:
            out.append(run)
            run = ""
    return [*out, run] if run else out


def plain_logit(net, words):
    """A window's logit, unit by unit."""
    sig = lambda x: 1 / (1 + math.exp(-x))
    h_, k_ = toxicity.HIDDEN, 2 * toxicity.SIZE
    inputs = []
    for w in words:
        row, grams, many = toxicity.features([w])
        mean = [float(sum(net.grams[g][i] for g in grams)) / max(1, int(many[0])) for i in range(toxicity.SIZE)]
        inputs.append([float(x) for x in net.words[row[0]]] + mean)
    states = [[0.0] * (2 * h_) for _ in words]
    for d in (0, 1):
        h = [0.0] * h_
        for t in range(len(words)) if d == 0 else range(len(words) - 1, -1, -1):
            gate = [sum(inputs[t][i] * float(net.into[d][i][j]) for i in range(k_)) + float(net.into_bias[d][j]) for j in range(3 * h_)]
            back = [sum(h[i] * float(net.back[d][i][j]) for i in range(h_)) for j in range(3 * h_)]
            new = []
            for j in range(h_):
                z, r = sig(gate[j] + back[j]), sig(gate[h_ + j] + back[h_ + j])
                c = math.tanh(gate[2 * h_ + j] + r * back[2 * h_ + j])
                new.append(h[j] + z * (c - h[j]))
            h = new
            states[t][d * h_ : (d + 1) * h_] = h
    weights = []
    for s in states:
        u = [math.tanh(sum(s[i] * float(net.look[i][a]) for i in range(2 * h_)) + float(net.look_bias[a])) for a in range(toxicity.ATTENTION)]
        weights.append(sum(u[a] * float(net.weigh[a]) for a in range(toxicity.ATTENTION)))
    e = [math.exp(w - max(weights)) for w in weights]
    pooled = [sum(x * s[i] for x, s in zip(e, states)) / sum(e) for i in range(2 * h_)]
    return sum(pooled[i] * float(net.out[i]) for i in range(2 * h_)) + float(net.out_bias[0])


def test_scores_by_hand(spark, net):
    """The largest of all windows' scores, each half a window after the one
    before, to the end of the text."""
    r = np.random.default_rng(9)
    texts = ["One word", "This one is longer, and so on.", "", "... !!!", "Ünïcode 日本語 words; 42 more"]
    texts += [" ".join(f"word{r.integers(200)}" for _ in range(n)) for n in (48, 49, 130)]
    got = {r.i: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "i long, text string"), net, "text", ["i"]).collect()}
    for i, t in enumerate(texts):
        words, starts = plain_words(t), [0]
        while starts[-1] + toxicity.WINDOW < len(words):
            starts.append(starts[-1] + toxicity.STRIDE)
        want = max(1 / (1 + math.exp(-plain_logit(net, words[s : s + toxicity.WINDOW]))) for s in starts) if words else 0.0
        assert abs(got[i] - want) < 1e-4, t


def test_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 72, 73, 500):
        starts, owner = toxicity.windows(np.array([5, n]))
        own = [s - 5 for s, o in zip(starts.tolist(), owner.tolist()) if o == 1]
        covered = {w for s in own for w in range(s, min(s + toxicity.WINDOW, n))}
        assert covered == set(range(n)) and own == [toxicity.STRIDE * i for i in range(len(own))]
        assert len(own) <= 1 or own[-1] + toxicity.WINDOW - toxicity.STRIDE < n


def test_logits_by_hand(net):
    words = "a gated network reads these words in both directions".split()
    gates, _ = net.encode_words(words)
    table = np.concatenate((np.zeros((1, 6 * toxicity.HIDDEN), np.float32), gates.reshape(len(words), -1)))
    for n in (1, 4, 9):
        ids = np.zeros((1, 12), np.int64)
        ids[0, :n] = np.arange(1, n + 1)
        assert abs(float(net.logits(table, ids)[0]) - plain_logit(net, words[:n])) < 1e-4


def test_gradients_by_differences(net):
    """Each parameter's gradient against the loss's change, in double
    precision."""
    for f in ("words", "grams", "into", "into_bias", "back", "look", "look_bias", "weigh", "out", "out_bias"):
        setattr(net, f, getattr(net, f).astype(np.float64))
    r = np.random.default_rng(8)
    inputs = r.normal(0, 1, (7, 2 * toxicity.SIZE))
    inputs[0] = 0
    ids = np.array([[1, 2, 3, 0], [4, 5, 6, 1], [2, 2, 0, 0]])
    labels, weights = np.array([1.0, 0.0, 1.0]), np.array([1.0, 0.7, 1.3])

    def loss():
        gates = np.concatenate([inputs @ net.into[d] + net.into_bias[d] for d in (0, 1)], axis=1)
        z = net.logits(gates, ids)
        return float((weights * (np.logaddexp(0, z) - labels * z)).sum())

    g = net.gradients(inputs, ids, labels, weights)
    step = 1e-3  # the states are kept in single precision
    for name in ("into", "into_bias", "back", "look", "look_bias", "weigh", "out", "out_bias", "inputs"):
        own = inputs if name == "inputs" else getattr(net, name)
        flat, grad = own.reshape(-1), np.asarray(g[name]).reshape(-1)
        for i in r.choice(len(flat), min(25, len(flat)), replace=False):
            if name == "inputs" and i < 2 * toxicity.SIZE:
                continue
            was = flat[i]
            flat[i] = was + step
            up = loss()
            flat[i] = was - step
            down = loss()
            flat[i] = was
            assert abs((up - down) / (2 * step) - grad[i]) < 2e-3 + 0.02 * abs(grad[i]), (name, i)


def test_scores_ignore_what_they_should(spark, net):
    rows = spark.createDataFrame([(1, "some words to score", "en", "a"), (2, "some words to score", "de", "b")], "doc_id long, text string, lang string, source string")
    got = [r.score for r in toxicity.score(rows, net, "text", ["doc_id"]).collect()]
    assert got[0] == got[1]
    model = language_id.fit(rows.withColumn("text", F.lit("x y z")), "doc_id", "text", "lang", F.lit(True))
    assert model.languages == ["de", "en"]


def test_learned_texts_take_few_bytes_a_word(monkeypatch):
    """The driver trains: a million words are held as numbers of four bytes."""
    import tracemalloc

    monkeypatch.setattr(toxicity, "EPOCHS", 0)
    monkeypatch.setattr(toxicity, "STEPS", 0)
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, 1000)) for _ in range(1000)]
    tracemalloc.start()
    try:
        toxicity.train(texts, [k % 2 for k in range(1000)])
        assert tracemalloc.get_traced_memory()[1] < 30e6
    finally:
        tracemalloc.stop()


def test_features_by_parts():
    words = [f"w{i * i}é" for i in range(50)]
    for part in (1, 7, 50, 60):
        assert all(np.array_equal(a, b) for a, b in zip(toxicity.features(words), toxicity.features_by_parts(words, part)))


def test_scoring_takes_little_memory(spark, net):
    """A task scores 160,000 distinct words, and hands rows on in parts."""
    import tracemalloc

    from keyloom.llm.vectext import blocks

    texts = [(" ".join(f"w{k}x" for k in range(at, at + 4000)),) for at in range(0, 160_000, 4000)]
    tracemalloc.start()
    try:
        own = toxicity.Scorer(net)
        for held in blocks(texts, lambda r: r[0], getattr(toxicity.Scorer, "CHARS", 1_000_000)):
            own.scores([r[0] for r in held])
        assert tracemalloc.get_traced_memory()[1] < 150e6
    finally:
        tracemalloc.stop()
    rows = spark.range(0, 1500, 1, 1).select("id", F.format_string("text %d", "id").alias("text"))
    one = toxicity.clean(rows, net, "text", 2.0)
    assert sorted(tuple(r) for r in one.collect()) == [(i, f"text {i}") for i in range(1500)]
    assert sorted(r.id for r in toxicity.score(rows, net, "text", ["id"]).collect()) == list(range(1500))
