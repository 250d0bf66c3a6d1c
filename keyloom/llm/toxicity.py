"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word's input is a learned vector of the word joined with the mean of learned
vectors of its character n-grams, so an unseen word still has an input. Two
gated recurrent layers read each window of words, one in either direction; an
attention layer pools their states, and a logistic unit scores the window. Every
window of a text is scored, each overlapping the next by half, and the text's
score is the largest.

The network is trained in numpy on at most ``PER_LABEL`` labelled texts of each
label, in ``EPOCHS`` passes or, where those make fewer than ``STEPS`` steps, in
as many passes as make them; the steps shorten evenly to none, so that the last
texts seen don't move the scores of all. A text's label says only that some window of a
toxic text is toxic, so each step learns from the window that scores highest.
Labels weigh as often as they stand in the sample.

Results by case: a null or empty text, or one without a word, scores 0; rows
without a label are scored but not learned from; of repeated label rows one
counts, an id with two labels isn't learned from, and of several texts with one
id the smallest is; an empty table gives an empty one, and without both labels every
score is 0; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import lowest_by_hash, schema_with
from keyloom.llm.vectext import SEPARATOR, TABLE, Block, WordCache, _mix, blocks, runs

#: The bounds on learned texts: so many of each label, by a hash of their id,
#: and none longer than so many characters.
PER_LABEL = 1000
LEARNED_CHARS = 10_000

WINDOW, STRIDE = 48, 24
WORDS, GRAMS = 1 << 17, 1 << 15
SIZE, HIDDEN, ATTENTION = 8, 8, 8
ORDERS = (3, 4, 5)
EPOCHS, BATCH, RATE, DECAY = 5, 16, 0.01, 1e-4
#: Steps that few learned texts are gone through again for.
STEPS = 300
#: Against learning texts by heart: a word in fewer learned texts has no vector
#: of its own, only its n-grams'; and this share of a window's words is left out
#: while learning from it.
MIN_TEXTS, DROPPED = 3, 0.4


def _lower() -> np.ndarray:
    out = np.arange(TABLE + 1, dtype=np.uint32)
    for c in range(TABLE):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


LOWER = _lower()
_LETTER = np.array([chr(c).isalnum() for c in range(TABLE)] + [True])


def spans(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Runs of letters and digits; characters beyond the table count as such."""
    inside = _LETTER[block.small] & (block.codes != SEPARATOR)
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its row among the word vectors, the rows of its character
    n-grams (end to end) and how many those are."""
    block = Block(words)
    codes = np.where(block.codes == SEPARATOR, 32, block.codes)
    values = _mix(codes)
    starts, ends = block.starts - 1, block.ends + 1  # with a blank on either side
    starts = np.maximum(starts, 0)
    rows = (block.hashes(block.starts, block.ends) >> np.uint64(40)).astype(np.int64) % WORDS
    lists, h = [], values
    for n in range(2, max(ORDERS) + 1):
        m = len(codes) - n + 1
        h = h[:m] * np.uint64(0x9FB21C651E98DF25) + values[n - 1 :]
        if n in ORDERS:
            many = np.maximum(np.minimum(ends, len(codes)) - starts - n + 1, 0)
            at = runs(starts, many)
            lists.append((((h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % GRAMS, many))
    total = sum(m for _, m in lists)
    out = np.zeros(int(total.sum()), np.int64)
    place = np.cumsum(total) - total
    for g, many in lists:
        out[runs(place, many)] = g
        place = place + many
    return rows, out, total


def features_by_parts(words: list[str], part: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of many words, with room for the hashes of a part at a time."""
    found = [features(words[:part])]
    for at in range(part, len(words), part):
        # The word before, so that the part's first one has a blank before it.
        rows, grams, many = features(words[at - 1 : at + part])
        found.append((rows[1:], grams[many[0] :], many[1:]))
    rows, grams, many = (np.concatenate(x) for x in zip(*found))
    return rows, grams, many


@dataclass
class Network:
    """Parameters. ``words`` and ``grams`` are the input vectors; ``into``
    holds both directions' input weights and ``back`` their recurrent ones."""

    words: np.ndarray
    grams: np.ndarray
    into: np.ndarray  # 2 x (2 SIZE) x (3 HIDDEN)
    into_bias: np.ndarray  # 2 x (3 HIDDEN)
    back: np.ndarray  # 2 x HIDDEN x (3 HIDDEN)
    look: np.ndarray  # (2 HIDDEN) x ATTENTION
    look_bias: np.ndarray
    weigh: np.ndarray  # ATTENTION
    out: np.ndarray  # 2 HIDDEN
    out_bias: np.ndarray  # 1

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        f = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        z = lambda *shape: np.zeros(shape, np.float32)
        # Input vectors start at zero, so those that nothing was learned for add no noise.
        return cls(z(WORDS + 1, SIZE), z(GRAMS, SIZE), f(0.35, 2, 2 * SIZE, 3 * HIDDEN), z(2, 3 * HIDDEN), f(0.3, 2, HIDDEN, 3 * HIDDEN), f(0.3, 2 * HIDDEN, ATTENTION), z(ATTENTION), f(0.3, ATTENTION), f(0.3, 2 * HIDDEN), z(1))

    def inputs(self, rows, grams, many) -> np.ndarray:
        """The input of each word: its vector and its n-grams' mean."""
        sums = np.zeros((len(rows), SIZE), np.float32)
        full = many > 0
        if full.any():
            sums[full] = np.add.reduceat(self.grams[grams], (np.cumsum(many) - many)[full], axis=0)
        return np.concatenate((self.words[rows], sums / np.maximum(many, 1)[:, None].astype(np.float32)), axis=1)

    def encode_inputs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's input, for the word table."""
        x = self.inputs(*features_by_parts(words))
        return x.ravel(), np.full(len(words), x.shape[1])

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        """What inputs give to both directions' gates."""
        return np.concatenate([inputs @ self.into[d] + self.into_bias[d] for d in (0, 1)], axis=1)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What each word gives to both directions' gates."""
        gates = self.gates(self.inputs(*features(words)))
        return gates.ravel(), np.full(len(words), gates.shape[1])

    def states(self, gates: np.ndarray, ids: np.ndarray, trace: list | None = None) -> np.ndarray:
        """windows x steps x (2 HIDDEN); ``ids`` are rows of ``gates``, whose
        first row stands for no word and leaves the state as it was."""
        n, steps = ids.shape
        out = np.zeros((n, steps, 2 * HIDDEN), np.float32)
        for d in (0, 1):
            own = np.ascontiguousarray(gates[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN])
            back, h = self.back[d], np.zeros((n, HIDDEN), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                x = own[ids[:, t]]
                live = (ids[:, t] > 0)[:, None]
                rec = h @ back
                zr = _sigmoid(x[:, : 2 * HIDDEN] + rec[:, : 2 * HIDDEN])
                z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
                c = np.tanh(x[:, 2 * HIDDEN :] + r * rec[:, 2 * HIDDEN :])
                new = np.where(live, h + z * (c - h), h)
                if trace is not None:
                    trace.append((d, t, h, z, r, c, rec[:, 2 * HIDDEN :], live))
                h = new
                out[:, t, d * HIDDEN : (d + 1) * HIDDEN] = h
        return out

    def pooled(self, states: np.ndarray, ids: np.ndarray):
        u = np.tanh(states @ self.look + self.look_bias)
        e = np.where(ids > 0, u @ self.weigh, -1e9)
        a = np.exp(e - e.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        return u, a, (a[:, :, None] * states).sum(1)

    def logits(self, gates: np.ndarray, ids: np.ndarray) -> np.ndarray:
        _, _, pooled = self.pooled(self.states(gates, ids), ids)
        return pooled @ self.out + self.out_bias[0]

    def gradients(self, inputs: np.ndarray, ids: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        """Of the windows' cross-entropy; ``inputs`` row 0 stands for no
        word."""
        gates = self.gates(inputs)
        trace: list = []
        states = self.states(gates, ids, trace)
        u, a, pooled = self.pooled(states, ids)
        off = ((_sigmoid(pooled @ self.out + self.out_bias[0]) - labels) * weights).astype(np.float32)
        g = {"out": pooled.T @ off, "out_bias": off.sum(keepdims=True)}
        d_pooled = off[:, None] * self.out
        d_states = a[:, :, None] * d_pooled[:, None, :]
        d_a = (states * d_pooled[:, None, :]).sum(2)
        d_e = a * (d_a - (a * d_a).sum(1, keepdims=True))
        g["weigh"] = (u * d_e[:, :, None]).sum((0, 1))
        d_u = d_e[:, :, None] * self.weigh * (1 - u * u)
        g["look"] = np.einsum("ntk,nta->ka", states, d_u)
        g["look_bias"] = d_u.sum((0, 1))
        d_states = d_states + d_u @ self.look.T
        d_gates = np.zeros_like(gates)
        g["back"] = np.zeros_like(self.back)
        d_h, was = None, None
        for d, t, h, z, r, c, rec, live in reversed(trace):
            if d != was:
                d_h, was = np.zeros_like(h), d
            dh = d_h + d_states[:, t, d * HIDDEN : (d + 1) * HIDDEN]
            through = np.where(live, dh, 0)
            d_c = through * z * (1 - c * c)
            d_z = through * (c - h) * z * (1 - z)
            d_r = d_c * rec * r * (1 - r)
            d_rec = np.concatenate((d_z, d_r, d_c * r), axis=1)
            g["back"][d] += h.T @ d_rec
            d_h = dh - through * z + d_rec @ self.back[d].T
            np.add.at(d_gates[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN], ids[:, t], np.concatenate((d_z, d_r, d_c), axis=1))
        halves = [d_gates[:, : 3 * HIDDEN], d_gates[:, 3 * HIDDEN :]]
        for x in halves:
            x[0] = 0
        g["into"] = np.stack([inputs.T @ x for x in halves])
        g["into_bias"] = np.stack([x.sum(0) for x in halves])
        g["inputs"] = sum(x @ self.into[d].T for d, x in enumerate(halves))
        return g


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the windows over texts of so many words start (counted over all
    words), and which text each belongs to."""
    many = np.where(counts > 0, 1 + np.maximum(0, -(-(counts - WINDOW) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(counts)), many)
    first = np.cumsum(counts) - counts
    return np.repeat(first, many) + runs(np.zeros(len(counts), np.int64), many) * STRIDE, owner


def window_ids(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """windows x WINDOW ids, 0 beyond where a window's text ends."""
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < ends[:, None], ids[np.minimum(at, len(ids) - 1)], 0) if len(ids) else np.zeros((0, WINDOW), np.int64)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """Fit on labelled texts; None unless both labels occur."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        return None
    order: dict[str, int] = {}
    docs = []
    for t in texts:
        block = Block([t], LOWER)
        text = block.text()
        # As an array: a list would keep a Python number for each word of all texts in the driver.
        docs.append(np.array([order.setdefault(text[a:b], len(order)) + 1 for a, b in zip(*(x.tolist() for x in spans(block)))], np.int32))
    rows, grams, many = features_by_parts(list(order))
    known = sum((np.bincount(np.unique(d) - 1, minlength=len(order)) for d in docs), np.zeros(len(order), np.int64)) >= MIN_TEXTS
    rows = np.where(known, rows, WORDS)  # a row that stays zero
    places = np.cumsum(many) - many
    net, r = Network.start(seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in vars(net).items()}
    step, batches = 0, -(-len(docs) // BATCH)
    passes = max(EPOCHS, -(-STEPS // batches))
    for _ in range(passes):
        turn = r.permutation(len(docs))
        for at in range(0, len(turn), BATCH):
            picked = [i for i in turn[at : at + BATCH].tolist() if len(docs[i])]
            if not picked:
                continue
            counts = np.array([len(docs[i]) for i in picked])
            own, ids = np.unique(np.concatenate([docs[i] for i in picked]), return_inverse=True)
            n = many[own - 1]
            flat = grams[runs(places[own - 1], n)]
            inputs = np.concatenate((np.zeros((1, 2 * SIZE), np.float32), net.inputs(rows[own - 1], flat, n)))
            gates = net.gates(inputs)
            starts, owner = windows(counts)
            every = window_ids(ids + 1, starts, np.cumsum(counts)[owner])
            scores = net.logits(gates, every)
            best = np.lexsort((-scores, owner))
            best = best[np.concatenate(([True], owner[best][1:] != owner[best][:-1]))]
            shown = np.where(r.random((len(best), WINDOW)) < DROPPED, 0, every[best])
            g = net.gradients(inputs, shown, y[picked], np.full(len(picked), 1 / len(picked)))
            d = g.pop("inputs")[1:]
            rate = RATE * (1 - step / (passes * batches))
            step += 1
            has = known[own - 1]
            _adam(net.words, moments["words"], step, rate, *_gathered(rows[own - 1][has], d[has, :SIZE]))
            _adam(net.grams, moments["grams"], step, rate, *_gathered(flat, np.repeat(d[:, SIZE:] / np.maximum(n, 1)[:, None], n, axis=0)))
            for k, v in g.items():
                _adam(getattr(net, k), moments[k], step, rate, ..., v)
    return net


def _gathered(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own, back = np.unique(rows, return_inverse=True)
    sums = np.zeros((len(own), values.shape[1]), np.float32)
    np.add.at(sums, back, values)
    return own, sums


def _adam(p: np.ndarray, moments: tuple[np.ndarray, np.ndarray], step: int, rate: float, at, g: np.ndarray) -> None:
    m, v = moments
    g = g + DECAY * p[at]
    m[at] = 0.9 * m[at] + 0.1 * g
    v[at] = 0.999 * v[at] + 0.001 * g * g
    p[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)


class Scorer:
    """Scores of whole texts, by a table of the words' inputs. The gates are
    made of a block's words: they are three times as large as the inputs."""

    WIDTH = 2 * SIZE
    TOGETHER = 1024
    #: Characters of a block, and bytes of the table, about: a task holds a few times as much.
    CHARS, TABLE = 400_000, 32 << 20

    def __init__(self, net: Network):
        self.net = net
        self.cache = WordCache(net.encode_inputs, np.float32, bits=18, most=self.TABLE)

    def scores(self, texts: list[str]) -> np.ndarray:
        block = Block(texts, LOWER)
        starts, ends = spans(block)
        out = np.zeros(len(texts))
        if not len(starts):
            return out
        offsets, _ = self.cache.lookup(block, starts, ends)
        inputs = self.cache.pool[: self.cache.used].reshape(-1, self.WIDTH)
        own, ids = np.unique(offsets // self.WIDTH, return_inverse=True)
        gates = self.net.gates(inputs[own])
        table = np.concatenate((np.zeros((1, gates.shape[1]), np.float32), gates))
        counts = block.counts(starts)
        firsts, owner = windows(counts)
        until = np.cumsum(counts)[owner]
        for at in range(0, len(owner), self.TOGETHER):
            some = slice(at, at + self.TOGETHER)
            np.maximum.at(out, owner[some], _sigmoid(self.net.logits(table, window_ids(ids + 1, firsts[some], until[some])).astype(float)))
        return out


def learned_rows(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, learn: Column) -> tuple[list[str], list[int]]:
    """The bounded sample: texts and labels in an order that the ids fix."""
    chosen = lowest_by_hash(labels.where(learn), key, label, PER_LABEL)
    own = docs.where(F.col(text).isNotNull() & (F.length(text) <= LEARNED_CHARS)).select(key, text)
    # At most PER_LABEL ids for each label, and one text for each id: neither
    # the broadcast nor what reaches the driver grows with the tables.
    rows = own.join(F.broadcast(chosen), key).groupBy(key, label, "turn").agg(F.min(text).alias(text)).orderBy("turn", label, key).select(text, label).collect()
    return [r[0] for r in rows], [int(r[1]) for r in rows]


#: Rows that are scored, and go back to Spark, at a time.
ROWS = 512


def _held(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``ROWS``: of a batch no second copy is made."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _scores(net: Network | None) -> Callable[[pa.Array], np.ndarray]:
    """The function that scores a column of texts, in one task."""
    own = Scorer(net) if net else None

    def run(texts: pa.Array) -> np.ndarray:
        if own is None:
            return np.zeros(len(texts))
        return np.concatenate([own.scores([r[0] or "" for r in held]) for held in blocks(zip(texts.to_pylist()), lambda r: r[0] or "", Scorer.CHARS)])

    return run


def score(df: DataFrame, net: Network | None, text: str, keep: list[str]) -> DataFrame:
    """``keep``, score and predicted."""
    shared = df.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(shared.value)
        for batch in _held(batches):
            got = scores(batch.column(0))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=[*batch.schema.names[1:], "score", "predicted"])

    return df.select(text, *keep).mapInArrow(run, schema_with(df, keep, "score double, predicted int"))


def clean(df: DataFrame, net: Network | None, text: str, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores under the threshold, with all their
    columns."""
    shared = df.sparkSession.sparkContext.broadcast(net)
    place = df.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _scores(shared.value)
        for batch in _held(batches):
            yield batch.filter(pa.array(scores(batch.column(place)) < threshold))

    return df.mapInArrow(run, df.schema)
