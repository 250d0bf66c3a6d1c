"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of character n-grams (hashed; frequencies relative
to the text's length, so a text's score is a mean over its n-grams). Document
frequencies are counted over every training text. The weights are learned by
follow-the-regularised-leader with elastic-net penalties on at most
``PER_LANGUAGE`` texts of each language, and a temperature fitted on a part of
them that was held back makes the scores probabilities. With 25 learned texts or
fewer none are held back, and the temperature is 1.

Results by case: a null text, or one without a letter, is ``und`` with score 0;
rows with a null language are scored but never learned from; an id with two
languages isn't learned from, and of several texts with one id the smallest is;
repeated rows and ties each give their own row (of equal scores the language
first in order);
an empty table, or one without a labelled text, gives ``und`` everywhere; other
columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import lowest_by_hash, schema_with
from keyloom.llm.vectext import LETTER, SEPARATOR, TABLE, Block, _mix, blocks

BUCKET_BITS = 16
BUCKETS = 1 << BUCKET_BITS
ORDERS = (1, 2, 3)
#: The bound on learned texts: so many of each language, by a hash of their id.
PER_LANGUAGE = 800
#: Every so many-th of them is held back for the temperature.
CALIBRATION = 5
UNKNOWN = "und"

ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.3, 0.1, 0.005, 0.05, 3, 10.0


def _plain(c: int) -> int:
    """A letter in lower case, where that is one letter; a blank for others."""
    low = chr(c).lower()
    return (ord(low) if len(low) == 1 else c) if chr(c).isalpha() else 32


def _lower() -> np.ndarray:
    out = np.arange(TABLE + 1, dtype=np.uint32)
    out[:TABLE] = [_plain(c) for c in range(TABLE)]
    return out


LOWER = _lower()


def grams(texts: list[str]) -> tuple[Block, list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """The block, for each order the n-grams' positions and buckets, and each
    text's number of letters. Whatever isn't a letter counts as a blank; grams
    with two blanks in a row, or of a lone blank, are left out."""
    block = Block(texts, LOWER)
    codes = block.codes
    if block.wide().any():
        beyond = np.flatnonzero((codes >= TABLE) & (codes != SEPARATOR))
        distinct, which = np.unique(codes[beyond], return_inverse=True)
        codes[beyond] = np.array([_plain(c) for c in distinct.tolist()], codes.dtype)[which]
    stop, blank = codes == SEPARATOR, codes == 32
    values = _mix(codes)
    letters = np.concatenate(([0], np.cumsum(~stop & ~blank)))
    found, bad, h = [], stop.copy(), np.zeros(len(codes), np.uint64)
    for n in ORDERS:
        m = len(codes) - n + 1
        h = h[:m] * np.uint64(0x9FB21C651E98DF25) + values[n - 1 :]
        bad = bad[:m] | stop[n - 1 :]
        if n == 2:
            bad = bad | (blank[:-1] & blank[1:])
        elif n > 2:
            bad = bad | (blank[n - 2 : -1] & blank[n - 1 :])
        use = ~(bad | blank[:m]) if n == 1 else ~bad
        at = np.flatnonzero(use)
        found.append((at, ((h[at] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)))
    return block, found, letters[block.ends] - letters[block.starts]


def _bounds(block: Block, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.searchsorted(at, block.starts), np.searchsorted(at, block.ends)


def document_frequencies(texts: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """In how many texts each bucket occurs, and how many texts there are."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_in, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for held in blocks(zip(batch.column(0).to_pylist()), lambda r: r[0] or ""):
                block, found, _ = grams([r[0] or "" for r in held])
                cuts = [(b, *_bounds(block, at)) for at, b in found]
                for i in range(len(held)):
                    seen = np.zeros(BUCKETS, bool)
                    for b, low, high in cuts:
                        seen[b[low[i] : high[i]]] = True
                    seen_in += seen
                n += len(held)
        at = np.flatnonzero(seen_in)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(seen_in[at], n))], names=["bucket", "n"])

    total = texts.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    rows = total.toPandas()  # a row for each bucket at most
    out = np.zeros(BUCKETS, np.int64)
    real = rows[rows.bucket >= 0]
    out[real.bucket.to_numpy()] = real.n.to_numpy()
    return out, int(rows[rows.bucket < 0].n.sum())


def sparse(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, and the buckets of the text with their relative frequencies."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(0).to_pylist():
                _, found, _ = grams([t or ""])
                b, n = np.unique(np.concatenate([x for _, x in found]), return_counts=True)
                rows.append((b, n / max(1, n.sum())))
            lists = [pa.array([r[i] for r in rows], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.float32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *lists], names=[*batch.schema.names[1:], "buckets", "shares"])

    fields = schema_with(df, keep, "buckets array<int>, shares array<float>")
    return df.select(text, *keep).mapInArrow(run, fields)


@dataclass
class Model:
    languages: list[str]
    #: Weights times inverse document frequency: bucket x language.
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text: a row of probabilities, and its number of letters."""
        block, found, letters = grams(texts)
        sums, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts))
        for at, b in found:
            low, high = _bounds(block, at)
            full = high > low
            if full.any():
                sums[full] += np.add.reduceat(self.weights[b], low[full], axis=0)
            n += high - low
        return softmax((sums / np.maximum(n, 1)[:, None] + self.bias) / self.temperature), letters


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def ftrl(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader; the bias is a bucket
    of its own, without penalties."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    l1 = np.full((BUCKETS + 1, 1), L1)
    l1[-1] = 0

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1[at], 0, -(zs - np.sign(zs) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for b, x, y in samples:
            at = np.append(b, BUCKETS)
            x = np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - s * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least cross-entropy, by golden section on its log."""

    def loss(t: float) -> float:
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(labels)), labels], 1e-12)).mean()

    low, high, ratio = -1.0, 4.0, (5**0.5 - 1) / 2
    while high - low > 1e-3:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(df: DataFrame, key: str, text: str, lang: str, learn: Column) -> Model | None:
    """Learn from the rows where ``learn`` holds and neither the text nor the
    language is null."""
    rows = df.where(learn & F.col(text).isNotNull() & F.col(lang).isNotNull())
    frequency, total = document_frequencies(rows, text)
    chosen = lowest_by_hash(rows, key, lang, PER_LANGUAGE).select(key, "turn")
    # At most PER_LANGUAGE ids for each language, and one text for each id:
    # neither the broadcast nor what reaches the driver grows with the table.
    texts = rows.select(key, text, lang).join(F.broadcast(chosen), key).groupBy(key, lang, "turn").agg(F.min(text).alias(text))
    picked = sparse(texts, text, [key, lang, "turn"]).orderBy("turn", lang, key).collect()
    if not picked:
        return None
    languages = sorted({r[lang] for r in picked})
    idf = np.log((1 + total) / (1 + frequency)) + 1
    samples = [(np.array(r.buckets, np.int64), np.array(r.shares) * idf[r.buckets] * SCALE, languages.index(r[lang])) for r in picked if r.buckets]
    held = samples[::CALIBRATION] if len(samples) > 5 * CALIBRATION else []
    w, bias = ftrl([s for i, s in enumerate(samples) if i % CALIBRATION or not held], len(languages))
    logits = np.array([x @ w[b] + bias for b, x, _ in held]).reshape(-1, len(languages))
    t = temperature(logits, np.array([y for *_, y in held])) if held else 1.0
    return Model(languages, (w * idf[:, None] * SCALE).astype(np.float32), bias, t)


def predict(df: DataFrame, model: Model | None, text: str, keep: list[str]) -> DataFrame:
    """``keep``, lang_pred and score."""
    spark = df.sparkSession
    # BUCKETS x languages floats: a bounded broadcast.
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            at = 0
            for held in blocks(zip(batch.column(0).to_pylist()), lambda r: r[0] or ""):
                n = len(held)
                names, scores = [UNKNOWN] * n, np.zeros(n)
                if own:
                    p, letters = own.probabilities([r[0] or "" for r in held])
                    best = p.argmax(1)
                    names = [own.languages[k] if c else UNKNOWN for k, c in zip(best.tolist(), letters.tolist())]
                    scores = np.where(letters > 0, p[np.arange(n), best], 0.0)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, n) for c in batch.columns[1:]), pa.array(names), pa.array(scores)], names=[*batch.schema.names[1:], "lang_pred", "score"])
                at += n

    fields = schema_with(df, keep, "lang_pred string, score double")
    return df.select(text, *keep).mapInArrow(run, fields)
