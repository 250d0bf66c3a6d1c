"""Byte-level BPE by corpus-level merge replay.

The words of many texts are gathered once each. An inverted index goes from a
merge's rank to the positions, over all those words, where the merge applies;
the ranks are replayed in order, and each application touches only the index
entries of its two neighbours. A text's ids are then its words' ids in order.

Results by case: a null or empty text has no ids and decodes to no bytes;
repeated rows and ties each give their own row; an empty table gives an empty
one; of other columns, those named in ``keep`` are carried.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from keyloom.llm.bpe import PairTable, spans_by_pattern, spans_with_space
from keyloom.llm.common import schema_with
from keyloom.llm.vectext import Block, WordCache, blocks, runs

SHIFT = 20
#: Characters whose new words are merged together.
CHARS = 3_000_000


class MergeReplay:
    """Ids of words under a file of ranks, and the way back to bytes."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        found = []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    found.append((a, b, rank))
        ids = np.array(found, np.int64).reshape(-1, 3)
        self.made = dict(zip((ids[:, 0] << SHIFT | ids[:, 1]).tolist(), ids[:, 2].tolist()))
        self.pairs = PairTable(ids[:, 0], ids[:, 1], ids[:, 2], ids[:, 2], bits=21)
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        names = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            names[rank] = token
        self.token_bytes, self.token_at, self.token_size = _laid(names)
        self.digits, self.digits_at, self.digits_size = _laid([b"%d," % i for i in range(len(names))])
        #: Rust's white space is the Unicode property, so the pattern says so.
        self.pattern = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.cache = WordCache(self.encode_words, np.int32, bits=20)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8") for w in words]
        whole = [self.ranks.get(b, -1) for b in raw]
        open_ = [b if r < 0 else b"" for b, r in zip(raw, whole)]
        ids, sizes = self.replay(open_)
        single = np.array(whole, np.int64)
        lengths = np.where(single >= 0, 1, sizes)
        out = np.zeros(int(lengths.sum()), np.int32)
        at = np.cumsum(lengths) - lengths
        out[at[single >= 0]] = single[single >= 0]
        out[runs(at[single < 0], sizes[single < 0])] = ids
        return out, lengths

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Apply every merge, in rank order, to all the words together."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int32), sizes
        word = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(word[1:] == word[:-1])
        rank, _ = self.pairs.find(symbols[inside], symbols[inside + 1], -1)
        inside, rank = inside[rank >= 0], rank[rank >= 0]
        order = np.argsort(rank, kind="stable")
        inside, rank = inside[order], rank[order]
        ends = np.cumsum(sizes)
        right = np.arange(1, n + 1)
        right[ends[sizes > 0] - 1] = -1
        left = np.arange(-1, n - 1)
        left[(ends - sizes)[sizes > 0]] = -1
        state = _Symbols(symbols, left, right, np.full(n, -1, np.int64), self)
        state.rank[inside] = rank
        values, firsts = np.unique(rank, return_index=True)
        for r, at in zip(values.tolist(), np.split(inside, firsts[1:]) if len(values) else []):
            state.add(r, at)
        while state.pending:
            state.apply(heapq.heappop(state.pending))
        lengths = np.bincount(word[symbols >= 0], minlength=len(words))
        ids = symbols[symbols >= 0].astype(np.int32)
        return self._again(words, ids, lengths, np.unique(word[np.array(state.odd)])) if state.odd else (ids, lengths)

    def _again(self, words, ids, lengths, which):
        """Where a merge opened one of lower rank, the order inside the word
        matters; such words are merged one step at a time."""
        parts = np.split(ids, np.cumsum(lengths)[:-1])
        for w in which.tolist():
            parts[w] = np.array(stepwise(words[w], self.ranks), np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts end to end, and how many each has."""
        block = Block(texts)
        starts, ends = spans_with_space(block)
        wide = block.wide()
        if wide.any():
            narrow = np.ones(len(block.codes) + 1, bool)
            for a, b in zip(block.starts[wide], block.ends[wide]):
                narrow[a:b] = False
            more = spans_by_pattern([t for t, x in zip(texts, wide) if x], block.starts[wide], self.pattern)
            keep = narrow[starts]
            starts, ends = np.concatenate((starts[keep], more[0])), np.concatenate((ends[keep], more[1]))
            order = np.argsort(starts)
            starts, ends = starts[order], ends[order]
        offsets, lengths = self.cache.lookup(block, starts, ends)
        total = np.concatenate(([0], np.cumsum(lengths)))
        counts = total[np.searchsorted(starts, block.ends)] - total[np.searchsorted(starts, block.starts)]
        return self.cache.pool[runs(offsets, lengths)], counts

    def decode_block(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, from the ids of many end to end."""
        return _cut(self.token_bytes, self.token_at, self.token_size, ids, counts)

    def digits_block(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """Each text's ids in decimal, joined by commas."""
        return [x[:-1] for x in _cut(self.digits, self.digits_at, self.digits_size, ids, counts)]


class _Symbols:
    """The symbols of all words, linked to their neighbours, and the inverted
    index from a merge's rank to the positions of its left symbols. ``rank``
    tells which merge a symbol and its right neighbour have now; an index entry
    that no longer agrees with it is stale.

    Ranks with many positions are applied by array operations, others in a
    loop over the same memory.
    """

    FEW = 40

    def __init__(self, token, left, right, rank, tables):
        self.token, self.left, self.right, self.rank, self.tables = token, left, right, rank, tables
        self.views = tuple(memoryview(x) for x in (token, left, right, rank))
        self.index: dict[int, list] = {}
        self.pending: list[int] = []
        self.odd: list[int] = []

    def add(self, r: int, at) -> None:
        if r not in self.index:
            self.index[r] = []
            heapq.heappush(self.pending, r)
        (self.index[r].append if isinstance(at, int) else self.index[r].extend)(at if isinstance(at, int) else at.tolist())

    def apply(self, r: int) -> None:
        at = self.index.pop(r)
        self._loop(r, sorted(at)) if len(at) < self.FEW else self._arrays(r, np.array(at))

    def _loop(self, r: int, at: list[int]) -> None:
        token, left, right, rank = self.views
        made = self.tables.made
        for i in at:
            if rank[i] != r:
                continue
            j = right[i]
            k, h = right[j], left[i]
            token[i], token[j], rank[j], right[i] = r, -1, -1, k
            q = -1
            if k >= 0:
                left[k] = i
                q = made.get(r << SHIFT | token[k], -1)
            rank[i] = q
            if q >= 0:
                self.add(q, i)
                if q < r:
                    self.odd.append(i)
            if h >= 0:
                q = rank[h] = made.get(token[h] << SHIFT | r, -1)
                if q >= 0:
                    self.add(q, h)
                    if q < r:
                        self.odd.append(h)

    def _arrays(self, r: int, at: np.ndarray) -> None:
        token, left, right, rank = self.token, self.left, self.right, self.rank
        at.sort()
        at = at[(rank[at] == r) & (np.diff(at, prepend=-1) > 0)]
        if not len(at):
            return
        follows = np.concatenate(([False], right[at[:-1]] == at[1:]))
        if follows.any():  # of overlapping places the first, third, ... apply
            first = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        j = right[at]
        k = right[j]
        token[at], token[j], rank[j], right[at] = r, -1, -1, k
        has = k >= 0
        left[k[has]] = at[has]
        rank[at] = -1
        h = left[at]
        self._renew(r, at[has], token[at[has]], token[k[has]])
        h = h[h >= 0]
        self._renew(r, h, token[h], token[right[h]])

    def _renew(self, r: int, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        q, _ = self.tables.pairs.find(a, b, -1)
        self.rank[at] = q
        real = q >= 0
        at, q = at[real], q[real]
        self.odd.extend(at[q < r].tolist())
        index, pending = self.index, self.pending
        for x, i in zip(q.tolist(), at.tolist()):
            if x in index:
                index[x].append(i)
            else:
                index[x] = [i]
                heapq.heappush(pending, x)


def stepwise(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain procedure: merge the leftmost pair of lowest rank, again and
    again."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if best[0] == 1 << 60:
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return [ranks[p] for p in parts]


def _laid(names: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in names], np.int64)
    return np.frombuffer(b"".join(names), np.uint8), np.cumsum(sizes) - sizes, sizes


def _cut(flat, at, size, ids, counts) -> list[bytes]:
    sizes = size[ids]
    raw = flat[runs(at[ids], sizes)].tobytes()
    total = np.concatenate(([0], np.cumsum(sizes)))
    bounds = total[np.concatenate(([0], np.cumsum(counts)))].tolist()
    return [raw[a:b] for a, b in zip(bounds, bounds[1:])]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> MergeReplay:
    """One per Python worker: its table of words serves all its tasks."""
    return MergeReplay(path, pattern)


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[list]:
    return [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names]


def encode(df: DataFrame, text: str, path: str, pattern: str, keep: list[str], out: str = "ids") -> DataFrame:
    """``keep`` and, as ``out``, the ids of the whole text: array<int>."""
    fields = schema_with(df, keep, f"`{out}` array<int>")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        schema = None
        for batch in batches:
            rows = list(zip(*_columns(batch, [text, *keep])))
            for held in blocks(rows, lambda r: r[0] or "", CHARS):
                ids, counts = own.encode_block([r[0] or "" for r in held])
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
                schema = schema or pa.schema([*(batch.schema.field(c) for c in keep), pa.field(out, pa.list_(pa.int32()))])
                yield pa.RecordBatch.from_arrays([*(pa.array(c, schema.field(i).type) for i, c in enumerate(list(zip(*held))[1:])), lists], schema=schema)

    return df.select(text, *[c for c in keep if c != text]).mapInArrow(run, fields)


def decode(df: DataFrame, ids: str, path: str, pattern: str, keep: list[str], out: str = "decoded") -> DataFrame:
    """``keep`` and, as ``out``, the bytes that the ids stand for."""
    fields = schema_with(df, keep, f"`{out}` binary")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            lists = [x or [] for x in _columns(batch, [ids])[0]]
            flat = np.array([i for x in lists for i in x], np.int64)
            got = own.decode_block(flat, np.array([len(x) for x in lists], np.int64))
            schema = pa.schema([*(batch.schema.field(c) for c in keep), pa.field(out, pa.binary())])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), pa.array(got, pa.binary())], schema=schema)

    return df.select(ids, *[c for c in keep if c != ids]).mapInArrow(run, fields)


def round_trip_digests(df: DataFrame, key: str, text: str, path: str, pattern: str) -> DataFrame:
    """Encode, decode, and digest both, in one pass over the texts: ``key``,
    n_tokens, ids_sha256, decoded_sha256."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for batch in batches:
            schema = pa.schema([batch.schema.field(key), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
            for held in blocks(zip(*_columns(batch, [key, text])), lambda r: r[1] or "", CHARS):
                ids, counts = own.encode_block([r[1] or "" for r in held])
                shas = [[hashlib.sha256(x).hexdigest() for x in made(ids, counts)] for made in (own.digits_block, own.decode_block)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in held], schema.field(0).type), pa.array(counts, pa.int64()), *map(pa.array, shas)], schema=schema)

    return df.select(key, text).mapInArrow(run, schema_with(df, [key], "n_tokens long, ids_sha256 string, decoded_sha256 string"))
