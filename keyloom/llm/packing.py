"""Packing of token sequences by minimum bin slack.

What is packed is described whole by how many pieces have each length, and a
length is at most the bin's capacity, so that table is small however large the
corpus is. On it the driver finds the patterns: the largest length left opens a
bin, a bitset of the sums that the other lengths can reach tells the fullest
feasible combination, and the pattern is used as often as its lengths last. The
pieces themselves stay distributed: each gets its ordinal among the pieces of
its length, and looks its bin and offset up.

Results by case: a null text counts as empty, and an empty text is one piece of
the end id alone; repeated rows are packed each; an empty table gives an empty
one; columns besides the key and the text aren't read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.bpe import WordBpe, spans_by_pattern, spans_without_space
from keyloom.llm.common import materialize
from keyloom.llm.vectext import Block, WordCache, blocks, runs

CAPACITY = 4096
END_ID = 1


class TextIds:
    """The ids of whole texts, by a table of the ids of their words."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.cache = WordCache(self.bpe.encode, np.int32)

    def encode_block(self, texts: list[str]) -> list[np.ndarray]:
        texts = [self.bpe.plain(t) for t in texts]
        block = Block(texts, self.bpe.lower)
        starts, ends = spans_without_space(block)
        wide = block.wide()
        if wide.any():
            narrow = np.ones(len(block.codes) + 1, bool)
            for a, b in zip(block.starts[wide], block.ends[wide]):
                narrow[a:b] = False
            more = spans_by_pattern([t for t, x in zip(texts, wide) if x], block.starts[wide], self.bpe.pattern)
            keep = narrow[starts]
            starts, ends = np.concatenate((starts[keep], more[0])), np.concatenate((ends[keep], more[1]))
            order = np.argsort(starts)
            starts, ends = starts[order], ends[order]
        offsets, lengths = self.cache.lookup(block, starts, ends)
        ids = self.cache.pool[runs(offsets, lengths)]
        total = np.concatenate(([0], np.cumsum(lengths)))
        low, high = total[np.searchsorted(starts, block.starts)], total[np.searchsorted(starts, block.ends)]
        return [ids[a:b] for a, b in zip(low.tolist(), high.tolist())]


@lru_cache(maxsize=2)
def text_ids(path: str) -> TextIds:
    """One per Python worker: its table of words serves all its tasks."""
    return TextIds(path)


def pieces(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each text's ids and the end id, cut at the capacity: key, piece, start,
    length, ids_crc32, and the piece's ordinal in its task among those of its
    length (task, nth)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, task, seen = text_ids(path), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            schema = pa.schema([batch.schema.field(0), *((c, pa.int64()) for c in ("piece", "start", "length", "ids_crc32", "task", "nth"))])
            for held in blocks(rows, lambda r: r[1] or ""):
                out = []
                for (k, _), ids in zip(held, own.encode_block([r[1] or "" for r in held])):
                    ids = np.append(ids, end_id).astype("<u4")
                    for i, at in enumerate(range(0, len(ids), capacity)):
                        cut = ids[at : at + capacity]
                        out.append((k, i, at, len(cut), zlib.crc32(cut.tobytes()), task, seen[len(cut)]))
                        seen[len(cut)] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*out))], schema=schema)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece long, start long, length long, ids_crc32 long, task long, nth long")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The combination of lengths (descending), each at most as often as it is
    there, whose sum comes nearest to ``room`` from below."""
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        most = min(counts[n], room // n) if n <= room else 0
        take = 1
        while most > 0:
            k = min(take, most)
            steps.append((n, k, reach))
            reach |= (reach << (n * k)) & mask
            most -= k
            take *= 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, Counter()
    for n, k, before in reversed(steps):
        if not before >> at & 1:
            at -= n * k
            used[n] += k
    return used


def minimum_bin_slack(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Patterns (times used, pieces by length) that together use up the
    histogram."""
    counts = {n: c for n, c in histogram.items() if c > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        largest = lengths[0]
        counts[largest] -= 1
        rest = fullest(counts, lengths, capacity - largest)
        counts[largest] += 1
        pattern = Counter(rest)
        pattern[largest] += 1
        times = min(counts[n] // m for n, m in pattern.items())
        for n, m in pattern.items():
            counts[n] -= times * m
        out.append((times, dict(pattern)))
        if any(not counts[n] for n in pattern):
            lengths = [n for n in lengths if counts[n]]
    return out


class Places:
    """For a length and an ordinal among the pieces of that length: the bin
    and the offset there. Its size is bounded by the capacity."""

    def __init__(self, patterns: list[tuple[int, dict[int, int]]]):
        rows, first, next_of = [], 0, Counter()
        for times, pattern in patterns:
            offset = 0
            for n, m in sorted(pattern.items(), reverse=True):
                rows.append((n << 40 | next_of[n], m, first, offset, n))
                next_of[n] += times * m
                offset += n * m
            first += times
        self.keys, self.many, self.first, self.offset, self.length = np.array(sorted(rows), np.int64).reshape(-1, 5).T

    def find(self, length: np.ndarray, ordinal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = length << 40 | ordinal
        at = np.searchsorted(self.keys, key, side="right") - 1
        into = key - self.keys[at]
        return self.first[at] + into // self.many[at], self.offset[at] + into % self.many[at] * self.length[at]


def pack(df: DataFrame, key: str, text: str, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(df, key, text, path, capacity, end_id), "pieces")
    by_task = cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    places = df.sparkSession.sparkContext.broadcast(Places(minimum_bin_slack(histogram, capacity)))  # bounded by the capacity
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(before, ["task", "length"]).select(key, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("ordinal"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, ordinal = (batch.column(i).to_numpy() for i in (3, 5))
            bins, offsets = places.value.find(length, ordinal)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], names=[*batch.schema.names[:5], "sequence_id", "offset"])

    kind = df.schema[key].dataType.simpleString()
    return numbered.mapInArrow(run, f"`{key}` {kind}, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long")
