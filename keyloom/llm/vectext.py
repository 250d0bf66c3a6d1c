"""Numpy helpers that split, hash and look up the words of many texts at once.

Texts are laid end to end as code points with a separator between them. Word
bounds, word hashes and table lookups are then array operations, so the cost
of a word is a few array elements and not a Python object.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import regex

SPACE, LETTER, NUMBER, OTHER, STOP = range(5)
#: Code points below this are classified by table; texts with others take the
#: pattern itself.
TABLE = 0x250
SEPARATOR = 0xFFFFFFFF


def _mix(codes: np.ndarray) -> np.ndarray:
    """A 64-bit pseudo-random value for each code point (splitmix64)."""
    z = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _classes() -> np.ndarray:
    kinds = np.full(TABLE + 1, OTHER, np.uint8)
    for kind, pattern in ((SPACE, r"\p{White_Space}"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")):
        found = regex.compile(pattern)
        for c in range(TABLE):
            if found.match(chr(c)):
                kinds[c] = kind
    kinds[TABLE] = STOP
    return kinds


CLASS = _classes()
_MIX = _mix(np.arange(TABLE + 1))
_P = 0x9FB21C651E98DF25
_P_INVERSE = pow(_P, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def blocks(rows: Iterable[tuple], text_of: Callable[[tuple], str], chars: int = 1_500_000) -> Iterator[list]:
    """Group rows so that a group's texts have about ``chars`` characters; a
    longer text stands alone."""
    held, size = [], 0
    for row in rows:
        n = len(text_of(row)) + 1
        if held and size + n > chars:
            yield held
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield held


class Block:
    """Texts laid end to end: ``codes``, and where each text starts and ends."""

    def __init__(self, texts: list[str], lower: np.ndarray | None = None):
        parts = [codes_of(t) for t in texts]
        lengths = np.array([len(p) for p in parts], np.int64)
        self.starts = np.cumsum(lengths + 1) - lengths
        self.ends = self.starts + lengths
        codes = np.full(int((lengths + 1).sum()) + 1, SEPARATOR, np.uint32)
        for a, b, p in zip(self.starts, self.ends, parts):
            codes[a:b] = p
        small = np.minimum(codes, TABLE)
        if lower is not None:
            plain = codes < TABLE
            codes = np.where(plain, lower[small], codes)
            small = np.minimum(codes, TABLE)
        self.codes, self.small = codes, small
        self.kinds = CLASS[small]

    def wide(self) -> np.ndarray:
        """Of each text: whether it has code points beyond the table."""
        beyond = np.concatenate(([0], np.cumsum((self.codes >= TABLE) & (self.codes != SEPARATOR))))
        return beyond[self.ends] > beyond[self.starts]

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the code points of each span."""
        n = len(self.codes)
        wide = bool(((self.codes >= TABLE) & (self.codes != SEPARATOR)).any())
        values = _mix(self.codes) if wide else _MIX[self.small]
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _power(_P, n), out=sums[1:])
        return (sums[ends] - sums[starts]) * _power(_P_INVERSE, n)[starts] + (ends - starts).astype(np.uint64)

    def text(self) -> str:
        return np.where(self.codes == SEPARATOR, 10, self.codes).astype("<u4").tobytes().decode("utf-32-le")

    def counts(self, positions: np.ndarray) -> np.ndarray:
        """How many of the sorted positions each text holds."""
        return np.searchsorted(positions, self.ends) - np.searchsorted(positions, self.starts)


def runs(offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``o, o+1, ..., o+n-1`` of each run, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(offsets - (ends - lengths), lengths) + np.arange(total)


def alike(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each pair of runs of equal length (one at least) in ``a`` and ``b``:
    whether they hold the same."""
    if not len(lengths):
        return np.zeros(0, bool)
    return np.logical_and.reduceat(a[runs(a_at, lengths)] == b[runs(b_at, lengths)], np.cumsum(lengths) - lengths)


class WordCache:
    """Variable-length values of words.

    ``encode`` gets the words that are new and returns their values end to end
    and each one's length. A word is looked for by its hash and recognised by
    its characters, which the table keeps. The table is direct-mapped and of
    fixed size, the pools are dropped beyond a bound, so memory is bounded on
    any corpus; a dropped word is encoded again.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype, bits: int = 19, most: int = 24 << 20):
        self.encode, self.bits, self.most, self.dtype = encode, bits, most, dtype
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.sizes, self.places, self.offsets, self.lengths = (np.zeros(1 << self.bits, np.int64) for _ in range(4))
        self.pool, self.used = np.zeros(1 << 16, self.dtype), 0
        self.letters, self.written = np.zeros(1 << 16, np.uint32), 0

    @staticmethod
    def _room(pool: np.ndarray, used: int, need: int) -> np.ndarray:
        if need <= len(pool):
            return pool
        grown = np.zeros(max(need, 2 * len(pool)), pool.dtype)
        grown[:used] = pool[:used]
        return grown

    def lookup(self, block: Block, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each span's value lies in ``pool``, and its length. Spans
        aren't empty."""
        if self.used * self.pool.itemsize + self.written * 4 > self.most:
            self.clear()
        h, sizes = block.hashes(starts, ends), ends - starts
        slots = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        offsets, lengths = self.offsets[slots], self.lengths[slots]
        known = (self.keys[slots] == h) & (self.sizes[slots] == sizes)
        known[known] = alike(block.codes, starts[known], self.letters, self.places[slots[known]], sizes[known])
        missing = np.flatnonzero(~known)
        if len(missing):
            new, first, back = np.unique(h[missing], return_index=True, return_inverse=True)
            at = missing[first]
            # Words of one hash: those unlike the first are encoded each.
            same = sizes[missing] == sizes[at][back]
            same[same] = alike(block.codes, starts[missing[same]], block.codes, starts[at[back[same]]], sizes[missing[same]])
            odd = missing[~same]
            every = np.concatenate((at, odd))
            text = block.text()
            values, many = self.encode([text[a:b] for a, b in zip(starts[every].tolist(), ends[every].tolist())])
            need = self.used + len(values)
            self.pool = self._room(self.pool, self.used, need)
            self.pool[self.used : need] = values
            where = self.used + np.cumsum(many) - many
            self.used = need
            offsets[missing[same]], lengths[missing[same]] = where[back[same]], many[back[same]]
            offsets[odd], lengths[odd] = where[len(at) :], many[len(at) :]
            long = sizes[at]
            need = self.written + int(long.sum())
            self.letters = self._room(self.letters, self.written, need)
            self.letters[self.written : need] = block.codes[runs(starts[at], long)]
            put = slots[at]
            self.keys[put], self.sizes[put], self.places[put] = new, long, self.written + np.cumsum(long) - long
            self.offsets[put], self.lengths[put] = where[: len(at)], many[: len(at)]
            self.written = need
        return offsets, lengths
