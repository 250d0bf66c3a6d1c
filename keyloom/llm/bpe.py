"""Word splitting and merges for the two public BPE vocabularies."""

from __future__ import annotations

import json
import re

import numpy as np
import regex

from keyloom.llm.vectext import NUMBER, SPACE, STOP, TABLE, Block, runs

#: The endings that both patterns split off after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def _contractions(codes: np.ndarray, start: np.ndarray) -> None:
    """Where a token starts with an apostrophe and one of the endings, end it
    after the ending."""
    for i in np.flatnonzero(start & (codes == 39)).tolist():
        for ending in ENDINGS:
            n = len(ending)
            if codes[i + 1 : i + 1 + n].tolist() == [ord(c) for c in ending]:
                start[i + 1 : i + 1 + n] = False
                if i + 1 + n < len(start) and start[i + 1 + n] == 0:
                    start[i + 1 + n] = True
                break


def _spans(start: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    before = np.concatenate(([False], token[:-1]))
    return np.flatnonzero(start & token), np.flatnonzero(before & (start | ~token))


def spans_without_space(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Spans of runs of letters, single numbers and runs of other characters,
    with the endings split off; white space is dropped."""
    kinds = block.kinds
    before = np.concatenate(([STOP], kinds[:-1]))
    token = (kinds != SPACE) & (kinds != STOP)
    start = ((kinds != before) | (kinds == NUMBER)) & token
    _contractions(block.codes, start)
    return _spans(start & token, token)


def spans_with_space(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Spans of runs of letters, numbers and other characters, each with one
    blank before it; of longer white space, all but its last character is a
    span of its own."""
    kinds = block.kinds
    before = np.concatenate(([STOP], kinds[:-1]))
    after = np.concatenate((kinds[1:], [STOP]))
    space = kinds == SPACE
    token = kinds != STOP
    joined = np.concatenate(([False], block.codes[:-1] == 32))
    inner = space & (before == SPACE)
    start = np.where(space, ~inner | ((after != SPACE) & (after != STOP)), np.where(before == SPACE, ~joined, kinds != before))
    start = start & token
    _contractions(block.codes, start)
    return _spans(start & token, token)


def spans_by_pattern(texts: list[str], firsts: np.ndarray, pattern: regex.Pattern) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pattern's matches, for texts beyond the class table."""
    found = [(int(a) + m.start(), int(a) + m.end()) for t, a in zip(texts, firsts) for m in pattern.finditer(t)]
    out = np.array(found, np.int64).reshape(-1, 2)
    return out[:, 0], out[:, 1]


class PairTable:
    """Open-addressing table from a pair of token ids to its merge's rank and
    result, looked up for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, made: np.ndarray, bits: int = 19):
        self.bits = bits
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.zeros(1 << bits, np.int32)
        self.made = np.zeros(1 << bits, np.int32)
        keys = left.astype(np.int64) << 20 | right
        todo = np.arange(len(keys))
        slots = self._slot(keys)
        while len(todo):
            free = self.keys[slots[todo]] == -1
            put = todo[free][::-1]
            self.keys[slots[put]] = keys[put]
            own = self.keys[slots[todo]] == keys[todo]
            done = todo[own]
            self.ranks[slots[done]], self.made[slots[done]] = rank[done], made[done]
            todo = todo[~own]
            slots[todo] = (slots[todo] + 1) & ((1 << bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, none: int) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``none`` where the pair has no merge) and result."""
        keys = left.astype(np.int64) << 20 | right
        slots = self._slot(keys)
        rank, made = np.full(len(keys), none, np.int32), np.zeros(len(keys), np.int32)
        held = self.keys[slots]
        own = held == keys
        rank[own], made[own] = self.ranks[slots[own]], self.made[slots[own]]
        todo = np.flatnonzero(~own & (held != -1))
        while len(todo):
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slots[todo]]
            hit = todo[held == keys[todo]]
            rank[hit], made[hit] = self.ranks[slots[hit]], self.made[slots[hit]]
            todo = todo[(held != -1) & (held != keys[todo])]
        return rank, made


class WordBpe:
    """Ids of lower-case words under a vocabulary whose words end in a mark.

    All words of a call are merged together, one merge of each word at a time.
    """

    NONE = np.iinfo(np.int32).max

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, mark = model["vocab"], model["end_of_word_suffix"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        self.pairs = PairTable(ids[:, 0], ids[:, 1], np.arange(len(ids)), ids[:, 2])
        shown = _byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + mark] for c in shown], np.int32)
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.lower = np.arange(TABLE + 1, dtype=np.uint32)
        for c in range(TABLE):
            if len(chr(c).lower()) == 1:
                self.lower[c] = ord(chr(c).lower())
        self.special = re.compile(f"[{chr(TABLE)}-{chr(0x10FFFF)}İ]")
        #: The vocabulary's own pattern, for texts beyond the class table.
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")

    def plain(self, text: str) -> str:
        """The text as the table can split it: as it is, or normalized where
        it has characters whose lower case or composition isn't one to one."""
        if text.isascii() or not self.special.search(text):
            return text
        return self.whole.normalizer.normalize_str(text)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [w.encode("utf-8") for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        firsts = np.cumsum(sizes) - sizes
        lengths = np.zeros(len(words), np.int64)
        parts = []
        for low, high in ((0, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 48), (48, 128)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                ids, lengths[rows] = self._merge(flat, firsts[rows], sizes[rows], high)
                parts.append((rows, ids))
        for i in np.flatnonzero(sizes > 128).tolist():
            ids = np.array(self.whole.encode(words[i], add_special_tokens=False).ids, np.int32)
            lengths[i] = len(ids)
            parts.append((np.array([i]), ids))
        out = np.zeros(int(lengths.sum()), np.int32)
        places = np.cumsum(lengths) - lengths
        for rows, ids in parts:
            out[runs(places[rows], lengths[rows])] = ids
        return out, lengths

    def _merge(self, flat, firsts, sizes, width) -> tuple[np.ndarray, np.ndarray]:
        columns = np.arange(width)
        at = np.minimum(firsts[:, None] + columns, len(flat) - 1)
        ids = self.inner[flat[at]]
        ids[columns >= sizes[:, None]] = -1
        index = np.arange(len(sizes))
        ids[index, sizes - 1] = self.last[flat[firsts + sizes - 1]]
        rank = np.full((len(sizes), width), self.NONE, np.int32)
        made = np.zeros((len(sizes), width), np.int32)
        r, c = np.nonzero(columns[:-1] + 1 < sizes[:, None])
        rank[r, c], made[r, c] = self.pairs.find(ids[r, c], ids[r, c + 1], self.NONE)
        n = sizes.copy()
        live = index
        while len(live):
            best = rank[live].argmin(1)
            more = rank[live, best] < self.NONE
            live, best = live[more], best[more]
            if not len(live):
                break
            take = np.minimum(columns + (columns > best[:, None]), width - 1)
            merged = made[live, best]
            for x in (ids, rank, made):
                x[live] = np.take_along_axis(x[live], take, 1)
            ids[live, best] = merged
            n[live] -= 1
            rank[live, n[live] - 1] = self.NONE
            for left in (best - 1, best):
                ok = (left >= 0) & (left + 1 < n[live])
                row, col = live[ok], left[ok]
                rank[row, col], made[row, col] = self.pairs.find(ids[row, col], ids[row, col + 1], self.NONE)
        return ids[columns < n[:, None]], n


def _byte_characters() -> list[str]:
    """The visible character that stands for each byte in byte-level
    vocabularies: printable Latin-1 as itself, the rest from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in shown:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out
