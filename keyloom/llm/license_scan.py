"""License scans by template-markup matching.

A template is license wording with markup: ``<<opt>>...<<end>>`` is a region
that may be absent, ``<<var N>>`` stands for up to N words of any kind. Each
template becomes an automaton over words; a passage is accepted where its
mandatory wording matches exactly, word for word, and takes the template's
label, unless a word of denial stands right before it ("not licensed under
..."). Besides, fixed phrases are counted where their words stand
consecutively (the base labels).

Words are runs of ASCII letters and digits and of any other characters beyond
ASCII, with A-Z in lower case.

Results by case: a null text counts as empty; a text without words has no
spans and score 0; repeated rows each give their own row; of a template's
matches that overlap the longest counts, then the first; an empty table gives an empty one; of
other columns, those named in ``keep`` are carried.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import schema_with
from keyloom.llm.vectext import SEPARATOR, Block, blocks

#: Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Public license wording, with this module's markup. Texts and
#: notices of several sentences are whole, disclaimers included; the rest are
#: one-line notices, with labels of their own.
TEMPLATES = {
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
        notice <<opt>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
        OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE""",
    "mit": "<<opt>>This <<var 3>> is<<end>> <<opt>>released<<end>> <<opt>>licensed<<end>> <<opt>>distributed<<end>> under the <<opt>>terms of the<<end>> MIT License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 <<opt>>(the \"License\"); you may not use this file except in compliance with the License<<end>>",
    "gpl-3.0": "licensed under the GNU General Public License, version 3 <<opt>>or <<opt>>(at your option)<<end>> any later version<<end>>",
    "gpl-2.0": "licensed under the GNU General Public License, version 2 <<opt>>or <<opt>>(at your option)<<end>> any later version<<end>>",
    "gpl-notice": """This program is free software<<opt>>:<<end>> you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version <<var 1>> of the License, or (at your
        option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without
        even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details""",
    "cc-by-nc-4.0": "Licensed under <<opt>>the<<end>> <<opt>>terms of<<end>> CC BY-NC 4.0",
    "cc-by-nc": "licensed under a Creative Commons Attribution-NonCommercial <<var 1>> <<opt>>International<<end>> License",
    "bsd-2-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<opt>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. <<opt>>2.<<end>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. THIS SOFTWARE IS PROVIDED BY <<var 12>> "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE""",
    "bsd-3-clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: <<opt>>1.<<end>> Redistributions of source code must retain the above copyright notice, this list
        of conditions and the following disclaimer. <<opt>>2.<<end>> Redistributions in binary form must reproduce the above copyright
        notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. <<opt>>3.<<end>> Neither the name of <<var 12>> nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY <<var 12>> "AS IS" AND ANY
        EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
        PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL,
        EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE,
        DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
        LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF
        THE POSSIBILITY OF SUCH DAMAGE""",
    "isc": """Permission to use, copy, modify, and<<opt>>/or<<end>> distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND <<var 12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var 12>> BE LIABLE FOR ANY
        SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
        WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE""",
    "zlib": """This software is provided <<opt>>'<<end>>as-is<<opt>>'<<end>>, without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: <<opt>>1.<<end>> The
        origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this
        software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<opt>>2.<<end>>
        Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. <<opt>>3.<<end>>
        This notice may not be removed or altered from any source distribution""",
    "apache-notice": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at <<opt>>http<<end>> <<opt>>https<<end>> www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
        law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License""",
    "cc-by-4.0": "licensed under <<opt>>the<<end>> <<opt>>a<<end>> Creative Commons Attribution 4.0 <<opt>>International<<end>> <<opt>>Public<<end>> License",
    "cc-by-sa": "licensed under <<opt>>the<<end>> <<opt>>a<<end>> Creative Commons Attribution-ShareAlike <<var 1>> <<opt>>International<<end>> <<opt>>Unported<<end>> License",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at <<opt>>http<<end>> <<opt>>https<<end>> mozilla.org/MPL/2.0""",
}

#: Words that deny what follows them.
DENIALS = frozenset("not never no neither nor without cannot t".split())

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate(_LOWER))


class Automaton:
    """States with moves on a word, on any word, and free ones."""

    def __init__(self, template: str):
        self.on: list[dict[str, int]] = [{}]
        self.any: list[int] = [-1]
        self.free: list[list[int]] = [[]]
        at, open_ = 0, []
        for mark, n, plain in re.findall(r"<<(opt|end|var)\s*(\d*)>>|((?:(?!<<(?:opt|end|var)).)+)", template, re.S):
            if mark == "opt":
                open_.append(at)
            elif mark == "end":
                at = self._new(at)
                self.free[open_.pop()].append(at)
            elif mark == "var":
                ways = [at]
                for _ in range(int(n)):
                    after = self._new()
                    self.any[at] = after
                    at = after
                    ways.append(at)
                at = self._new(at)
                for w in ways[:-1]:
                    self.free[w].append(at)
            else:
                for word in words_of(plain):
                    after = self._new()
                    self.on[at][word] = after
                    at = after
        self.last = at
        self.first = {w for s in self._closed({0}) for w in self.on[s]}

    def _new(self, from_: int | None = None) -> int:
        self.on.append({})
        self.any.append(-1)
        self.free.append([])
        n = len(self.on) - 1
        if from_ is not None:
            self.free[from_].append(n)
        return n

    def _closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[str], at: int) -> int:
        """Where the longest match from ``at`` ends, or -1."""
        states, found = self._closed({0}), -1
        for i in range(at, len(words) + 1):
            if self.last in states:
                found = i
            if i == len(words):
                break
            w = words[i]
            states = self._closed({t for s in states for t in (self.on[s].get(w, -1), self.any[s]) if t >= 0})
            if not states:
                break
        return found


class Scanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = [(p.split(), label) for p, label in phrases.items()]
        self.automata = [(Automaton(t), label) for label, t in templates.items()]
        self.starts: dict[str, list] = {}
        for own, label in self.automata:
            for w in own.first:
                self.starts.setdefault(w, []).append((own, label))
        # A text can hold a phrase or a template only with all its needed words.
        needed = [set(p) for p, _ in self.phrases] + [self._needed(t) for t in templates.values()]
        self.needed = [sorted(x, key=lambda w: (-len(w), w))[:3] for x in needed]

    @staticmethod
    def _needed(template: str) -> set[str]:
        plain = re.sub(r"<<var\s*\d+>>", " ", template)
        while (out := re.sub(r"<<opt>>(?:(?!<<opt>>|<<end>>).)*<<end>>", " ", plain, flags=re.S)) != plain:
            plain = out
        return set(words_of(plain))

    def base(self, words: list[str]) -> list[tuple[str, int]]:
        out = []
        for i, w in enumerate(words):
            out += [(label, i) for p, label in self.phrases if p[0] == w and words[i : i + len(p)] == p]
        return out

    def found(self, words: list[str]) -> list[tuple[str, int, int]]:
        """Accepted passages; of those of one label that overlap, the longest
        (then the first), and of what is left those that aren't denied."""
        every: dict[str, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(words):
            for own, label in self.starts.get(w, ()):
                end = own.match(words, i)
                if end > i:
                    every.setdefault(label, []).append((i - end, i, end))
        out: list[tuple[str, int, int]] = []
        for label, matches in every.items():
            # What is taken doesn't overlap, so a match only has to be held
            # against its neighbours.
            starts: list[int] = []
            ends: dict[int, int] = {}
            for _, i, end in sorted(matches):
                at = bisect_left(starts, i)
                if (at < len(starts) and starts[at] < end) or (at and ends[starts[at - 1]] > i):
                    continue
                starts.insert(at, i)
                ends[i] = end
            out += [(label, i, ends[i]) for i in starts if not (i and words[i - 1] in DENIALS)]
        return sorted(out, key=lambda x: (x[1], x[0]))

    def candidate(self, lowered: str) -> bool:
        return any(all(w in lowered for w in need) for need in self.needed)


@lru_cache(maxsize=4)
def _scanner(phrases: tuple, templates: tuple) -> Scanner:
    return Scanner(dict(phrases), dict(templates))


def count_words(texts: list[str]) -> np.ndarray:
    block = Block(texts)
    c = block.codes
    inside = ((c >= 48) & (c <= 57)) | ((c >= 65) & (c <= 90)) | ((c >= 97) & (c <= 122)) | ((c >= 128) & (c != SEPARATOR))
    return block.counts(np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1]))))


def scan(df: DataFrame, text: str, keep: list[str], phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``keep``, n_words, base: array of (label, word) for each place of a
    phrase, found: array of (label, word, until) for each accepted passage."""
    key = tuple(phrases.items()), tuple(templates.items())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scanner(*key)
        base_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
        found_type = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64()), ("until", pa.int64())]))
        for batch in batches:
            at = 0
            for held in blocks(zip(batch.column(0).to_pylist()), lambda r: r[0] or ""):
                texts = [r[0] or "" for r in held]
                base, found = [], []
                for t in texts:
                    words = words_of(t) if own.candidate(t.lower()) else []
                    base.append([{"label": a, "word": i} for a, i in own.base(words)])
                    found.append([{"label": a, "word": i, "until": j} for a, i, j in own.found(words)])
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, len(held)) for c in batch.columns[1:]), pa.array(count_words(texts), pa.int64()), pa.array(base, base_type), pa.array(found, found_type)],
                    names=[*batch.schema.names[1:], "n_words", "base", "found"],
                )
                at += len(held)

    fields = schema_with(df, keep, "n_words long, base array<struct<label: string, word: long>>, found array<struct<label: string, word: long, until: long>>")
    return df.select(text, *keep).mapInArrow(run, fields)


def summary(scanned: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, n_words, n_base, first_word, last_word, base_labels, labels
    and score: 1 with an accepted passage, 0.5 with a phrase alone, else 0."""
    base, found = F.col("base"), F.col("found")
    labels = lambda *a: F.array_join(F.sort_array(F.array_distinct(F.concat(*(x["label"] for x in a)))), ",")
    return scanned.select(
        *keep,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"),
        F.array_max(base["word"]).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, found).alias("labels"),
        F.when(F.size(found) > 0, 1.0).when(F.size(base) > 0, 0.5).otherwise(0.0).alias("score"),
    )
