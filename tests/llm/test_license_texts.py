"""License texts that are whole, altered or cut."""

from __future__ import annotations

import re
import time

import numpy as np
import pytest

from keyloom.llm import license_scan

#: Public license wording, here to the next table.
CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution. """
THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
from this software without specific prior written permission. """
BSD = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE
COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING,
BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED
AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. """
MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies. """
ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER
TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. """
GPL_END = """This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty
of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""
TEXTS = {"bsd-2-clause": (CLAUSES, BSD), "bsd-3-clause": (CLAUSES + THIRD, BSD), "mit-text": (MIT, MIT_END), "isc": (ISC, ISC_END), "gpl-notice": (GPL, GPL_END)}


def labels(text):
    own = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    words = license_scan.words_of(text)
    return {label for label, *_ in own.found(words)} if own.candidate(text.lower()) else set()


@pytest.mark.parametrize("label", sorted(TEXTS))
def test_whole_altered_and_cut(label):
    grant, end = TEXTS[label]
    assert labels("Copyright 2020 A. Body. " + grant + end + " More words.") == {label}
    assert labels(grant) == set()
    for word in ("MERCHANTABILITY", "FITNESS"):
        assert labels(grant + end.replace(word, "USE")) == set()
    assert labels(grant + " ".join(end.split()[:-1])) == set()


def test_another_holder():
    text = MIT + MIT_END.replace("THE AUTHORS OR COPYRIGHT HOLDERS", "ACME INC")
    assert labels(text) == {"mit-text"}


def test_notices_of_one_line():
    assert labels("This code is released under the MIT License.") == {"mit"}
    assert labels("Licensed under the Apache License, Version 2.0") == {"apache-2.0"}


def test_denied():
    assert labels("This is not licensed under the MIT License.") == set()
    assert labels("It isn't distributed under the MIT License, but licensed under the Apache License, Version 2.0") == {"apache-2.0"}
    assert labels("This code is not finished. It is released under the MIT License.") == {"mit"}


MARKUP = re.compile(r"<<(opt|end|var)\s*(\d*)>>|((?:(?!<<(?:opt|end|var)).)+)", re.S)


def sample(template, optional, var):
    """The template's words with all or no optional regions, and ``var`` words
    (of those allowed, None for all) for each replaceable one."""
    out, depth = [], 0
    for mark, n, plain in MARKUP.findall(template):
        if mark == "opt":
            depth += 1
        elif mark == "end":
            depth -= 1
        elif optional or not depth:
            out += ["zz"] * (int(n) if var is None else var if var >= 0 else int(n) - var) if mark else license_scan.words_of(plain)
    return out


def as_regex(template):
    """The same template as a regular expression over words with a blank after
    each."""
    out = []
    for mark, n, plain in MARKUP.findall(template):
        if mark == "opt":
            out.append("(?:")
        elif mark == "end":
            out.append(")?")
        elif mark:
            out.append(r"(?:\S+ ){0,%s}" % n)
        else:
            out += [re.escape(w) + " " for w in license_scan.words_of(plain)]
    return re.compile(r"(?<!\S)" + "".join(out))


@pytest.mark.parametrize("label", sorted(license_scan.TEMPLATES))
def test_every_template(label):
    template = license_scan.TEMPLATES[label]
    own = license_scan.Automaton(template)
    for optional in (True, False):
        for var in (None, 0):
            words = sample(template, optional, var)
            assert own.match(words, 0) == len(words)
            assert label in labels(" ".join(["so", *words, "then"]))
    words = sample(template, False, 0)
    for i in range(len(words)):
        assert own.match([*words[:i], "zzz", *words[i + 1 :]], 0) < len(words)
    too_long = sample(template, False, -1)
    if too_long != words:  # a replaceable region outside the optional ones
        assert own.match(too_long, 0) < len(too_long)


def test_labels_by_regular_expressions():
    """Random mixtures of wording, against the longest match of each regular
    expression at each word."""
    random = np.random.default_rng(6)
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    regexes = {label: as_regex(t) for label, t in license_scan.TEMPLATES.items()}
    short = [label for label, t in license_scan.TEMPLATES.items() if len(t) < 300]
    for _ in range(150):
        words = []
        for _ in range(random.integers(1, 6)):
            piece = sample(license_scan.TEMPLATES[short[random.integers(len(short))]], bool(random.integers(2)), 0)
            if random.integers(3) == 0:
                del piece[random.integers(len(piece))]
            words += piece + ["and", "not"][: random.integers(3)]
        text, want = " ".join(words) + " ", set()
        for label, r in regexes.items():
            at = 0
            starts = [0, *(m.end() for m in re.finditer(" ", text))][:-1]
            found = []
            for i, at in enumerate(starts):
                ends = [m.end() for m in [r.match(text, at)] if m]
                if ends:
                    found.append((i, i + text[at : ends[0]].count(" ")))
            taken = []
            for a, b in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
                if all(b <= c or d <= a for c, d in taken):
                    taken.append((a, b))
            want |= {(label, a, b) for a, b in taken if not (a and words[a - 1] in license_scan.DENIALS)}
        assert set(scanner.found(words)) == want


def test_many_matches():
    """100,000 notices in one text take seconds."""
    scanner = license_scan.Scanner(license_scan.PHRASES, license_scan.TEMPLATES)
    words = "this is licensed under the mit license now".split() * 100_000
    start = time.perf_counter()
    assert len(scanner.found(words)) == 100_000
    assert time.perf_counter() - start < 60
