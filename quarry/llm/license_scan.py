"""License scan by patience alignment.

A license template is found in a text by aligning words: words that occur once
in the text's region and once in the template are anchors; their longest
increasing subsequence is kept, and the gaps between are aligned the same way,
after equal words at a gap's ends are matched. Coverage is the share of the
template's words that are aligned; a match has ``least`` or more.

Where to align. The words that tell a license from its rivals (name, variant,
version) are its template's key phrases. A match has all of them aligned, with
no other word between the words of a phrase: "BSD License" is no altered "MIT
License", and "GNU Lesser General Public License" no GNU General one. So places
of the first phrase are looked up in whole batches, and only around them the
words before and behind it are aligned, up to the next such place and in
stretches of at most ``STRETCH`` times the template's words.

A long template (over ``LONG`` words) is also found where a key phrase is altered
or missing, a title left out for instance: runs of ``RUN`` words, spread over the
template, are looked up in whole batches too; where several stand at their
distances the template is aligned around them. Such a match must be nearly whole
(``KEYLESS``), with hardly a foreign word in between, and stands behind any match
with about as many words that lies there: key phrases decide between rivals.

A template without key phrases (a caller's own) is looked for by its words
alone. A match needs nearly all of its distinct words: a document without them is
passed by (this loses nothing: ``distinct - (1 - least) * words`` of them are in
any match). Else its words are walked from left to right; wherever a stretch
holds enough distinct words, it is aligned, and the walk goes on behind the
match. So repeated notices are all found, and the cost follows the text.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased, and
compared by 64-bit hashes computed for whole batches; the scan needs no shuffle.

Defined results: null and empty texts match nothing. The best match has the most
aligned words; ties go to the higher coverage, the earlier place, the name. Templates
without words are ignored. Repeated rows give repeated results; other columns
are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import hashing

LEAST = 0.8
STRETCH = 2
LONG = 150  # words of a template that may be found without its key phrases
KEYLESS = 0.97  # coverage that this takes, and share of the template's words in the stretch
RUN, RUNS, LEAST_RUNS = 8, 24, 3  # words of a run, runs of a template, runs near one another that are worth an alignment
_ODD = np.uint64(0x9E3779B97F4A7C15)
BETWEEN = ~hashing.byte_set((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))

# The notices to look for (public license texts).
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for "
        "more details."),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
        "language governing permissions and limitations under the License."),
    "BSD": "Released under the BSD License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Licensed under CC0 1.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more "
        "details."),
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later "
        "version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
        "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for "
        "more details."),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
        "and this permission notice shall be included in all copies or substantial portions of the Software."),
    "MPL-2.0": "Licensed under the Mozilla Public License, Version 2.0.",
}

# Whole license texts: short ones put together here, long ones in ``licenses/``.
_GRANT = TEMPLATES["MIT-grant"].split(", subject to the following conditions: ")[0]
_NO_WARRANTY = (
    " THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. {}"
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR "
    "TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE.")
_ADVERTISING = (
    "All advertising materials mentioning features or use of this software must display the following acknowledgement: This "
    "product includes software developed by the organization. ")
_ENDORSE = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. ")
TEMPLATES |= {
    "BSD-2-Clause-text": _BSD.format(""),
    "BSD-3-Clause-text": _BSD.format(_ENDORSE),
    "BSD-4-Clause-text": _BSD.format(_ADVERTISING + _ENDORSE),
    "ISC-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" "
        "AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
        "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    "MIT-text": TEMPLATES["MIT-grant"] + _NO_WARRANTY,
    "MIT-0-text": _GRANT + "." + _NO_WARRANTY,
} | {f"{p.stem}-text": p.read_text(encoding="utf-8") for p in Path(__file__).with_name("licenses").glob("*.txt")}

# Key phrases of each template; the first occurs once in it.
_GNU = "GNU {}General Public License as published"
KEYS = {
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "AGPL-3.0-header": (_GNU.format("Affero "), "version 3 of the License"),
    "Apache-2.0": ("Apache License, Version 2.0",),
    "Apache-2.0-header": ("Apache License, Version 2.0",),
    "BSD": ("BSD License",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License",),
    "CC-BY-4.0": ("CC BY 4.0",),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0",),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0",),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0",),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0",),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0",),
    "CC0-1.0": ("CC0 1.0",),
    "GPL-2.0": ("GNU General Public License, version 2",),
    "GPL-2.0-header": (_GNU.format(""), "version 2 of the License"),
    "GPL-3.0": ("GNU General Public License, version 3",),
    "GPL-3.0-header": (_GNU.format(""), "version 3 of the License"),
    "ISC": ("ISC License",),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-2.1-header": (_GNU.format("Lesser "), "version 2.1 of the License"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "MIT": ("MIT License",),
    "MIT-grant": ("The above copyright notice and this permission notice shall be included in all copies",),
    "MPL-2.0": ("Mozilla Public License, Version 2.0",),
    # texts
    "Apache-2.0-text": ("Apache License Version 2.0, January 2004",),
    "BSD-2-Clause-text": ("provided with the distribution. THIS SOFTWARE IS PROVIDED",),
    "BSD-3-Clause-text": ("to endorse or promote products derived from this software",),
    "BSD-4-Clause-text": ("must display the following acknowledgement", "to endorse or promote products derived from this software"),
    "CC-BY-SA-4.0-text": ("Creative Commons Attribution-ShareAlike 4.0 International Public License By exercising",),
    "CC0-1.0-text": ("CC0 1.0 Universal",),
    "GPL-2.0-text": ("GNU General Public License Version 2, June 1991",),
    "GPL-3.0-text": ("GNU General Public License Version 3, 29 June 2007",),
    "ISC-text": ("provided that the above copyright notice and this permission notice appear in all copies",),
    "LGPL-2.1-text": ("GNU Lesser General Public License Version 2.1, February 1999",),
    "LGPL-3.0-text": ("GNU Lesser General Public License Version 3, 29 June 2007",),
    "MIT-text": ("The above copyright notice and this permission notice shall be included in all copies",),
    "MIT-0-text": ("furnished to do so. THE SOFTWARE IS PROVIDED",),
    "MPL-2.0-text": ("Mozilla Public License Version 2.0",),
}


def hashed(text: str) -> list[int]:
    return hashing.words_of([text.encode()], BETWEEN, hashing.LOWER)[0].tolist()


def places_of(phrase: list[int], words: np.ndarray) -> np.ndarray:
    """Where the words of a phrase stand side by side."""
    at = np.flatnonzero(words[:max(0, len(words) - len(phrase) + 1)] == np.uint64(phrase[0]))
    for j, w in enumerate(phrase[1:], 1):
        at = at[words[at + j] == np.uint64(w)]
    return at


def longest_increasing(values: list[int]) -> list[int]:
    """Places of a longest strictly increasing subsequence (patience piles)."""
    tops, places, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        back[i] = places[pile - 1] if pile else -1
        if pile == len(tops):
            tops.append(v)
            places.append(i)
        else:
            tops[pile], places[pile] = v, i
    out, i = [], places[-1] if places else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def align(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places (in text, in template), increasing in both."""
    out, gaps = [], [(0, len(text), 0, len(template))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        in_text, in_template = Counter(text[a:b]), Counter(template[c:d])
        at = {w: i for i, w in enumerate(template[c:d], c) if in_template[w] == 1 and in_text[w] == 1}
        unique = [(i, at[w]) for i, w in enumerate(text[a:b], a) if w in at]
        anchors = [unique[k] for k in longest_increasing([j for _, j in unique])]
        if anchors:
            out += anchors
            ends = [(a - 1, c - 1), *anchors, (b, d)]
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


def side(text: list[int], template: list[int]) -> list[tuple[int, int]]:
    """Aligned places from the start of a text on, in the stretch where they are densest.

    A word passed over costs half of what an aligned word gains, so a far word
    of the next notice does not stand in for one that is altered here.
    """
    best, most, n = [], 0.0, len(template)
    for width in sorted({min(len(text), w) for w in (n, n + n // 4, n + n // 2, STRETCH * n)}):
        pairs = align(text[:width], template)
        gain = len(pairs) - 0.5 * (pairs[-1][0] + 1 - len(pairs)) if pairs else 0.0
        if gain > most:
            best, most = pairs, gain
        if len(pairs) == n:
            break
    return best


def run_hashes(words: np.ndarray) -> np.ndarray:
    """A hash of the RUN words from each place on."""
    n = max(0, len(words) - RUN + 1)
    out = np.zeros(n, np.uint64)
    for j in range(RUN):
        out = (out + words[j:j + n]) * _ODD
    return hashing.mix(out)


class Scanner:
    """All templates, ready to be looked for in hashed words."""

    def __init__(self, templates: dict[str, str], least: float, keys: dict[str, tuple[str, ...]] | None = None):
        self.least, self.templates, self.keyed = least, [], []
        runs = []  # (hash of a run of words, number of the keyed template, place in it)
        for name, text in sorted(templates.items()):
            words = hashed(text)
            if phrases := [hashed(p) for p in (keys or {}).get(name, ())]:
                at = [places_of(p, np.array(words, np.uint64)).tolist() for p in phrases]
                if len(at[0]) != 1 or not all(at):
                    raise ValueError(f"template {name} lacks a key phrase, or repeats the first")
                if len(words) > LONG:
                    h = run_hashes(np.array(words, np.uint64))
                    once = [i for i in np.linspace(0, len(h) - 1, RUNS).astype(int).tolist() if (h == h[i]).sum() == 1]
                    runs += [(h[i], len(self.keyed), i) for i in once]
                self.keyed.append((name, words, phrases[0], [(a[0], a[0] + len(p)) for a, p in zip(at, phrases)]))
            elif words:
                need = max(1, int(np.ceil(len(set(words)) - (1 - least) * len(words) - 1e-9)))
                self.templates.append((name, words, frozenset(words), need))
        self.vocabulary = np.unique(np.array([w for _, words, _, _ in self.templates for w in words], np.uint64))
        self.runs = defaultdict(list)
        for h, k, i in runs:
            self.runs[int(h)].append((k, i))
        self.run_hashes = np.array(sorted(self.runs), np.uint64)

    def matches(self, words: np.ndarray, known: np.ndarray) -> list[tuple[str, float, int, int]]:
        """(template, coverage, first word, last word) in a text; ``known`` are the places of template words."""
        here = words[known].tolist()
        present, out = set(here), []
        for name, template, vocabulary, need in self.templates:
            if len(present & vocabulary) >= need:
                mine = [(p, w) for p, w in zip(known.tolist(), here) if w in vocabulary]
                out += [(name, *m) for m in self.walk(words, mine, template, need)]
        return out

    def walk(self, words: np.ndarray, mine: list[tuple[int, int]], template: list[int], need: int) -> Iterator[tuple]:
        span, count, right, distinct, i = STRETCH * len(template), Counter(), 0, 0, 0
        while i < len(mine):
            start = mine[i][0]
            while right < len(mine) and mine[right][0] < start + span:
                count[mine[right][1]] += 1
                distinct += count[mine[right][1]] == 1
                right += 1
            behind = i + 1
            if distinct >= need:
                pairs = side(words[start:start + span].tolist(), template)
                if len(pairs) >= self.least * len(template) - 1e-9 and pairs[0][0] == 0:
                    last = start + pairs[-1][0]
                    yield len(pairs) / len(template), start, last
                    behind = next((k for k in range(i, len(mine)) if mine[k][0] > last), len(mine))
            for k in range(i, min(behind, right)):
                count[mine[k][1]] -= 1
                distinct -= count[mine[k][1]] == 0
            i = behind
            right = max(right, i)

    def around(self, words: np.ndarray, places: list[int], template: list[int], spans: list[tuple[int, int]]) -> Iterator[tuple]:
        """The matches around the places of the first key phrase in a text."""
        (a, b), behind = spans[0], 0
        for p, following in zip(places, [*places[1:], len(words)]):
            q = p + b - a
            left = side(words[max(behind, p - STRETCH * a):p][::-1].tolist(), template[:a][::-1])
            right = side(words[q:min(following, q + STRETCH * (len(template) - b))].tolist(), template[b:])
            at = {a - 1 - j: p - 1 - i for i, j in left} | {j: p + j - a for j in range(a, b)} | {b + j: q + i for i, j in right}
            behind = q
            whole = all(c in at and at.get(j) == at[c] + j - c for c, d in spans[1:] for j in range(c, d))
            if whole and len(at) >= self.least * len(template) - 1e-9:
                yield len(at) / len(template), min(at.values()), max(at.values())
                behind = max(at.values()) + 1

    def key_places(self, words: np.ndarray, counts: np.ndarray) -> dict[int, dict[int, list[int]]]:
        """Number of the text -> number of the keyed template -> places of its first key phrase in the text."""
        ends, out = np.cumsum(counts), defaultdict(lambda: defaultdict(list))
        for k, (_, _, phrase, _) in enumerate(self.keyed):
            at = places_of(phrase, words)
            text = np.searchsorted(ends, at, "right")
            for t, p in zip(text.tolist(), at.tolist()):
                if p + len(phrase) <= ends[t]:
                    out[t][k].append(p - int(ends[t] - counts[t]))
        return out

    def run_places(self, words: np.ndarray, counts: np.ndarray) -> dict[int, dict[int, list[tuple[int, int]]]]:
        """Number of the text -> number of the keyed template -> (place in the text, in the template) of its runs."""
        out: dict = defaultdict(lambda: defaultdict(list))
        if not len(self.run_hashes) or len(words) < RUN:
            return out
        h = run_hashes(words)
        at = np.minimum(np.searchsorted(self.run_hashes, h), len(self.run_hashes) - 1)
        found = np.flatnonzero(self.run_hashes[at] == h)
        ends = np.cumsum(counts)
        text = np.searchsorted(ends, found, "right")
        for t, p in zip(text.tolist(), found.tolist()):
            if p + RUN <= ends[t]:
                for k, i in self.runs[int(h[p])]:
                    out[t][k].append((p - int(ends[t] - counts[t]), i))
        return out

    def along(self, words: np.ndarray, hits: list[tuple[int, int]], template: list[int], taken: list[tuple]) -> Iterator[tuple]:
        """Nearly whole copies of a long template around its runs, key phrases or not; ``taken``: its matches so far."""
        behind = 0
        for n, (p, i) in enumerate(hits):
            if p < behind or any(m[2] <= p <= m[3] for m in taken):
                continue
            near = [x for x in hits[n:n + 2 * RUNS] if abs((x[0] - p) - (x[1] - i)) <= len(template) * (1 - KEYLESS) * 2 + RUN]
            if len(near) < LEAST_RUNS:
                continue
            left = side(words[max(behind, p - i - i // 4):p][::-1].tolist(), template[:i][::-1])
            rest = len(template) - i - RUN
            right = side(words[p + RUN:p + RUN + rest + rest // 4 + RUN].tolist(), template[i + RUN:])
            at = {i - 1 - y: p - 1 - x for x, y in left} | {y: p + y - i for y in range(i, i + RUN)} | {i + RUN + y: p + RUN + x for x, y in right}
            first, last = min(at.values()), max(at.values())
            if len(at) >= KEYLESS * len(template) and (last - first + 1) * KEYLESS <= len(template):
                yield len(at) / len(template), first, last
                behind = last + 1

    def scan(self, texts) -> Iterator[list[tuple]]:
        for _, group in hashing.blocks(texts):
            h, counts = hashing.words_of(group, BETWEEN, hashing.LOWER)
            keys = self.key_places(h, counts)
            runs = self.run_places(h, counts)
            at = np.searchsorted(self.vocabulary, h)
            known = np.flatnonzero(self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == h) if len(self.vocabulary) else h[:0].astype(np.int64)
            start = 0
            for t, n in enumerate(counts.tolist()):
                a, b = np.searchsorted(known, [start, start + n]) if len(known) else (0, 0)
                words = h[start:start + n]
                out = self.matches(words, known[a:b] - start) if a < b else []
                for k, places in keys.get(t, {}).items():
                    name, template, _, spans = self.keyed[k]
                    out += [(name, *m) for m in self.around(words, places, template, spans)]
                without_key = []
                for k, hits in runs.get(t, {}).items():
                    name, template = self.keyed[k][:2]
                    without_key += [(name, *m, len(template)) for m in self.along(words, hits, template, [m for m in out if m[0] == name])]
                # a rival that has its key phrases there, or more words, stands before it
                sizes = {x[0]: len(x[1]) for x in self.keyed} | {x[0]: len(x[1]) for x in self.templates}
                for m in sorted(without_key, key=lambda m: (-m[1] * m[4], m[0])):
                    if not any(o[2] <= m[3] and m[2] <= o[3] and o[1] * sizes[o[0]] >= KEYLESS * m[1] * m[4] for o in out):
                        out.append(m[:4])
                yield out
                start += n


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST,
         keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, matches: every notice found, with coverage and word places."""
    wanted = dict(TEMPLATES if templates is None else templates)
    keys = dict(KEYS if templates is None and keys is None else keys or {})

    @F.pandas_udf("array<struct<license:string,coverage:double,first_word:long,last_word:long>>")
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(wanted, least, keys)
        for batch in texts:
            yield pd.Series([[{"license": n, "coverage": c, "first_word": a, "last_word": b} for n, c, a, b in m]
                             for m in scanner.scan(batch)], dtype=object)

    return docs.select("doc_id", found("text").alias("matches"))


def licenses(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST,
             keys: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per document: doc_id, license and coverage of the best match, its word places, n_matches."""
    wanted = TEMPLATES if templates is None else templates
    words = F.create_map(*[F.lit(x) for n, t in wanted.items() for x in (n, len(hashed(t)))])
    ranked = F.transform("matches", lambda m: F.struct(-m["coverage"] * words[m["license"]], -m["coverage"], m["first_word"].alias("first_word"), m["license"].alias("license"),
                                                      m["coverage"].alias("coverage"), m["last_word"].alias("last_word")))
    best = scan(docs, templates, least, keys).select("doc_id", F.array_min(ranked).alias("best"), F.size("matches").cast("long").alias("n_matches"))
    return best.select("doc_id", F.col("best.license").alias("license"), F.coalesce("best.coverage", F.lit(0.0)).alias("coverage"),
                       F.col("best.first_word").alias("first_word"), F.col("best.last_word").alias("last_word"), "n_matches")
