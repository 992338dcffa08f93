"""License notices in texts, by conditional compression and exact wording.

A text is one sequence of words, whatever its lines and comment marks, so wrapped notices are whole. A candidate block
is a stretch of words around a piece of a template: of k + 1 pieces, one stands unchanged wherever there are at most k
differences, so with k = DIFFER of the template's words no notice is outside a block, and no list of signal words
decides. Every block is compressed alone and with each template whose piece it has as zstandard's raw dictionary; what
the dictionary takes off the compressed size is the template's reduction, and templates are tried in order of it.
A template is confirmed wherever the words between two places of the block become its own by at most k insertions and
deletions, which are reported. SPDX tags are read by a pattern; their license is the expression as written.

Every confirmed notice is measured by its own text's reduction less the bytes of the words that differ. Where notices
overlap, the one that gains most stays, then the one with the most words in place, then the most similar, then the
first by name; all that do not overlap are reported, however many a block has.

Defined results: null, empty and blank texts and texts without a notice have no rows; line is that of the first
word; equal texts have the same result wherever they are; rows that repeat repeat their rows; an empty table gives
no rows; other columns of the input are not looked at.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from palimpsest.llm import common

#: The wording of public notices, by SPDX identifier where there is one.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause-full": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-or-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: The share of a template's words that may differ.
DIFFER = 0.2
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
#: A tag and its expression: identifiers, joined by AND, OR and WITH, with brackets.
SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*((?:\([ \t]*)*[\w.+:-]+(?:[ \t]*\))*(?:[ \t]+(?:AND|OR|WITH)[ \t]+(?:\([ \t]*)*[\w.+:-]+(?:[ \t]*\))*)*)", re.IGNORECASE)


def words(text: str) -> list[tuple[str, int, int]]:
    """The words of a text in lower case, and where they are."""
    return [(m[0].lower(), m.start(), m.end()) for m in WORD.finditer(text)]


class Scanner:
    def __init__(self, templates: dict[str, str] | None = None):
        self.names = sorted(templates or TEMPLATES)
        self.texts = {n: (templates or TEMPLATES)[n] for n in self.names}
        self.wording = {n: [w for w, _, _ in words(t)] for n, t in self.texts.items()}
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = {n: self._given(t) for n, t in self.texts.items()}
        #: Pieces by their longest word: name, place in the template, words, place of that word in the piece.
        self.pieces: dict[str, list[tuple[str, int, list[str], int]]] = defaultdict(list)
        for name, want in self.wording.items():
            k = self.most(name)
            cuts = [len(want) * i // (k + 1) for i in range(k + 2)]
            for lo, hi in zip(cuts, cuts[1:]):
                piece = want[lo:hi]
                at = max(range(hi - lo), key=lambda i: len(piece[i]))
                self.pieces[piece[at]].append((name, lo, piece, at))
        self.signs = sorted(self.pieces, key=len)
        self.signs = [s for i, s in enumerate(self.signs) if not any(x in s for x in self.signs[:i])]

    @staticmethod
    def _given(text: str) -> zstandard.ZstdCompressor:
        raw = zstandard.ZstdCompressionDict(text.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=raw)

    def most(self, name: str) -> int:
        """Differences that a template may have."""
        return int(DIFFER * len(self.wording[name]))

    def reduction(self, block: str, given: zstandard.ZstdCompressor) -> int:
        """Bytes that a template takes off the block's compressed size."""
        data = block.lower().encode()
        return len(self.plain.compress(data)) - len(given.compress(data))

    def ranked(self, block: str, names: Iterable[str] | None = None) -> list[tuple[int, str]]:
        """The reductions of templates (all, or those named), the greatest first."""
        data = block.lower().encode()
        alone = len(self.plain.compress(data))
        return sorted(((alone - len(self.given[n].compress(data)), n) for n in (self.given if names is None else names)), key=lambda x: (-x[0], x[1]))

    def places(self, name: str, have: list[str]) -> Iterator[tuple[int, int, int, str]]:
        """First word, end, number and list of differences wherever the words have the template, from left to right."""
        want, k = self.wording[name], self.most(name)
        steps, number = np.arange(len(want) + 1), {w: i for i, w in enumerate(dict.fromkeys(want))}
        template = np.array([number[w] for w in want])
        start = 0
        while start < len(have):
            # Differences of each beginning of the template and the words that end here, wherever they begin.
            costs, at, end, until = [steps], start, None, len(have)
            while at < until:
                before = costs[-1]
                now = before + 1
                now[0] = 0
                if (c := number.get(have[at])) is not None:
                    now[1:] = np.where(template == c, np.minimum(now[1:], before[:-1]), now[1:])
                now = np.minimum.accumulate(now - steps) + steps
                costs.append(now)
                at += 1
                if now[-1] <= k and (end is None or now[-1] < costs[end - start][-1]):
                    # The best end of this place is at most 2 k words beyond its first.
                    until = min(len(have), at + 2 * k) if end is None else until
                    end = at
            if end is None:
                return
            # Back through the costs: words in place, as pairs.
            i, j, same = end, len(want), []
            while j:
                cost = costs[i - start]
                if i > start and have[i - 1] == want[j - 1] and cost[j] == costs[i - start - 1][j - 1]:
                    i, j = i - 1, j - 1
                    same.append((i, j))
                elif i > start and cost[j] == costs[i - start - 1][j] + 1:
                    i -= 1
                else:
                    j -= 1
            changes, a, b = [], i, 0
            for to_a, to_b in [*same[::-1], (end, len(want))]:
                changes += [f"-{w}" for w in want[b:to_b]] + [f"+{w}" for w in have[a:to_a]]
                a, b = to_a + 1, to_b + 1
            yield i, end, int(costs[end - start][-1]), " ".join(changes)
            start = end

    def compare(self, name: str, found: list[tuple[str, int, int]]) -> tuple[float, int, int, str] | None:
        """Share of the template's words in place, where the words have it best, and the differing words; None if too few."""
        best = min(self.places(name, [w for w, _, _ in found]), key=lambda p: p[2], default=None)
        return best and (1 - best[2] / len(self.wording[name]), found[best[0]][1], found[best[1] - 1][2], best[3])

    def near(self, have: list[str]) -> dict[str, list[list[int]]]:
        """By template, the ranges of words around its pieces; every place of the template is within one."""
        out: dict[str, list[list[int]]] = {}
        for at, w in enumerate(have):
            for name, place, piece, i in self.pieces.get(w, ()):
                p = at - i
                if p >= 0 and have[p : p + len(piece)] == piece:
                    k = self.most(name)
                    out.setdefault(name, []).append([max(0, p - place - k), min(len(have), p - place + len(self.wording[name]) + k)])
        for name, ranges in out.items():
            ranges.sort()
            joined = ranges[:1]
            for r in ranges[1:]:
                if r[0] <= joined[-1][1]:
                    joined[-1][1] = max(joined[-1][1], r[1])
                else:
                    joined.append(r)
            out[name] = joined
        return out

    def blocks(self, have: list[str]) -> Iterator[tuple[int, int, dict[str, list[list[int]]]]]:
        """Candidate blocks: first word, end, and by template the ranges of words within them that may hold it."""
        ranges = sorted((lo, hi, name) for name, rs in self.near(have).items() for lo, hi in rs)
        first = end = 0
        within: dict[str, list[list[int]]] = {}
        for lo, hi, name in ranges:
            if within and lo > end:
                yield first, end, within
                within = {}
            first, end = (lo, hi) if not within else (first, max(end, hi))
            within.setdefault(name, []).append([lo, hi])
        if within:
            yield first, end, within

    def tags(self, text: str) -> Iterator[tuple[int, int, str]]:
        """start, end and expression of each SPDX tag."""
        for m in SPDX.finditer(text):
            told = m[1].rstrip(".:-")
            while told.endswith(")") and told.count(")") > told.count("("):
                told = told[:-1].rstrip(" \t.:-")
            if told:
                yield m.start(), m.start(1) + len(told), told

    def scan(self, text: str) -> Iterator[tuple]:
        """line, start and end in the text, license, reduction, similarity, differences."""
        low = text.lower()
        hits = []
        if "spdx-license-identifier" in low:
            for lo, hi, told in self.tags(text):
                block = text[lo:hi]
                hits.append((-1e9, 0, 0.0, told, lo, hi, "", self.reduction(block, self._given(block))))
        if any(s in low for s in self.signs):
            found = words(text)
            have = [w for w, _, _ in found]
            for lo, hi, near in self.blocks(have):
                for _, name in self.ranked(text[found[lo][1] : found[hi - 1][2]], near):
                    n = len(self.wording[name])
                    for at, to in near[name]:
                        for a, b, cost, changes in self.places(name, have[at:to]):
                            start, end = found[at + a][1], found[at + b - 1][2]
                            gain = self.reduction(text[start:end], self.given[name]) - len(changes.encode())
                            hits.append((-gain, cost - n, cost / n, name, start, end, changes, gain + len(changes.encode())))
        taken: list[tuple] = []
        for hit in sorted(hits):
            i = bisect.bisect(taken, hit[4], key=lambda h: h[4])
            if (not i or taken[i - 1][5] <= hit[4]) and (i == len(taken) or hit[5] <= taken[i][4]):
                taken.insert(i, hit)
        line = at = 0
        for *_, differ, name, start, end, changes, reduction in taken:
            line, at = line + text.count("\n", at, start), start
            yield line, start, end, name, reduction, 1 - differ, changes


def scan(df: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each notice: doc_id, line, start, end, license, reduction, similarity, differences, exact."""
    docs = common.texts(df, id_col, text_col)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates)
        for batch in it:
            hits = [(i, *h) for i, t in enumerate(batch.column("text").to_pylist()) for h in scanner.scan(t)]
            columns = [*zip(*hits)] if hits else [()] * 8
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds))],
                names=["doc_id", "line", "start", "end", "license", "reduction", "similarity", "differences"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.mapInArrow(run, f"doc_id {kind}, line int, start int, `end` int, license string, reduction int, similarity double, differences string")
    return out.withColumn("exact", out["differences"] == "")
