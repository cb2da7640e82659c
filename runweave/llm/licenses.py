"""License scans by conditional compression.

Blocks of text that share three-word runs with a template, as many as any wording close enough must share, are compressed
alone and with each template as a zstandard raw dictionary. The bytes that a template saves rank the templates; each is
confirmed word by word, and the words in which the text differs are told. Where confirmed templates lie in one place, as a
header in its license, the one that saves most wins it, and the others are told as lying within it. Each row is scanned by
itself: nothing is shuffled but the hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, byte_slices, record, text_columns

#: Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "CC-BY-NC": "Licensed under CC BY-NC 4.0.",
    "CC-BY": "Licensed under CC BY 4.0.",
    "GPL-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-line": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Least share of a template's words that must be found, in order; words of a run by which blocks are found.
LEAST_WORDS, GRAM = 0.9, 3
_WORD = re.compile(r"\w+")
_DIGITS = re.compile(r"\d+")
_HIT = pa.schema([("doc_id", pa.int64()), ("xh", pa.int64()), ("license", pa.string()), ("at", pa.int32()), ("gain", pa.float64()), ("found", pa.float64()), ("differences", pa.string()), ("within", pa.string())])


def numbered(text: str) -> list[str]:
    """The words of a text in lower case, with all numbers alike."""
    return [w.lower() for w in _WORD.findall(_DIGITS.sub("0", text))]


class Template:
    """One license text and what any wording that counts as it must share with it."""

    def __init__(self, name: str, text: str, plain: zstandard.ZstdCompressor):
        raw = text.encode()
        self.name, self.wanted, self.alike = name, [w.lower() for w in _WORD.findall(text)], numbered(text)
        self.given = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
        self.itself = max(1, len(plain.compress(raw)) - len(self.given.compress(raw)))
        n, edits = len(self.alike), int(len(self.alike) * (1 - LEAST_WORDS) + 1e-9)
        self.grams = {tuple(self.alike[i : i + GRAM]) for i in range(max(1, n - GRAM + 1))}
        # an edit breaks no more runs than a run has words, and parts the text in one more stretch
        self.needed, self.least_run = max(1, len(self.grams) - GRAM * edits), max(1, -(-(n - edits) // (edits + 1)))


class Scanner:
    """Compressors for a set of templates; made once in each task."""

    def __init__(self, templates: dict[str, str]):
        self.plain = zstandard.ZstdCompressor(level=3)
        self.known = [Template(name, text, self.plain) for name, text in templates.items() if _WORD.search(text)]
        self.numbers: dict[str, int] = {}
        for t in self.known:
            for w in t.alike:
                self.numbers.setdefault(w, len(self.numbers) + 1)
        self.of_gram: dict[tuple, list[int]] = {}
        for i, t in enumerate(self.known):
            for g in t.grams:
                self.of_gram.setdefault(tuple(self.numbers[w] for w in g), []).append(i)
        #: Words in which a wording of the longest template lies; words of a block.
        self.reach = int(max((len(t.alike) for t in self.known), default=0) * (1 + 2 * (1 - LEAST_WORDS))) + 8
        self.block = 4 * self.reach
        self.short = any(len(t.alike) < GRAM for t in self.known)

    def hits(self, text: str) -> list[tuple[int, tuple]]:
        """(word, run) of each run of words that a template holds."""
        ids = np.fromiter(map(self.numbers.get, numbered(text), repeat(0)), np.int32)
        found = []
        for n in range(1 if self.short else GRAM, GRAM + 1):
            if len(ids) >= n:
                full = np.ones(len(ids) - n + 1, bool)
                for j in range(n):
                    full &= ids[j : len(ids) - n + 1 + j] > 0
                found += [(i, g) for i in np.flatnonzero(full).tolist() if (g := tuple(ids[i : i + n].tolist())) in self.of_gram]
        return sorted(found)

    def blocks(self, hits: list[tuple[int, tuple]]) -> Iterator[tuple[int, int, set[int]]]:
        """(first word, end, templates) of blocks in which templates meet what they need. A wording lies whole in one of them."""
        merged: list[list[int]] = []
        for i, _ in hits:
            if merged and i - self.reach <= merged[-1][1]:
                merged[-1][1] = i + self.reach
            else:
                merged.append([max(0, i - self.reach), i + self.reach])
        at = 0
        for a, b in merged:
            for start in range(a, max(a + 1, b - self.reach), self.block - self.reach):
                end = min(b, start + self.block)
                while at < len(hits) and hits[at][0] < start:
                    at += 1
                seen: dict[int, set] = {}
                for i, g in islice(hits, at, None):
                    if i >= end:
                        break
                    for t in self.of_gram[g]:
                        seen.setdefault(t, set()).add(g)
                enough = {t for t, gs in seen.items() if len(gs) >= self.known[t].needed}
                if enough:
                    yield start, end, enough

    def places(self, t: Template, given: list[str], alike: list[str | None]) -> Iterator[tuple[int, int, float, str]]:
        """(word, end, found, differences) of each place where `alike` words hold the template closely enough.

        found: share of the template's words that are there in order; words that the text adds between them count against
        it. Numbers match any number; those that differ are told, as words are: `wanted>given`. The place with the longest
        equal run comes first; its words are blanked, then the next.
        """
        alike, wanted = list(alike), t.wanted
        while True:
            best = SequenceMatcher(None, t.alike, alike, autojunk=False).find_longest_match()
            if best.size < t.least_run:
                return
            slack = int(len(wanted) * (1 - LEAST_WORDS)) + 3
            low, high = max(0, best.b - best.a - slack), best.b - best.a + len(wanted) + slack
            ops = SequenceMatcher(None, t.alike, alike[low:high], autojunk=False).get_opcodes()
            ops = [o for o in ops if o[1] < o[2] or 0 < o[1] < len(wanted)]  # words before and after are no difference
            hit = [(a, c, b - a) for kind, a, b, c, d in ops if kind == "equal"]
            foreign = sum(max(0, (d - c) - (b - a)) for kind, a, b, c, d in ops if kind != "equal" and 0 < a and b < len(wanted))
            found = sum(n for _, _, n in hit) / (len(wanted) + foreign)
            if found >= LEAST_WORDS:
                some = given[low:high]
                differing = [f"{' '.join(wanted[a:b])}>{' '.join(some[c:d])}" for kind, a, b, c, d in ops if kind != "equal"]
                differing += [f"{wanted[a + i]}>{some[c + i]}" for a, c, n in hit for i in range(n) if wanted[a + i] != some[c + i]]
                yield low + hit[0][1], low + hit[-1][1] + hit[-1][2], found, "; ".join(differing)
                alike[low + hit[0][1] : low + hit[-1][1] + hit[-1][2]] = [None] * (hit[-1][1] + hit[-1][2] - hit[0][1])
            else:
                alike[best.b : best.b + best.size] = [None] * best.size

    def scan(self, text: str) -> Iterator[tuple[str, int, float, float, str, str | None]]:
        """(license, at, gain, found, differences, within) of each confirmed template, once for each place."""
        hits = self.hits(text)
        if not hits:
            return
        spots, found_at = [(m.start(), m.end()) for m in _WORD.finditer(text)], {}
        for a, b, enough in self.blocks(hits):
            b = min(b, len(spots))
            block = text[spots[a][0] : spots[b - 1][1]]
            raw = block.encode("utf-8", "surrogatepass")
            size = len(self.plain.compress(raw))
            saved = [size - len(t.given.compress(raw)) for t in self.known]
            given, alike = [text[x:y].lower() for x, y in spots[a:b]], numbered(block)
            for i in sorted(enough, key=lambda i: (-saved[i], self.known[i].name)):
                t = self.known[i]
                for word, end, found, differing in self.places(t, given, alike):
                    place = (t.name, spots[a + word][0])
                    found_at.setdefault(place, (spots[a + end - 1][1], saved[i], round(saved[i] / t.itself, 6), round(found, 6), differing))
        winners = within([(*place, *rest[:2]) for place, rest in found_at.items()])
        for place, (_, _, *told) in found_at.items():
            yield *place, *told, winners.get(place)


def within(places: list[tuple[str, int, int, int]]) -> dict[tuple[str, int], str]:
    """(license, at) -> license that wins there, for each of the (license, at, end, saved) that wins no place itself.

    The most bytes saved win, then the longer place, then the name. A place is lost to a winner that holds half of it.
    """
    ranked = sorted(places, key=lambda p: (-p[3], p[1] - p[2], p[0], p[1]))
    over: dict[int, list[int]] = {}
    running: list[int] = []
    for i in sorted(range(len(ranked)), key=lambda i: ranked[i][1]):  # places of one template lie apart: few run at once
        at, end = ranked[i][1:3]
        running = [j for j in running if ranked[j][2] > at]
        for j in running:
            low, high = max(i, j), min(i, j)  # a later rank can lose to an earlier one
            shared = min(end, ranked[j][2]) - at
            if 2 * shared >= ranked[low][2] - ranked[low][1]:
                over.setdefault(low, []).append(high)
        running.append(i)
    lost: dict[int, str] = {}
    for i in sorted(over):
        winner = min((j for j in over[i] if j not in lost), default=None)
        if winner is not None:
            lost[i] = ranked[winner][0]
    return {ranked[i][:2]: name for i, name in lost.items()}


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, n_places, n_won, at, gain, found, differences, within): a row for each license that a document holds.

    n_won counts the places at which no template that saves more holds half of the words. The other columns are those of
    the place with the largest gain, the first of equals; within is the license that wins it, null if this one does. Rows with equal doc_id
    and text are one document. Null and empty texts have no row; null doc_ids are kept as null. Other columns are ignored;
    empty tables give no rows. Texts and templates of any length are taken whole. A wording is found if at least LEAST_WORDS
    of the template's words, and of all words within it, are in order; none of these is passed over before it is confirmed.
    """
    chosen = docs.sparkSession.sparkContext.broadcast(TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen.value)
        for b in byte_slices(batches, 1):
            rows = [(d, x, *hit) for d, text, x in zip(*(c.to_pylist() for c in b.columns)) if text for hit in scanner.scan(text)]
            yield record(_HIT, *([r[i] for r in rows] for i in range(len(_HIT))))

    some = text_columns(docs, id_col, text_col).withColumn("xh", F.xxhash64("text"))
    hits = arrow_map(some, run, "doc_id long, xh long, license string, at int, gain double, found double, differences string, within string").distinct()
    best = F.max_by(F.struct("at", "gain", "found", "differences", "within"), F.struct("gain", -F.col("at"))).alias("b")
    found = hits.groupBy("doc_id", "xh", "license").agg(F.count("*").alias("n_places"), F.count_if(F.col("within").isNull()).alias("n_won"), best)
    return found.select("doc_id", "license", "n_places", "n_won", "b.at", "b.gain", "b.found", "b.differences", "b.within")
