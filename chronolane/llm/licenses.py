"""License scan by patience alignment against templates.

Words that occur once in a region of the text and once in the template are anchors; the longest increasing run of
their positions is kept, and the gaps between anchors are aligned the same way, ends of gaps first. The share of the
template's words that align is its coverage. Regions lie around the key words of a template, so repeated notices and
very long texts are aligned piece by piece, whole texts through. A template has one key word (its rarest by template
count) more than words that may be missing at LEAST, so that every notice at LEAST holds one of them in its place.

Key words in the template's order chain into one region. What is one notice is a rule: between two neighbouring key
words, and before the first and after the last, up to a template's length of other words may be inserted; the number
of inserted words in all has no bound.

Defined cases: null or empty text holds no license; a document with several notices of one license gives its best and
their number; ties go to the earlier place and the template listed first; repeated rows each give rows; documents
without a license give none; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

#: Notices by which licenses are commonly named, and the texts of short licenses.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    (
        "MIT",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: '
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ),
    (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
    ),
)
#: Coverage from which a license is reported.
LEAST = 0.8

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of pairs, sorted by the first, in which the second increases (patience piles)."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        back[k] = piles[at - 1] if at else -1
        tops[at:], piles[at:] = [j, *tops[at + 1 :]], [k, *piles[at + 1 :]]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = back[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Increasing pairs of positions of equal words of ``a`` and ``b``."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i == m or j == n:
            continue
        once, other = Counter(a[i:m]), Counter(b[j:n])
        place = {w: k for k, w in enumerate(b[j:n], j) if other[w] == 1}
        anchors = _increasing([(k, place[w]) for k, w in enumerate(a[i:m], i) if once[w] == 1 and w in place])
        out += anchors
        ends = [(i - 1, j - 1), *anchors, (m, n)]
        if anchors:
            todo += [(p + 1, r, q + 1, s) for (p, q), (r, s) in zip(ends, ends[1:], strict=False)]
    return sorted(out)


class Scanner:
    """Templates with their key words: the rarest over all templates, one more than words that may be missing."""

    def __init__(self, templates=TEMPLATES) -> None:
        self.templates = [(name, words_of(text)) for name, text in templates]
        self.missing = [len(t) - math.ceil(LEAST * len(t)) for _, t in self.templates]
        self.distinct = [set(t) for _, t in self.templates]
        common = Counter(w for t in self.distinct for w in t)
        self.keys: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.templates):
            for w in sorted(self.distinct[k], key=lambda w: (len(w) == 1, common[w], t.count(w), -len(w), w))[: self.missing[k] + 1]:
                self.keys.setdefault(w, []).extend((k, j) for j, v in enumerate(t) if v == w)
        self.pattern = r"\b(?:" + "|".join(sorted(self.keys)) + r")\b"

    def regions(self, k: int, hits: list[tuple[int, int]]) -> set[tuple[int, int]]:
        """Regions (first word, end) for places of key words (in the text, in template ``k``), in order of the text."""
        size = len(self.templates[k][1])
        slack = max(2, size // 4)
        out = set()
        links, before, ends, first = [1] * len(hits), [-1] * len(hits), [True] * len(hits), 0
        for h, (at, offset) in enumerate(hits):
            out.add((at - offset - slack, at - offset + size + slack))
            while at - hits[first][0] > 2 * size:
                first += 1
            for p in range(first, h):
                apart, step = at - hits[p][0], offset - hits[p][1]
                if apart > 0 < step and apart - step <= size and links[p] >= links[h] - (before[h] >= 0):
                    links[h], before[h] = links[p] + 1, p
            if before[h] >= 0:
                ends[before[h]] = False
        for h, (at, offset) in enumerate(hits):
            if ends[h]:
                root = h
                while before[root] >= 0:
                    root = before[root]
                start, skipped = hits[root]
                out.add((start - skipped - slack, at - offset + size + slack))
                out.add((start - skipped - size, at - offset + 2 * size))
        return out

    def scan(self, text: str) -> dict[str, tuple]:
        """Best (coverage, template, first word, end word) and number of notices by license."""
        words = words_of(text)
        places: dict[int, list[tuple[int, int]]] = {}
        for at, w in enumerate(words):
            for k, offset in self.keys.get(w, ()):
                places.setdefault(k, []).append((at, offset))
        found: dict[str, list[tuple]] = {}
        for k, hits in places.items():
            name, t = self.templates[k]
            for low, high in self.regions(k, hits):
                low = max(0, low)
                region = words[low:high]
                if len(self.distinct[k].difference(region)) > self.missing[k]:
                    continue
                pairs = align(region, t)
                if len(pairs) >= LEAST * len(t):
                    found.setdefault(name, []).append((len(pairs) / len(t), -k, -(low + pairs[0][0]), low + pairs[-1][0] + 1))
        out = {}
        for name, hits in found.items():
            best = max(hits)
            ends, n = -1, 0
            for end, start in sorted({(e, -s) for _, _, s, e in hits}):  # the most that don't overlap
                n, ends = (n + 1, end) if start >= ends else (n, ends)
            out[name] = (best[0], -best[1], -best[2], best[3], n)
        return out


FOUND = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("coverage", pa.float64()), ("template", pa.int64()), ("first_word", pa.int64()), ("end_word", pa.int64()), ("notices", pa.int64())])


def licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """(doc_id, license, coverage, template, first_word, end_word, notices) for every license that a document holds."""
    scanner = Scanner(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(doc, name, *hit) for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for name, hit in sorted(scanner.scan(text).items())]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(FOUND), FOUND, strict=True)], schema=FOUND)

    # Only texts with a key word somewhere leave the JVM.
    rows = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.col("text").rlike("(?iU)" + scanner.pattern))
    return rows.mapInArrow(run, "doc_id long, license string, coverage double, template long, first_word long, end_word long, notices long")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
