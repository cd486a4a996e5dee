"""License scan by patience alignment.

Text and template are words (lower case, ASCII punctuation as space).  Words unique to both are paired, the longest
increasing run of the pairs anchors the alignment, and the gaps between anchors are aligned the same way, where more
words are unique; equal words at the ends of a gap are taken first.  Coverage is the share of the template's words
that are aligned.

A template can only be covered to C if at least that share of its words occurs in the text at all; texts that fail
this for every template are passed over.  In the others, each template is aligned with every region of the text: a
region ends where more than one template length goes by without a word pair of the template.  A region is cut where the
template starts again, that is where the place of a word pair in the template falls back; the whole region counts where no
part covers the template.

Edge cases: null and empty texts match nothing; a template found several times is reported by its best region, the
first of equals, with the number of regions; equal texts are reported each; repeated rows too; an empty table gives an
empty result; further columns are left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame

from gristmill.llm.common import as_bytes, map_arrow, read, schema_of

# Notices and headers by which texts state their license.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mit": "Released under the MIT License.",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "all-rights-reserved": "Copyright. All rights reserved.",
    "rights-reserved": "All rights reserved.",
}
SHORT, REACH = 8, 24  # templates of few words: names and years may stand between the words, so regions reach further back
COVERAGE = 0.8
_SPLIT = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(_SPLIT).split()


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest run of (a, b), sorted by a, whose b increases."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(b)
            at.append(i)
        else:
            tails[k], at[k] = b, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def align(a: list[bytes], b: list[bytes]) -> list[tuple[int, int]]:
    """Pairs of equal words (place in a, place in b), increasing in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: i for i, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = _increasing([(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place])
        if not anchors:
            continue
        found += anchors
        edges = [(a0 - 1, b0 - 1), *anchors, (a1, b1)]
        todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(edges, edges[1:]) if x + 1 < y and u + 1 < v]
    return sorted(found)


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.coverage = coverage
        self.templates = {name: words_of(text.encode()) for name, text in templates.items()}
        self.templates = {name: words for name, words in self.templates.items() if words}
        self.vocabulary = {w for words in self.templates.values() for w in words}
        self.pairs = {name: set(zip(words, words[1:])) or {(words[0],)} for name, words in self.templates.items()}
        counts = {name: Counter(zip(words, words[1:])) for name, words in self.templates.items()}
        self.places = {name: {p: i for i, p in enumerate(zip(words, words[1:])) if counts[name][p] == 1} for name, words in self.templates.items()}

    def regions(self, words: list[bytes], name: str) -> list[tuple[int, int]]:
        """Half-open runs of words around the template's word pairs."""
        n, pairs = len(self.templates[name]), self.pairs[name]
        hits = [i for i in range(len(words)) if tuple(words[i : i + 2]) in pairs] if n > 1 else [i for i, w in enumerate(words) if (w,) in pairs]
        out: list[tuple[int, int]] = []
        for i in hits:
            start, end = max(0, i - (n if n > SHORT else REACH)), min(len(words), i + n + 1)
            if out and i - last <= n:
                out[-1] = (out[-1][0], end)
            else:
                out.append((max(start, out[-1][1]) if out else start, end))
            last = i
        return out

    def parts(self, words: list[bytes], name: str, start: int, end: int) -> list[tuple[int, int]]:
        """The region, cut where the place of the template's word pairs falls back."""
        places, cuts, last, before = self.places[name], [start], start - 2, -1
        for i in range(start, end - 1):
            place = places.get((words[i], words[i + 1]))
            if place is not None:
                if place <= before:
                    cuts.append(min(i, max(last + 2, i - place)))
                last, before = i, place
        return list(zip(cuts, [*cuts[1:], end]))

    def covered(self, words: list[bytes], template: list[bytes], runs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(aligned words, first and last place) of the runs that cover the template."""
        aligned = [(start, align(template, words[start:end])) for start, end in runs]
        return [(len(p), start + p[0][1], start + p[-1][1] + 1) for start, p in aligned if p and len(p) >= self.coverage * len(template)]

    def scan(self, text: bytes) -> list[tuple[str, float, int, int, int, int]]:
        """(license, coverage, aligned words, first and last place, regions) of each template that the text covers."""
        words = words_of(text)
        present = self.vocabulary.intersection(words)
        out = []
        for name, template in self.templates.items():
            if sum(w in present for w in template) < self.coverage * len(template):
                continue
            best, found = None, 0
            for region in self.regions(words, name):
                parts = self.parts(words, name, *region)
                covered = self.covered(words, template, parts) or (self.covered(words, template, [region]) if len(parts) > 1 else [])
                found += len(covered)
                for hit in covered:
                    if best is None or hit[0] > best[0]:
                        best = hit
            if best:
                out.append((name, round(best[0] / len(template), 6), *best, found))
        return out


SCHEMA = "doc_id long, license string, coverage double, aligned_words int, start_word int, end_word int, n_regions int"


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE) -> DataFrame:
    """A row for each document and template that it covers to `coverage` or more; templates are a parameter and few."""
    templates = templates or TEMPLATES
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches):
        scanner = Scanner(templates, coverage)
        for b in batches:
            ids = b.column(0).to_pylist()
            rows = [(ids[k], *hit) for k, text in enumerate(b.column(1).to_pylist()) for hit in scanner.scan(text)]
            cols = list(zip(*rows)) or [[]] * 7
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return map_arrow(as_bytes(docs), run, schema_of(SCHEMA))


def query(spark, sf_dir):
    return scan_licenses(read(spark, sf_dir, "documents"))
