"""Licence texts and notices found by patience alignment."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .durable import small_batches

# Public licence texts and the notices that name them.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software or the use or other dealings in the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-2.0 notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1 notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0 notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "MIT line": "Released under the MIT License.",
    "BSD line": "Released under the BSD License.",
    "CC-BY-4.0 line": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 line": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0 line": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-2.1 line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0 line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MPL-2.0 line": "Licensed under the Mozilla Public License, Version 2.0.",
}
_GPL, _LGPL, _TWO, _THREE = ("gnu general public",), ("lesser general public",), ("license 2", "version 2", "2 of the license"), ("license 3", "version 3", "3 of the license")
_LESSER_TWO = ("license 2 1", "version 2 1", "2 1 of the license")
#: Name and version of the licences that share their other words: of each group one phrase must stand in the place found.
TELLING = {
    "Apache-2.0 notice": (("apache",), ("2 0",)), "Apache-2.0 line": (("apache",), ("2 0",)),
    "GPL-2.0 notice": (_GPL, _TWO), "GPL-2.0 line": (_GPL, _TWO), "GPL-3.0 notice": (_GPL, _THREE), "GPL-3.0 line": (_GPL, _THREE),
    "LGPL-2.1 notice": (_LGPL, _LESSER_TWO), "LGPL-2.1 line": (_LGPL, _LESSER_TWO), "LGPL-3.0 notice": (_LGPL, _THREE), "LGPL-3.0 line": (_LGPL, _THREE),
    "MPL-2.0 notice": (("mozilla public", "the mpl"), ("2 0",)), "MPL-2.0 line": (("mozilla public",), ("2 0",)),
    "CC-BY-4.0 line": (("cc by 4 0",),), "CC-BY-SA-4.0 line": (("cc by sa 4 0",),), "CC-BY-NC-4.0 line": (("cc by nc 4 0",),),
    "MIT line": (("mit",),), "BSD line": (("bsd",),),
}
#: Templates that are the beginning of another: no place of their own where the other stands.
PART_OF = {"BSD-2-Clause": "BSD-3-Clause"}
#: Words too common to show where a template stands.
COMMON = frozenset("a all an and any are as at be by for from in is it may no not of on or other that the this to use under with without you".split())
MIN_COVERAGE = 0.75
_WORD = re.compile(r"[a-z0-9]+")


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence that rises in the second number; the first rises already."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        at = bisect_left(tops, j)
        before[k] = piles[at - 1] if at else -1
        tops[at : at + 1] = [j]
        piles[at : at + 1] = [k]
    out, k = [], piles[-1] if piles else -1
    while k >= 0:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Patience alignment of two word lists: pairs of equal words at rising places.

    Equal words at both ends of a gap are paired; the words that are unique on both sides of what is left are
    anchors, the longest rising run of them stays, and the gaps between are aligned in the same way.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        left, right = Counter(a[i:k]), Counter(b[j:m])
        place = {w: y for y, w in enumerate(b[j:m], j) if right[w] == 1}
        anchors = _rising([(x, place[a[x]]) for x in range(i, k) if left[a[x]] == 1 and a[x] in place])
        if anchors:
            out += anchors
            for (x, y), (u, v) in zip([(i - 1, j - 1), *anchors], [*anchors, (k, m)]):
                if u > x + 1 and v > y + 1:
                    todo.append((x + 1, u, y + 1, v))
    return sorted(out)


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE):
        self.templates = {name: _WORD.findall(text.lower()) for name, text in templates.items()}
        self.counts = {name: Counter(words) for name, words in self.templates.items()}
        self.vocabulary = frozenset(w for words in self.templates.values() for w in words)
        self.min_coverage = min_coverage
        self.telling = {name: [[f" {phrase} " for phrase in group] for group in TELLING.get(name, ())] for name in self.templates}

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, first character, character after the last, covered share of the template's words) of each place found."""
        low = text.lower()
        if len(low) != len(text):  # a letter whose lower case is longer
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        seen = self.vocabulary.intersection(_WORD.findall(low))
        likely = [n for n, c in self.counts.items() if sum(k for w, k in c.items() if w in seen) >= self.min_coverage * len(self.templates[n]) and all(any(seen.issuperset(p.split()) for p in group) for group in self.telling[n])]
        if not likely:
            return []
        spans = [m.span() for m in _WORD.finditer(low)]
        words = [low[x:y] for x, y in spans]
        found = []
        for name in likely:
            template = self.templates[name]
            for first, last, covered in self._places(template, words, self.telling[name]):
                found.append((name, spans[first][0], spans[last][1], covered))
        found = [x for x in found if not any(y[0] == PART_OF.get(x[0]) and y[1] < x[2] and x[1] < y[2] for y in found)]
        return sorted(found, key=lambda x: (x[1], -x[2], x[0]))

    @staticmethod
    def _told(needed: list[list[str]], words: list[str]) -> bool:
        """Whether the words hold a phrase of each group."""
        text = f" {' '.join(words)} " if needed else ""
        return all(any(phrase in text for phrase in group) for group in needed)

    def _places(self, template: list[str], words: list[str], needed: list[list[str]]) -> list[tuple[int, int, float]]:
        size = len(template)
        telling = frozenset(template) - COMMON or frozenset(template)
        at = [k for k, w in enumerate(words) if w in telling]
        regions: list[list[int]] = []
        for k in at:
            if regions and k - regions[-1][1] <= size:
                regions[-1][1] = k
            else:
                regions.append([k, k])
        out = []
        for lo, hi in regions:
            lo, hi = max(0, lo - size), min(len(words), hi + size + 1)
            while hi - lo >= self.min_coverage * size:
                best = None
                end = min(hi, lo + 3 * size)
                for begin in range(lo, max(lo + 1, end - int(self.min_coverage * size) + 1), max(1, size // 4)):
                    if best and begin > best[0]:
                        break  # the first copy stands; others come in later windows
                    window = words[begin : min(hi, begin + size + size // 2 + 2)]
                    pairs = align(template, window)
                    covered = len(pairs) / size
                    if covered >= self.min_coverage and (best is None or covered > best[2]) and self._told(needed, window[pairs[0][1] : pairs[-1][1] + 1]):
                        best = (begin + pairs[0][1], begin + pairs[-1][1], covered)
                if best:
                    out.append(best)
                    lo = best[1] + 1
                elif end == hi:
                    break
                else:
                    lo = end - size
        return out


def _scanned(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *hit) for i, t in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) if t for hit in scanner.scan(t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "license", "start", "stop", "coverage"])

    return run


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Rows (id, license, start, stop, coverage), one for each place in a text where a template is covered by min_coverage.

    Where licences share their words, the name and version must stand in the place too.
    start and stop count characters. Words are runs of ASCII letters and digits in lower case. A text is
    aligned only if its words could cover the template, and only near words that tell the template; windows
    over half a template's length apart keep repeated copies apart. A text may hold several templates and
    several copies. Null and empty texts have none; repeated rows are scanned each; other columns are not read; an
    empty table gives no rows. One pass, no shuffle; the templates travel with the tasks.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(_scanned(Scanner(templates, min_coverage)), "id long, license string, start long, stop long, coverage double").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
