"""License scan (operator 1).

Templates are cut into lower-case words.  Their runs of words are hashed and winnowed: of
``window`` neighbouring hashes the least is kept, so that every ``gram + window - 1``
unchanged words in a row hold a kept one, and an inverted index maps a kept hash to its
templates and places.  How many words in a row every match is sure to leave unchanged
follows from the template's length (``sure_run``, 3 at most with a coverage of 0.8), and
run and window are chosen by that; templates of which two words or fewer are sure are
indexed run by run.

Looking up the runs of a text finds the templates and diagonals (place in the text less
place in the template) that may match.  Words left out or put in move a match to another
diagonal, by at most a template's length while its parts are worth joining, so diagonals are
chained: those of each two neighbouring stretches of that length are aligned together, word
by word, in a band around them (Smith-Waterman).  Matches of at least ``COVERAGE`` of a
template's words are reported with their span in the text.

Templates are a parameter; their index (bounded by their size, checked) is broadcast.
Each text is scanned whole and by itself, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartlens.llm.common import slices, text_of
from cartlens.llm.decontaminate import shingles, words

GRAM = 3  # words of a template at least
COVERAGE = 0.8
MATCH, MISMATCH, GAP = 2, -1, -1
#: The most bytes of templates that are broadcast.
MAX_TEMPLATE_BYTES = 64 << 20

#: Fixed texts: common statements, notices and permission texts.
TEMPLATES = {
    "MIT statement": "Released under the MIT License.",
    "Apache-2.0 statement": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 statement": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 statement": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 statement": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 statement": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Apache-2.0 notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "GPL-3.0 notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT whole text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC whole text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib whole text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def winnowed(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the kept hashes: the last least one of every ``window`` neighbours."""
    if not hashes.size:
        return []
    values, kept = hashes.tolist(), set()
    for i in range(max(1, len(values) - window + 1)):
        near = values[i : i + window]
        least = min(near)
        kept.add(i + max(k for k, v in enumerate(near) if v == least))
    return sorted(kept)


def band_of(length: int) -> int:
    """How far an alignment may leave the diagonals of its hits."""
    return max(2, length // 10)


def sure_run(length: int) -> int:
    """Words in a row that every match of a template of ``length`` words leaves as they
    are: up to ``1 - COVERAGE`` of them left out or changed and up to ``band_of`` places
    with words put in part the others."""
    lost = int((1 - COVERAGE) * length + 1e-9)
    return -(-(length - lost) // (lost + band_of(length) + 1))


def gram_and_window(length: int) -> tuple[int, int]:
    """Words of a run and runs of a window such that no match goes without a kept run."""
    sure = sure_run(length)
    return (min(GRAM, sure - 1), 2) if sure > 2 else (sure, 1)


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int) -> tuple[int, int, int]:
    """Words (numbers) matched by the best local alignment within ``band`` of a diagonal, and
    the first and last matched place in ``text`` (0, 0, -1 for none).  Of equal
    scores the first end is taken.

    Row *i* has the places ``j = i + diagonal + k - band`` (words of both from 1); the one
    above is that of *k* + 1, the one before of *k* - 1, straight on of *k*.
    """
    width, n = 2 * band + 1, len(text)
    score = np.zeros((len(template) + 1, width + 1), dtype=np.int64)  # the last column stays 0
    step = np.arange(width)
    padded = np.concatenate([[-1], text])
    for i, word in enumerate(template.tolist(), 1):
        j = i + diagonal - band + step
        inside = (j >= 1) & (j <= n)
        straight = score[i - 1, :width] + np.where(padded[np.where(inside, j, 0)] == word, MATCH, MISMATCH)
        row = np.maximum(np.maximum(straight, score[i - 1, 1:] + GAP), 0)
        row[~inside] = 0
        # gaps along the row: the best of all before it, less their distance
        row = np.maximum(row, np.maximum.accumulate(row - GAP * step) + GAP * step)
        score[i, :width] = np.where(inside, row, 0)
    where = int(np.argmax(score))
    i, k = divmod(where, width + 1)
    matched, first, last = 0, 0, -1
    while score[i, k] > 0:
        j = i + diagonal + k - band
        same = text[j - 1] == template[i - 1]
        if score[i, k] == score[i - 1, k] + (MATCH if same else MISMATCH):
            if same:
                matched, first, last = matched + 1, j - 1, max(last, j - 1)
            i -= 1
        elif score[i, k] == score[i - 1, k + 1] + GAP:
            i, k = i - 1, k + 1
        else:
            k -= 1
    return matched, first, last


@dataclass
class TemplateIndex:
    """Templates and the inverted index of their hashes, by the length of the runs."""

    texts: Mapping[str, str]
    names: list[str] = field(default_factory=list)
    bodies: list[np.ndarray] = field(default_factory=list)  # of each template, its words as numbers
    vocabulary: list[np.ndarray] = field(default_factory=list)  # and their hashes, sorted
    words: list[Counter] = field(default_factory=list)

    def __post_init__(self) -> None:
        postings: dict[int, dict[int, list[tuple[int, int]]]] = {}
        self.number: dict[bytes, int] = {}
        for name, text in self.texts.items():
            raw = text.encode().lower()
            starts, ends, hashes = words(raw)
            if len(starts) < GRAM:
                raise ValueError(f"template {name!r} has fewer than {GRAM} words")
            size, window = gram_and_window(len(starts))
            runs = shingles(hashes, size)
            for at in winnowed(runs, window):
                postings.setdefault(size, {}).setdefault(int(runs[at]), []).append((len(self.names), at))
            self.names.append(name)
            body = [raw[s:e] for s, e in zip(starts, ends, strict=True)]
            self.bodies.append(np.array([self.number.setdefault(w, len(self.number)) for w in body]))
            self.vocabulary.append(np.unique(hashes))
            self.words.append(Counter(hashes.tolist()))
        self.postings = postings
        self.keys = {size: np.array(sorted(found), dtype=np.uint64) for size, found in postings.items()}

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """``(template, coverage, matched words, start, end)`` of every match: the best
        alignment of each band, spans in characters, by template and start."""
        raw = text.encode("utf-8", "replace").lower()  # A-Z only: places stay
        starts, ends, hashes = words(raw)
        diagonals: dict[int, list[int]] = {}
        for size, keys in self.keys.items():
            runs = shingles(hashes, size)
            hits = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, runs), len(keys) - 1)] == runs)
            for at in hits.tolist():
                for template, place in self.postings[size][int(runs[at])]:
                    diagonals.setdefault(template, []).append(at - place)
        found = []
        for template, places in diagonals.items():
            spans = self._matches(template, np.unique(places), raw, starts, ends, hashes)
            taken: list[tuple[int, int, int]] = []
            for s in sorted(spans, key=lambda s: (-s[0], s[1], s[2])):  # bands overlap: a match's best alignment stands for it
                if all(s[2] < t[1] or s[1] > t[2] for t in taken):
                    taken.append(s)
            for matched, first, last in taken:
                begin = len(raw[: starts[first]].decode("utf-8"))
                found.append((self.names[template], matched / len(self.bodies[template]), matched, begin, begin + len(raw[starts[first] : ends[last]].decode("utf-8"))))
        return sorted(found, key=lambda f: (f[0], f[3]))

    def _matches(self, template: int, diagonals: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """``(matched words, first word, last word)`` of the alignments around the diagonals.
        These are dealt into stretches as long as the template; each two neighbouring
        stretches are aligned together, so that no two diagonals that may belong to one match are
        parted."""
        body, out = self.bodies[template], []
        length, band = len(body), band_of(len(self.bodies[template]))
        known = self.vocabulary[template]
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        own = np.concatenate([[0], np.cumsum(known[place] == hashes)])  # words that the template has
        stretch = diagonals // length
        for s in np.unique(stretch).tolist():
            group = diagonals[(stretch == s) | (stretch == s + 1)]
            low, high = int(group[0]), int(group[-1])
            middle = (low + high) // 2
            reach = band + high - middle  # the band around each of them
            lo, hi = max(0, middle - reach), min(len(starts), middle + length + reach)
            if own[hi] - own[lo] < COVERAGE * length or not self._enough(template, hashes[lo:hi]):
                continue
            region = np.array([self.number.get(raw[a:b], -2) for a, b in zip(starts[lo:hi].tolist(), ends[lo:hi].tolist(), strict=True)])
            # a text may hold several matches in the band: each is put out of the way of the next
            while True:
                matched, first, last = align(body, region, middle - lo, reach)
                if matched < COVERAGE * length:
                    break
                out.append((matched, lo + first, lo + last))
                region[first : last + 1] = -2
        return out

    def _enough(self, template: int, single: np.ndarray) -> bool:
        """Whether the words of a region can hold a match: ``COVERAGE`` of the template's."""
        return sum((Counter(single.tolist()) & self.words[template]).values()) >= COVERAGE * len(self.bodies[template])


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each match in each row of ``docs``: ``doc_id``, ``template``,
    ``coverage`` (share of the template's words matched in order), ``n_matched``,
    ``start``, ``end`` (characters of the text, end exclusive).

    Null and empty texts, and texts without a match, give no row; null and repeated
    ids and repeated rows are reported as they are; an empty table gives an empty
    result; other columns of ``docs`` don't matter.
    """
    if sum(len(t) for t in templates.values()) > MAX_TEMPLATE_BYTES:
        raise ValueError(f"templates of over {MAX_TEMPLATE_BYTES} bytes: scan with parts of them, one after the other")
    shared = docs.sparkSession.sparkContext.broadcast(TemplateIndex(dict(templates)))
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("template", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("n_matched", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            found = [(r, *match) for r, body in enumerate(batch.column(1).to_pylist()) for match in shared.value.scan(body)]
            columns = list(zip(*found, strict=True)) or [[]] * 6
            types = (pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            ids = batch.column(0).take(pa.array(columns[0], type=pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, type=t) for c, t in zip(columns[1:], types, strict=True))], names=schema.names)

    return source.mapInArrow(run, schema)
