"""License scans: winnowed fingerprints find candidates, banded alignment reports coverage and spans.

Word k-grams of every template are hashed and thinned by winnowing (the smallest hash of each window
stays), and an inverted index maps each to its templates and places. Fingerprints of a document that hit
the index name a template and a diagonal; around it a local alignment inside a band measures which words
of the template the document holds, and where.
"""

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from passarank.llm import kernels

GRAM, WINDOW, BAND, COVERAGE = 3, 3, 16, 0.8
# Templates of fewer words must be there in full.
SHORT = 10
# The template words per block; more templates take further passes over the documents.
BLOCK_WORDS = 200_000

# Notices and texts of common licenses, as published.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
        FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": """
        This program is free software: you can redistribute it and/or modify it under the terms of the GNU
        General Public License as published by the Free Software Foundation, either version 3 of the License, or
        (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU
        General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "BSD-conditions": """
        Redistribution and use in source and binary forms, with or without modification, are permitted provided
        that the following conditions are met: Redistributions of source code must retain the above copyright
        notice, this list of conditions and the following disclaimer. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution.""",
    "ISC-text": """
        Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all
        copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS
        SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "MPL-2.0-header": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the
        MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


def grams(words, size):
    """Hashes of ``size`` words in a row; all words together if there are fewer."""
    return kernels.shingles(words, np.array([0, words.size]), size)[0]


def winnow(hashes, window):
    """Places of the smallest hash of each window, the last of equal ones; sorted, each once."""
    if not hashes.size:
        return np.empty(0, np.int64)
    window = min(window, hashes.size)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    at = window - 1 - views[:, ::-1].argmin(axis=1)
    return np.unique(at + np.arange(len(views)))


class Index:
    """Inverted index of the templates' fingerprints."""

    def __init__(self, templates, gram, window):
        self.words = kernels.Words()
        self.texts = [self.words.hashes([text])[0] for text in templates]
        self.gram, self.window = gram, window
        listed = []
        for number, words in enumerate(self.texts):
            hashes = grams(words, gram)
            # Every k-gram of a text too short for two windows is kept, so that an edit leaves some.
            places = winnow(hashes, window) if hashes.size > 2 * window else np.arange(hashes.size)
            listed.extend((int(hashes[p]), number, int(p)) for p in places)
        listed.sort()
        self.keys = np.array([k for k, _, _ in listed], np.uint64)
        self.entries = [(number, place) for _, number, place in listed]

    def hits(self, hashes):
        """(place in the document, first entry, last entry) of each hash that the index holds."""
        low = np.searchsorted(self.keys, hashes, side="left")
        high = np.searchsorted(self.keys, hashes, side="right")
        found = np.flatnonzero(high > low)
        return zip(found.tolist(), low[found].tolist(), high[found].tolist())


def align(template, text, shift, band, needed=0):
    """Local alignment of the template with the words of ``text`` near the diagonal ``shift``.

    Cell (i, j) pairs template word i with text word j where |j − i − shift| ≤ band. A match scores 2, a
    mismatch or a gap −1. Returns (matched words, template start, stop, text start, stop) of the best path
    with at least ``needed`` matches, or zeros.
    """
    width = 2 * band + 1
    nothing = (0, 0, 0, 0)  # score, matches, template start, text start
    before, best = [nothing] * (width + 2), (0, 0, 0, 0, 0, 0)
    for i, word in enumerate(template):
        row = [nothing] * (width + 2)
        for c in range(1, width + 1):
            j = i + shift - band + c - 1
            if not 0 <= j < len(text):
                continue
            score, matches, i0, j0 = before[c]
            if score == 0:
                matches, i0, j0 = 0, i, j
            same = word == text[j]
            cell = (score + 2, matches + 1, i0, j0) if same else (score - 1, matches, i0, j0)
            up, left = before[c + 1], row[c - 1]
            if up[0] - 1 > cell[0]:
                cell = (up[0] - 1, *up[1:])
            if left[0] - 1 > cell[0]:
                cell = (left[0] - 1, *left[1:])
            if cell[0] > 0:
                row[c] = cell
                if cell[0] > best[0] and cell[1] >= needed:
                    best = (*cell[:2], cell[2], i + 1, cell[3], j + 1)
        before = row
    return best[1:]


def _scanner(names, templates, gram, window, band, coverage):
    """Arrow batches of (id, text) to spans (id, license, coverage, matched, start, stop)."""

    def scan(batches):
        index = Index(templates, gram, window)
        lists = [words.tolist() for words in index.texts]
        for batch in batches:
            rows, found = [], []
            texts = batch.column(1).to_pylist()
            for first, last in kernels.slices(texts):
                words, borders = index.words.hashes(texts[first:last])
                hashes, edges = kernels.shingles(words, borders, gram)
                # Every k-gram of the document is looked up, so no window of it can miss a fingerprint.
                by_text = {}
                for place, low, high in index.hits(hashes):
                    number = int(np.searchsorted(edges, place, side="right")) - 1
                    by_text.setdefault(number, []).append((place - int(edges[number]), low, high))
                for number, hits in by_text.items():
                    text = words[borders[number] : borders[number + 1]].tolist()
                    for span in spans(index, lists, text, hits, band, coverage):
                        rows.append(first + number)
                        found.append(span)
            taken = batch.column(0).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [taken, pa.array([names[f[0]] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()),
                 *[pa.array([f[k] for f in found], pa.int64()) for k in (2, 3, 4)]],
                ["id", "license", "coverage", "matched_words", "start_word", "stop_word"],
            )

    return scan


def spans(index, lists, text, hits, band, coverage):
    """Matches (template, coverage, matched words, start, stop) of one document, without overlaps per template.

    Diagonals at most ``band`` apart are aligned together, in cells that hold the full band of each. What a
    match leaves of their words before and after it is aligned again until nothing reaches the coverage.
    """
    diagonals = {}
    for place, low, high in hits:
        for number, at in index.entries[low:high]:
            diagonals.setdefault(number, set()).add(place - at)
    more = (band + 1) // 2
    for number, found in sorted(diagonals.items()):
        template, starts, stops = lists[number], [], []
        needed = coverage * len(template) if len(template) >= SHORT else len(template)

        def best(low, high, shift, width, least):
            low, high = max(low, shift - width), min(high, shift + width + len(template))
            if high - low < least:
                return None
            matched, first, _, start, stop = align(template, text[low:high], shift - low, width, least)
            return (matched, low + start, low + stop, low + start - first) if matched else None

        last = None
        for shift in sorted(found):
            if last is not None and shift - last <= band:
                continue  # aligned with the diagonal before
            last = shift
            # The free stretches of the words that the cells reach, the first one on top.
            low, high = max(0, shift - band), min(len(text), shift + band + 2 * more + len(template))
            left = []
            for at in range(bisect.bisect_right(stops, low), bisect.bisect_left(starts, high)):
                left.append((low, starts[at]))
                low = stops[at]
            left = [*left, (low, high)][::-1]
            while left:
                low, high = left.pop()
                match = best(low, high, shift + more, band + more, needed)
                if match is None:
                    continue
                # Aligned around its own diagonal it is not cut where these cells or words end.
                at = bisect.bisect_left(starts, match[1])
                free = stops[at - 1] if at else 0, starts[at] if at < len(starts) else len(text)
                matched, start, stop, _ = best(*free, match[3], band, match[0]) or match
                at = bisect.bisect_left(starts, start)
                starts.insert(at, start)
                stops.insert(at, stop)
                yield number, matched / len(template), matched, start, stop
                left += [(max(low, stop), high), (low, min(high, start))]


def scan(
    docs, templates=None, id_col="doc_id", text_col="text", gram=GRAM, window=WINDOW, band=BAND, coverage=COVERAGE,
    block_words=BLOCK_WORDS,
):
    """One row per license notice found in a document.

    Columns: ``id``, ``license``, ``coverage`` (share of the template's words matched in order),
    ``matched_words``, ``start_word`` and ``stop_word`` (the stretch in words of the document: runs of letters and
    digits). Matches need ``coverage``, and templates of fewer than ``SHORT`` words all their words. A text that holds a template several times gives several
    rows; of overlapping matches of one template the first stays. Templates may be any {name: text}; those
    without a word match nothing. Null and empty texts hold none; repeated rows are reported each.

    Templates go through in blocks of at most ``block_words`` words, each one pass over the documents.
    """
    templates = TEMPLATES if templates is None else templates
    chosen = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    id_type = chosen.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, license string, coverage double, matched_words bigint, start_word bigint, stop_word bigint"
    blocks, room = [[]], block_words
    for name, text in templates.items():
        size = len(text.split())
        if blocks[-1] and size > room:
            blocks.append([])
            room = block_words
        blocks[-1].append((name, text))
        room -= size
    found = None
    for block in blocks:
        names, texts = [n for n, _ in block], [t for _, t in block]
        part = chosen.mapInArrow(_scanner(names, texts, gram, window, band, coverage), schema)
        found = part if found is None else found.union(part)
    return found
