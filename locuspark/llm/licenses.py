"""License scan: winnowed template fingerprints, then banded alignment.

Templates are winnowed: in each window of consecutive k-gram hashes the least
is kept, so every run of ``gram + window - 1`` tokens that a document shares
with a template holds a kept fingerprint. Both numbers follow from a template's
length, so that no way to substitute or drop the permitted share of its tokens
leaves every such run broken. The inverted index from fingerprint to (template,
place) is as large as the template library, and goes to the executors with the
tasks. All k-grams of a document are looked up; hits of a template that lie
within its length of each other form a region, however many copies or long
insertions it has. A local alignment over the band of diagonals of the region
gives the matched share of the template and the span of each occurrence.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from locuspark.llm.frames import columns, map_text
from locuspark.llm.tokens import Runs, U, combine, raw

GRAM, WINDOW, BAND, COVERAGE = 3, 2, 6, 0.8
#: Tokens of a region that are aligned at once.
STRETCH = 1 << 22

#: Fixed texts: the wording of licenses. Whole long licenses come as a table.
TEMPLATES = {
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-short": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause-third": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "LGPL-short": "This library is licensed under the GNU Lesser General Public License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "All-rights-reserved": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means.",
    "MIT-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "BSD-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "ISC-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.',
}


def fingerprint_sizes(n: int, coverage: float = COVERAGE) -> tuple[int, int, int]:
    """Gram, window and least number of kept fingerprints for a template of ``n`` tokens.

    If ``wrong`` tokens may differ, one shared run has ``run`` tokens at least;
    of the agreeing tokens at most three in each run lie in runs too short.
    """
    wrong = n - int(np.ceil(coverage * n - 1e-9))
    run = -(-(n - wrong) // (wrong + 1))
    gram = max(1, min(GRAM, run))
    window = max(1, min(WINDOW, run - gram + 1))
    return gram, window, max(1, (n - wrong - 3 * (wrong + 1)) // 4)


def winnowed(h: np.ndarray, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept k-gram hashes of token hashes ``h``, and their places."""
    n = len(h) - gram + 1
    if n < 1:
        return h[:0], np.zeros(0, int)
    keys = combine([h[i : i + n] for i in range(gram)], 8 + gram)
    if n < window:
        keep = np.array([int(np.argmin(keys))])
    else:
        views = np.lib.stride_tricks.sliding_window_view(keys, window)
        keep = np.unique(np.arange(n - window + 1) + window - 1 - views[:, ::-1].argmin(axis=1))
    return keys[keep], keep


class Library:
    """Templates, their fingerprints and the inverted index."""

    def __init__(self, templates: Mapping[str, str] | None = None, coverage: float = COVERAGE, band: int = BAND):
        tokens = {name: Runs(*raw(pa.array([text]))).words() for name, text in (templates or TEMPLATES).items()}
        self.names = [n for n, h in tokens.items() if len(h)]  # a template without words matches nothing
        self.tokens = [tokens[n] for n in self.names]
        self.coverage, self.band = coverage, band
        sizes = [fingerprint_sizes(len(h), coverage) for h in self.tokens]
        self.least = np.array([s[2] for s in sizes], int)
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for gram in sorted({s[0] for s in sizes}):
            kept = [(t, *winnowed(self.tokens[t], gram, s[1])) for t, s in enumerate(sizes) if s[0] == gram]
            keys, which, place = (np.concatenate(x) for x in zip(*((k, np.full(len(k), t), p) for t, k, p in kept), strict=True))
            order = np.argsort(keys, kind="stable")
            sieve = np.zeros(1 << 16, bool)
            sieve[keys >> U(48)] = True
            self.index[gram] = (keys[order], which[order], place[order], sieve)

    def regions(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(document, template, first hit, last hit, least diagonal, last diagonal) of hits within a template's length of each other."""
        for gram, (keys, which, place, sieve) in self.index.items():
            n = len(h) - gram + 1
            if n < 1:
                continue
            key = combine([h[i : i + n] for i in range(gram)], 8 + gram)
            at = np.flatnonzero(sieve[key >> U(48)])
            lo, hi = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            at, lo, size = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            hit = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())
            at = np.repeat(at, size)
            doc = np.searchsorted(bounds, at, "right") - 1
            own = at + gram <= bounds[doc + 1]
            at, doc, t, q = at[own], doc[own], which[hit[own]], place[hit[own]]
            if not len(at):
                continue
            order = np.lexsort((at, t, doc))
            at, doc, t, q = at[order], doc[order], t[order], q[order]
            length = np.array([len(x) for x in self.tokens])[t]
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (t[1:] != t[:-1]) | (at[1:] - at[:-1] > length[1:])
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))
            low, high = np.minimum.reduceat(at - q, first), np.maximum.reduceat(at - q, first)
            for a, b, s, e in zip(first.tolist(), last.tolist(), low.tolist(), high.tolist(), strict=True):
                if len(np.unique(q[a:b])) >= self.least[t[a]]:
                    yield int(doc[a]), int(t[a]), int(at[a]), int(at[b - 1]), s, e

    def find(self, h: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(document, template, matched, first token, past token) of each occurrence that reaches the threshold."""
        for d, t, first, last, low, high in self.regions(h, bounds):
            own = self.tokens[t]
            start, end = max(int(bounds[d]), first - 2 * len(own)), min(int(bounds[d + 1]), last + 2 * len(own))
            taken: list[tuple[int, int]] = []
            for a in range(start, end, STRETCH):
                b = min(end, a + STRETCH + 4 * len(own))  # stretches overlap, so that no occurrence is cut
                for matched, x, y in occurrences(own, h[a:b], low - a - self.band, high - a + self.band, self.coverage):
                    if _free(taken, a + x, a + y):
                        yield d, t, matched, a + x, a + y


def _free(taken: list[tuple[int, int]], a: int, b: int) -> bool:
    """Whether the span overlaps none of the disjoint ``taken``; it is added if so."""
    k = bisect_left(taken, (a, b))
    if (k and taken[k - 1][1] > a) or (k < len(taken) and taken[k][0] < b):
        return False
    taken.insert(k, (a, b))
    return True


def occurrences(template: np.ndarray, doc: np.ndarray, low: int, high: int, coverage: float) -> list[tuple[int, int, int]]:
    """Disjoint (matched, first, past) of local alignments (match 1, mismatch and gap -1) on diagonals ``low`` to ``high``.

    A cell is one word: score, matched tokens, and start; rows are template
    tokens. Ever the best score first, of what does not overlap a better one.
    """
    n, length = len(doc), len(template)
    need = max(1, int(np.ceil(coverage * length - 1e-9)))
    one, match, mask = 1 << 40, 1 << 23, (1 << 23) - 1
    fresh = mask - np.arange(n + 1, dtype=np.int64)  # of equal scores the earliest start
    slope = np.arange(n + 1, dtype=np.int64) * one
    above, best = fresh.copy(), np.zeros(n + 1, np.int64)
    for i, want in enumerate(template):
        a, b = max(0, i + low), min(n, i + high + 1)
        row = fresh.copy()
        if a < b:
            cell = above[a:b] + np.where(doc[a:b] == want, one + match, -one)
            own = np.maximum(np.maximum(row[a + 1 : b + 1], cell), above[a + 1 : b + 1] - one)
            own = np.maximum.accumulate(own + slope[: b - a]) - slope[: b - a]
            row[a + 1 : b + 1] = own
            best[a + 1 : b + 1] = np.maximum(best[a + 1 : b + 1], np.where((own >> 23) & 0x1FFFF >= need, own, 0))
        above = row
    ends = np.flatnonzero(best)
    taken: list[tuple[int, int]] = []
    out = []
    for j in ends[np.argsort(-best[ends], kind="stable")].tolist():
        start = mask - int(best[j] & mask)
        if _free(taken, start, j):
            out.append((int(best[j] >> 23) & 0x1FFFF, start, j))
    return sorted(out, key=lambda x: x[1])


def library_of(templates: Mapping[str, str] | DataFrame | None, coverage: float = COVERAGE) -> Library:
    """A library of a table ``license, text`` (bounded by what licenses there are), of a mapping, or the own one."""
    if isinstance(templates, DataFrame):
        rows = columns(templates, "license", "text").where("license is not null and text is not null").dropDuplicates(["license"]).toLocalIterator()
        templates = {r["license"]: r["text"] for r in rows}
    return Library(templates, coverage)


def scan(docs: DataFrame, templates: Mapping[str, str] | DataFrame | None = None, coverage: float = COVERAGE) -> DataFrame:
    """``doc_id, license, coverage, n_matched, byte_start, byte_end``: one row for each occurrence of a template.

    Null and empty texts have none; a text may match several templates, one
    template in several places, and repeated rows are reported repeatedly.
    ``templates`` may be a table ``license, text``; rows without either do not count.
    """
    library = library_of(templates, coverage)

    def fn(batch: pa.RecordBatch) -> dict | None:
        runs = Runs(*raw(batch.column("text")))
        rows = list(library.find(runs.words(), runs.bounds(batch.num_rows)))
        if not rows:
            return None
        d, t, matched, a, b = (np.array(x) for x in zip(*rows, strict=True))
        base = runs.offsets[d]
        return {
            "doc_id": batch.column("doc_id").take(pa.array(d)), "license": [library.names[k] for k in t], "coverage": matched / np.array([len(library.tokens[k]) for k in t]),
            "n_matched": matched, "byte_start": runs.start[a] - base, "byte_end": runs.end[b - 1] - base,
        }

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_text(columns(docs, "doc_id", "text"), fn, f"doc_id {kind}, license string, coverage double, n_matched int, byte_start int, byte_end int")
