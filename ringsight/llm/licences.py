"""Licence scan: word-bigram Dice coefficient between parts of a text and licence templates.

Texts and templates are reduced to lower-case words of letters and digits. A part is a run of
whole lines, or, for templates that no run of lines matches, any run of words. Its Dice coefficient with a template B can reach the threshold t only if its number
of distinct bigrams lies in [|B| t / (2 - t), |B| (2 - t) / t] and it shares at least
|B| t / (2 - t) bigrams with B; templates out of these bounds are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ringsight.llm.wordhash import ODD, SYMBOLS, Words, mix, slices

THRESHOLD = 0.8

# Notices, headers and short texts of common licences; licence_texts holds whole texts.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "Reserved": "All rights reserved.",
    "CC-BY-4.0 notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0 notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS
IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause notice": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause notice": "Licensed under the BSD 3-Clause License.",
    "BSD notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0 notice": "Licensed under the Mozilla Public License, Version 2.0.",
    "EPL-2.0 notice": "Licensed under the Eclipse Public License, Version 2.0.",
    "LGPL notice": "Licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1 notice": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0 notice": "Licensed under the GNU Affero General Public License, version 3.",
    "GPL-2.0 notice": "Licensed under the GNU General Public License, version 2.",
    "Unlicense notice": "This is free and unencumbered software released into the public domain.",
    "CC0-1.0 notice": "This work is dedicated to the public domain under CC0 1.0 Universal.",
    "CC-BY-4.0 short": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 short": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-SA-4.0 short": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-4.0 long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "MPL-2.0 header": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL
was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "GPL-2.0 header": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU
General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option)
any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even
the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details.""",
    "LGPL header": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU
Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your
option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public
License for more details.""",
    "AGPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU
Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your
option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;
without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public
License for more details.""",
}


def whole_texts() -> dict[str, str]:
    """The whole licences of licence_texts, by file name; read by the driver."""
    held = [x for x in resources.files("ringsight.llm").joinpath("licence_texts").iterdir() if x.name.endswith(".txt")]
    return {f"{x.name[:-4]} text": x.read_text(encoding="utf-8") for x in sorted(held, key=lambda x: x.name)}


def _bigrams(words: Words) -> np.ndarray:
    """The bigram that starts at each word; the last word of a row has one with the next row, to be skipped."""
    h = words.hashes
    return mix(h[:-1] * ODD[0] + h[1:] * ODD[1]) if len(h) > 1 else np.empty(0, np.uint64)


class _Templates:
    def __init__(self, templates: dict[str, str], threshold: float) -> None:
        words = Words(pa.array(list(templates.values()), pa.large_string()), blank=SYMBOLS)
        grams = _bigrams(words)
        sets = [np.unique(grams[words.rows[r] : words.rows[r + 1] - 1]) for r in range(len(templates))]
        self.names, self.sizes = list(templates), np.array([len(s) for s in sets])
        self.all = np.unique(np.concatenate(sets))
        self.holds = np.zeros((len(self.all), len(sets)), bool)
        for k, s in enumerate(sets):
            self.holds[np.searchsorted(self.all, s), k] = True
        self.threshold = threshold
        self.low, self.high = self.sizes * threshold / (2 - threshold), self.sizes * (2 - threshold) / threshold

    def matches(self, ids: np.ndarray, lines: np.ndarray, grams: np.ndarray) -> list[tuple[int, int, int, float, bool]]:
        """``ids``: bigram numbers of a text in order (-1: in no template); ``lines``: the lines of each
        bigram's two words, as two rows. Returns template, first and last line, coefficient and whether they are whole lines, of the best
        run of lines for each template, or of the best run of words where no run of lines is enough."""
        known = np.unique(ids[ids >= 0])
        able = np.flatnonzero(self.holds[known].sum(axis=0) >= self.low - 1e-9)
        if not len(able):
            return []
        best: dict[int, tuple[float, int, int, bool]] = {}
        most = self.high[able].max()
        held = self.holds[:, able]
        hit_lines = np.unique(lines[:, ids >= 0])
        firsts = np.unique(lines[0])
        other = np.unique(grams, return_inverse=True)[1]
        # A best run begins and ends with lines that share a bigram: others only add to its size.
        for first in hit_lines.tolist():
            seen: set[int] = set()
            count = np.zeros(len(able), int)
            at = int(np.searchsorted(lines[0], first))
            last = first
            for last in firsts[np.searchsorted(firsts, first) :].tolist():
                while at < len(ids) and lines[1][at] <= last:
                    gram = int(ids[at]) if ids[at] >= 0 else -2 - int(other[at])
                    if gram not in seen:
                        seen.add(gram)
                        if gram >= 0:
                            count = count + held[gram]
                    at += 1
                size = len(seen)
                if size > most:
                    break
                for j, k in enumerate(able.tolist()):
                    if self.low[k] - 1e-9 <= size <= self.high[k] + 1e-9:
                        dice = 2 * int(count[j]) / (size + int(self.sizes[k]))
                        if dice >= self.threshold and (k not in best or dice > best[k][0]):
                            best[k] = (dice, first, last, True)
        rest = [k for k in able.tolist() if k not in best]
        if rest:
            # Where each bigram stands before and after.
            order = np.argsort(other, kind="stable")
            same = np.flatnonzero(other[order][1:] == other[order][:-1])
            before, after = np.full(len(other), -1), np.full(len(other), len(other))
            before[order[same + 1]], after[order[same]] = order[same], order[same + 1]
            for k in rest:
                found = self._window(k, ids, before, after)
                if found:
                    dice, first, last = found
                    best[k] = (dice, int(lines[0][first]), int(lines[1][last]), False)
        return [(k, first, last, dice, whole) for k, (dice, first, last, whole) in sorted(best.items())]

    def _window(self, k: int, ids: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[float, int, int] | None:
        """Coefficient, first and last bigram of the best run of words for template ``k``, if it is enough.

        Only runs that begin and end with a bigram of the template and don't repeat the first one can
        be better than all shorter ones."""
        own = (ids >= 0) & self.holds[ids, k]
        at, high = np.flatnonzero(own), int(self.high[k] + 1e-9)
        best = None
        for first in at.tolist():
            stop, length = int(after[first]), high
            while True:
                end = min(stop, first + length)
                size = np.cumsum(before[first:end] < first)
                if end == stop or size[-1] > high:
                    break
                length *= 2
            size = size[: np.searchsorted(size, high, "right")]
            fresh = own[first : first + len(size)] & (before[first : first + len(size)] < first)
            count = np.cumsum(fresh)
            if count[-1] < self.low[k] - 1e-9:
                continue
            dice = 2 * count / (size + int(self.sizes[k]))
            last = int(np.argmax(dice))
            if dice[last] >= self.threshold and (best is None or dice[last] > best[0]):
                best = (float(dice[last]), first, first + last)
        return best


def find_licences(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_licences, licence, dice, lines, licences, inside``.

    ``licence`` is the template with the largest coefficient (ties: whole lines, then the first), ``lines``
    its first and last line (from 0). ``licences`` has all that match a run of whole lines, ``inside`` all
    others, which match a run of words only, as ``name=coefficient``, in template order; ``n_licences``
    counts both.
    Null and empty texts match nothing. Repeated rows give equal rows; a null doc_id is carried
    through. Other columns are ignored.
    """
    given = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text"))
    wanted = templates or {**TEMPLATES, **whole_texts()}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Templates(wanted, threshold)
        for part in slices(batches):
            words = Words(part.column("text"), blank=SYMBOLS)
            grams = _bigrams(words)
            at = np.searchsorted(held.all, grams)
            at[at == len(held.all)] = 0
            ids = np.where(held.all[at] == grams, at, -1)
            breaks = np.flatnonzero(words.bytes == 10)
            line = np.searchsorted(breaks, words.starts)
            first_line = np.searchsorted(breaks, words.row_bytes[:-1])
            rows = []
            for r in range(part.num_rows):
                lo, hi = words.rows[r], words.rows[r + 1] - 1
                found = []
                if hi > lo and (ids[lo:hi] >= 0).any():
                    found = held.matches(ids[lo:hi], np.stack([line[lo:hi], line[lo + 1 : hi + 1]]) - first_line[r], grams[lo:hi])
                top = max(found, key=lambda x: (x[3], x[4], -x[0]), default=None)
                rows.append((
                    len(found), held.names[top[0]] if top else None, round(top[3], 9) if top else None,
                    f"{top[1]}-{top[2]}" if top else None,
                    *(";".join(f"{held.names[k]}={d:.4f}" for k, _, _, d, whole in found if whole == kind) for kind in (True, False)),
                ))
            cols = list(zip(*rows))
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.string(), pa.string(), pa.string()]
            yield pa.record_batch(
                [part.column("doc_id"), *[pa.array(c, k) for c, k in zip(cols, kinds)]],
                names=["doc_id", "n_licences", "licence", "dice", "lines", "licences", "inside"],
            )

    return given.mapInArrow(each, "doc_id bigint, n_licences bigint, licence string, dice double, lines string, licences string, inside string")
