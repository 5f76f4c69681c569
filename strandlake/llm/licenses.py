"""Licence scans: passages compared to licence templates by the Dice coefficient over word bigrams.

Texts and templates are normalised to lower-case words of letters and digits. A passage is any run of a
document's bigrams; its Dice coefficient with a template is twice the bigrams they share (as multisets) over
the sum of their sizes. A passage scoring at least t has between t / (2 - t) and (2 - t) / t times the
template's bigrams and shares at least the lower of these, so a template is dropped for a document, and a
start for a template, as soon as too few of its bigrams are in reach.
"""

from __future__ import annotations

import bisect
import heapq
import math
import pkgutil
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import map_batches

THRESHOLD = 0.8
_WORD = re.compile(r"[^\W_]+")

# Public licence texts and the notices by which works refer to them, by licence.
TEMPLATES = {
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": [
        "Released under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work."],
    "GPL-1.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 1, or (at your option) any later version."],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-2.0": ["This work is licensed under the GNU Library General Public License, version 2."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}
# Texts that differ by a clause or a few words from one above: without them they would be taken for it.
for _kind in ("library", "program"):
    for _name, _terms in (("LGPL-2.0", "Library General Public License as published by the Free Software Foundation; either version 2"), ("LGPL-2.1", "Lesser General Public License as published by the Free Software Foundation; either version 2.1"), ("LGPL-3.0", "Lesser General Public License as published by the Free Software Foundation; either version 3")):
        TEMPLATES[_name].append(f"This {_kind} is free software; you can redistribute it and/or modify it under the terms of the GNU {_terms} of the License, or (at your option) any later version.")
_HEAD, _AS_IS = TEMPLATES["BSD-2-Clause"][1].split(" THIS SOFTWARE IS PROVIDED")
_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED" + _AS_IS
_NOTED = "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the copyright holder."
TEMPLATES["BSD-3-Clause"].append(f"{_HEAD} 3. {_NAMES}")
TEMPLATES["BSD-4-Clause"] = ["Released under the BSD 4-Clause License.", f"{_HEAD} 3. {_NOTED} 4. {_NAMES}"]
TEMPLATES["0BSD"] = [TEMPLATES["ISC"][1].replace(", provided that the above copyright notice and this permission notice appear in all copies", "")]
TEMPLATES["MIT-0"] = [TEMPLATES["MIT"][2].replace(", subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software", "")]
#: Licences whose full texts are kept beside this module.
FULL_TEXTS = ("Apache-2.0", "CC0-1.0", "GPL-1.0", "GPL-2.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "Unlicense")
for _name in FULL_TEXTS:
    TEMPLATES[_name].append(pkgutil.get_data(__package__, f"license_texts/{_name}.txt").decode())


def normalised(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """The templates with an index from bigram to the templates that hold it."""

    def __init__(self, templates: dict[str, list[str]], threshold: float = THRESHOLD):
        self.threshold = threshold
        self.names, self.bigrams = [], []
        self.index = defaultdict(list)
        for name in sorted(templates):
            for text in templates[name]:
                words = normalised(text)
                counts = Counter(zip(words, words[1:]))
                for pair in counts:
                    self.index[pair].append(len(self.names))
                self.names.append(name)
                self.bigrams.append(counts)
        self.sizes = [sum(c.values()) for c in self.bigrams]
        self.index = dict(self.index)

    def _from(self, k: int, i: int, where: np.ndarray, back: np.ndarray, end: int) -> tuple[float, int] | None:
        """(Dice, last bigram) of the best passage for template k from hit ``i`` to a hit before ``end``."""
        m, t = self.sizes[k], self.threshold
        reach = min(end, int(np.searchsorted(where, where[i] + math.floor((2 - t) / t * m + 1e-9))))
        if reach - i < math.ceil(t / (2 - t) * m - 1e-9):
            return None
        # a hit is shared if fewer of its bigram precede it in the passage than the template holds
        dice = 2 * np.cumsum(back[i:reach] < i) / (m + where[i:reach] - where[i] + 1)
        best = int(dice.argmax())
        return (float(dice[best]), int(where[i + best])) if dice[best] >= t else None

    def matches(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, Dice, first word, last word) of passages that overlap no better one, best first.

        All passages of all templates compete, several of one template too. Ties go to the longer template, then
        to the earlier passage and the licence first in order.
        """
        words = normalised(text or "")
        pairs = list(zip(words, words[1:]))
        index = self.index
        hits = defaultdict(list)
        for i, pair in enumerate(pairs):
            if pair in index:
                for k in index[pair]:
                    hits[k].append(i)
        lines, found = {}, []
        for k, at in hits.items():
            m, t = self.sizes[k], self.threshold
            least = math.ceil(t / (2 - t) * m - 1e-9)
            if len(at) < least:
                continue
            where = np.array(at)
            reach = np.searchsorted(where, where + math.floor((2 - t) / t * m + 1e-9))  # hits before this one are within the size bound
            starts = np.flatnonzero(reach - np.arange(len(at)) >= least)
            if not len(starts):
                continue
            seen, back = defaultdict(list), np.full(len(at), -1)
            for i, place in enumerate(at):  # back: the hit with the same bigram as many hits ago as the template holds
                own, most = seen[pairs[place]], self.bigrams[k][pairs[place]]
                if len(own) >= most:
                    back[i] = own[-most]
                own.append(i)
            lines[k] = where, back
            for i in starts.tolist():
                if best := self._from(k, i, where, back, len(at)):
                    found.append((-best[0], -m, at[i], self.names[k], best[1], k, i))
        heapq.heapify(found)  # the best passage from each start; one that is cut short by a better one comes again
        kept: list[tuple[str, float, int, int]] = []
        spans: list[tuple[int, int]] = []  # words of the kept passages, in order
        while found:
            dice, size, first, name, last, k, i = heapq.heappop(found)
            after = bisect.bisect_right(spans, (first, len(words)))
            if after and spans[after - 1][1] >= first:
                continue
            if after < len(spans) and spans[after][0] <= last + 1:
                where, back = lines[k]
                if best := self._from(k, i, where, back, int(np.searchsorted(where, spans[after][0] - 1))):
                    heapq.heappush(found, (-best[0], size, first, name, best[1], k, i))
                continue
            spans.insert(after, (first, last + 1))
            kept.append((name, -dice, first, last + 1))
        return kept


def _scan(templates: dict[str, list[str]], threshold: float):
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("first_word", pa.int32()), ("last_word", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for b in batches:
            found = [scanner.matches(t) for t in b.column("text").to_pylist()]
            rows = [[dict(zip(("license", "dice", "first_word", "last_word"), m)) for m in ms] for ms in found]
            best = [ms[0] if ms else (None, None) for ms in found]
            columns = [b.column("doc_id"), pa.array([m[0] for m in best], pa.string()), pa.array([m[1] for m in best], pa.float64()), pa.array([len(ms) for ms in found], pa.int32()), pa.array(rows, kind)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "license", "dice", "n_matches", "matches"])

    return run


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, ...): doc_id, license and dice of its best passage (null if
    none reaches ``threshold``), n_matches, and matches: every passage of any template that overlaps no better one.

    Null, empty and one-word texts have no bigram and match nothing. Null doc_ids stay null, repeated rows stay
    repeated, an empty table gives an empty one, other columns take no part.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, license string, dice double, n_matches int, matches array<struct<license: string, dice: double, first_word: int, last_word: int>>"
    return map_batches(rows, _scan(TEMPLATES if templates is None else templates, threshold), schema)
