"""License scans: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Each template's word trigrams are winnowed: of every few in a row, the one of
the least hash stays. These fingerprints form an inverted index from hash to
(template, place). All trigrams of a document are looked up in it, so a
template that stands in a text unchanged is always a candidate. A candidate's
region is aligned with the template word by word within a band around the
diagonal of the hit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakevec.llm.common import WORD
from lakevec.llm.language_id import flat_bytes
from lakevec.llm.ngram_join import _pieces, shingle_hashes

GRAM, WINNOW, BAND, MIN_COVERAGE = 3, 4, 8, 0.8

_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_MIT_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_GPL = 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.'
_BSD = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met'
_BSD_1_2 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: Public license notices.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License.",
    "MIT-grant": _MIT,
    "MIT-text": f"{_MIT} {_MIT_WARRANTY}",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": _GPL,
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-header": _GPL.replace("version 3", "version 2"),
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-3.0-header": _GPL.replace("GNU General", "GNU Lesser General"),
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-2.1-header": _GPL.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1").replace("This program", "This library"),
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "AGPL-3.0-header": _GPL.replace("GNU General", "GNU Affero General"),
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "ISC-text": f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "ISC": "Released under the ISC License.",
    "BSD": _BSD,
    "BSD-2-Clause": f"{_BSD}: {_BSD_1_2} {_BSD_WARRANTY}",
    "BSD-3-Clause": f"{_BSD}: {_BSD_1_2} {_BSD_3} {_BSD_WARRANTY}",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-name": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-name": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
}


def _lower(text: str) -> str:
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text)


def winnow(hashes: np.ndarray, window: int = WINNOW) -> list[int]:
    """Places of the winnowed hashes: in every window the rightmost of the least; all of a short text's least."""
    if len(hashes) <= window:
        return [int(len(hashes) - 1 - np.argmin(hashes[::-1]))] if len(hashes) else []
    return sorted({i + window - 1 - int(np.argmin(hashes[i : i + window][::-1])) for i in range(len(hashes) - window + 1)})


def template_index(templates: dict[str, str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], list[list[str]]]:
    """(sorted fingerprints, template of each, place of each, names, words): the inverted index."""
    names, found = sorted(templates), []
    for t, name in enumerate(names):
        raw = np.frombuffer(templates[name].encode(), np.uint8)
        hashes, _ = shingle_hashes(raw, np.array([0, len(raw)]), GRAM)
        found += [(int(hashes[i]), t, i) for i in winnow(hashes)]
    found.sort()
    words = [re.findall(WORD, _lower(templates[n])) for n in names]
    return np.array([f[0] for f in found], np.uint64), np.array([f[1] for f in found], int), np.array([f[2] for f in found], int), names, words


def align(template: list[str], words: list[str], diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched words, first, end): the best local alignment within band of the diagonal, words of the text counted from 0.

    A match scores 1, a changed, missing or added word -1; of equal scores the first stays.
    """
    best = (0, 0, 0, 0)
    above: dict[int, tuple[int, int, int]] = {}
    for i, word in enumerate(template):
        row: dict[int, tuple[int, int, int]] = {}
        for j in range(max(0, i + diagonal - band), min(len(words), i + diagonal + band + 1)):
            score, matched, first = above.get(j - 1, (0, 0, j))
            cell = (score + 1, matched + 1, first) if words[j] == word else (score - 1, matched, first)
            for other in (above.get(j), row.get(j - 1)):
                if other and other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0]:
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1], best[2], best[3]


def _matches(text: str, hits: np.ndarray, index: tuple, min_coverage: float) -> list[tuple[str, int, int, float, int, int]]:
    fingerprints, owner, place, names, templates = index
    spans = [m.span() for m in re.finditer(WORD, _lower(text))]
    words = [_lower(text[a:b]) for a, b in spans]
    found, tried = [], set()
    for at, h in hits:
        for i in range(np.searchsorted(fingerprints, h, "left"), np.searchsorted(fingerprints, h, "right")):
            t, diagonal = int(owner[i]), int(at) - int(place[i])
            if (t, diagonal) in tried or any(x[0] == t and x[3] <= at < x[4] for x in found):
                continue
            tried.add((t, diagonal))
            matched, first, end = align(templates[t], words, diagonal, min(BAND, len(templates[t]) // 2))
            coverage = matched / len(templates[t])
            named = set(re.findall(WORD, _lower(names[t]))) & set(templates[t])
            if coverage >= min_coverage and named <= set(words[first:end]) and not any(x[0] == t and x[3] < end and first < x[4] for x in found):
                found.append((t, matched, coverage, first, end))
    kept: list[tuple] = []
    for x in sorted(found, key=lambda x: (len(templates[x[0]]) - 2 * x[1], x[4] - x[3], x[0])):
        if all(2 * (min(x[4], y[4]) - max(x[3], y[3])) < min(x[4] - x[3], y[4] - y[3]) for y in kept):
            kept.append(x)
    return [(names[t], matched, len(templates[t]), coverage, spans[first][0], spans[end - 1][1]) for t, matched, coverage, first, end in sorted(kept, key=lambda x: x[3])]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, license, n_matched, n_template, coverage, start, end): a row for each place where a template stands.

    start and end count characters of the text. Of matches that share half of the
    shorter the one of most matched less missing words stays. Words of a
    template's name that it holds, as its version, must be in the match. Null, empty and short texts have none; rows
    that repeat each report theirs; other columns are left out. The templates
    are a fixed table and travel with the tasks.
    """
    index = template_index(templates or TEMPLATES)
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = {"license": pa.string(), "n_matched": pa.int64(), "n_template": pa.int64(), "coverage": pa.float64(), "start": pa.int64(), "end": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = flat_bytes(b.column("text"))
            rows, out = [], []
            for lo, hi in _pieces(data, offsets):
                hashes, at = shingle_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], GRAM)
                hit = np.flatnonzero(np.isin(hashes, index[0]))
                row = np.searchsorted(at, hit, "right") - 1
                for r in np.unique(row):
                    own = hit[row == r]
                    for m in _matches(b.column("text")[lo + int(r)].as_py(), list(zip(own - at[r], hashes[own], strict=True)), index, min_coverage):
                        rows.append(lo + int(r))
                        out.append(m)
            cols = [b.column("doc_id").take(pa.array(rows, pa.int64()))] + [pa.array([m[i] for m in out], t) for i, t in enumerate(fields.values())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *fields])

    return docs.mapInArrow(run, f"doc_id {kind}, license string, n_matched long, n_template long, coverage double, start long, end long")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
