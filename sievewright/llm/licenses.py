"""License notices found by patience alignment with templates."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.llm.common import ByteHasher, chunks, text_buffers, words_of

_DISCLAIMER = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_OPENING = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
_BSD_BINARY = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_DISCLAIMER = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND "
    "ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
#: Whole bodies of short licenses and whole headers of long ones.
BODIES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": _BSD_OPENING + "1. " + _BSD_SOURCE + "2. " + _BSD_BINARY + _BSD_DISCLAIMER,
    "BSD-3-Clause": _BSD_OPENING + "1. " + _BSD_SOURCE + "2. " + _BSD_BINARY + "3. " + _BSD_NAMES + _BSD_DISCLAIMER,
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
    "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
    "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, "
    "and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
    "or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "ISC-body": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH "
    "THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-body": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _DISCLAIMER,
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, "
    "for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
    "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
    "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original "
    "software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the "
    "original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Usual notices and the opening of usual license texts, beside the bodies.
TEMPLATES = BODIES | {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_HASHER = ByteHasher(2)


def words(text: str) -> list[str]:
    """Runs of 0-9, a-z (A-Z lower-cased) and letters beyond ASCII."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs (sorted by their first) whose second increases: patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tops, b)
        if k == len(tops):
            tops.append(b)
            piles.append(i)
        else:
            tops[k], piles[k] = b, i
        back.append(piles[k - 1] if k else -1)
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _numbered(words: list, begin: int) -> dict[tuple, int]:
    """The place of each (word, how often it came before)."""
    seen: Counter = Counter()
    out = {}
    for place, word in enumerate(words, begin):
        out[word, seen[word]] = place
        seen[word] += 1
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched places of two word lists, increasing in both.

    Equal ends match; words unique to both sides anchor, of which the longest
    increasing run is taken, and the gaps between are aligned in the same way.
    Where a gap has no such words, the first, second, ... occurrences of a word
    on both sides count as words of their own, so that every gap whose sides
    share a word is aligned further.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        left, right = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if right[w] == 1}
        anchors = _increasing([(p, place[w]) for p, w in enumerate(a[i:j], i) if left[w] == 1 and w in place])
        if not anchors:
            later = _numbered(b[k:m], k)
            anchors = _increasing([(p, later[w]) for w, p in _numbered(a[i:j], i).items() if w in later])
        out += anchors
        if anchors:
            ends = [(i - 1, k - 1), *anchors, (j, m)]
            todo += [(x + 1, y, u + 1, v) for (x, u), (y, v) in zip(ends[:-1], ends[1:], strict=True)]
    return sorted(out)


def scan_words(doc: list, template: list, min_coverage: float, spread: float = 2.0) -> list[tuple[float, int, int]]:
    """(coverage, first word, last word + 1) of a template's notices in a document, apart and in order.

    A notice's words lie within ``spread`` times the template's length; windows
    of half a template more, each half a template on, hold every such stretch.
    Coverage is the share of the template's words that patience alignment
    matches; what lies before the first and after the last match is left out.
    """
    n = len(template)
    need, supply = Counter(template), []
    have: Counter = Counter()
    step = max(1, n // 2)
    window = int(spread * n) + step
    enough = min_coverage * n - 1e-9
    for start in range(0, max(1, len(doc) - window + step), step):
        part = doc[start : start + window]
        have = Counter(w for w in part if w in need)
        if sum(min(c, need[w]) for w, c in have.items()) < enough:
            continue
        matched = align(part, template)
        if len(matched) >= enough:
            supply.append((len(matched) / n, start + matched[0][0], start + matched[-1][0] + 1))
    out: list[tuple[float, int, int]] = []
    for found in sorted(supply, key=lambda x: (-x[0], x[2] - x[1], x[1])):
        if all(found[2] <= o[1] or found[1] >= o[2] for o in out):
            out.append(found)
    return sorted(out, key=lambda x: x[1])


NOTICES = "array<struct<license:string,coverage:double,start:int,length:int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None, min_coverage: float = 0.8, spread: float = 2.0) -> DataFrame:
    """Rows (<id>, n_words, notices): every notice in each whole text, by patience alignment.

    start and length are in words.  Of overlapping notices of several templates
    that with most matched words counts (ties: the higher coverage, then the
    name).  A notice may have other words between its own, up to ``spread`` times
    its length in all.  A null text or one without words has none.  Documents that lack the
    words a template needs are passed over by an exact bound: coverage cannot
    exceed the share of the template's words, repeats included, that occur.
    """
    known = {name: words(t) for name, t in (TEMPLATES if templates is None else templates).items()}
    known = {name: w for name, w in known.items() if w}
    vocab = sorted({w for t in known.values() for w in t})
    schema = T.StructType([docs.schema[id_col], T.StructField("n_words", T.LongType())])
    notice = T.StructType().add("license", "string").add("coverage", "double").add("start", "integer").add("length", "integer")
    schema = schema.add("notices", T.ArrayType(notice))
    arrow = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("start", pa.int32()), ("length", pa.int32())]))
    need = np.array([[t.count(w) for w in vocab] for t in known.values()], np.int64).reshape(len(known), len(vocab))
    coded = {name: [vocab.index(w) for w in t] for name, t in known.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = np.frombuffer("".join(vocab).encode(), np.uint8)
        ends = np.cumsum([len(w.encode()) for w in vocab], dtype=np.int64)
        hashes = _HASHER.ranges(_HASHER.prefix(raw), np.r_[0, ends[:-1]].astype(np.int64), ends) if vocab else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        for batch in batches:
            blob, offsets = text_buffers(batch.column(1))
            n_words, notices = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)]
            for i, j in chunks(offsets):
                part = _LOWER[blob[offsets[i] : offsets[j]]]
                starts, stops, first = words_of(part, offsets[i : j + 1] - offsets[i], _IS_WORD)
                n_words[i:j] = np.diff(first)
                if not vocab or not len(starts):
                    continue
                h = _HASHER.ranges(_HASHER.prefix(part), starts, stops)
                at = np.minimum(np.searchsorted(hashes[order], h), len(vocab) - 1)
                code = np.where(hashes[order][at] == h, order[at], -1)
                row = np.repeat(np.arange(j - i), np.diff(first))
                some = np.flatnonzero(code >= 0)
                have = np.bincount(row[some] * len(vocab) + code[some], minlength=(j - i) * len(vocab)).reshape(j - i, len(vocab))
                for k, (name, template) in enumerate(coded.items()):
                    for r in np.flatnonzero(np.minimum(have, need[k]).sum(axis=1) >= min_coverage * len(template) - 1e-9).tolist():
                        found = scan_words(code[first[r] : first[r + 1]].tolist(), template, min_coverage, spread)
                        notices[i + r] += [(round(c * len(template)), c, name, a, b) for c, a, b in found]
            out = []
            for found in notices:
                kept: list[tuple] = []
                for x in sorted(found, key=lambda x: (-x[0], -x[1], x[2], x[3])):
                    if all(x[4] <= y[3] or x[3] >= y[4] for y in kept):
                        kept.append(x)
                out.append([{"license": x[2], "coverage": x[1], "start": x[3], "length": x[4] - x[3]} for x in sorted(kept, key=lambda x: x[3])])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words), pa.array(out, arrow)], names=schema.fieldNames())

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(work, schema)
