"""License scans by conditional compression.

A template is tried in a block of text around license words unless an exact bound
on shared words rules it out. The block is compressed once alone and once with each
template as a raw zstandard dictionary; the size saved ranks the templates. All
of them are then confirmed word by word: the least-edit alignment of the template
inside the block that leaves the license's name unchanged may have one other
difference in ten words. Differences are reported. A confirmed stretch is
taken out of the block and the rest is ranked again, so a block may hold several.

Defined cases: a null or blank text has no licenses; repeated rows each come
back; an empty table gives an empty result; every block of a text is scanned,
long paragraphs in overlapping windows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: SPDX identifiers and the names by which notices call these licenses.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0"),
    "MIT": ("MIT License",),
    "ISC": ("ISC License",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GPLv2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GPLv3"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1",),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0",),
    "Unlicense": ("Unlicense",),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
}
FORMS = (
    "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}.", "Distributed under the terms of the {}.",
    "Available under the {}.", "Available under the terms of the {}.", "Published under the {}.", "Provided under the {}.", "Covered by the {}.", "Subject to the {}.", "This project uses the {}.", "License: {}.",
)
#: Names too short to stand in every form.
BARE = {"MIT": "MIT", "ISC": "ISC", "Apache-2.0": "Apache 2.0", "MPL-2.0": "MPL 2.0", "BSD-3-Clause": "BSD-3-Clause", "BSD-2-Clause": "BSD-2-Clause"}
BARE_FORMS = ("Licensed under {}.", "License: {}.")
ALSO = {"GPL-2.0": "or GPLv2", "GPL-3.0": "or GPLv3"}
#: Openings of notices, and whole license texts.
AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS {}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
MAY_USE = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_END = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
BSD_START = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
BSD_RULES = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
MIT_START = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details."
UNLICENSE = "This is free and unencumbered software released into the public domain"
#: Words of a notice that tell its license from its relatives: they may not differ.
GNU_NAMES = {"GPL-2.0": "2", "GPL-3.0": "3", "LGPL-3.0": "Lesser 3", "AGPL-3.0": "Affero 3"}
NOTICES = (
    ("MIT", MIT_START),
    ("MIT", f"{MIT_START}, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {AS_IS.format('OR COPYRIGHT HOLDERS ')}"),
    ("ISC", MAY_USE),
    ("ISC", f"{MAY_USE}, provided that the above copyright notice and this permission notice appear in all copies. {ISC_END}"),
    ("0BSD", f"{MAY_USE}. {ISC_END}"),
    ("BSD", BSD_START),
    ("BSD-2-Clause", f"{BSD_START}: {BSD_RULES} {BSD_END}"),
    ("BSD-3-Clause", f"{BSD_START}: {BSD_RULES} {BSD_NAMES} {BSD_END}"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPL-2.0", GNU.format("", "2")),
    ("GPL-3.0", GNU.format("", "3")),
    ("LGPL-3.0", GNU.format("Lesser ", "3")),
    ("AGPL-3.0", GNU.format("Affero ", "3")),
    ("Unlicense", UNLICENSE),
    ("Unlicense", f"{UNLICENSE}. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.+-][A-Za-z0-9]+)*")
#: Words of a block, and the step between windows of a longer paragraph; no template, with its differences, is longer than their difference.
BLOCK, STEP = 560, 240
#: Edits of an alignment that changes a license's name: more than any template has words.
NEVER = 1 << 20
LEVEL = 3


class Template:
    def __init__(self, license_id: str, text: str, name: str):
        self.id, self.words = license_id, [w.lower() for w in WORD.findall(text)]
        own = [w.lower() for w in WORD.findall(name)]
        #: Positions that must match exactly: the name's words.
        self.fixed = frozenset(i for i, w in enumerate(self.words) if w in own) if name else frozenset()
        self.name = frozenset(self.words[i] for i in self.fixed)
        line = " ".join(self.words).encode()
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, dict_data=zstandard.ZstdCompressionDict(line, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def cues(self) -> list[str]:
        """Words of which every confirmed stretch holds at least one.

        Any word of a template too short for a difference, or any of the name, can't be missing; else one word more than
        there may be differences.
        """
        edits = len(self.words) // 10
        sure = self.words if not edits else [self.words[i] for i in self.fixed]
        by = sorted(set(sure or self.words), key=lambda w: ("licens" not in w, -len(w), w))
        return by[:1] if sure else by[: edits + 1]

    def possible(self, words: frozenset[str]) -> bool:
        """Whether a block of these words can confirm it: the name's words are there, and few enough others miss."""
        return self.name <= words and 10 * sum(w not in words for w in self.words) <= len(self.words)

    def saved(self, body: bytes, alone: int) -> int:
        return alone - len(self.packer.compress(body))


@lru_cache(maxsize=1)
def templates() -> list[Template]:
    out = []
    for license_id, names in NAMES.items():
        out += [Template(license_id, form.format(name), name) for name in names for form in FORMS]
        out.append(Template(license_id, f"SPDX-License-Identifier: {license_id}", license_id))
    out += [Template(k, form.format(name), name) for k, name in BARE.items() for form in BARE_FORMS]
    out += [Template(k, text, text) for k, text in ALSO.items()]
    return out + [Template(k, text, GNU_NAMES.get(k, "") if len(text) > 200 else "") for k, text in NOTICES]


@lru_cache(maxsize=1)
def cues() -> dict[str, int]:
    """Words that open a block, for each template's confirmed stretches hold one; and how far such a stretch can reach from there."""
    out: dict[str, int] = {}
    for t in templates():
        for w in t.cues():
            out[w] = max(out.get(w, 0), len(t.words) + len(t.words) // 10)
    return out


def cued_text(text: str) -> bool:
    low = text.lower()
    return any(w in low for w in cues())


def align(template: list[str], words: list[str], fixed: frozenset[int] = frozenset()) -> tuple[int, int, int, list[tuple[int, str, str]]]:
    """(edits, start, end, differences) of the template's least-edit alignment inside words.

    A difference is (template position, template word or "", block word or ""); one at a fixed position costs NEVER.
    """
    n = len(words)
    cost = [NEVER if i in fixed else 1 for i in range(len(template) + 1)]
    rows = [[0] * (n + 1)]
    for i, t in enumerate(template, 1):
        before, own, added = rows[-1], cost[i - 1], cost[i]
        row = [before[0] + own]
        for j, w in enumerate(words, 1):
            row.append(min(before[j - 1] + (own if t != w else 0), before[j] + own, row[j - 1] + added))
        rows.append(row)
    end = min(range(n + 1), key=rows[-1].__getitem__)
    i, j, diffs = len(template), end, []
    while i:
        at = rows[i][j]
        if j and at == rows[i - 1][j - 1] + (cost[i - 1] if template[i - 1] != words[j - 1] else 0):
            i, j = i - 1, j - 1
            if template[i] != words[j]:
                diffs.append((i, template[i], words[j]))
        elif at == rows[i - 1][j] + cost[i - 1]:
            i -= 1
            diffs.append((i, template[i], ""))
        else:
            j -= 1
            diffs.append((i, "", words[j]))
    return rows[-1][end], j, end, diffs[::-1]


@lru_cache(maxsize=2_000)
def confirmed(words: tuple[str, ...]) -> tuple[tuple[str, int, int, str], ...]:
    """(license, first word, end word, differences) in a block of lower-case words."""
    out, parts = [], [(0, list(words))]
    plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
    while parts:
        at, part = parts.pop()
        own = frozenset(part)
        tried = [t for t in templates() if t.possible(own)]
        if not tried:
            continue
        body = " ".join(part).encode()
        alone = len(plain.compress(body))
        best = None
        for rank, t in enumerate(sorted(tried, key=lambda t: -t.saved(body, alone))):
            edits, i, j, diffs = align(t.words, part, t.fixed)
            if 10 * edits <= len(t.words) and (best is None or (2 * edits - len(t.words), -len(t.fixed)) < best[0]):
                best = ((2 * edits - len(t.words), -len(t.fixed)), rank, t.id, i, j, "; ".join(f"{a or '+'}/{b or '-'}" for _, a, b in diffs))
        if best:
            _, _, name, i, j, diffs = best
            out.append((name, at + i, at + j, diffs))
            parts += [(at, part[:i]), (at + j, part[j:])]
    return tuple(sorted(out, key=lambda x: x[1:3]))


def scan_text(text: str | None) -> list[tuple[str, int, int, str]]:
    """(license, start, end, differences) by start; offsets in code points."""
    if not text or not cued_text(text):
        return []
    found = {}
    at = 0
    for paragraph in re.split(r"(\n[ \t\r]*\n)", text):
        if cued_text(paragraph):
            spans = [(m.start() + at, m.end() + at, m[0].lower()) for m in WORD.finditer(paragraph)]
            cued = [k for k, (_, _, w) in enumerate(spans) if w in cues()]
            # only words near a cue can belong to a template: windows start and end there
            begin = end = None
            windows: list[tuple[int, int]] = []
            for k in cued:
                reach = cues()[spans[k][2]]
                i, j = max(0, k - reach), min(len(spans), k + reach + 1)
                if end is not None and i <= end:
                    begin, end = min(begin, i), max(end, j)
                else:
                    if begin is not None:
                        windows.append((begin, end))
                    begin, end = i, j
            if begin is not None:
                windows.append((begin, end))
            for i, j in windows:
                for k in range(i, j, STEP):
                    block = spans[k : min(j, k + BLOCK)]
                    for name, a, b, diffs in confirmed(tuple(w for _, _, w in block)):
                        found.setdefault((block[a][0], block[b - 1][1]), (name, diffs))
                    if k + BLOCK >= j:
                        break
        at += len(paragraph)
    return [(name, a, b, diffs) for (a, b), (name, diffs) in sorted(found.items())]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_licenses, licenses (distinct, sorted) and spans as license:start:end:differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan_text(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({x[0] for x in f})) for f in found], pa.string()), pa.array([",".join(f"{n}:{a}:{b}:{d}" for n, a, b, d in f) for f in found], pa.string())],
                names=["doc_id", "n_licenses", "licenses", "spans"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_batches(rows, run, "doc_id long, n_licenses long, licenses string, spans string")
