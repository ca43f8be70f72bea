"""Operator 5, licence scans: normalised text against licence templates by the Dice coefficient of word bigrams.

A text is compared as a whole, by blank-line paragraphs and by lines. With A and B the bigram sets, Dice is 2|A and B| / (|A| + |B|), so
that a template can only reach a threshold t where |B| lies between t / (2 - t) and (2 - t) / t times |A|: templates are kept
by size, and only those within the bounds are compared. What is sent to the tasks is the template list alone.

Beyond these units, all word windows within a template's bounds are compared, across line ends and blank lines, so that a notice counts
in the middle of prose and over several paragraphs. In a short template one word (the version) makes the licence, so windows against
it have its number of words at least; else a window would just leave out the word that differs.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from math import ceil, floor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The wording of public licence notices.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify,
        merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished
        to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all
        copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT
        SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT
        OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
        writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
        either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License v3.0.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Licensed under the BSD 2-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met""",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
        TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
        conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
        following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
        following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder
        nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior
        written permission. THIS SOFTWARE IS PROVIDED BY THE
        COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
        WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
        CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED
        TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE
        USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ),
    "CC-BY-4.0": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "LGPL-2.1": (
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as
        published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.""",
    ),
    "AGPL-3.0": (
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as
        published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is
        distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.""",
    ),
    "ISC": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS
        ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
        AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA
        OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR
        PERFORMANCE OF THIS SOFTWARE.""",
    ),
    "Zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this
        software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an
        acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked
        as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source
        distribution.""",
    ),
    "Unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
        or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by
        any means.""",
    ),
}

SHORT = 24  # words; a longer template may also be met by shorter windows

_KEEP = bytes(b if b == 10 or chr(b).isalnum() and b < 128 else 32 for b in range(256))


def normalise(text: str) -> bytes:
    """Lower-case ASCII letters, digits and line ends; everything else is a space."""
    return text.lower().encode("ascii", "replace").translate(_KEEP)


def bigrams(words: list[bytes]) -> frozenset:
    return frozenset(zip(words, words[1:], strict=False))


class Scanner:
    """Finds, for a unit of text, the template with the largest Dice coefficient of the threshold or more."""

    def __init__(self, templates: dict[str, tuple[str, ...]], least: float) -> None:
        self.least = least
        sets = sorted((len(b), name, b) for name, forms in templates.items() for form in forms if (b := bigrams(normalise(form).split())))
        self.sets = sets
        self.sizes = [size for size, _, _ in sets]
        self.forms = []
        self.known: dict[tuple, list[int]] = {}
        for name, words in sorted({(name, tuple(normalise(form).split())) for name, forms in templates.items() for form in forms}):
            if b := bigrams(list(words)):
                for pair in b:
                    self.known.setdefault(pair, []).append(len(self.forms))
                self.forms.append((name, b, len(words) - 1, ceil(len(b) * least / (2 - least) - 1e-9), floor(len(b) * (2 - least) / least + 1e-9)))
        self.fewest = ceil(self.sizes[0] * least / (2 - least) - 1e-9) if sets else 1 << 60

    def best(self, words: list[bytes]) -> tuple[float, str] | None:
        if len(words) - 1 < self.fewest:
            return None
        own = bigrams(words)
        low, high = ceil(len(own) * self.least / (2 - self.least) - 1e-9), floor(len(own) * (2 - self.least) / self.least + 1e-9)
        found = None
        for size, name, other in self.sets[bisect_left(self.sizes, low) : bisect_right(self.sizes, high)]:
            dice = 2 * len(own & other) / (len(own) + size)
            if dice >= self.least and (found is None or (-dice, name) < (-found[0], found[1])):
                found = (dice, name)
        return found

    def windows(self, words: list[bytes]) -> list[tuple[float, str, int, int]]:
        """(dice, name, first word, end) of the best window that begins at a place, for the places that have one of the threshold or more."""
        pairs = list(zip(words, words[1:], strict=False))
        shared = self.known.keys() & set(pairs)
        counts: dict[int, int] = {}
        for pair in shared:
            for at in self.known[pair]:
                counts[at] = counts.get(at, 0) + 1
        near = [at for at, n in counts.items() if n >= self.forms[at][3]]
        if not near:
            return []
        found = []
        for name, form, length, _, most in (self.forms[at] for at in near):
            hits = [i for i, pair in enumerate(pairs) if pair in form]
            short = length < SHORT
            starts = sorted({s for i in hits for s in range(max(0, i - length + 1), i + 1)}) if short else hits
            for s in starts:
                seen: set[tuple] = set()
                both, best, end = 0, 0.0, s
                for e in range(s, min(len(pairs), s + most) if short else len(pairs)):
                    pair = pairs[e]
                    if pair in seen:
                        if pair == pairs[s] and not short:
                            break  # a window beyond holds no more than one that begins later
                    else:
                        seen.add(pair)
                        if len(seen) > most:
                            break
                        both += pair in form
                    dice = 2 * both / (len(seen) + len(form))
                    if dice > best and (not short or e - s + 1 >= length):
                        best, end = dice, e + 2
                if best >= self.least:
                    found.append((best, name, s, end))
        return found

    def scan(self, text: str) -> list[tuple[float, str]]:
        """The best template of each unit that has one, then of windows: the best first, and none that overlaps an equal or better match; one within a match of its own licence lifts that to its own coefficient."""
        plain = normalise(text)
        taken = [(*x, first, first + len(unit)) for unit, first in placed(plain) if (x := self.best(unit))]
        for dice, name, first, end in sorted(self.windows(plain.split()), key=lambda x: (-x[0], x[1], x[2])):
            met = [i for i, (d, n, a, b) in enumerate(taken) if first < b and a < end and (d >= dice or name == n)]
            if not met:
                taken.append((dice, name, first, end))
            elif all(taken[i][0] < dice for i in met):  # a better part of a match of its own licence
                taken[met[0]] = (dice, *taken[met[0]][1:])
        return [x[:2] for x in taken]


def placed(text: bytes) -> Iterator[tuple[list[bytes], int]]:
    """Words, and the first one's number, of the lines, of paragraphs of more than one line, and of the whole where it has more than one paragraph."""
    lines = [line.split() for line in text.split(b"\n")]
    at = 0
    for line in lines:
        if line:
            yield line, at
        at += len(line)
    paragraph: list[list[bytes]] = []
    n = at = first = 0
    for line in [*lines, []]:
        if line:
            first = first if paragraph else at
            paragraph.append(line)
        elif paragraph:
            n += 1
            if len(paragraph) > 1:
                yield [w for x in paragraph for w in x], first
            paragraph = []
        at += len(line)
    if n > 1:
        yield [w for x in lines for w in x], 0


def units(text: bytes) -> Iterator[list[bytes]]:
    """Words of the lines, of paragraphs and of the whole."""
    return (unit for unit, _ in placed(text))


def scan(docs: DataFrame, least: float = 0.8, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, licence, dice, n_units, licences) for each row of docs.

    licence is the template name with the largest Dice coefficient over all units and windows of the text (the first by name among equals), null
    without a match; n_units counts the units that match, and windows elsewhere; licences lists all names by a comma. A null or empty text matches
    nothing. Rows are judged one by one, repeated ones alike. Extra columns are ignored.
    """
    known = TEMPLATES if templates is None else templates

    def run(batches):
        scanner = Scanner(known, least)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for text in batch.column(1).slice(at, 512):
                    found = scanner.scan(text.as_py() or "")
                    top = min(found, key=lambda x: (-x[0], x[1]), default=(None, None))
                    out.append((top[1], top[0], len(found), ",".join(sorted({name for _, name in found}))))
                kinds = [pa.string(), pa.float64(), pa.int64(), pa.string()]
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 512), *columns], ["doc_id", "licence", "dice", "n_units", "licences"])

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, "doc_id long, licence string, dice double, n_units long, licences string")
