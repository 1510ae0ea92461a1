"""Licence scans: Dice coefficient over word bigrams against licence templates.

Texts and templates are normalised to lower-case words of letters and digits.
A span of words matches a template when 2 |A n B| / (|A| + |B|) over the
multisets of word bigrams reaches ``threshold``. With ``spans='words'`` they begin
and end at any word that starts or ends a bigram of the template (cutting other
words off only raises the coefficient), with ``spans='lines'`` at line breaks. Of
all matching spans of all templates, the best are taken first, and spans that
share words with a taken one give way. A licence is told by its best span taken.

Size bounds prune: with threshold t a span needs between t/(2-t) |B| and (2-t)/t
|B| bigrams, and must share t/(2-t) |B| of them, so a template is looked at only
in documents whose own bigrams can reach that, and only in spans of fitting size.

With ``tell_apart`` a span is refused where the words that tell licences from their
neighbours differ from the template's: the numbers of a version and the words of
``TELLING``. So a Lesser or Affero licence is not told as the plain one, nor a version
as another one, also where there is no template for it.

Defined cases: null, empty and one-word texts match nothing; templates of under
two words are refused; of spans with equal coefficients the earliest, then the
shortest wins; repeated rows are scanned each; extra columns pass through.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.llm.common import small_batches

# Wording of public licence notices and short licences.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED
"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
governing permissions and limitations under the License.""",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
details. You should have received a copy of the GNU General Public License along with this program. If not, see
https://www.gnu.org/licenses/.""",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version.""",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": [
        "Licensed under CC BY-NC-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC-BY-3.0": ["Licensed under CC BY 3.0.",
                  "This work is licensed under a Creative Commons Attribution 3.0 Unported License."],
    "CC-BY-SA-3.0": ["Licensed under CC BY-SA 3.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work.", "Released into the public domain under CC0 1.0."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "Apache-1.1": ["Licensed under the Apache License, Version 1.1.", "Licensed under the Apache Software License, Version 1.1."],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version.""",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any
later version.""",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
later version.""",
    ],
    "BSD-2-Clause": [
        "Licensed under the BSD 2-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.""",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.""",
    ],
    "ISC": ["""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""],
    "Zlib": ["""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be
held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions:"""],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

# Words that tell a licence from its neighbours, and those that a version's number follows.
TELLING = frozenset("lesser library affero noncommercial nc sharealike sa noderivatives noderivs nd".split())
_VERSIONED = TELLING | frozenset("version v license licenses licence attribution by cc0 bsd mpl gpl lgpl agpl apache".split())

_WORD = re.compile(r"[^\W_]+")


def telling(w: list[str]) -> frozenset[str]:
    """The telling words of a stretch, and the numbers of the versions that it names."""
    out, number = set(), False
    for before, x in zip(["", *w], w):
        number = x.isdigit() and (number or before in _VERSIONED)
        if number or x in TELLING:
            out.add(x)
    return frozenset(out)


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Scanner:
    """Templates with an index from bigram to the templates that hold it."""

    def __init__(self, templates: dict[str, list[str]], threshold: float = 0.8, spans: str = "lines",
                 tell_apart: bool = False):
        if spans not in ("lines", "words"):
            raise ValueError(f"spans is 'lines' or 'words', not {spans!r}")
        self.threshold, self.spans = threshold, spans
        self.told: list[frozenset] | None = [] if tell_apart else None  # of each template
        self.items: list[tuple[str, Counter, int, int, int]] = []  # name, bigrams, size, least, most
        self.index: dict[tuple[str, str], list[int]] = {}
        share = threshold / (2 - threshold)
        for name, texts in templates.items():
            for text in texts:
                w = words(text)
                if len(w) < 2:
                    raise ValueError(f"template of {name} has under two words")
                grams = Counter(zip(w, w[1:]))
                size = len(w) - 1
                if self.told is not None:
                    self.told.append(telling(w))
                for g in grams:
                    self.index.setdefault(g, []).append(len(self.items))
                self.items.append((name, grams, size, math.ceil(share * size - 1e-9), math.floor(size / share + 1e-9)))

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(licence, coefficient, first line, last line; from 1) of the best span of
        each licence that reaches the threshold, by name; on shared words the best alone."""
        if not text:
            return []
        flat: list[str] = []
        lines: list[tuple[int, int, int]] = []  # number, first word, word after the last
        for i, line in enumerate(text.split("\n"), 1):
            w = words(line)
            if w:
                lines.append((i, len(flat), len(flat) + len(w)))
                flat += w
        index = self.index
        hits = [(p, g) for p, g in enumerate(zip(flat, flat[1:])) if g in index]
        if not hits:
            return []
        held = Counter(g for _, g in hits)
        shared: Counter = Counter()
        for g, n in held.items():
            for t in index[g]:
                shared[t] += min(n, self.items[t][1][g])
        # all matching spans, in arrays: coefficient, template, first word, word after the last
        found = array("d"), array("q"), array("q"), array("q")
        for t, most_shared in shared.items():
            grams, least = self.items[t][1], self.items[t][3]
            if most_shared >= least:
                at = [(p, g) for p, g in hits if g in grams]
                if self.spans == "words":
                    self._words(t, at, found)
                else:
                    self._lines(t, len(flat), lines, at, found)
        if not found[0]:
            return []
        dice, of, begin, end = (np.frombuffer(x, x.typecode) for x in found)
        rank = {name: i for i, name in enumerate(sorted({x[0] for x in self.items}))}
        name_rank = np.array([rank[x[0]] for x in self.items])[of]
        used = bytearray(len(flat))
        firsts = [a for _, a, _ in lines]
        best: dict[str, tuple[float, int, int]] = {}
        for k in np.lexsort((end - begin, begin, name_rank, -dice)).tolist():
            a, b = int(begin[k]), int(end[k])
            if self.told is not None and telling(flat[a:b]) != self.told[of[k]]:
                continue
            if used.find(1, a, b) < 0:  # a weaker match on the same words gives way
                used[a:b] = b"\x01" * (b - a)
                best.setdefault(self.items[of[k]][0], (
                    float(dice[k]), lines[bisect_right(firsts, a) - 1][0], lines[bisect_right(firsts, b - 1) - 1][0]))
        return sorted((name, *x) for name, x in best.items())

    def _words(self, t: int, at: list, found: tuple[array, ...]) -> None:
        """Add the matching spans of words of template ``t``, given the places of its bigrams."""
        _, grams, size, least, most = self.items[t]
        for i, (first, _) in enumerate(at):
            # the least-th bigram from here on must stand within the longest span
            if i + least > len(at) or at[i + least - 1][0] - first >= most:
                continue
            own: dict = {}
            both = 0
            for k in range(i, len(at)):
                p, g = at[k]
                n = p - first + 1
                if n > most:
                    break
                c = own[g] = own.get(g, 0) + 1
                if c <= grams[g]:
                    both += 1
                d = 2 * both / (n + size)
                if d >= self.threshold:
                    for column, x in zip(found, (d, t, first, p + 2)):
                        column.append(x)

    def _lines(self, t: int, n_words: int, lines, at: list, found: tuple[array, ...]) -> None:
        """Add the matching spans of whole lines of template ``t``, given the places of its bigrams."""
        _, grams, size, least, most = self.items[t]
        before = [0] * (n_words + 1)
        for p, _ in at:
            before[p + 1] = 1
        for i in range(1, len(before)):
            before[i] += before[i - 1]
        touched = [k for k, (_, a, b) in enumerate(lines) if before[b] > before[max(a - 1, 0)]]
        places = [p for p, _ in at]
        for x, i in enumerate(touched):
            a = lines[i][1]
            for j in touched[x:]:
                b = lines[j][2]
                n = b - a - 1  # bigrams of the span
                if n > most:
                    break
                if n < least or 2 * (before[b - 1] - before[a]) / (n + size) < self.threshold:
                    continue
                own = Counter(g for _, g in at[bisect_left(places, a):bisect_left(places, b - 1)])
                d = 2 * sum(min(c, grams[g]) for g, c in own.items()) / (n + size)
                if d >= self.threshold:
                    for column, value in zip(found, (d, t, a, b)):
                        column.append(value)


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = 0.8,
         max_templates: int = 10_000, spans: str = "lines", tell_apart: bool = False) -> DataFrame:
    """``docs`` columns but the text, with ``licenses``: array of (license, dice,
    first_line, last_line), ordered by licence. The templates (at most
    ``max_templates`` texts) travel with the tasks. A column named licenses is replaced."""
    templates = TEMPLATES if templates is None else templates
    if sum(map(len, templates.values())) > max_templates:
        raise ValueError("more templates than max_templates")
    names = [c for c in docs.columns if c not in ("text", "licenses")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in names)
    kind = "array<struct<license:string,dice:double,first_line:bigint,last_line:bigint>>"
    out_type = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()),
                                   ("first_line", pa.int64()), ("last_line", pa.int64())]))
    keys = ("license", "dice", "first_line", "last_line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold, spans, tell_apart)
        for b in small_batches(batches, "text"):
            found = [[dict(zip(keys, m)) for m in scanner.scan(x.as_py())] for x in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(found, out_type)],
                                             names=[*names, "licenses"])

    src = docs.select(*[F.col(f"`{c}`") for c in names], "text")
    return src.mapInArrow(run, f"{kept}, licenses {kind}" if kept else f"licenses {kind}")
