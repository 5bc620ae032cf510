"""Licence scans: Dice coefficient of word bigrams against templates.

A text and each of its lines are units. A unit is lower-cased (A-Z) and cut into
words as in decontam.py; its distinct word bigrams are compared to those of each
template by 2 |A & B| / (|A| + |B|). Since that is at most 2 min / (|A| + |B|), a
template of n bigrams can only reach THRESHOLD with units of n * t / (2 - t) to
n * (2 - t) / t bigrams, and others are not compared.

With windows, every run of words of a text is a unit too, across line ends, so a
notice inside a longer text or line is found. The best runs begin and end with a
bigram of the template, and only those are tried. SQL has lines and whole texts only:
it gives the same rows where each notice is a line or a text of its own.

Nulls: a null text has no units, nor an empty one. Ties go to the first template by
name. Rows that repeat are scanned one by one; an empty table gives an empty one. A
very long text is scanned whole, in memory that follows its words. Other columns, of
any names, are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices, texts_of
from .decontam import words

THRESHOLD = 0.8

#: Public licence notices, by SPDX identifier.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0 (line)": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "CC-BY-4.0 (line)": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 (line)": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0 (line)": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "AGPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "GPL-2.0-or-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "GPL-3.0 (line)": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-3.0-or-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library. If not, see https://www.gnu.org/licenses/.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT (line)": "Released under the MIT License.",
    "rights reserved (line)": "All rights reserved.",
}


def bigrams(text: bytes) -> set[tuple[bytes, bytes]]:
    w = words(text)
    return set(zip(w, w[1:], strict=False))


class Matcher:
    def __init__(self, templates: dict[str, str], threshold: float = THRESHOLD):
        self.names = sorted(templates)
        grams = [bigrams(templates[n].encode()) for n in self.names]
        self.sizes, self.threshold = [len(g) for g in grams], threshold
        self.low = [n * threshold / (2 - threshold) for n in self.sizes]
        self.high = [n * (2 - threshold) / threshold for n in self.sizes]
        self.holders: dict[tuple[bytes, bytes], list[int]] = {}
        for k, g in enumerate(grams):
            for x in g:
                self.holders.setdefault(x, []).append(k)
        self.least, self.most = min(self.low, default=1), max(self.high, default=0)

    def unit(self, w: list[bytes]) -> list[tuple[str, float]]:
        """Templates that these words reach the threshold with."""
        if len(w) - 1 < self.least:
            return []
        grams = set(zip(w, w[1:], strict=False))
        n = len(grams)
        if not self.least <= n <= self.most:
            return []
        shared: dict[int, int] = {}
        for x in grams & self.holders.keys():
            for k in self.holders[x]:
                shared[k] = shared.get(k, 0) + 1
        return [(self.names[k], d) for k, c in shared.items() if self.low[k] <= n <= self.high[k] and (d := 2 * c / (n + self.sizes[k])) >= self.threshold]

    def windows(self, w: list[bytes]) -> dict[str, float]:
        """The best coefficient of any run of these words, by template that reaches the threshold."""
        grams = list(zip(w, w[1:], strict=False))
        shared: dict[int, int] = {}
        for x in set(grams) & self.holders.keys():
            for k in self.holders[x]:
                shared[k] = shared.get(k, 0) + 1
        # a run of s bigrams shares c <= s, so 2 c / (n + s) asks for c >= low
        some = {k for k, c in shared.items() if c >= self.low[k]}
        best: dict[int, float] = {}
        ahead: OrderedDict[tuple[bytes, bytes], None] = OrderedDict()
        for x in reversed(grams) if some else ():
            # distinct bigrams from here on, the nearest last
            ahead[x] = None
            ahead.move_to_end(x)
            for k in self.holders.get(x, ()):
                if k not in some:
                    continue
                c = 0
                for s, y in enumerate(reversed(ahead), 1):
                    if s > self.high[k]:
                        break
                    if k in self.holders.get(y, ()):
                        c += 1
                        best[k] = max(best.get(k, 0.0), 2 * c / (s + self.sizes[k]))
        return {self.names[k]: d for k, d in best.items() if d >= self.threshold}

    def text(self, text: bytes, windows: bool = False) -> tuple[int, dict[str, float]]:
        """How many lines match, and the best coefficient by template."""
        best: dict[str, float] = {}
        every, hits = [], 0
        lines = text.split(b"\n")
        for line in lines:
            w = words(line)
            every += w
            found = self.unit(w)
            hits += bool(found)
            for k, d in found:
                best[k] = max(d, best.get(k, 0.0))
        for k, d in self.windows(every).items() if windows else self.unit(every):
            best[k] = max(d, best.get(k, 0.0))
        return hits, best


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD, windows: bool = False) -> DataFrame:
    """(doc_id, n_lines, license, dice, licenses) for each row: matching lines, the best template, and all by name."""
    matcher = Matcher(templates, threshold)
    names = ["doc_id", "n_lines", "license", "dice", "licenses"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in text_slices(batch):
                out = []
                for t in texts_of(rows.column("text")):
                    n, best = matcher.text(t, windows)
                    top = min(best, key=lambda k: (-best[k], k), default=None)
                    out.append((n, top, best.get(top), ",".join(sorted(best))))
                kinds = (pa.int64(), pa.string(), pa.float64(), pa.string())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array([o[k] for o in out], t) for k, t in enumerate(kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(add, "doc_id long, n_lines long, license string, dice double, licenses string")


def _words_sql(column: str) -> str:
    return rf"regexp_extract_all(translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(k.replace("'", "''"), v.replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    pairs = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t AS (SELECT name, {pairs} AS g FROM (SELECT name, {_words_sql('body')} AS w FROM (VALUES {values}) v(name, body))),
tg AS (SELECT name, len(g) AS n, unnest(g) AS x FROM t),
u AS (SELECT doc_id, 0 AS line, {_words_sql("coalesce(text, '')")} AS w FROM documents
  UNION ALL SELECT doc_id, line, {_words_sql('body')} FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents)),
ug AS (SELECT doc_id, line, {pairs} AS g FROM u WHERE len(w) > 1),
ux AS (SELECT doc_id, line, len(g) AS n, unnest(g) AS x FROM ug),
m AS (SELECT doc_id, line, name, 2.0::DOUBLE * count(*) / (any_value(ux.n) + any_value(tg.n)) AS dice FROM ux JOIN tg USING (x)
  GROUP BY doc_id, line, name HAVING 2.0::DOUBLE * count(*) / (any_value(ux.n) + any_value(tg.n)) >= {THRESHOLD}),
b AS (SELECT doc_id, count(DISTINCT line) FILTER (line > 0) AS n_lines, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, max(dice) AS dice FROM m GROUP BY doc_id),
k AS (SELECT doc_id, min(name) AS license FROM m JOIN b USING (doc_id) WHERE m.dice = b.dice GROUP BY doc_id)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, license, dice, coalesce(licenses, '') AS licenses FROM documents LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)
"""


SQL = _sql()
