"""Licence scans: Dice coefficient over word bigrams against templates.

A text is compared with a template as a whole, by its paragraphs and lines, and by
every window of as many words as the template has, so that a licence is found
inside a longer text, a code comment or a sentence.
"""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

THRESHOLD = 0.8

# Notices and short texts of public licences.
TEMPLATES = {
    "AGPL-3.0-notice": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
    ],
    "Apache-2.0-header": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
        "except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
        "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
        "specific language governing permissions and limitations under the License.",
    ],
    "Apache-2.0-notice": ["Licensed under the Apache License, Version 2.0."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE "
        "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted "
        "provided that the following conditions are met: 1. Redistributions of source code must retain the "
        "above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in "
        "binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither "
        "the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission. THIS SOFTWARE "
        "IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR "
        "A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
        "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT "
        "NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
        "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "BSD-3-Clause-notice": ["Released under the BSD 3-Clause License."],
    "BSL-1.0-notice": [
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or "
        "copy at https://www.boost.org/LICENSE_1_0.txt)",
    ],
    "CC-BY-4.0-notice": ["Licensed under CC BY 4.0."],
    "CC-BY-NC-4.0-notice": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0-notice": ["Licensed under CC BY-SA 4.0."],
    "GPL-3.0-header": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the "
        "GNU General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This program is distributed in the hope that it "
        "will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY "
        "or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You "
        "should have received a copy of the GNU General Public License along with this program. If not, "
        "see <https://www.gnu.org/licenses/>.",
    ],
    "GPL-3.0-notice": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
        "fee is hereby granted, provided that the above copyright notice and this permission notice appear "
        "in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO "
        "EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR "
        "ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
        "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-3.0-header": [
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version. This library is distributed in the hope that it will "
        "be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS "
        "FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should "
        "have received a copy of the GNU Lesser General Public License along with this library. If not, see "
        "<https://www.gnu.org/licenses/>.",
    ],
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, "
        "sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is "
        "furnished to do so, subject to the following conditions: The above copyright notice and this "
        "permission notice shall be included in all copies or substantial portions of the Software. THE "
        "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
        "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, "
        "DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MIT-notice": ["Released under the MIT License."],
    "MPL-2.0-header": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, "
        "modify, publish, use, compile, sell, or distribute this software, either in source code form or as a "
        "compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions "
        "that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
        "interest in the software to the public domain. We make this dedication for the benefit of the public "
        "at large and to the detriment of our heirs and successors. We intend this dedication to be an overt "
        "act of relinquishment in perpetuity of all present and future rights to this software under copyright "
        "law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND "
        "NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to "
        "<https://unlicense.org/>",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the "
        "authors be held liable for any damages arising from the use of this software. Permission is granted "
        "to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions: 1. The origin of this software "
        "must not be misrepresented; you must not claim that you wrote the original software. If you use this "
        "software in a product, an acknowledgment in the product documentation would be appreciated but is "
        "not required. 2. Altered source versions must be plainly marked as such, and must not be "
        "misrepresented as being the original software. 3. This notice may not be removed or altered from any "
        "source distribution.",
    ],
    "all-rights-reserved": ["All rights reserved."],
}


def words(raw: bytes) -> list:
    """Normalised text: ASCII letters in lower case and digits; all else separates words."""
    return re.sub(rb"[^a-z0-9]+", b" ", raw.lower()).split()


def bigrams(found: list) -> set:
    return set(zip(found, found[1:]))


def units(text: str) -> list:
    """The whole text, its paragraphs and its lines."""
    return [text, *re.split(r"\n[ \t\r]*\n", text), *text.split("\n")]


def _sliding(first: np.ndarray, at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Per start of a window of `width` of `n` places: distinct values among the places `at`.

    first[i] is the place after the last earlier one with the value of place i, so i
    counts for the starts from there on, of the windows that hold it.
    """
    steps = np.zeros(n - width + 2, np.int64)
    begin, end = np.maximum(first[at], at - width + 1), np.minimum(at, n - width)
    held = begin <= end
    np.add.at(steps, begin[held], 1)
    np.add.at(steps, end[held] + 1, -1)
    return np.cumsum(steps[:-1])


class Scanner:
    """Dice coefficients with templates whose size can reach the threshold."""

    def __init__(self, templates: dict, threshold: float):
        self.threshold = threshold
        known = [
            (name, words(text.encode())) for name, texts in sorted(templates.items()) for text in texts
        ]
        self.templates = [(name, bigrams(found)) for name, found in known if len(found) > 1]
        self.lengths = [len(found) for _, found in known if len(found) > 1]
        self.holders = {}
        for i, (_, grams) in enumerate(self.templates):
            for gram in grams:
                self.holders.setdefault(gram, []).append(i)
        # With a and b bigrams the coefficient is at most 2 min(a, b) / (a + b).
        self.by_size = {}
        self.most = int(max([0, *(len(g) for _, g in self.templates)]) * (2 - threshold) / threshold) + 1

    def candidates(self, size: int) -> list:
        if size not in self.by_size:
            self.by_size[size] = [
                (name, grams) for name, grams in self.templates
                if 2 * min(size, len(grams)) >= self.threshold * (size + len(grams))
            ]
        return self.by_size[size]

    def likely(self, grams: set) -> list:
        """Templates that some part of a text with these bigrams can match.

        A part has at least the bigrams it shares, so c shared ones allow 2 c / (c + b) at most.
        """
        shared = Counter(i for gram in self.holders.keys() & grams for i in self.holders[gram])
        return [i for i, c in shared.items() if 2 * c >= self.threshold * (c + len(self.templates[i][1])) - 1e-9]

    def windows(self, found: list, places: dict, first: np.ndarray, i: int) -> float:
        """Best coefficient of template i with as many consecutive words, if the text has more."""
        own, width, n = self.templates[i][1], self.lengths[i] - 1, len(found) - 1
        if n <= width:
            return 0.0
        kinds = _sliding(first, np.arange(n), width, n)
        inside = np.sort(np.array([p for gram in own if gram in places for p in places[gram]], np.int64))
        return float((2.0 * _sliding(first, inside, width, n) / (kinds + len(own))).max())

    def scan(self, text: str) -> dict:
        """Licence -> best coefficient over all units and windows, where it reaches the threshold."""
        best = {}
        whole = words(text.encode())
        likely = self.likely(bigrams(whole))
        if not likely:
            return best
        names = {self.templates[i][0] for i in likely}
        for unit in units(text):
            found = words(unit.encode())
            if len(found) < 2:
                continue
            grams = bigrams(found)
            for name, own in self.candidates(len(grams)) if len(grams) <= self.most else ():
                if name not in names:
                    continue
                dice = 2.0 * len(grams & own) / (len(grams) + len(own))
                if dice >= self.threshold and dice > best.get(name, 0.0):
                    best[name] = dice
        places = {}
        first = np.zeros(len(whole) - 1, np.int64)
        for place, gram in enumerate(zip(whole, whole[1:])):
            seen = places.setdefault(gram, [])
            if seen:
                first[place] = seen[-1] + 1
            seen.append(place)
        for i in likely:
            dice = self.windows(whole, places, first, i)
            if dice >= self.threshold and dice > best.get(self.templates[i][0], 0.0):
                best[self.templates[i][0]] = dice
        return best


def scan_licenses(docs: DataFrame, text="text", templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with `license`, `dice`, `n_licenses` and `licenses` (replaced if present).

    The whole text, each paragraph and each line are normalised and compared with
    every template whose bigram count can reach `threshold`, and so is each window of
    as many consecutive words as the template has.  Templates that share too few
    bigrams with the whole text are left out first.  `license` is the best
    match (ties: first name), `licenses` all names that reach the threshold, in order,
    joined by commas.  A text that is null, empty or matches nothing has null, 0.0,
    0 and ''.  Other columns pass through.  No shuffle; templates are a bounded
    parameter (by default TEMPLATES).
    """
    new = ("license", "dice", "n_licenses", "licenses")
    kept = [c for c in docs.columns if c not in new]
    known = TEMPLATES if templates is None else templates
    base = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = T.StructType([
        *base.schema.fields, T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()),
        T.StructField("n_licenses", T.LongType()), T.StructField("licenses", T.StringType()),
    ])

    def run(batches):
        scanner = Scanner(known, threshold)
        for batch in batches:
            found = [scanner.scan(t.as_py() or "") for t in batch.column(text)]
            top = [min(f, key=lambda n: (-f[n], n)) if f else None for f in found]
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c) for c in kept], pa.array(top, pa.string()),
                pa.array([f[t] if f else 0.0 for f, t in zip(found, top)], pa.float64()),
                pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(sorted(f)) for f in found], pa.string()),
            ], names=[*kept, *new])

    return base.mapInArrow(run, schema)


def oracle_sql() -> str:
    """DuckDB SQL for doc_id and the four columns over `documents`."""
    quoted = ", ".join(
        "('{}', '{}')".format(name, text.replace("'", "''"))
        for name, texts in sorted(TEMPLATES.items()) for text in texts
    )
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = (
        "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    )
    split = (
        "list_filter(string_split(regexp_replace(" + lower + ", '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')"
    )
    return f"""
WITH templates(name, body) AS (VALUES {quoted}),
known AS (
  SELECT name, body, len(w) AS n, {grams.format('w')} AS g FROM (SELECT name, body, {split.format('body')} AS w FROM templates)
),
units AS (
  SELECT DISTINCT doc_id, unnest(list_concat([text], list_concat(
    regexp_split_to_array(text, '\\n[ \\t\\r]*\\n'), string_split(text, chr(10))))) AS u
  FROM documents
),
pieces AS (SELECT doc_id, {grams.format('w')} AS g FROM (SELECT doc_id, {split.format('u')} AS w FROM units) WHERE len(w) > 1),
texts AS (
  SELECT row_number() OVER () AS t, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS s
  FROM (SELECT doc_id, {split.format('text')} AS w FROM documents WHERE text IS NOT NULL)
),
likely AS (
  SELECT t, body FROM (SELECT t, unnest(list_distinct(s)) AS gram FROM texts)
  JOIN (SELECT body, len(g) AS b, unnest(g) AS gram FROM known) USING (gram)
  GROUP BY t, body, b HAVING 2 * count(*) >= {THRESHOLD} * (count(*) + b) - 1e-9
),
windows AS (
  SELECT doc_id, name, g, list_distinct(s[i:i + n - 2]) AS own
  FROM (
    SELECT doc_id, name, s, n, g, unnest(range(1, len(s) - n + 3)) AS i
    FROM texts JOIN likely USING (t) JOIN known USING (body) WHERE len(s) >= n
  )
),
scored AS (
  SELECT doc_id, name, max(dice) AS dice FROM (
    SELECT doc_id, name, 2.0 * len(list_intersect(p.g, k.g)) / (len(p.g) + len(k.g)) AS dice
    FROM pieces p JOIN known k
      ON 2 * least(len(p.g), len(k.g)) >= {THRESHOLD} * (len(p.g) + len(k.g))
    UNION ALL
    SELECT doc_id, name, 2.0 * len(list_intersect(own, g)) / (len(own) + len(g)) AS dice FROM windows
  ) GROUP BY doc_id, name
),
best AS (
  SELECT doc_id, arg_min(name, (-dice, name)) AS license, CAST(max(dice) AS DOUBLE) AS dice,
         count(*) AS n_licenses, string_agg(name, ',' ORDER BY name) AS licenses
  FROM scored WHERE dice >= {THRESHOLD} GROUP BY doc_id
)
SELECT d.doc_id, license, coalesce(dice, 0.0) AS dice, coalesce(n_licenses, 0) AS n_licenses,
       coalesce(licenses, '') AS licenses
FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id
"""
