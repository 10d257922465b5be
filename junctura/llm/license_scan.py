"""Licence scan: normalised text units compared to licence templates by the Dice coefficient over word bigrams.

Units of a text are its lines, its blocks between blank lines, and the whole text. A unit is normalised to its words
(runs of 0-9 and a-z after lowering A-Z); its bigrams are those of neighbouring words. Since the Dice coefficient of
sets of m and n bigrams is at most 2 * min / (m + n), only templates with m within [n * t / (2 - t), n * (2 - t) / t]
are candidates at threshold t. A unit that cannot have a candidate is dropped on its word counts, before it has any
bigrams. Shared bigrams are then counted through an index from bigrams to templates.

Cases: an empty table gives an empty one; a very long text is read whole, and no more than a few MB of others share its
batch. a null, empty or wordless text has no hits: license null, dice 0, n_hits 0. Units of one word have no bigram
and match nothing. Ties of the coefficient go to the smaller name. Repeated rows give equal rows. Input columns named
license, dice or n_hits are replaced, others are carried along.
"""

from __future__ import annotations

import re
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches

NAME = "op4_license_scan"
THRESHOLD = 0.75
BLANK_LINE = r"\n[ \t\r\x0b\x0c]*\n"
BLANKS = re.compile(r"[ \t\r\x0b\x0c]*")

#: Names and texts of short public licences, and notices that works under longer ones carry.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "All-Rights-Reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "MIT-whole": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Unlicense-text": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "Zlib": 'This software is provided "as-is", without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.',
}
#: The longer licences, whole: a file each.
TEMPLATES |= {f"{f.stem}-text": f.read_text("utf-8") for f in sorted((Path(__file__).parent / "licenses").glob("*.txt"))}


def normalised(text: str) -> list[str]:
    return re.findall(r"[0-9a-z]+", re.sub(r"[A-Z]+", lambda m: m[0].lower(), text))


def bigrams(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:], strict=False))


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: float):
        self.threshold = threshold
        made = {name: bigrams(normalised(text)) for name, text in sorted(templates.items())}
        self.sizes = {name: len(grams) for name, grams in made.items() if grams}
        low, high = threshold / (2 - threshold), (2 - threshold) / threshold
        self.bounds = {name: (n * low, n * high) for name, n in self.sizes.items()}
        self.index: dict[tuple[str, str], list[str]] = {}
        for name, grams in made.items():
            for g in grams:
                self.index.setdefault(g, []).append(name)
        self.low = min((a for a, _ in self.bounds.values()), default=float("inf"))
        self.high = max((b for _, b in self.bounds.values()), default=0.0)
        self.possible = [any(a <= n <= b for a, b in self.bounds.values()) for n in range(int(self.high) + 1)]

    def hits(self, words: list[str]) -> list[tuple[float, str]]:
        """(coefficient, template) of the templates that a unit of these words reaches."""
        # n words have n - 1 bigrams at most, and one less than there are different words at least
        if len(words) - 1 < self.low or len(words) > self.high + 1 and len(set(words)) - 1 > self.high:
            return []
        grams = bigrams(words)
        n = len(grams)
        if n >= len(self.possible) or not self.possible[n]:
            return []
        shared = Counter(x for g in grams for x in self.index.get(g, ()))
        reached = [(2 * k / (n + self.sizes[name]), name) for name, k in shared.items() if self.bounds[name][0] <= n <= self.bounds[name][1]]
        return [x for x in reached if x[0] >= self.threshold]

    def scan(self, text: str | None) -> tuple[str | None, float, int]:
        """The best template, its coefficient, and the number of (unit, template) pairs at the threshold.

        A text is normalised once, line by line; blocks and the whole text are runs of its lines."""
        blocks: list[list[list[str]]] = [[]]
        for line in (text or "").split("\n"):
            if words := normalised(line):
                blocks[-1].append(words)
            elif BLANKS.fullmatch(line) and blocks[-1]:
                blocks.append([])
        if not blocks[-1]:
            blocks.pop()
        found: list[tuple[float, str]] = []
        for block in blocks:
            own = [self.hits(words) for words in block]
            # a unit of one smaller one has the hits of that
            joined = own[0] if len(block) == 1 else self.hits([w for words in block for w in words])
            found += [x for hit in own for x in hit] + joined
        if blocks:
            found += joined if len(blocks) == 1 else self.hits([w for block in blocks for words in block for w in words])
        if not found:
            return None, 0.0, 0
        best = min(found, key=lambda x: (-x[0], x[1]))
        return best[1], best[0], len(found)


def scan(df: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep (all, if not given), license (the best template's name), dice and n_hits."""
    templates = TEMPLATES if templates is None else templates
    columns = [c for c in (keep if keep is not None else df.columns) if c not in ("license", "dice", "n_hits")]
    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("license", T.StringType()), T.StructField("dice", T.DoubleType()), T.StructField("n_hits", T.LongType())])

    def run(batches):
        import pyarrow as pa

        scanner = Scanner(templates, threshold)
        for batch in batches:
            out = [scanner.scan(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            made = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, k) for c, k in zip(made, (pa.string(), pa.float64(), pa.int64()), strict=True)]], [*columns, "license", "dice", "n_hits"])

    return df.select(*columns, F.col(text).alias("__text")).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return scan(documents(spark, sf_dir), keep=["doc_id"])


def _oracle() -> str:
    values = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z]+')"
    grams = "list_distinct(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
    WITH t AS (SELECT name, {grams} AS g FROM (SELECT name, {words("txt")} AS w FROM (VALUES {values}) v(name, txt)) x),
    d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
    u AS (
      SELECT doc_id, unnest(string_split(body, chr(10))) AS unit FROM d
      UNION ALL SELECT doc_id, unnest(regexp_split_to_array(body, '{BLANK_LINE}')) FROM d
      UNION ALL SELECT doc_id, body FROM d),
    g AS (SELECT doc_id, row_number() OVER () AS unit_id, {grams} AS g FROM (SELECT doc_id, {words("unit")} AS w FROM u) x),
    gx AS (SELECT doc_id, unit_id, len(g) AS n, unnest(g) AS gram FROM g),
    tx AS (SELECT name, len(g) AS m, unnest(g) AS gram FROM t),
    s AS (SELECT doc_id, unit_id, name, 2 * count(*) / (n + m)::double AS dice FROM gx JOIN tx USING (gram) GROUP BY doc_id, unit_id, name, n, m),
    h AS (SELECT doc_id, name, dice FROM s WHERE dice >= {THRESHOLD}),
    b AS (SELECT doc_id, name, dice, count(*) OVER (PARTITION BY doc_id) AS n_hits, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name) AS r FROM h)
    SELECT d.doc_id, b.name AS license, coalesce(b.dice, 0.0)::double AS dice, coalesce(b.n_hits, 0)::bigint AS n_hits
    FROM d LEFT JOIN b ON d.doc_id = b.doc_id AND b.r = 1
    """


ORACLE_SQL = _oracle()
