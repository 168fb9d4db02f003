"""Operator 8: licence statements and licence texts by Dice coefficient over word bigrams (DataFrame functions only).

A text is normalised (lower case, runs of anything but letters and digits to
one space).  Two kinds of passages are compared with the licence templates by
the Dice coefficient of their sets of word bigrams:

*  every line of the text;
*  every window of each template's number of words over the whole text, lines
   or not.  A text shorter than a template is one window.

For sets of a and b bigrams, 2 * min(a, b) / (a + b) bounds the coefficient, so
a template is only compared with lines within its size bounds, and with windows
only in texts that share as many of its bigrams as the threshold asks for.  Of
such a text the places of shared bigrams are listed, in order; a window reaches
the threshold only if it holds as many places as that, so the starts that the
places leave over are compared exactly and no other start can reach it.
Texts that lack the words without which no template can reach the threshold are
dropped before their bigrams are made.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Licence statements and texts by SPDX-like name.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "All rights reserved.",
    "Apache-2.0 header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License.""",
    "BSD-3-Clause text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
        in the documentation and/or other materials provided with the distribution.
        3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission.""",
    "BSD disclaimer": """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
        LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT
        HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY,
        WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE,
        EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "GPL-3.0 header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
        This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
        MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
        You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "ISC text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies.""",
    "MIT text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER
        DEALINGS IN THE SOFTWARE.""",
}
THRESHOLD = 0.8


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def pairs(words: Column) -> Column:
    """The pairs of neighbouring words, in order."""
    n = F.size(words)
    both = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat_ws(" ", F.get(words, i - 1), F.get(words, i)))
    return F.when(n >= 2, both).otherwise(F.array().cast("array<string>"))


def bigrams(words: Column) -> Column:
    """Set of the pairs of neighbouring words."""
    return F.array_distinct(pairs(words))


def _words(text: str) -> list[str]:
    return re.sub("[^a-z0-9]+", " ", text.lower()).split()


def _template(text: str) -> list[str]:
    words = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _ratio(threshold: float) -> float:
    """The smaller set's least share of the larger one at the threshold; rounding must not cut what just fits."""
    return threshold / (2 - threshold) - 1e-9


def _needed(grams: list[str], ratio: float) -> list[str]:
    """Words, the longest first, of which a text has at least one if it has ``ratio`` of the bigrams."""
    left, out = set(grams), []
    for w in sorted({w for g in grams for w in g.split()}, key=lambda w: (-len(w), w)):
        out.append(w)
        left = {g for g in left if w not in g.split()}
        if len(left) < ratio * len(grams):
            return out
    return out


def scan_lines(docs: DataFrame, *, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, line, license, dice): every line of every text that reaches the threshold with a template.

    Lines are numbered from 1 at each line feed.  Null and empty texts have no
    lines; rows with equal ids are scanned each; a line may match several
    templates.  Templates of fewer than two words never match.
    """
    sets = {name: grams for name, t in (TEMPLATES if templates is None else templates).items() if (grams := _template(t))}
    schema = "line bigint, license string, dice double"
    if not sets:
        return docs.select(F.col(id), F.explode(F.array().cast(f"array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>")).alias("x")).select(id, "x.*")
    ratio = _ratio(threshold)
    least, most = min(len(g) for g in sets.values()) * ratio, max(len(g) for g in sets.values()) / ratio
    lines = docs.select(F.col(id), F.posexplode(F.split(F.col(text), "\n")).alias("n", "raw"))
    # a line of w words has at most w - 1 pairs and at least 2 w - 1 characters
    lines = lines.where(F.length("raw") >= 2 * least + 1).select(id, (F.col("n") + 1).cast("long").alias("line"), F.array(F.split(normal(F.col("raw")), " ")).alias("w"))
    # the lambda's variable and the explode keep the words and the set from being computed again for every use
    lines = lines.select(id, "line", F.explode("w").alias("w")).where(F.arrays_overlap("w", _literal(sorted({w for g in sets.values() for w in _needed(g, ratio)}))))
    lines = lines.select(id, "line", F.explode(F.array(bigrams(F.col("w")))).alias("g")).where((F.size("g") >= least) & (F.size("g") <= most))

    def compared(name: str, grams: list[str]) -> Column:
        size = len(grams)
        fits = (F.size("g") >= size * ratio) & (F.size("g") <= size / ratio)
        common = F.size(F.array_intersect("g", _literal(grams)))
        return F.when(fits, F.struct(F.lit(name).alias("license"), (2.0 * common / (F.size("g") + size)).alias("dice")))

    found = F.filter(F.array(*(compared(n, g) for n, g in sets.items())), lambda x: x["dice"] >= threshold)
    return lines.select(id, "line", F.explode(found).alias("x")).select(id, "line", "x.license", "x.dice")


def _starts(at: Column, n: Column, least: Column, last: Column) -> Column:
    """Starts, each once and in order, of the windows of ``n`` words (``n - 1`` pairs) that hold ``least`` of the places ``at``.

    The windows from ``at[k]`` back that still reach ``at[k + least - 1]`` hold
    them; those that begin at or before ``at[k - 1]`` are told by the place before.
    """

    def of(k: Column) -> Column:
        low = F.greatest(F.get(at, k + least - 1) - n + 2, F.coalesce(F.get(at, k - 1) + 1, F.lit(0)), F.lit(0))
        return F.struct(low.alias("low"), F.least(F.get(at, k), last).alias("high"))

    spans = F.filter(F.transform(F.sequence(F.lit(0), F.size(at) - least), of), lambda x: x["low"] <= x["high"])
    return F.flatten(F.transform(spans, lambda x: F.sequence(x["low"], x["high"])))


def scan_windows(docs: DataFrame, *, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, word, license, dice): every window of every text that reaches the threshold with its template; ``word`` counts from 1."""
    own = {name: (len(_words(t)), grams) for name, t in (TEMPLATES if templates is None else templates).items() if (grams := _template(t))}
    ratio = _ratio(threshold)
    needed = _literal(sorted({w for _, g in own.values() for w in _needed(g, ratio)}))
    words = docs.select(F.col(id), F.explode(F.array(F.split(normal(F.col(text)), " "))).alias("w")).where(F.arrays_overlap("w", needed))
    # each explode of one value keeps it from being computed again for every use
    told = words.select(id, F.explode(F.array(pairs(F.col("w")))).alias("p"))

    def shared(name: str, n: int, grams: list[str]) -> Column:
        least = max(1, math.ceil(len(grams) * ratio))
        enough = F.size(F.array_intersect("p", _literal(grams))) >= least
        places = F.filter(F.sequence(F.lit(0), F.size("p") - 1), lambda i: F.get("p", i).isin(grams))
        return F.when(enough, F.struct(F.lit(name).alias("license"), F.lit(n).alias("n"), F.lit(least).alias("least"), places.alias("at"), _literal(grams).alias("grams")))

    none = F.expr("cast(array() as array<struct<license:string,n:int,least:int,at:array<int>,grams:array<string>>>)")
    asked = told.select(id, "p", F.explode(F.filter(F.array(*(shared(name, n, g) for name, (n, g) in own.items())), lambda x: x.isNotNull()) if own else none).alias("x"))
    starts = _starts(F.col("x.at"), F.col("x.n"), F.col("x.least"), F.greatest(F.lit(0), F.size("p") + 1 - F.col("x.n")))
    dice = lambda g: 2.0 * F.size(F.array_intersect(g, F.col("x.grams"))) / (F.size(g) + F.size("x.grams"))
    # a window's words never leave their row: only what reaches the threshold becomes rows
    of = lambda s: F.get(F.transform(F.array(F.array_distinct(F.slice("p", s + 1, F.col("x.n") - 1))), dice), F.lit(0))
    hits = F.filter(F.transform(starts, lambda s: F.struct((s + 1).cast("long").alias("word"), of(s).alias("dice"))), lambda h: h["dice"] >= threshold)
    return asked.select(id, F.col("x.license").alias("license"), F.explode(hits).alias("h")).select(id, "h.word", "license", "h.dice")


def scan(docs: DataFrame, *, id: str = "doc_id", text: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(id, license, n_lines, n_windows, first_line, first_word, dice): for each id and licence what reaches the threshold, and the best coefficient.

    Null and empty texts have none.  Rows with equal ids are one entry.  Extra
    columns are ignored.
    """
    docs = docs.select(F.col(id), F.col(text))
    none = F.lit(None).cast("long")
    lines = scan_lines(docs, id=id, text=text, templates=templates, threshold=threshold).select(id, "license", "line", none.alias("word"), "dice")
    windows = scan_windows(docs, id=id, text=text, templates=templates, threshold=threshold).select(id, "license", none.alias("line"), "word", "dice")
    return lines.unionByName(windows).groupBy(id, "license").agg(
        F.count("line").alias("n_lines"), F.count("word").alias("n_windows"), F.min("line").alias("first_line"), F.min("word").alias("first_word"), F.max("dice").alias("dice")
    )


def _literal(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def oracle(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same over ``documents`` in DuckDB's SQL: every line, and every window of texts with enough of its bigrams, against every template."""
    rows = ", ".join(f"('{name}', {len(_words(t))}, [{', '.join(repr(g) for g in _template(t))}])" for name, t in (TEMPLATES if templates is None else templates).items() if _template(t))
    clean = "trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g'))"
    pairs = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""
        WITH t(license, n, b) AS (VALUES {rows}),
        l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents),
        w AS (SELECT doc_id, line, string_split({clean.format('raw')}, ' ') AS w FROM l),
        d AS (SELECT doc_id, string_split({clean.format('text')}, ' ') AS w FROM documents),
        o AS (SELECT d.*, {pairs.format('w')} AS o FROM d WHERE len(w) >= 2),
        s AS (SELECT doc_id, license, b, n, w, unnest(range(0, greatest(0, len(w) - n) + 1)) AS s FROM o, t WHERE len(list_intersect(o, b)) * (2 - {threshold}) >= len(b) * {threshold} - 0.000001),
        v AS (SELECT doc_id, license, b, s + 1 AS word, w[s + 1:s + n] AS w FROM s),
        g AS (SELECT doc_id, license, line, NULL AS word, b, {pairs.format('w')} AS g FROM w, t WHERE len(w) >= 2
            UNION ALL SELECT doc_id, license, NULL, word, b, {pairs.format('w')} FROM v WHERE len(w) >= 2),
        x AS (SELECT doc_id, license, line, word, CAST(2.0 * len(list_intersect(g, b)) / (len(g) + len(b)) AS DOUBLE) AS dice FROM g)
        SELECT doc_id, license, count(line) AS n_lines, count(word) AS n_windows, CAST(min(line) AS BIGINT) AS first_line, CAST(min(word) AS BIGINT) AS first_word, max(dice) AS dice
        FROM x WHERE dice >= {threshold} GROUP BY 1, 2"""
