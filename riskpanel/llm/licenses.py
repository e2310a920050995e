"""License scans: normalised text against license templates by Dice coefficient over word bigrams.

Texts and templates are lower-cased and cut into words of ASCII letters, digits and characters beyond ASCII. What
is compared is the whole text, each of its blocks (between blank lines) and each of its lines. With A and B the sets of
word bigrams, Dice is 2|A n B| / (|A| + |B|); to reach ``least``, |A| must lie within |B| least / (2 - least) and
|B| (2 - least) / least, so all other templates are passed over without a comparison, and a part of a text that no
template's bounds admit is never cut into bigrams. A part of one word has no bigram and matches nothing.

Notices among other words, in a line or over several, are found by windows: for every template, and for the licenses of
full length in ``FULL``, each run of words that begins with one of the template's bigrams and has at most
(2 - least) / least times its number of word pairs. A match shares at least |B| least / (2 - least) bigrams, so a run
is compared only if so many of the template's bigrams follow within its reach, and a text with none of the ``keys``,
words that every match must hold one of, has no windows. ``n_parts`` counts the whole text, blocks and lines only.

Nulls: a null text has no part. Of equal scores the first license name counts. Repeated rows get a row each; an empty
table gives no rows; other columns are ignored.

Everything is column expressions inside a row: no shuffle, whatever the sizes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskpanel.llm.text import pinned

LEAST = 0.8
COMMON = {"a", "and", "by", "for", "in", "is", "of", "or", "the", "to"}  # poor keys: any other word of a template is tried first
WORD = r"[a-z0-9\u0080-\U0010FFFF]+"

# License name and the text of a notice or license.
TEMPLATES = [
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
]

# Licenses of full length, looked for by windows only.
FULL = [
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
]


def bigrams(text: str) -> set[str]:
    words = re.findall(WORD, text.lower())
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def bounds(size: int, least: float) -> tuple[float, float]:
    """Numbers of bigrams that can reach the least coefficient with a template of ``size`` bigrams."""
    return size * least / (2 - least), size * (2 - least) / least


def plain(text: Column) -> Column:
    """The text in lower case with single blanks between words; line ends stay."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9\n\x{80}-\x{10FFFF}]+", " ")


def least_shared(size: int, least: float) -> int:
    """Bigrams that a match shares with a template of ``size`` bigrams at least."""
    return math.ceil(bounds(size, least)[0] - 1e-9)


def keys(templates: list[set[str]], least: float) -> list[str]:
    """Words of which every match with any of the templates holds one, long ones first: too few bigrams are without all of them."""
    left = [set(b) for b in templates]
    chosen: list[str] = []
    while open_ := [b for b, t in zip(left, templates, strict=True) if len(b) >= least_shared(len(t), least)]:
        words = {w for b in open_ for g in b for w in g.split(" ")}
        gain = {w: 0 if w in COMMON else sum(w in g.split(" ") for b in open_ for g in b) * min(len(w), 8) ** 4 for w in words}
        chosen.append(max(sorted(words), key=gain.__getitem__))
        left = [{g for g in b if chosen[-1] not in g.split(" ")} for b in left]
    return chosen


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with the value computed once."""
    return F.transform(F.array(value), fn)[0]


def windows(norm: Column, templates, least: float) -> Column:
    """Name and best coefficient of each template that some run of words in the text matches."""
    known = [(name, bigrams(t), len(re.findall(WORD, t.lower())) - 1) for name, t in templates]
    known = [k for k in known if k[1]]
    none = F.array().cast("array<struct<name:string,dice:double>>")
    if not known:
        return none
    every = sorted(set().union(*[b for _, b, _ in known]))

    def best(grams: Column, hits: Column, b: set[str], reach: int) -> Column:
        need, size, listed = least_shared(len(b), least), len(b), F.lit(",".join(sorted(b)))  # one literal keeps the plan small

        def dice(start: Column) -> Column:
            """The best of all runs from there: distinct bigrams so far, shared ones, best coefficient."""
            step = lambda run: F.transform(run, lambda g, i: F.struct((F.array_position(run, g) == i + 1).alias("new"), (F.find_in_set(g, listed) > 0).alias("shared")))
            zero = F.struct(F.lit(0).alias("a"), F.lit(0).alias("m"), F.lit(0.0).alias("dice"))

            def add(s: Column, x: Column) -> Column:
                a, m = s["a"] + x["new"].cast("int"), s["m"] + (x["new"] & x["shared"]).cast("int")
                return F.struct(a.alias("a"), m.alias("m"), F.greatest(s["dice"], m * 2.0 / (a + size)).alias("dice"))

            return F.aggregate(let(F.slice(grams, start + 1, F.lit(reach)), step), zero, add, lambda s: s["dice"])

        def run(own: Column) -> Column:
            starts = F.filter(own, lambda h, j: F.coalesce(F.get(own, j + (need - 1))["at"] - h["at"] < reach, F.lit(False)))
            return F.array_max(F.transform(starts, lambda h: dice(h["at"])))

        return let(F.filter(hits, lambda h: F.find_in_set(h["gram"], listed) > 0), run)

    def all_best(grams: Column, hits: Column) -> Column:
        found = [F.struct(F.lit(name).alias("name"), best(grams, hits, b, int(pairs * (2 - least) / least + 1e-9)).alias("dice")) for name, b, pairs in known]
        return F.filter(F.array(*found), lambda h: h["dice"] >= least)

    def look(w: Column) -> Column:
        pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
        placed = lambda g: F.filter(F.transform(g, lambda x, i: F.struct(i.alias("at"), x.alias("gram"))), lambda h: h["gram"].isin(*every))
        return let(pairs, lambda g: let(placed(g), lambda h: all_best(g, h)))

    def holds(text: Column) -> Column:
        held = F.lit(False)
        for word in keys([b for _, b, _ in known], least):
            held = held | F.contains(text, F.lit(f" {word} "))
        return held

    return F.when(let(F.concat(F.lit(" "), F.translate(norm, "\n", " "), F.lit(" ")), holds), let(F.filter(F.split(norm, "[ \\n]+"), lambda w: w != ""), look)).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, least: float = LEAST, full=FULL) -> DataFrame:
    """doc_id, n_parts compared and ``found``: the best coefficient of every license in the text, by name."""
    known = [(name, sorted(bigrams(t))) for name, t in templates]
    known = [(name, b) for name, b in known if b]
    low = min((bounds(len(b), least)[0] for _, b in known), default=0.0)
    high = max((bounds(len(b), least)[1] for _, b in known), default=-1.0)
    rows = pinned(docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), norm=plain(F.col("text")))
    rows = pinned(rows.select("doc_id", "norm"), inside=windows(F.col("norm"), [*templates, *full], least))
    every = F.array_distinct(F.concat(F.split("norm", r"\n *\n"), F.split("norm", r"\n"), F.array("norm")))
    words = F.transform(every, lambda p: F.filter(F.split(p, "[ \n]+"), lambda w: w != ""))
    # distinct bigrams are at most one less than words, so a short part is settled by its length
    rows = pinned(rows.select("doc_id", "norm", "inside"), words=F.array_distinct(F.filter(words, lambda w: F.size(w) > low)))
    pairs = F.transform("words", lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))))
    rows = pinned(rows.select("doc_id", "inside", "words"), grams=F.array_distinct(F.transform(F.filter(pairs, lambda g: F.size(g).between(low, high)), lambda g: F.array_sort(g))))

    def best(g: Column) -> Column:
        hits = []
        for name, b in known:
            x, y = bounds(len(b), least)
            dice = F.size(F.array_intersect(g, F.array(*[F.lit(w) for w in b]))) * 2.0 / (F.size(g) + len(b))
            hits.append(F.when(F.size(g).between(x, y), F.struct(F.lit(name).alias("name"), dice.alias("dice"))))
        return F.filter(F.array(*hits), lambda h: h["dice"] >= least)

    found = F.flatten(F.transform("grams", best)) if known else F.array().cast("array<struct<name:string,dice:double>>")
    rows = pinned(rows.select("doc_id", F.size("grams").cast("long").alias("n_parts"), "inside", "grams"), hits=found)
    return rows.select("doc_id", "n_parts", F.array_sort(F.array_distinct(F.concat("hits", "inside"))).alias("found"))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row a document: parts within the size bounds, licenses found, the best one and its coefficient."""
    top = F.aggregate("found", F.struct(F.lit(None).cast("string").alias("name"), F.lit(-1.0).alias("dice")), lambda a, h: F.when(h["dice"] > a["dice"], h).otherwise(a))
    rows = pinned(scan(docs, id_col, text_col, **options), top=top)
    return rows.select("doc_id", "n_parts", F.array_join(F.array_distinct(F.col("found.name")), ",").alias("licenses"), F.col("top.name").alias("license"),
                       F.when(F.col("top.name").isNotNull(), F.col("top.dice")).alias("dice"))


def _sql() -> str:
    rows = ", ".join(f"({i}, '{n}', [{', '.join(chr(39) + b + chr(39) for b in sorted(bigrams(t)))}])" for i, (n, t) in enumerate(TEMPLATES))
    return rf"""
WITH templates(template, name, grams) AS (VALUES {rows}),
docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\n\x{{80}}-\x{{10FFFF}}]+', ' ', 'g') AS norm FROM documents),
parts AS (
  SELECT r, doc_id, unnest(list_distinct(string_split_regex(norm, '\n *\n') || string_split(norm, chr(10)) || [norm])) AS part FROM docs),
words AS (SELECT DISTINCT r, doc_id, list_filter(string_split_regex(part, '[ \n]+'), lambda w: w <> '') AS w FROM parts),
grams AS (SELECT DISTINCT r, doc_id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS g FROM words WHERE len(w) > 1),
bounded AS (SELECT * FROM grams WHERE len(g) >= (SELECT min(len(grams)) FROM templates) * {LEAST} / (2 - {LEAST}) AND len(g) <= (SELECT max(len(grams)) FROM templates) * (2 - {LEAST}) / {LEAST}),
hits AS (
  SELECT r, name, len(list_intersect(g, t.grams)) * 2.0 / (len(g) + len(t.grams)) AS dice FROM bounded, templates t
  WHERE len(list_intersect(g, t.grams)) * 2.0 / (len(g) + len(t.grams)) >= {LEAST}),
counted AS (SELECT r, count(DISTINCT g) AS n_parts FROM bounded GROUP BY r),
named AS (
  SELECT r, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, (list({{'d': -dice, 'n': name}} ORDER BY -dice, name))[1].n AS license, max(dice) AS dice FROM hits GROUP BY r)
SELECT doc_id, coalesce(n_parts, 0) AS n_parts, coalesce(licenses, '') AS licenses, license, dice::DOUBLE AS dice
FROM docs LEFT JOIN counted USING (r) LEFT JOIN named USING (r)
"""


SQL = _sql()
