"""Licence scans: normalised text compared to licence templates by the Dice coefficient over word bigrams.

A text's units are its lines, its paragraphs (parted by blank lines, where there are any) and the
whole. A unit is lower-cased, everything but letters and digits becomes a space, and its n words
give n - 1 bigrams, counted with repeats: Dice = 2 * shared / (own + template's). Since that is at
most 2 * min / (own + template's), a unit's length alone rules most templates out; the bigrams are
built only for units that some template's size admits. Map-only: no shuffle, no Python.

The templates are a fixed list; their paragraphs count as templates too. A null or empty text has
no match; an empty table gives no rows. Ties of the best score go to the smaller licence id. Repeated rows come out row by row. Very long texts
are scanned whole, unit by unit. Other columns go along untouched, whatever they are called, but for ``license_hits``, which it makes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm.common import all_columns, table

THRESHOLD = 0.8

_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_CLAUSE = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""

#: Licence id and text, fixed values: public licence texts and customary one-line notices.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("BSD-2-Clause", _BSD),
    ("BSD-3-Clause", _BSD + "\n\n" + _BSD_CLAUSE),
    ("ISC", _ISC),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", _GPL.format("General Public License")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", _GPL.format("Lesser General Public License")),
    ("AGPL-3.0", _GPL.format("Affero General Public License")),
    ("MPL-2.0", _MPL),
    ("Unlicense", _UNLICENSE),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

NOT_WORD = r"[^\p{L}\p{N}\n]+"


def template_rows(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[str, list[str]]]:
    """Licence id and numbered bigrams of each template and each of its paragraphs, without repeats."""
    rows: dict[tuple[str, tuple[str, ...]], None] = {}
    for name, text in templates:
        for part in dict.fromkeys([text, *re.split(r"\n\s*\n", text)]):
            words = re.findall(r"[^\W_]+", part.lower())
            seen: dict[str, int] = {}
            numbered = []
            for a, b in zip(words, words[1:], strict=False):
                seen[f"{a} {b}"] = seen.get(f"{a} {b}", 0) + 1
                numbered.append(f"{a} {b} {seen[f'{a} {b}']}")
            if numbered:
                rows[(name, tuple(sorted(numbered)))] = None
    return [(name, list(grams)) for name, grams in rows]


def numbered_bigrams(words: Column) -> Column:
    """Bigrams of a word array, each followed by how often it has occurred so far in sorted order."""
    from strata.llm.quality import let

    pairs = let(words, lambda w: F.transform(F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda b, i: F.concat_ws(" ", F.get(w, i), b)))
    return let(F.sort_array(pairs), lambda s: F.transform(s, lambda g, i: F.concat_ws(" ", g, (i + 2 - F.array_position(s, g)).cast("string"))))


def scan_licenses(df: DataFrame, text: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Add ``license_hits`` to ``df``: an array of (license, dice, n_words), one for each unit and template at ``threshold`` or above."""
    from strata.llm.quality import let

    rows = template_rows(templates)
    known = F.array(*(F.struct(F.lit(name).alias("license"), F.lit(len(g)).alias("n"), F.array(*map(F.lit, g)).alias("grams")) for name, g in rows))
    low, high = min(len(g) for _, g in rows), max(len(g) for _, g in rows)
    ratio = threshold / (2 - threshold)
    body = F.regexp_replace(F.lower(F.coalesce(df[text], F.lit(""))), F.lit(NOT_WORD), F.lit(" "))
    kept = [(name, c) for name, c in zip(df.columns, all_columns(df), strict=True) if name != "license_hits"]
    x = df.select(F.struct(*(c for _, c in kept)).alias("__row"), body.alias("__body"))  # one column, so that no name can clash
    words = lambda unit: F.filter(F.split(unit, "[ \n]+"), lambda w: w != "")
    body = F.col("__body")
    paragraphs = F.when(body.rlike(r"\n *\n"), F.split(body, r"\n *(?:\n *)+")).otherwise(F.array().cast("array<string>"))
    units = F.concat(F.split(body, "\n"), paragraphs, F.when(body.contains("\n"), F.array(body)).otherwise(F.array().cast("array<string>")))
    # the number of spaces bounds the number of words before any is cut out
    admitted = F.filter(F.transform(units, words), lambda w: (F.size(w) - 1 >= low * ratio) & (F.size(w) - 1 <= high / ratio))
    x = x.select("__row", admitted.alias("__units"))

    def hits(w: Column) -> Column:
        n = F.size(w) - 1
        fits = F.filter(known, lambda t: F.least(n, t.n) * 2 >= threshold * (n + t.n))
        scored = lambda f: let(
            numbered_bigrams(w),
            lambda g: F.transform(
                f, lambda t: F.struct(t.license.alias("license"), (F.lit(2.0) * F.size(F.array_intersect(g, t.grams)) / (n + t.n)).alias("dice"), F.size(w).alias("n_words"))
            ),
        )
        return let(fits, lambda f: F.when(F.size(f) > 0, F.filter(scored(f), lambda s: s.dice >= threshold)))

    empty = F.array().cast("array<struct<license:string,dice:double,n_words:int>>")
    found = F.flatten(F.transform("__units", lambda w: F.coalesce(hits(w), empty)))
    return x.select(*(F.col("__row").getField(name).alias(name) for name, _ in kept), found.alias("license_hits"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: units that match a template, the licences in id order, the best one and its score."""
    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    best = F.element_at(F.array_sort(F.transform("license_hits", lambda s: F.struct((-s.dice).alias("d"), s.license.alias("license")))), 1)
    return found.select(
        "doc_id",
        F.size("license_hits").cast("long").alias("n_matches"),
        F.array_join(F.sort_array(F.array_distinct(F.transform("license_hits", lambda s: s.license))), ",").alias("licenses"),
        F.when(F.size("license_hits") > 0, best["license"]).alias("best_license"),
        F.when(F.size("license_hits") > 0, -best["d"]).alias("best_dice"),
    )


def _op7_sql() -> str:
    values = ", ".join("({}, {}, '{}', {})".format(i, len(g), name, "[" + ", ".join(f"'{x}'" for x in g) + "]") for i, (name, g) in enumerate(template_rows()))
    return rf"""
WITH t(tid, n, license, grams) AS (VALUES {values}),
d AS (SELECT doc_id, row_number() OVER () AS k, regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}\n]+', ' ', 'g') AS body FROM documents),
u AS (SELECT k, unnest(string_split(body, chr(10)) || (CASE WHEN regexp_matches(body, '\n *\n') THEN string_split_regex(body, '\n *(?:\n *)+') ELSE [] END)
    || (CASE WHEN contains(body, chr(10)) THEN [body] ELSE [] END)) AS unit FROM d),
w AS (SELECT row_number() OVER () AS uid, k, list_filter(string_split_regex(unit, '[ \n]+'), lambda x: x <> '') AS w FROM u),
c AS (SELECT uid, k, len(w) - 1 AS own, tid, n, license, grams, w FROM w JOIN t ON least(len(w) - 1, n) * 2 >= {THRESHOLD}::DOUBLE * (len(w) - 1 + n)),
o AS (SELECT DISTINCT uid, w FROM c),
b AS (SELECT uid, w[i] || ' ' || w[i+1] AS g FROM (SELECT uid, w, unnest(range(1, len(w))) AS i FROM o)),
q AS (SELECT uid, list(g || ' ' || r) AS grams FROM (SELECT uid, g, row_number() OVER (PARTITION BY uid, g) AS r FROM b) GROUP BY uid),
s AS (SELECT c.k, c.license, 2.0::DOUBLE * len(list_intersect(c.grams, q.grams)) / (own + n) AS dice FROM c JOIN q USING (uid)),
h AS (SELECT k, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, min({{'d': -dice, 'l': license}}) AS best FROM s WHERE dice >= {THRESHOLD}::DOUBLE GROUP BY k)
SELECT doc_id, coalesce(h.n, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, best.l AS best_license, -best.d AS best_dice FROM d LEFT JOIN h USING (k)
"""


OP7_SQL = _op7_sql()
