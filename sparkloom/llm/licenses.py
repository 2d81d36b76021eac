"""Licence scans: normalised text against licence templates by the Dice coefficient over word bigrams.

The units compared are a text's lines, its sentences (whatever lines they run over), its paragraphs (between blank lines)
and the whole of it, in lower case with everything but letters and digits as blanks. Templates are notices and their
sentences, and the full texts in the folder ``licences`` with their paragraphs; of equal ones the first by id is kept. A
unit and a template with a and b distinct bigrams share at most min(a, b), so a coefficient of t or more needs a between
b * t / (2 - t) and b * (2 - t) / t: templates outside are not compared. It also holds all but b - b * t / (2 - t) of a
template's bigrams, so words that lie in more bigrams than that can't all be missing (``marks``): a text without any such
word of any template is passed over before units are made of it, and a unit before its bigrams are. Both are implied by
the coefficient, so nothing that reaches it is lost.

All in built-in functions within a row: no shuffle, whatever the texts' or groups' size. The templates are a fixed literal
of the plan. Bigrams are compared by their 64-bit hashes.

Not covered: licences without a template, and a notice that is part of a longer sentence.

Null and empty texts match nothing. Very long texts are read whole. A coefficient at the threshold counts; ties go to the
largest template, then to the first by id. Repeated rows give repeated results; an empty table gives an empty one; columns besides the id and
the text are not read, whatever their names.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8
#: Bigrams that a paragraph or sentence of a template has at least, so that headings are none.
LEAST = 8
#: Words of most English texts, which are looked for last. They decide how much is passed over, never what is found.
COMMON = frozenset("a about all an and any are as at be but by can for from had has have he in into is it its may more no not of on one or other our out she so such than that the their them there these they this to under up us was we were when which who will with would you your".split())
#: What a paragraph or sentence must have one of, in lower case, to be taken as a template. Texts need none of them.
SIGNS = r"licen[cs]e|copyright|redistribut|warrant|permission|patent|public domain|rights reserved"

#: Notices by SPDX id, beside the full texts in the folder licences.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "BSD-3-Clause": ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0."),
    "CC-BY-SA-4.0": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "CC0-1.0": ("This work is dedicated to the public domain under CC0 1.0 Universal.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0.",),
    "LicenseRef-Reserved": ("All rights reserved.",),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",),
}



def words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def bigrams(text: str) -> list[str]:
    w = words(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Numbers of bigrams with which the coefficient can reach the threshold; a little wide rather than narrow."""
    ratio = threshold / (2 - threshold)
    return max(1, int(size * ratio - 1e-9)), int(size / ratio + 1e-9)


def marks(texts: Iterable[str], threshold: float) -> list[str]:
    """Words of which a unit has at least one if it reaches the threshold with one of these templates: of each template they
    lie in more bigrams than such a unit can lack. Small templates first: what serves them serves larger ones; then a
    template's longest words, as short ones are in most texts, and common ones last."""
    chosen: set[str] = set()
    for grams in sorted(({tuple(g.split()) for g in bigrams(text)} for text in texts), key=lambda g: (len(g), sorted(g))):
        lacking = len(grams) - math.ceil(len(grams) * threshold / (2 - threshold) - 1e-9)
        held = sum(not chosen.isdisjoint(g) for g in grams)
        for word in sorted({w for g in grams for w in g} - chosen, key=lambda w: (w in COMMON, -len(w), w)):
            if held > lacking:
                break
            held += sum(word in g and chosen.isdisjoint(g) for g in grams)
            chosen.add(word)
    return sorted(chosen)


def templates_of(texts: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """Id and normalised text of each template: the texts whole, their paragraphs and sentences, each bag of bigrams once."""
    out: dict[tuple[str, ...], tuple[str, str]] = {}
    for name, own in sorted(texts.items()):
        for text in own:
            blocks = re.split(r"\n[ \t\r]*\n", text)
            parts = blocks + (re.split(r"(?<=[.!?])\s+", text) if len(blocks) == 1 else [])
            for part, least in [(text, 1), *((p, LEAST) for p in parts)]:
                grams = tuple(bigrams(part))
                if len(grams) >= least and re.search(SIGNS, " ".join(part.lower().split())):
                    out.setdefault(grams, (name, " ".join(words(part))))
    return sorted(out.values())


@cache
def known() -> tuple[tuple[str, str], ...]:
    """The templates of the notices and the full texts."""
    texts = dict(NOTICES)
    for file in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        texts[file.stem] = (*texts.get(file.stem, ()), file.read_text())
    return tuple(templates_of(texts))


@cache
def _marks(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    return marks((text for _, text in templates), threshold)


def scan(docs: DataFrame, threshold: float = THRESHOLD, templates: dict[str, tuple[str, ...]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license_id (of the best template, null if none reaches the threshold), dice (rounded to 6 places, null
    likewise), n_units (the distinct units that reach it)."""
    from xxhash import xxh64_intdigest

    held = known() if templates is None else tuple(templates_of(templates))
    rows = []
    for name, text in held:
        grams = [xxh64_intdigest(g, 42) for g in bigrams(text)]
        low, high = bounds(len(grams), threshold)
        rows.append({"id": name, "size": len(grams), "low": low, "high": high, "grams": sorted(g - (g >> 63 << 64) for g in grams)})
    rows.sort(key=lambda r: r["id"])
    least, most = min(r["low"] for r in rows), max(r["high"] for r in rows)
    # folded into a literal once, when the plan is optimised
    table = F.from_json(F.lit(json.dumps(rows)), "array<struct<id:string,size:int,low:int,high:int,grams:array<bigint>>>")

    marked = F.array(*map(F.lit, _marks(held, threshold)))
    worded = lambda text: F.split(F.btrim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")
    found = docs.select(F.col(id_col).alias("doc_id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    found = found.select("doc_id", F.when(F.arrays_overlap(worded(F.col("text")), marked), F.col("text")).otherwise(F.lit("")).alias("text"))
    sentences = F.split(F.regexp_replace(F.translate("text", "\n", " "), r"([.!?])[ \t\r]+", "$1\n"), "\n")
    units = F.array_distinct(F.concat(F.split("text", "\n"), sentences, F.split("text", "\n[ \t\r]*\n"), F.array("text")))
    # each step a projection, so that none is evaluated again inside a function of another
    found = found.select("doc_id", F.array_distinct(F.transform(units, worded)).alias("units"))
    # a unit of so many distinct words has that many bigrams but one at least
    fitting = F.filter("units", lambda w: (F.size(w) > least) & F.arrays_overlap(w, marked) & (F.size(F.array_distinct(w)) - 1 <= most))
    found = found.select("doc_id", fitting.alias("words"))
    paired = F.transform("words", lambda w: F.array_distinct(F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(F.concat(a, F.lit(" "), b)))))
    found = found.select("doc_id", F.filter(F.array_distinct(F.transform(paired, lambda g: F.array_sort(g))), lambda g: F.size(g).between(least, most)).alias("grams"))

    def best(grams: Column) -> Column:
        suited = F.filter(table, lambda t: F.size(grams).between(t["low"], t["high"]))
        coefficient = lambda t: F.round(2.0 * F.size(F.array_intersect(grams, t["grams"])) / (F.size(grams) + t["size"]), 6)
        scored = F.transform(suited, lambda t: F.struct((-coefficient(t)).alias("d"), (-t["size"]).alias("s"), t["id"].alias("id")))
        return F.array_min(F.filter(scored, lambda s: s["d"] <= -threshold))

    hits = F.filter(F.transform("grams", best), lambda x: x.isNotNull())
    found = found.select("doc_id", hits.alias("hits")).select("doc_id", F.array_min("hits").alias("top"), F.size("hits").cast("long").alias("n_units"))
    return found.select("doc_id", F.col("top.id").alias("license_id"), (-F.col("top.d")).alias("dice"), "n_units")


def sql(threshold: float = THRESHOLD) -> str:
    """The same in another engine, from the same templates, without the marks."""
    rows = ", ".join(f"('{name}', '{text}')" for name, text in known())
    return rf"""
WITH n(id, text) AS (VALUES {rows}),
t AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS grams FROM (SELECT id, string_split(text, ' ') AS w FROM n)),
d AS (SELECT doc_id, lower(coalesce(text, '')) AS text FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(list_concat(string_split(text, chr(10)),
        string_split(regexp_replace(replace(text, chr(10), ' '), '([.!?])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)), string_split_regex(text, '\n[ \t\r]*\n'), [text])) AS unit FROM d),
w AS (SELECT DISTINCT doc_id, string_split(trim(regexp_replace(unit, '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS words FROM u),
g AS (SELECT DISTINCT doc_id, list_sort(list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]))) AS grams
      FROM w WHERE len(words) > 1),
e AS (SELECT g.*, unnest(g.grams) AS gram FROM g),
f AS (SELECT DISTINCT id, grams, unnest(grams) AS gram FROM t),
s AS (SELECT e.doc_id, e.grams AS unit, f.id, len(f.grams) AS size, round(2.0::DOUBLE * count(*) / (len(e.grams) + len(f.grams)), 6) AS dice
      FROM e JOIN f ON e.gram = f.gram GROUP BY e.doc_id, e.grams, f.id, f.grams),
h AS (SELECT doc_id, count(DISTINCT unit) AS n_units, max(dice) AS dice FROM s WHERE dice >= {threshold} GROUP BY doc_id),
b AS (SELECT h.doc_id, first(s.id ORDER BY s.size DESC, s.id) AS license_id FROM h JOIN s ON h.doc_id = s.doc_id AND h.dice = s.dice GROUP BY h.doc_id)
SELECT d.doc_id, b.license_id, h.dice, coalesce(h.n_units, 0)::BIGINT AS n_units
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN b USING (doc_id)
"""
