"""License scans: normalised text against license templates by the Dice coefficient of word bigrams.

SQL functions only.  The units compared are each line of a document, the whole document, and windows of words that cross
line ends: wherever one of a template's anchor words stands in the text, the window of the template's length in words that puts
this word where the template has it.  A unit of n distinct bigrams can reach a coefficient t with a template of m bigrams only if
n >= m * t / (2 - t) and n <= m * (2 - t) / t; lines and documents that no template's bounds admit are
dropped before any bigram is made, by their number of words, and each remaining unit
meets only the templates whose bounds admit it.  Lines and documents without a probe, a set of words of which every unit over the threshold
holds one, and texts without an anchor are passed over.  The templates are a short list of fixed texts, so they travel in the plan; no unit ever meets another unit.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, functions as F

THRESHOLD = 0.8

# Notices as licensors publish them; fixed values.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}


def words_of(text: str) -> list[str]:
    """Normalised words: ASCII letters in lower case and digits; everything else parts words. Used for the templates; ``_words`` is its SQL form."""
    return re.findall(r"[a-z0-9]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def bigrams_of(text: str) -> list[str]:
    w = words_of(text)
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def bounds(m: int, threshold: float) -> tuple[float, float]:
    return m * threshold / (2 - threshold), m * (2 - threshold) / threshold


def probes_of(known: list[tuple[str, list[str], float, float]]) -> list[str]:
    """Words of which every unit that reaches the threshold with some template has at least one.

    A unit at the threshold has at least ``lo`` of a template's m bigrams, so it cannot lack words that
    touch more than m - lo of them. Words are chosen greedily, long ones and those of several templates first.
    """
    open_ = [(set(grams), len(grams) - math.ceil(lo - 1e-9) + 1) for _, grams, lo, _ in known]
    chosen: list[str] = []
    while open_:
        gain: dict[str, float] = {}
        for grams, need in open_:
            for g in grams:
                for w in set(g.split()):
                    gain[w] = gain.get(w, 0) + (6 if w.isdigit() else min(len(w), 9)) ** 3 / need
        best = max(sorted(gain), key=gain.get)
        chosen.append(best)
        left = []
        for grams, need in open_:
            hit = {g for g in grams if best in g.split()}
            if need > len(hit):
                left.append((grams - hit, need - len(hit)))
        open_ = left
    return sorted(chosen)


def _words(text: Column) -> Column:
    plain = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    return F.array_distinct(F.transform(F.slice(words, 2, F.size(words)), lambda w, i: F.concat_ws(" ", F.get(words, i), w)))


def _known(templates: dict[str, list[str]], threshold: float) -> list[tuple[str, list[str], float, float]]:
    found = [(name, bigrams_of(t)) for name, texts in sorted(templates.items()) for t in texts]
    return [(name, grams, *bounds(len(grams), threshold)) for name, grams in found if grams]


def anchors_of(templates: dict[str, list[str]], threshold: float) -> tuple[list[int], list[tuple[str, int, int]]]:
    """The number of words of each template, and its anchors (word, template, position): the longest probe (ties: the first) of each
    of up to four equal parts of at least eight words. A copy has all of them; an edited one is found by any that is left."""
    probes = set(probes_of(_known(templates, threshold)))
    texts, out = [w for _, texts in sorted(templates.items()) for t in texts if len(w := words_of(t)) > 1], []
    for t, w in enumerate(texts):
        parts = max(1, min(4, len(w) // 8))
        found = [max(((len(w[i]), -i) for i in range(len(w) * k // parts, len(w) * (k + 1) // parts) if w[i] in probes), default=None) for k in range(parts)]
        long = [f for f in found if f and f[0] >= 5] or [max(f for f in found if f)]
        out += [(w[-minus], t, -minus) for _, minus in long]
    return [len(w) for w in texts], out


HIT = "array<struct<minus double, line int, license string>>"


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, n_licenses, licenses, best_license, best_dice, best_line.

    n_licenses counts the licenses of which some template reaches the threshold with some unit; licenses lists them in order, separated by
    commas; the best hit is the one of highest coefficient, then first line (of a window: its first word's; -1, the whole document, before
    all), then license. Without hits licenses is empty and the best hit is null, as for null and empty texts. A document of one line is one
    unit, its line, beside its windows. A window at an end of the text is cut there. Repeated rows each give a row; an empty table gives an empty table; further columns are not carried.
    """
    templates = TEMPLATES if templates is None else templates
    known = _known(templates, threshold)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    probes, (lengths, places) = probes_of(known), anchors_of(templates, threshold)
    table = [
        F.struct(F.lit(name).alias("license"), F.array(*map(F.lit, grams)).alias("grams"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), F.lit(n).alias("n"))
        for (name, grams, lo, hi), n in zip(known, lengths, strict=True)
    ]
    marks = sorted({w for w, _, _ in places})
    anchors = [F.struct(F.lit(p).alias("word"), F.array(*(F.struct(F.lit(t).alias("t"), F.lit(i).alias("at")) for w, t, i in places if w == p)).alias("places")) for p in marks]
    least, longest = min((k[2] for k in known), default=0.0), max((k[3] for k in known), default=0.0)

    def bind(x: Column, f) -> Column:
        """f(x) with x computed once: the array of one holds it while the lambda runs."""
        return F.get(F.transform(F.array(x), f), 0)

    def maybe(text: Column, some: list[str] = probes) -> Column:
        """Whether a unit has one of the words; Spark lowers the text once, not once per word."""
        return F.exists(F.array(F.lower(text)), lambda low: F.exists(F.array(*map(F.lit, some)), lambda p: F.contains(low, p)))

    def matches(u: Column, candidates: Column) -> Column:
        size = F.size(u["grams"])
        fit = F.filter(candidates, lambda t: size.between(t["lo"] - F.lit(1e-9), t["hi"] + F.lit(1e-9)))
        dice = lambda t: F.lit(2.0) * F.size(F.array_intersect(u["grams"], t["grams"])) / (size + F.size(t["grams"]))
        found = F.transform(fit, lambda t: F.struct((-dice(t)).alias("minus"), u["line"].alias("line"), t["license"].alias("license")))
        return F.filter(found, lambda h: h["minus"] <= F.lit(-threshold))

    def whole(text: Column) -> Column:
        """Hits of the lines and of the document."""
        lines = F.split(text, "\n")
        units = F.transform(lines, lambda x, i: F.struct(i.alias("line"), x.alias("unit")))
        units = F.when(F.size(lines) > 1, F.concat(F.array(F.struct(F.lit(-1).alias("line"), text.alias("unit"))), units)).otherwise(units)
        units = F.filter(units, lambda u: maybe(u["unit"]))
        units = F.transform(units, lambda u: F.struct(u["line"].alias("line"), _words(u["unit"]).alias("words")))
        units = F.filter(units, lambda u: F.size(u["words"]) > F.lit(least))  # n distinct bigrams need n + 1 words
        units = F.transform(units, lambda u: F.struct(u["line"].alias("line"), _bigrams(u["words"]).alias("grams")))
        units = F.filter(units, lambda u: F.size(u["grams"]).between(F.lit(least - 1e-9), F.lit(longest + 1e-9)))
        return F.flatten(F.transform(units, lambda u: matches(u, F.array(*table))))

    def windows(text: Column) -> Column:
        """Hits of the windows: the text's words with their lines, the starts that anchors give, then each distinct window."""
        words = F.flatten(F.transform(F.split(text, "\n"), lambda x, i: F.transform(_words(x), lambda w: F.struct(w.alias("w"), i.alias("line")))))

        def of(p: Column) -> Column:
            at = F.filter(F.transform(p, lambda x, i: F.struct(x["w"].alias("w"), i.alias("i"))), lambda x: F.array_contains(F.array(*map(F.lit, marks)), x["w"]))
            here = lambda x: F.flatten(F.transform(F.filter(F.array(*anchors), lambda a: a["word"] == x["w"]), lambda a: a["places"]))
            starts = F.flatten(F.transform(at, lambda x: F.transform(here(x), lambda q: F.struct(q["t"].alias("t"), F.greatest(x["i"] - q["at"], F.lit(0)).alias("start"), (x["i"] - q["at"] + F.get(F.array(*table), q["t"])["n"]).alias("stop")))))
            cut = lambda s: F.transform(F.slice(p, s["start"] + 1, F.greatest(s["stop"] - s["start"], F.lit(0))), lambda x: x["w"])
            unit = lambda s: F.struct(F.get(p, s["start"])["line"].alias("line"), bind(cut(s), _bigrams).alias("grams"))
            return F.flatten(F.transform(F.array_distinct(starts), lambda s: bind(unit(s), lambda u: matches(u, F.array(F.get(F.array(*table), s["t"]))))))

        return bind(words, of)

    nothing = F.array().cast(HIT)
    text = F.col("text")
    found = F.when(maybe(text), F.array_sort(F.concat(whole(text), F.when(maybe(text, marks), windows(text)).otherwise(nothing)))).otherwise(nothing) if known else nothing
    out = rows.withColumn("hits", found).drop("text")
    best, names = F.get("hits", 0), F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["license"])))
    return out.select(
        "doc_id", F.size(names).cast("long").alias("n_licenses"), F.array_join(names, ",").alias("licenses"),
        best["license"].alias("best_license"), (-best["minus"]).alias("best_dice"), best["line"].alias("best_line"),
    )


def oracle_sql(templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> str:
    """The same result with no passing over and no bounds: every unit against every template, every window against its own."""
    templates = TEMPLATES if templates is None else templates
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lengths, places = anchors_of(templates, threshold)
    values = ", ".join(f"({t}, {quote(name)}, {n}, [{', '.join(map(quote, grams))}])" for t, ((name, grams, *_), n) in enumerate(zip(_known(templates, threshold), lengths, strict=True)))
    anchors = ", ".join(f"({quote(w)}, {t}, {i})" for w, t, i in places)
    return f"""
WITH templates(t, license, n, grams) AS (VALUES {values}),
anchors(word, t, place) AS (VALUES {anchors}),
numbered AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT row_id, text, string_split(text, chr(10)) AS lines FROM numbered),
units AS (
  SELECT row_id, unnest(range(len(lines)))::INTEGER AS line, unnest(lines) AS unit FROM parts
  UNION ALL SELECT row_id, -1, text FROM parts WHERE len(lines) > 1),
words AS (
  SELECT row_id, line, list_filter(string_split_regex(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM units),
grams AS (SELECT row_id, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1),
texts AS (
  SELECT row_id, flatten(list(w ORDER BY line)) AS w, flatten(list(list_transform(w, lambda x: line) ORDER BY line)) AS line_of
  FROM words JOIN parts USING (row_id) WHERE line >= 0 GROUP BY row_id),
standing AS (SELECT row_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM texts),
starts AS (SELECT DISTINCT row_id, t, greatest(i - place, 0) AS start, i - place + n AS stop FROM standing JOIN anchors USING (word) JOIN templates USING (t)),
pieces AS (SELECT row_id, t, line_of[start + 1] AS line, w[start + 1:stop] AS w FROM starts JOIN texts USING (row_id)),
scores AS (
  SELECT row_id, line, license, 2.0::DOUBLE * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams)) AS dice FROM grams, templates AS t
  UNION ALL
  SELECT row_id, line, license, 2.0::DOUBLE * len(list_intersect(g, t.grams)) / (len(g) + len(t.grams))
  FROM (SELECT row_id, t, line, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM pieces) JOIN templates AS t USING (t)),
hits AS (SELECT * FROM scores WHERE dice >= {threshold!r}::DOUBLE),
best AS (
  SELECT row_id, count(DISTINCT license) AS n_licenses, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
    first(license ORDER BY dice DESC, line, license) AS best_license, max(dice) AS best_dice, first(line ORDER BY dice DESC, line, license) AS best_line
  FROM hits GROUP BY row_id)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, best_license, best_dice, best_line::INTEGER AS best_line
FROM numbered LEFT JOIN best USING (row_id)
"""
