"""License notices by Dice coefficient over word bigrams, in DataFrame functions only.

A unit is a line, or a paragraph of several lines (paragraphs end at blank lines). Units and templates are lower-cased, all but
ASCII letters and digits is white space, and the sets of their word bigrams are compared: 2 |A & B| / (|A| + |B|). Sizes prune
first: a coefficient of t needs |A| between t / (2 - t) |B| and (2 - t) / t |B|. Before that, a text is read further only if it
holds an anchor word; the anchors are chosen so that a unit without any of them shares too few bigrams with every template
(``anchors``), so nothing is lost.

Null and empty texts have no units. A unit of fewer than two words has no bigrams and no match. Of several templates at the
same coefficient, the first by name is given. Repeated rows give repeated matches, null ids stay null, other columns are
ignored, an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Public license names and notices.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                   "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for "
                   "the specific language governing permissions and limitations under the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
            "the Software is furnished to do so, subject to the following conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
                "version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                     "following conditions are met:"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
                "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the "
                "public domain worldwide."),
)
THRESHOLD = 0.8


def bigrams_of(text: str) -> list[str]:
    """Distinct word bigrams of a template, in order."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:])))


def anchors(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Words of which every unit that reaches ``threshold`` holds one. Such a unit has at least threshold / (2 - threshold) of a
    template's bigrams; words are taken, those first that most templates hold, until fewer bigrams are free of them."""
    grams = [[b.split() for b in bigrams_of(t)] for _, t in templates]
    spread: dict[str, int] = {}
    for g in grams:
        for word in {w for b in g for w in b}:
            spread[word] = spread.get(word, 0) + (len(word) > 4)
    chosen: list[str] = []
    for g in sorted(grams, key=len):
        need = math.ceil(threshold / (2 - threshold) * len(g) - 1e-9)
        free = lambda: sum(not set(b) & set(chosen) for b in g)
        rest = sorted({w for b in g for w in b}, key=lambda w: (-spread[w], -len(w), w))
        while free() >= need:
            chosen.append(next(w for w in rest if w not in chosen))
    return sorted(set(chosen))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(words: Column) -> Column:
    return F.array_distinct(F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
                                       F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                                       lambda a, b: F.concat(a, F.lit(" "), b)))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """Matches of all documents (``doc_id, text``): ``doc_id, unit`` (line or paragraph), ``position`` (from 0, of lines or of
    paragraphs), ``license``, ``dice``, ``matched_text``."""
    seen = r"(?<![a-z0-9])(?:" + "|".join(anchors(templates, threshold)) + r")(?![a-z0-9])"
    text = F.col("text").cast("string")
    few = docs.select(F.col("doc_id"), text.alias("text")).filter(F.lower("text").rlike(seen))
    units = few.select("doc_id", F.inline(F.concat(
        F.transform(F.split("text", "\n"), lambda x, i: F.struct(F.lit("line").alias("unit"), i.alias("position"), x.alias("body"))),
        F.filter(F.transform(F.split("text", "\n[ \t\r]*\n"), lambda x, i: F.struct(F.lit("paragraph").alias("unit"), i.alias("position"), x.alias("body"))),
                 lambda s: F.contains(s["body"], F.lit("\n"))))))
    units = units.filter(F.lower("body").rlike(seen))
    units = units.withColumn("grams", bigrams(F.split(normal(F.col("body")), " ")))

    known = sorted({(name, tuple(bigrams_of(t))) for name, t in templates}, key=lambda x: (x[0], len(x[1]), x[1]))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    size = F.size("grams")
    scored = []
    for rank, (name, own) in enumerate(known):               # ties go to the first name
        fits = size.between(math.ceil(low * len(own) - 1e-9), math.floor(high * len(own) + 1e-9))
        common = F.size(F.array_intersect("grams", F.array(*map(F.lit, own))))
        scored.append(F.when(fits, F.struct(F.round(2.0 * common / (size + len(own)), 6).alias("dice"),
                                            F.lit(-rank).alias("rank"), F.lit(name).alias("license"))))
    best = F.array_max(F.array(*scored))
    return (units.withColumn("best", best).filter(F.col("best.dice") >= threshold)
            .select("doc_id", "unit", "position", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"),
                    F.col("body").alias("matched_text")))


def oracle(templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same question in SQL, without anchors and size bounds."""
    known = sorted({(name, tuple(bigrams_of(t))) for name, t in templates})
    rows = ", ".join("('%s', [%s])" % (n, ", ".join(f"'{b}'" for b in g)) for n, g in known)
    return f"""
WITH t(license, own) AS (VALUES {rows}),
l AS (SELECT doc_id, 'line' AS unit, unnest(range(len(string_split(text, chr(10))))) AS position, unnest(string_split(text, chr(10))) AS body FROM documents),
p AS (SELECT doc_id, 'paragraph' AS unit, unnest(range(len(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')))) AS position,
  unnest(regexp_split_to_array(text, '\\n[ \\t\\r]*\\n')) AS body FROM documents),
u AS (SELECT *, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') AS w
  FROM (SELECT * FROM l UNION ALL SELECT * FROM p WHERE contains(body, chr(10)))),
g AS (SELECT *, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS grams FROM u WHERE len(w) > 1),
c AS (SELECT doc_id, unit, position, body, license, round(2.0 * len(list_intersect(grams, own)) / (len(grams) + len(own)), 6) AS dice,
  row_number() OVER (PARTITION BY doc_id, unit, position ORDER BY round(2.0 * len(list_intersect(grams, own)) / (len(grams) + len(own)), 6) DESC, license) AS k
  FROM g, t WHERE len(grams) <= 2 * len(own) AND len(own) <= 2 * len(grams))
SELECT doc_id, unit, CAST(position AS INTEGER) AS position, license, dice, body AS matched_text FROM c WHERE k = 1 AND dice >= {threshold}"""
