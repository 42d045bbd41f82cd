"""Licence scans: passages compared with licence templates by the Dice coefficient over word bigrams.

A passage is a line, or a run of neighbouring lines that each hold a telling word. Words are runs of letters and digits,
lower-cased. A template is a candidate only if its number of bigrams allows a Dice coefficient of ``LIMIT`` with the
passage; and since a passage that similar must share more than half of a template's bigrams, it must hold one of the
template's telling words, which leaves nearly all lines out before any bigram is made.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMIT = 0.75
# Notices of common licences.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "BSD-3-Clause": "Licensed under the BSD 3-Clause License.",
    "BSD-3-Clause-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "BSD-3-Clause-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in "
        "the documentation and/or other materials provided with the distribution."
    ),
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright and related rights to the public domain worldwide.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided "
        "that the above copyright notice and this permission notice appear in all copies."
    ),
    "MIT": "Released under the MIT License.",
    "MIT-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions:"
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with "
        "this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
WORD = r"[\p{L}\p{N}]+"


def _bigrams(words: list[str]) -> list[str]:
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def prepared(templates: dict[str, str], limit: float) -> tuple[list[tuple[str, list[str]]], list[str]]:
    """Names and distinct bigrams of the templates, and the telling words.

    A passage with ``a`` bigrams that is similar enough to a template with ``b`` shares at least ``limit * b / (2 - limit)``
    of them, so any larger remainder of the template's bigrams holds a shared one; the longer words of those with the
    longest words are telling.
    """
    out, telling = [], set()
    for name, text in sorted(templates.items()):
        bigrams = _bigrams(re.findall(r"[^\W_]+", text.lower()))
        shared = math.ceil(limit * len(bigrams) / (2 - limit))
        ranked = sorted(bigrams, key=lambda g: (-max(map(len, g.split())), g))
        for gram in ranked[: len(bigrams) - shared + 1]:
            telling.add(max(gram.split(), key=lambda w: (len(w), w)))
        out.append((name, bigrams))
    return out, sorted(telling)


def find_licences(
    docs: DataFrame, *, text: str = "text", out: str = "licences", templates: dict[str, str] | None = None, limit: float = LIMIT
) -> DataFrame:
    """Every row with ``out``: an array of ``first_line, last_line, licence, dice`` (lines from 0) for each passage whose
    best template reaches ``limit``, ordered by lines. Equal scores go to the alphabetically first licence.

    A null or empty text has none. A column named ``out`` is replaced, others pass through; repeated rows each get theirs.
    """
    known, telling = prepared(TEMPLATES if templates is None else templates, limit)

    def words(line: Column) -> Column:
        return F.regexp_extract_all(F.lower(line), F.lit(f"({WORD})"), F.lit(1))

    lines = F.transform(F.split(F.coalesce(F.col("__text"), F.lit("")), "\n"), lambda s, i: F.struct(i.alias("line"), words(s).alias("words")))
    marked = F.filter(lines, lambda s: F.exists(s["words"], lambda w: w.isin(*telling)))
    kept = [F.col("__row")[c].alias(c) for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text")).withColumn("__marked", marked)

    none = F.array().cast("array<struct<first_line:int,last_line:int,words:array<string>>>")

    def grow(runs: Column, s: Column) -> Column:
        """The runs of neighbouring lines with one more line."""
        last = F.element_at(runs, -1)
        joins = F.when(F.size(runs) > 0, last["last_line"] == s["line"] - 1).otherwise(False)
        alone = F.struct(s["line"].alias("first_line"), s["line"].alias("last_line"), s["words"].alias("words"))
        longer = F.struct(last["first_line"].alias("first_line"), s["line"].alias("last_line"), F.concat(last["words"], s["words"]).alias("words"))
        return F.when(joins, F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(longer))).otherwise(F.concat(runs, F.array(alone)))

    runs = F.when(F.size("__marked") > 1, F.aggregate("__marked", none, grow)).otherwise(none)
    single = F.transform("__marked", lambda s: F.struct(s["line"].alias("first_line"), s["line"].alias("last_line"), s["words"].alias("words")))
    rows = rows.withColumn("__passages", F.concat(single, F.filter(runs, lambda r: r["last_line"] > r["first_line"])))
    grams = F.transform(
        "__passages",
        lambda p: F.struct(
            p["first_line"].alias("first_line"),
            p["last_line"].alias("last_line"),
            F.array_distinct(
                F.transform(F.sequence(F.lit(1), F.greatest(F.size(p["words"]) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.get(p["words"], i - 1), F.get(p["words"], i)))
            ).alias("grams"),
        ),
    )
    rows = rows.withColumn("__grams", F.when(F.size("__passages") > 0, grams).otherwise(F.array().cast("array<struct<first_line:int,last_line:int,grams:array<string>>>")))

    def best(p: Column) -> Column:
        scores = []
        for i, (name, bigrams) in enumerate(known):
            b = len(bigrams)
            low, high = b * limit / (2 - limit), b * (2 - limit) / limit
            size = F.size(p["grams"])
            dice = F.lit(2.0) * F.size(F.array_intersect(p["grams"], F.array(*map(F.lit, bigrams)))) / (size + b)
            score = F.when((size >= low - 1e-9) & (size <= high + 1e-9), F.round(dice, 9)).otherwise(F.lit(0.0))
            scores.append(F.struct(score.alias("dice"), F.lit(-i).alias("order"), F.lit(name).alias("licence")))
        top = F.array_max(F.array(*scores))
        return F.struct(p["first_line"].alias("first_line"), p["last_line"].alias("last_line"), top["licence"].alias("licence"), top["dice"].alias("dice"))

    scored = F.array_sort(F.filter(F.transform("__grams", best), lambda s: s["dice"] >= limit))
    return rows.withColumn("__scored", scored).select(*kept, F.col("__scored").alias(out))
