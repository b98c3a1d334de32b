"""Licence notices in texts by the Dice coefficient of word bigrams, in column expressions alone.

Two sets of word bigrams are alike when 2 |A and B| / (|A| + |B|) reaches the threshold t. That
needs |A| between |B| t / (2 - t) and |B| (2 - t) / t, and |B| t / (2 - t) bigrams of B in A. A
document that does not have so many of any template is not looked at further.

Units (lines, and sentences in them) are compared with the short notices first. Then windows of the
running words, across the ends of lines and sentences, are compared with all templates. A window
begins and ends with a bigram of the template, as trimming others only makes it more alike, and has
at most (2 - t) / t times as many bigrams as the template, repeats counted. Bigrams of a unit that
is alike by itself count for no window of that licence, so no place is counted twice.

``n_units`` has the units and the windows that do not overlap: those of longer templates first, then
the most alike, the longest and the first, so copies that follow one another count one by one.
Licences whose texts are nearly equal (BSD-2-Clause and BSD-3-Clause) are both found; the larger
dice tells which it is.

Cases: a null or empty text, and texts of fewer than two words, match nothing; repeated rows are
matched alike and a doc_id that is repeated gets one row per licence; a null doc_id is a group of
its own; an empty table gives an empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logfathom.plans.scale import compute_once

from .common import text_of

#: The usual short notices of public licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license that can be found "
                    "in the LICENSE file.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International "
                 "License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related "
               "or neighboring rights to this work.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with "
           "or without fee is hereby granted.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the "
                "terms of the GNU Lesser General Public License, version 2.1.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, "
               "v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Whole texts of licences without copyright lines, and the headers that longer ones
#: (GPL, LGPL) give for files and hold themselves. Found as windows only.
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain "
    "the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution. ")
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission. ")
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR "
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND "
    "FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, "
    "DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER "
    "IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT "
    "OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
FULL_TEXTS = {
    "BSD-2-Clause": _BSD_TERMS + _BSD_END,
    "BSD-3-Clause": _BSD_TERMS + _BSD_THIRD + _BSD_END,
    "GPL-3.0":
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version 3 "
        "of the License, or (at your option) any later version.",
    "ISC":
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL "
        "WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY "
        "AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
        "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN "
        "CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "LGPL-2.1":
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    "MIT":
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
        "and associated documentation files (the \"Software\"), to deal in the Software without "
        "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR "
        "IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A "
        "PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE "
        "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    "Unlicense":
        "This is free and unencumbered software released into the public domain. Anyone is free to "
        "copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}
THRESHOLD = 0.8
#: Ends of units: line ends, and white space after the end of a sentence.
UNIT_END = r"[\n\r]+|[.!?:;][ \t]+"


def bigrams_of(words: Column) -> Column:
    """The distinct pairs of neighbouring words."""
    return F.array_distinct(F.zip_with(
        F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
        lambda a, b: F.concat_ws(" ", a, b)))


def template_bigrams(notice: str) -> list[str]:
    """Bigrams of a template: unlike a text it is one unit, whatever its punctuation."""
    words = re.findall(r"[^\W_]+", notice.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[ \n]+"), lambda w: w != "")


def _dice(common: Column, a: Column, b: Column) -> Column:
    return F.lit(2.0) * common / (a + b)


def scan(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD,
         full_texts: Mapping[str, str] = FULL_TEXTS) -> DataFrame:
    """Per document and licence found in it: doc_id, license, dice (the best), n_units."""
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    names = sorted({*templates, *full_texts})

    def needed(bigrams: list[str]) -> int:
        return math.ceil(len(bigrams) * low - 1e-9)

    owned = {name: [(kind is templates, template_bigrams(kind[name]), kind[name])
                    for kind in (templates, full_texts) if name in kind] for name in names}
    every = F.array(*map(F.lit, sorted({b for own in owned.values() for _, bs, _ in own for b in bs})))

    def template(notice: bool, bigrams: list[str], text: str) -> Column:
        span = int((len(re.findall(r"[^\W_]+", text)) - 1) * high + 1e-9)
        return F.struct(F.lit(notice).alias("notice"), F.array(*map(F.lit, bigrams)).alias("bigrams"),
                        F.lit(len(bigrams)).alias("n"), F.lit(needed(bigrams)).alias("need"),
                        F.lit(span).alias("span"))

    options = F.array(*[F.struct(F.lit(name).alias("license"),
                                 F.array(*[template(*one) for one in own]).alias("templates"))
                        for name, own in owned.items()])
    normal = F.regexp_replace(F.lower(F.regexp_replace(text_of(), UNIT_END, "\n")),
                              r"[^\p{L}\p{N}\n]+", " ")
    rows = compute_once(docs.select("doc_id", normal.alias("normal")), words=_words(F.col("normal")))
    rows = rows.filter(F.size("words") >= 2)
    rows = compute_once(rows, shared=F.array_intersect(bigrams_of(F.col("words")), every)).drop("words")
    rows = rows.filter(F.size("shared") >= min(needed(bs) for own in owned.values() for _, bs, _ in own))
    # Licences of which some template may be there, one row each.
    likely = F.filter(options, lambda o: F.exists(o["templates"], lambda t: F.size(
        F.array_intersect(F.col("shared"), t["bigrams"])) >= t["need"]))
    rows = rows.select("doc_id", "normal", F.explode(likely).alias("option"))
    rows = compute_once(rows.select("doc_id", "option.*", F.transform(
        F.split("normal", "\n"), _words).alias("units")), units=F.col("units"))

    def unit_dice(words: Column) -> Column:
        """The dice of a unit and the notice, 0 below the threshold."""
        def compared(t: Column) -> Column:
            return F.transform(F.array(bigrams_of(words)), lambda a: _dice(
                F.size(F.array_intersect(a, t["bigrams"])), F.size(a), t["n"]))[0]
        found = F.transform(F.filter("templates", lambda t: t["notice"]), compared)
        return F.when((F.size(words) >= 2) & (F.get(found, F.lit(0)) >= threshold),
                      F.get(found, F.lit(0))).otherwise(F.lit(0.0))

    rows = compute_once(rows, alike=F.transform("units", unit_dice))
    placed = F.flatten(F.transform("units", lambda u, i: F.transform(u, lambda w: F.struct(
        w.alias("word"), (F.element_at("alike", i + 1) > 0).alias("done")))))
    rows = compute_once(rows, placed=placed).drop("units")
    n = F.size("placed")
    rows = compute_once(rows, pairs=F.zip_with(
        F.slice("placed", 1, n - 1), F.slice("placed", 2, n - 1), lambda a, b: F.struct(
            F.concat_ws(" ", a["word"], b["word"]).alias("bigram"),
            (a["done"] | b["done"]).alias("done")))).drop("placed")
    # Where bigrams of each template stand, outside of the units that are alike.
    hits = F.transform("templates", lambda t: F.struct(
        t["n"].alias("n"), t["need"].alias("need"), t["span"].alias("span"),
        F.filter(F.transform("pairs", lambda p, i: F.struct(
            i.alias("at"), F.when(~p["done"] & F.array_contains(t["bigrams"], p["bigram"]), p["bigram"])
            .alias("bigram"))), lambda h: h["bigram"].isNotNull()).alias("hits")))
    rows = compute_once(rows, bigrams=F.col("pairs.bigram"), found=hits).drop("pairs", "templates")

    def windows(t: Column) -> Column:
        def from_hit(first: Column) -> Column:
            begin = t["hits"][first - 1]["at"]

            def window(last: Column) -> Column:
                end = t["hits"][last - 1]["at"]
                common = F.array_distinct(F.slice(t["hits"], first, last - first + 1)["bigram"])
                held = F.array_distinct(F.slice("bigrams", begin + 1, end - begin + 1))
                dice = _dice(F.size(common), F.size(held), t["n"])
                # The order in which windows are taken: the most alike, then the longest, then the first.
                return F.struct((-t["n"]).alias("n"), (-dice).alias("unlike"), (begin - end).alias("short"),
                                begin.alias("begin"), end.alias("end"), dice.alias("dice"))
            last = F.sequence(first + t["need"] - 1, F.least(F.size(t["hits"]), first + t["span"] - 1))
            return F.filter(F.transform(F.filter(
                last, lambda j: t["hits"][j - 1]["at"] - begin < t["span"]), window),
                lambda w: w["dice"] >= threshold)
        starts = F.size(t["hits"]) - t["need"] + 1
        return F.when(starts >= 1, F.flatten(F.transform(F.sequence(F.lit(1), starts), from_hit)))

    seen = F.flatten(F.filter(F.transform("found", windows), lambda w: w.isNotNull()))
    rows = compute_once(rows, windows=F.array_sort(seen)).drop("found", "bigrams")
    none = F.slice(F.transform("windows", lambda w: F.struct(w["begin"].alias("begin"), w["end"].alias("end"))),
                   1, 0)
    apart = F.aggregate("windows", none, lambda taken, w: F.when(
        F.exists(taken, lambda o: (w["begin"] <= o["end"]) & (w["end"] >= o["begin"])), taken).otherwise(
        F.concat(taken, F.array(F.struct(w["begin"].alias("begin"), w["end"].alias("end"))))))
    units = F.size(F.filter("alike", lambda d: d > 0)) + F.size(apart)
    best = F.greatest(F.array_max("alike"), F.array_max(F.transform("windows", lambda w: w["dice"])))
    rows = compute_once(rows.select("doc_id", "license", best.alias("dice"), units.alias("units")),
                        units=F.col("units").cast("long"))
    return (rows.filter("units > 0").groupBy("doc_id", "license")
            .agg(F.round(F.max("dice"), 6).alias("dice"), F.sum("units").alias("n_units")))
