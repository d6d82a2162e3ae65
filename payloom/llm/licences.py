"""Licence scans with DataFrame operations only: sentences and windows of a text against licence notices by the Dice
coefficient of their word bigrams.

Texts are cut into lines and these into sentences; both sides are reduced to lower-case words of a-z and 0-9. A stretch
and a template with a and b distinct bigrams can reach t = 2 common / (a + b) only if a lies between b t / (2 - t) and
b (2 - t) / t. Compared are whole sentences and, as notices are wrapped over lines or stand inside longer sentences,
all windows of admissible size over the words of the whole text that begin and end with a bigram of the template (others
are bettered by a shorter one). Of stretches that overlap the best counts. Whole texts are compared with whole licences (TEXTS)
in the same way; only texts that hold enough of a licence's words are taken apart. Documents and places in them count only if
they hold one of a set of words chosen such that every template loses its match without them (more than the share of
its bigrams that a match may lack holds one), so nothing is lost.

Defined results: null and empty texts and sentences of one word have no bigrams and match nothing; a licence that several
different stretches name is one row with their count and the best coefficient; repeated rows give repeated rows only if their ids
differ (counts add up otherwise); a null doc_id is kept; other columns are ignored; an empty table gives an empty result;
texts of any length are read whole.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Notices by which texts name their licence.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License v3.0.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Licensed under the BSD 3-Clause License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0."],
    "Proprietary": ["All rights reserved.", "All rights reserved; no part of this publication may be reproduced without prior written permission."],
}
#: Short names by which files declare their licence.
TEMPLATES = {name: [*TEMPLATES.get(name, []), f"SPDX-License-Identifier: {name}"] for name in [*TEMPLATES, "ISC", "BSD-2-Clause", "Unlicense", "Zlib"] if name != "Proprietary"} | {"Proprietary": TEMPLATES["Proprietary"]}
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
#: Whole licences, without their copyright lines.
TEXTS = {
    "MIT": f"""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": f"""Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS} AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "Unlicense": f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.""",
}
LEAST = 0.8
#: Words that most texts hold; they choose documents only if nothing else does.
COMMON = frozenset("a all and any are be by for from in is may no of on or that the this to under use was with without you it as".split())


def words_of(text: str) -> list[str]:
    return re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split(" ")


def bigrams_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def needed_words(templates: list[list[str]], least: float) -> list[str]:
    """Words such that of each template more bigrams hold one than a match may lack."""
    chosen: set[str] = set()
    for grams in templates:
        spare = len(grams) * (1 - least / (2 - least))
        held = lambda w: {g for g in grams if w in g.split(" ")}  # noqa: E731, B023
        while True:
            got = {g for g in grams if chosen & set(g.split(" "))}
            if len(got) > spare:
                break
            rest = {w for g in grams for w in g.split(" ")} - chosen
            chosen.add(max(rest, key=lambda w: (len(held(w) - got) > 0 and w not in COMMON, len(held(w) - got), len(w), w)))
    return sorted(chosen)


def sentence_words(text: Column) -> Column:
    """The words of each sentence of a text, as an array of arrays."""
    lines = F.split(F.regexp_replace(text, r"([.!?;])\s+", "$1\n"), "\n")
    words = F.transform(lines, lambda s: F.split(F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " "))), " "))
    return F.filter(words, lambda w: F.size(w) + F.length(w[0]) > 1)


def _bigrams(words: Column) -> Column:
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.size(words)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b)))


def _dice(grams: Column, template: Column) -> Column:
    return 2 * F.size(F.array_intersect(grams, template)) / (F.size(grams) + F.size(template))


def apart_words(grams: list[str], least: float) -> tuple[dict[str, int], float]:
    """Words no two of which stand in the same bigram, with their bigrams, and how many of these a match holds at least."""
    of = {w: {g for g in grams if w in g.split(" ")} for g in grams for w in g.split(" ")}
    chosen: dict[str, int] = {}
    used: set[str] = set()
    for w in sorted(of, key=lambda w: (w in COMMON, -len(of[w]), -len(w), w)):
        if not of[w] & used:
            chosen[w] = len(of[w])
            used |= of[w]
    return chosen, len(used) - len(grams) * (1 - least / (2 - least)) - 1e-9


def _may_be(text: Column, grams: list[list[str]], least: float) -> Column:
    """Whether a text holds the words without which it can't be like one of ``grams``, whatever its length."""
    needed = needed_words(grams, least)

    def one_of(t: Column) -> Column:
        held = F.lit(False)
        for w in needed:
            held = held | F.contains(t, F.lit(w))
        return held

    def enough(t: Column) -> Column:
        each = F.lit(False)
        for g in grams:
            words, sum_ = apart_words(g, least)
            each = each | (sum(F.contains(t, F.lit(w)).cast("int") * n for w, n in words.items()) >= sum_)
        return each

    # The text is put in lower case once.
    return F.element_at(F.transform(F.array(F.lower(text)), lambda t: one_of(t) & enough(t)), 1)


def _whole(docs: DataFrame, texts: dict[str, str], least: float, id_col: str, text_col: str) -> DataFrame:
    """id, ``licence`` and ``dice`` for each text that is, but for little, a whole licence: the one it is most like. Repeated
    passages and long words make a text longer but not less like, so its distinct bigrams alone bound its size."""
    low, high = least / (2 - least), (2 - least) / least
    grams = {name: g for name, t in texts.items() if (g := bigrams_of(t))}
    near = docs.select(F.col(id_col), F.col(text_col).alias("__text")).where(_may_be(F.col(text_col), list(grams.values()), least) if grams else F.lit(False))
    own = near.select(id_col, F.array_distinct(_bigrams(F.split(F.trim(F.lower(F.regexp_replace("__text", "[^A-Za-z0-9]+", " "))), " "))).alias("own"))
    each = [F.when(F.size("own").between(int(len(g) * low), int(len(g) * high) + 1), F.struct((-_dice(F.col("own"), F.array(*map(F.lit, g)))).alias("less"), F.lit(name).alias("licence"))) for name, g in grams.items()]
    each = each or [F.lit(None).cast("struct<less:double,licence:string>")]
    best = own.select(id_col, F.array_min(F.filter(F.array(*each), lambda c: c.isNotNull())).alias("b")).where(F.col("b.less") <= -least)
    return best.select(id_col, F.col("b.licence").alias("licence"), (-F.col("b.less")).alias("dice"))


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", texts: dict[str, str] | None = None) -> DataFrame:
    """id, ``licence``, ``sentences`` and ``dice`` (the best) for each licence that a document names: a notice names the one it
    is most like, the first by name of several; a document that is a whole licence (of ``texts``, TEXTS if null) names it as one
    more sentence."""
    spark = docs.sparkSession
    grams = [(name, bigrams_of(t)) for name, texts in templates.items() for t in texts]
    needed = needed_words([g for _, g in grams], least)
    low, high = least / (2 - least), (2 - least) / least
    known = [F.struct(F.lit(name).alias("licence"), F.array(*map(F.lit, g)).alias("template"), F.lit(max(1, int(-(-len(g) * low // 1)) - 1)).alias("low"), F.lit(int(len(g) * high) + 1).alias("high")) for name, g in grams]
    laid = spark.range(1).select(F.inline(F.array(*known)))
    reach = int(max((len(g) for _, g in grams), default=0) * high) + 2

    rows = docs.select(F.col(id_col), F.col(text_col).alias("__text")).where(F.col("__text").rlike(f"(?i)(?:{'|'.join(needed)})"))
    tagged = F.flatten(F.transform(sentence_words(F.col("__text")), lambda s: F.transform(s, lambda w, i: F.struct(w.alias("w"), i.alias("i"), F.size(s).alias("n")))))
    rows = rows.select(id_col, F.monotonically_increasing_id().alias("row"), tagged.alias("t")).where(F.size("t") > 1)
    # Every match holds a needed word, so sentences and windows around these are all that can match.
    places = F.filter(F.sequence(F.lit(1), F.size("t")), lambda p: F.get(F.col("t"), p - 1)["w"].isin(needed))
    at = rows.select(id_col, "row", "t", F.explode(places).alias("p")).withColumn("here", F.get("t", F.col("p") - 1))
    at = at.withColumns({"first": F.col("p") - F.col("here.i"), "from": F.greatest(F.col("p") - reach, F.lit(1))})
    cut = lambda a, n: F.transform(F.slice("t", a, n), lambda x: x["w"])
    at = at.select(id_col, "row", "p", "first", "from", F.col("here.n").alias("words"), F.array_distinct(_bigrams(cut(F.col("first"), F.col("here.n")))).alias("own"), _bigrams(cut(F.col("from"), F.col("p") - F.col("from") + reach + 1)).alias("zone"))
    # A sentence that equals a notice can't be bettered by a window that overlaps it.
    exact = F.array_join(F.array_sort("own"), "|").isin(["|".join(sorted(g)) for _, g in grams])
    at = at.withColumn("exact", exact)

    q = F.col("p") - F.col("from") + 1
    hits = F.filter(F.sequence(F.lit(1), F.size("zone")), lambda i: F.array_contains("template", F.get("zone", i - 1)))
    ends = lambda a: F.filter("hits", lambda b: (b >= q - 1) & (b - a + 1 >= F.col("low")) & (b - a + 1 <= F.col("high")))
    found = lambda start, end, whole, grams: F.struct((-_dice(grams, F.col("template"))).alias("less"), whole.alias("part"), (start - end).alias("shorter"), F.col("licence").alias("licence"), start.alias("start"), end.alias("end"), F.array_sort(grams).alias("grams"))
    window = lambda a, b: found(F.col("from") + a - 1, F.col("from") + b, F.lit(1), F.array_distinct(F.slice("zone", a, b - a + 1)))
    windows = F.flatten(F.transform(F.filter("hits", lambda a: a <= q), lambda a: F.transform(ends(a), lambda b: window(a, b))))
    sentence = F.array(found(F.col("first"), F.col("first") + F.col("words") - 1, F.lit(0), F.col("own")))
    each = at.crossJoin(F.broadcast(laid)).withColumn("hits", F.when(~F.col("exact") & (F.size(F.array_intersect("zone", "template")) >= F.col("low")), hits).otherwise(F.array().cast("array<int>")))
    each = each.select(id_col, "row", F.explode(F.filter(F.concat(sentence, windows), lambda c: -c["less"] >= least)).alias("c"))

    # Of overlapping ones the best counts: by coefficient, whole sentences before windows, longer before shorter ones.
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda done, c: F.when(F.exists(done, lambda d: (d["start"] <= c["end"]) & (c["start"] <= d["end"])), done).otherwise(F.concat(done, F.array(c))))
    named = each.groupBy(id_col, "row").agg(F.array_sort(F.collect_set("c")).alias("all")).select(id_col, F.explode(kept).alias("c"))
    best = named.groupBy(id_col, "c.grams").agg(F.min(F.struct("c.less", "c.licence")).alias("best"))
    whole = _whole(docs, TEXTS if texts is None else texts, least, id_col, text_col)
    both = best.select(id_col, F.col("best.licence").alias("licence"), (-F.col("best.less")).alias("dice")).unionByName(whole)
    return both.groupBy(id_col, "licence").agg(F.count("*").alias("sentences"), F.max("dice").alias("dice"))


def oracle(least: float = LEAST) -> str:
    """SQL for DuckDB that compares every sentence with every template."""
    known = ", ".join(f"('{name}', {bigrams_of(t)!r})" for name, texts in TEMPLATES.items() for t in texts)
    whole = ", ".join(f"('{name}', {bigrams_of(t)!r})" for name, t in TEXTS.items())
    return f"""
with template(licence, template) as (values {known}),
sentence as (select doc_id, unnest(string_split(regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), chr(10))) as s from documents),
words as (select doc_id, string_split(trim(lower(regexp_replace(s, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') as w from sentence),
grams as (select doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from words where len(w) > 1),
hit as (select doc_id, licence, list_sort(g) as g, cast(2.0 * len(list_intersect(g, template)) / (len(g) + len(template)) as double) as dice from grams, template),
best as (select *, row_number() over (partition by doc_id, g order by dice desc, licence) as place from hit where dice >= {least}),
full_text(licence, template) as (values {whole}), text_words as (select doc_id, string_split(trim(lower(regexp_replace(text, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') as w from documents where text ilike '%software%'),
text_grams as (select doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from text_words where len(w) > 1),
text_hit as (select doc_id, licence, cast(2.0 * len(list_intersect(g, template)) / (len(g) + len(template)) as double) as dice from text_grams, full_text), text_best as (select *, row_number() over (partition by doc_id order by dice desc, licence) as place from text_hit where dice >= {least}),
named as (select doc_id, licence, dice from best where place = 1 union all select doc_id, licence, dice from text_best where place = 1)
select doc_id, licence, count(*) as sentences, max(dice) as dice from named group by doc_id, licence"""
