"""License scans: Dice coefficient over word bigrams against licence templates.

Passages are a document's lines, its paragraphs - taken one by one and in runs, comment marks at the
beginning of lines left out - and the whole text. Passages and templates are normalised to lower-case
words without marks, numbers kept. A text is read in full only if it holds an anchor word: so many of a
template's bigrams have one that no passage without one can reach the wanted coefficient. A passage is
compared with a template only if their bigram counts allow it, and only through bigrams they share:
passages' bigrams are hash-joined with an index of the templates', never with the templates as such.
"""

from __future__ import annotations

import re
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, with_found

#: The Dice coefficient from which a passage is a template's.
DICE = 0.8
#: Paragraphs in a run at most.
RUN = 6
#: What begins a line of a comment, and is no part of its text.
COMMENT = r"(?m)^[ \t]*(?:/\*+|\*+/|\*+|//+|#+|;+|--|<!--|%+|>+)?[ \t]*"
#: Words that every text has; other words make better anchors.
COMMON = "a an and any are as at be by for from if in into is it its may no not of on or such that the their then there these this to under use was will with you".split()
#: Bigrams of all templates together that may be broadcast (the default set has under 2000).
BROADCAST_BIGRAMS = 1_000_000

#: Licence notices and texts.
TEMPLATES = {
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-notice": "Released under the MIT License.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def normalised(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, one space between them; other characters separate."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def bigrams(normal: Column) -> Column:
    """array of distinct word pairs of a normalised text; a single word stands for itself, no word: none."""

    def all_of(words: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.concat(F.get(words, i - 1), F.lit(" "), F.get(words, i)))
        return F.when(F.size(words) == 1, words).otherwise(F.array_distinct(pairs))

    return F.when(normal == "", F.array().cast("array<string>")).otherwise(let(F.split(normal, " "), all_of))


def passages(text: Column) -> Column:
    """array of a text's lines, runs of up to RUN of its paragraphs, and itself."""
    bare = F.split(F.regexp_replace(text, "(?d)" + COMMENT, ""), r"\n(?:[ \t\r]*\n)+")

    def runs(paragraphs: Column) -> Column:
        n = F.size(paragraphs)
        starts = F.sequence(F.lit(1), n)
        return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(RUN), n - i + 1)), lambda k: F.array_join(F.slice(paragraphs, i, k), "\n"))))

    return F.array_distinct(F.concat(F.split(text, "\n"), let(bare, runs), F.array(text)))


def anchors(templates: dict[str, str], dice: float) -> list[str] | None:
    """Words of which every passage within reach of a template has one: such a passage holds the share
    dice / (2 - dice) of the template's bigrams, and more of them than may be missing have an anchor.
    None if a template has too few words for that."""
    found = set()
    for body in templates.values():
        words = re.sub("[^a-z0-9]+", " ", body.lower()).split()
        if len(words) < 2:
            found |= set(words)
            continue
        pairs = set(zip(words, words[1:]))
        spare = len(pairs) - ceil(len(pairs) * dice / (2 - dice) - 1e-9)
        held, own = set(), set()
        for w in sorted(set(words), key=lambda w: (w in COMMON, -len(w), w)):
            if len(held) > spare:
                break
            own.add(w)
            held |= {p for p in pairs if w in p}
        if len(held) <= spare:
            return None
        found |= own
    return sorted(found)


def template_index(spark: SparkSession, templates: dict[str, str], dice: float) -> DataFrame:
    """(bigram, license, size, least, most): each template's bigrams, its size, and the sizes a passage may have."""
    rows = spark.createDataFrame(sorted(templates.items()), "license string, body string")
    each = rows.select("license", bigrams(normalised(F.col("body"))).alias("b")).withColumn("size", F.size("b"))
    return each.select(F.explode("b").alias("bigram"), "license", "size", F.ceil(F.col("size") * (dice / (2 - dice)) - 1e-9).cast("int").alias("least"), F.floor(F.col("size") * ((2 - dice) / dice) + 1e-9).cast("int").alias("most"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, dice: float = DICE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, license (of the largest coefficient, then of the first name; null if
    none), dice (rounded to 6 places; null if none), licenses (how many templates were found).

    Null and wordless texts have no licence. Rows that repeat an id are scanned each and report
    the same; rows with a null id report nothing; an empty table gives an empty result.
    """
    if not 0 < dice <= 1:
        raise ValueError("dice must be over 0 and at most 1")
    templates = TEMPLATES if templates is None else templates
    index = template_index(docs.sparkSession, templates, dice)
    words = [len(t.split()) for t in templates.values()]
    longest = floor((2 - dice) / dice * 2 * max(words, default=0)) + 2
    shortest = max(1, ceil(dice / (2 - dice) * 1))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words_in = anchors(templates, dice)
    able = docs if words_in is None else docs.where(F.exists(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w.isin(words_in))) if words_in else docs.limit(0)
    base = able.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.array_distinct(F.filter(F.transform(passages(text), normalised), lambda p: p != ""))).alias("at", "normal"))
    sized = base.select("doc_id", "at", bigrams(F.col("normal")).alias("b")).withColumn("n", F.size("b")).where(F.col("n").between(shortest, longest))
    kept = sized.select("doc_id", "at", "n", F.explode("b").alias("pair")).where("doc_id is not null")
    right = F.broadcast(index) if sum(words) <= BROADCAST_BIGRAMS else index
    met = kept.join(right, (F.col("pair") == F.col("bigram")) & F.col("n").between(F.col("least"), F.col("most")))
    shared = met.groupBy("doc_id", "at", "license", "n", "size").agg(F.count("*").alias("both"))
    scored = shared.withColumn("dice", F.round(2 * F.col("both") / (F.col("n") + F.col("size")), 6)).where(F.col("dice") >= dice)
    best = F.min_by("license", F.struct(-F.col("dice"), F.col("license")))
    found = scored.groupBy("doc_id").agg(best.alias("license"), F.max("dice").alias("dice"), F.size(F.collect_set("license")).alias("licenses"))
    out = with_found(docs, found, id_col)
    return out.select("doc_id", "license", "dice", F.coalesce("licenses", F.lit(0)).alias("licenses"))
