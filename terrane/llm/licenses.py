"""License texts and notices by MinHash bands over overlapping windows, in SQL expressions only.

Templates fall into classes by length; the windows of a class are four to two times
as long as its templates and overlap by half, so every template lies whole in one and
makes up about a quarter of its shingles at least. Each band is one MinHash: with 32
of them a window that holds its template whole shares a band with a probability over
0.9999, one that holds four fifths of it over 0.998. Windows and templates meet by
equal bands, and candidates are confirmed by the share of the template's shingles in
the window.

A band of a window equals a template's only if the shingle of the template's least
hash lies in the window. So only windows around such shingles, one for each band of
each template, get a signature: the others cannot share a band.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality import let

SHINGLE = 3
#: Signatures of templates (rows) up to which their table is broadcast; they do not grow with the corpus.
BROADCAST_ROWS = 100_000
WARRANTY = (
    "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. "
)
#: License texts and notices in their usual wording, by license.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        'The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", ' + WARRANTY,
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        GPL.format(""),
    ],
    "agpl-3.0": [GPL.format("Affero ")],
    "lgpl-3.0": [GPL.format("Lesser ")],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-2-clause": [BSD_HEAD + BSD_TAIL],
    "bsd-3-clause": [BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. " + BSD_TAIL],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    "bsl-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
}


def template_words(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def doc_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def window_of(n: int) -> int:
    """Words of the windows for templates of n words: 12, 24, 48, ..."""
    w = 12
    while n > w // 2 + 1:
        w *= 2
    return w


def shingles(words: Column) -> Column:
    """Distinct hashes of three words in a row."""
    at = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    return F.when(F.size(words) < SHINGLE, F.array().cast("array<bigint>")).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), at)))


def signature(s: Column, bands: int) -> Column:
    def least(k: int) -> Column:
        return F.array_min(F.transform(s, lambda x: F.xxhash64(x, F.lit(k))))

    return F.array(*[least(k) for k in range(bands)])


def template_table(spark: SparkSession, templates: dict[str, list[str]]) -> DataFrame:
    """license, template (its number), width (of its windows), shingles."""
    rows, n = [], 0
    for name, texts in sorted(templates.items()):
        for text in texts:
            words = template_words(text)
            if len(words) < SHINGLE:
                raise ValueError(f"a template needs {SHINGLE} words: {text!r}")
            rows.append({"license": name, "template": n, "width": window_of(len(words)), "words": words})
            n += 1
    form = "array<struct<license: string, template: int, width: int, words: array<string>>>"
    table = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), form)))
    return table.select("license", "template", "width", shingles(F.col("words")).alias("shingles"))


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, least: float = 0.8, bands: int = 32) -> DataFrame:
    """doc_id, license, containment, first_word, n_windows: the licenses whose text or notice a document holds.

    docs: doc_id, text. Words are runs of ASCII letters and digits, in lower case. A
    template counts when a window holds at least ``least`` of its distinct shingles;
    containment is the largest share, first_word where the first such window begins,
    n_windows how many windows match. Null and empty texts match nothing; very long
    texts are scanned whole; rows that repeat a doc_id (null ids among them) are one
    document; other columns are ignored, whatever their names; an empty table gives an
    empty one. Sent to all: the templates' bands, ``bands`` rows for each template.
    """
    templates = TEMPLATES if templates is None else templates
    known = template_table(docs.sparkSession, templates)
    # the shingle of least hash of each band of each template
    least_of = lambda k: F.array_min(F.transform("shingles", lambda x: F.struct(F.xxhash64(x, F.lit(k)).alias("hash"), x.alias("shingle"))))["shingle"]
    marks = sorted({x for row in known.select(F.array(*[least_of(k) for k in range(bands)])).collect() for x in row[0]})
    widths = sorted({window_of(len(template_words(t))) for texts in templates.values() for t in texts})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    # values are bound once by let: a filter on them would be pushed down and split the text for every word
    def hits(words: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))
        return F.filter(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]).isin(marks))

    def windows(words: Column, places: Column, width: int) -> Column:
        step = width // 2
        both = F.transform(places, lambda p: F.filter(F.array(F.floor(p / step) - 1, F.floor(p / step)), lambda j: j >= 0))
        cut = lambda j: F.struct(F.lit(width).alias("width"), (j * step).alias("first_word"), F.slice(words, (j * step + 1).cast("int"), F.lit(width)).alias("words"))
        return F.transform(F.array_distinct(F.flatten(both)), cut)

    around = let(doc_words(F.col("text")), lambda w: let(hits(w), lambda h: F.concat(*[windows(w, h, k) for k in widths])))
    wins = rows.select("doc_id", F.explode(around).alias("w")).select("doc_id", "w.width", "w.first_word", "w.words")
    keyed = wins.withColumn("s", let(shingles(F.col("words")), lambda f: F.struct(f.alias("found"), signature(f, bands).alias("bands"))))
    keyed = keyed.select("doc_id", "width", "first_word", F.col("s.found").alias("found"), F.posexplode("s.bands").alias("band", "value"))
    # one row for each band of each template
    sought = known.withColumn("bands", signature(F.col("shingles"), bands)).select("license", "template", "width", "shingles", F.posexplode("bands").alias("band", "value"))
    small = sum(map(len, templates.values())) * bands <= BROADCAST_ROWS
    cand = keyed.join(F.broadcast(sought) if small else sought, ["width", "band", "value"])
    share = F.size(F.array_intersect("shingles", "found")) / F.size("shingles")
    match = cand.select("doc_id", "license", "width", "first_word", share.alias("share")).where(F.col("share") >= least)
    return match.groupBy("doc_id", "license").agg(
        F.round(F.max("share"), 6).alias("containment"), F.min("first_word").cast("long").alias("first_word"), F.countDistinct("width", "first_word").alias("n_windows")
    )
