"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest directory.

Units are the lines of a file, its runs of adjacent lines (headers over several lines; a
line without letters or digits ends a run) and its whole text. Words weigh (1 + ln tf) * idf, with idf from
the document frequencies over all files and templates; words that no template has share
the idf of a word never seen. Templates are short licences in full, notices that the licences' texts recommend,
titles of long licences, and identifier tags, each with the cosine that it asks for (titles
and tags stand for exact wordings and ask for more). A file's own licence is the template nearest to one of its
lines or runs; a file whose whole text is near a licence or notice, or that has a title, is a licence file of its
directory. A file without a licence of its own takes that of the nearest ancestor
directory with a licence file (of several, the most similar, then the least path).

Only units that can reach a template's cosine are compared, and none that can is left out: the words
of a template are ordered by weight, and those after the first few have together a norm below its cosine, so that a
unit without one of the first few can't reach it.

Only the templates' words and their weights are broadcast or known to the driver: their number is
fixed by the templates, whatever the corpus. Ancestors are joined by path, a row for each level; nothing
is compared in pairs.

Null texts are empty and have no licence; null path parts give the file no directory but the root's; repeated
rows get repeated results, rows of one path with different texts their own; ties go to the least template;
very long texts are many units; empty tables give empty results; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.shared import written

# The wording of the licences and of the notices that they recommend.

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
MIT = f"""{_GRANT} (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
_BSD_1_2 = """: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = """ THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."


def _gnu(name: str, version: str) -> list[str]:
    first = f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    rest = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy of the GNU {name} along with this program. If not, see https://www.gnu.org/licenses/."
    return [f"This work is licensed under the GNU {name}, version {version}.", f"Licensed under the GNU {name}, version {version}.", first, f"{first} {rest}"]


TEXT, NOTICE, TITLE, TAG = "text", "notice", "title", "tag"
#: The cosine that each kind of template asks for.
LEAST = {TEXT: 0.6, NOTICE: 0.6, TITLE: 0.85, TAG: 0.97}
TEMPLATES = {
    "MIT": {TEXT: [MIT, f"MIT License {MIT}"], NOTICE: ["Released under the MIT License.", f"{_GRANT}, to deal in the software without restriction."]},
    "Apache-2.0": {NOTICE: ["Licensed under the Apache License, Version 2.0.", APACHE.split(" You may obtain")[0], APACHE], TITLE: ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "Apache License Version 2.0, January 2004"]},
    "GPL-2.0": {NOTICE: _gnu("General Public License", "2"), TITLE: ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991"]},
    "GPL-3.0": {NOTICE: _gnu("General Public License", "3"), TITLE: ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]},
    "LGPL-2.1": {NOTICE: _gnu("Lesser General Public License", "2.1"), TITLE: ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"]},
    "LGPL-3.0": {NOTICE: _gnu("Lesser General Public License", "3"), TITLE: ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"]},
    "AGPL-3.0": {NOTICE: _gnu("Affero General Public License", "3"), TITLE: ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"]},
    "BSD-2-Clause": {TEXT: [_BSD + _BSD_1_2 + _BSD_AS_IS], NOTICE: ["Licensed under the BSD 2-Clause License."]},
    "BSD-3-Clause": {TEXT: [_BSD + _BSD_1_2 + _BSD_3 + _BSD_AS_IS], NOTICE: ["Licensed under the BSD 3-Clause License.", f"{_BSD}."]},
    "ISC": {TEXT: [ISC], NOTICE: ["Licensed under the ISC License."]},
    "Zlib": {TEXT: [ZLIB], NOTICE: ["Licensed under the zlib License."]},
    "Unlicense": {TEXT: [UNLICENSE]},
    "MPL-2.0": {NOTICE: [MPL, f"{MPL} If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."], TITLE: ["Mozilla Public License Version 2.0"]},
    "CC-BY-4.0": {NOTICE: ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."], TITLE: ["Creative Commons Attribution 4.0 International Public License"]},
    "CC-BY-SA-4.0": {NOTICE: ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."], TITLE: ["Creative Commons Attribution-ShareAlike 4.0 International Public License"]},
    "CC-BY-NC-4.0": {NOTICE: ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."], TITLE: ["Creative Commons Attribution-NonCommercial 4.0 International Public License"]},
    "CC0-1.0": {NOTICE: ["Released into the public domain under CC0 1.0 Universal."], TITLE: ["Creative Commons Legal Code CC0 1.0 Universal"]},
}
WORD = r"[a-z0-9]+"
#: What parts the runs of a lower-cased text.
GAP = r"\n[^a-z0-9\n]*\n"


def template_rows() -> list[tuple[int, str, str, float, str]]:
    """Number, licence, kind, least cosine and text of each template."""
    rows = [(name, kind, text) for name, kinds in TEMPLATES.items() for kind, texts in kinds.items() for text in texts]
    rows += [(name, TAG, f"SPDX-License-Identifier: {name}{more}") for name in TEMPLATES for more in (("", "-only", "-or-later") if "GPL" in name else ("",))]
    return [(k, name, kind, LEAST[kind], text) for k, (name, kind, text) in enumerate(rows)]


def _words(text: str = "text") -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _terms(units: DataFrame, key: list[str]) -> DataFrame:
    return units.select(*key, F.explode("words").alias("word")).groupBy(*key, "word").agg((1 + F.log(F.count("*").cast("double"))).alias("tf"))


def _first_words(weights: dict[int, dict[str, float]], least: dict[int, float]) -> set[str]:
    """Words of which a unit must have one to reach the cosine of some template."""
    out: set[str] = set()
    for t, own in weights.items():
        rest = sum(w * w for w in own.values())
        bound = (least[t] - 1e-5) ** 2 * rest
        for word, w in sorted(own.items(), key=lambda x: (-x[1], x[0])):
            if rest < bound:
                break
            out.add(word)
            rest -= w * w
    return out


def scan(files: DataFrame) -> DataFrame:
    """path, license, similarity, origin (header, file, inherited or none) and from_dir, for each row of ``files`` (path, text)."""
    spark = files.sparkSession
    own = files.select(F.coalesce("path", F.lit("")).alias("path"), F.col("text").cast("string").alias("text")).withColumn("id", F.xxhash64("path", "text"))
    templates = spark.createDataFrame(template_rows(), "template int, license string, kind string, least double, text string")
    shown = _terms(templates.select("template", _words().alias("words")), ["template"]).collect()  # as many as the templates have
    least = {t: x for t, _, _, x, _ in template_rows()}
    vocabulary = sorted({r.word for r in shown})

    # idf of the templates' words
    listed = F.array(*map(F.lit, vocabulary))
    counted = own.select(F.explode(F.array_append(F.array_intersect(_words(), listed), F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    df = {r.word: r.df for r in counted.collect()}  # at most one for each word of the templates; "" counts the files
    total = df.pop("", 0) + len(least)
    for r in shown:
        df[r.word] = df.get(r.word, 0) + 1
    idf = {w: math.log((1 + total) / (1 + n)) + 1 for w, n in df.items()}
    unseen = math.log(1 + total) + 1
    weights: dict[int, dict[str, float]] = {}
    for r in shown:
        weights.setdefault(r.template, {})[r.word] = r.tf * idf[r.word]
    norm = {t: math.sqrt(sum(w * w for w in x.values())) for t, x in weights.items()}
    of = [(w, idf[w], [(t, weights[t][w] / norm[t]) for t in weights if w in weights[t]]) for w in vocabulary]
    by_word = F.broadcast(spark.createDataFrame(of, "word string, idf double, of array<struct<template:int,x:double>>"))
    known = F.broadcast(templates.select("template", "license", "kind", "least"))

    # units that can reach a template
    needed = F.array(*map(F.lit, sorted(_first_words(weights, least))))
    near = own.where(F.arrays_overlap(_words(), needed)).select("id", "path", F.lower("text").alias("text")).distinct()
    lines = near.select("id", F.posexplode(F.split("text", "\n")).alias("n", "text")).withColumn("n", 2 * F.col("n"))
    runs = near.select("id", F.posexplode(F.split("text", GAP)).alias("n", "text")).where(F.instr("text", "\n") > 0).withColumn("n", 2 * F.col("n") + 1)
    units = lines.unionByName(runs).unionByName(near.select("id", F.lit(-1).alias("n"), "text"))
    units = units.select("id", "n", _words().alias("words")).where(F.arrays_overlap("words", needed))
    terms = written(_terms(units, ["id", "n"]))

    weighed = terms.join(by_word, "word", "left").select("id", "n", (F.col("tf") * F.coalesce("idf", F.lit(unseen))).alias("w"), "of")
    lengths = weighed.groupBy("id", "n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    dots = weighed.where("of is not null").select("id", "n", "w", F.inline("of")).groupBy("id", "n", "template").agg(F.sum(F.col("x") * F.col("w")).alias("dot"))
    cosines = dots.join(lengths, ["id", "n"]).join(known, "template").withColumn("similarity", F.round(F.col("dot") / F.col("length"), 6)).where("similarity >= least")
    # a title makes its file a licence file, wherever it stands
    kinds = F.when(F.col("kind") == TITLE, F.array(F.lit("file"))).when(F.col("n") < 0, F.when(F.col("kind") == TAG, F.array()).otherwise(F.array(F.lit("file")))).otherwise(F.array(F.lit("header")))
    best = cosines.select("id", F.explode(kinds).alias("kind"), "template", "license", "similarity").groupBy("id", "kind").agg(
        F.max(F.struct("similarity", (-F.col("template")).alias("least"), "license")).alias("best")
    )
    best = written(best.select("id", "kind", "best.license", "best.similarity"))

    level = F.split("path", "/")
    directory = F.array_join(F.slice(level, 1, F.size(level) - 1), "/")
    kept = best.where("kind = 'file'").join(near.select("id", "path"), "id").withColumn("dir", directory)
    kept = kept.groupBy("dir").agg(F.min(F.struct((-F.col("similarity")).alias("s"), "path", "license")).alias("of")).select("dir", F.col("of.license").alias("dir_license"), (-F.col("of.s")).alias("dir_similarity"))
    headers = best.groupBy("id").agg(F.min(F.struct(F.when(F.col("kind") == "header", 0).otherwise(1).alias("o"), "kind", "license", "similarity")).alias("own"))

    paths = own.select("path").distinct()
    above = paths.withColumn("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(level) - 1), lambda k: F.array_join(F.slice(level, 1, k), "/")))).withColumn("depth", F.size(F.split("dir", "/")) - F.when(F.col("dir") == "", 1).otherwise(0))
    inherited = above.join(kept, "dir").groupBy("path").agg(F.max_by(F.struct("dir", "dir_license", "dir_similarity"), "depth").alias("from"))
    out = own.select("path", "id").join(headers, "id", "left").join(inherited, "path", "left")
    has = F.col("own").isNotNull()
    return out.select(
        "path",
        F.coalesce("own.license", "from.dir_license").alias("license"),
        F.coalesce("own.similarity", "from.dir_similarity").alias("similarity"),
        F.when(has, F.col("own.kind")).when(F.col("from").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has, F.col("from.dir")).alias("from_dir"),
    )
