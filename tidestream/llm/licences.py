"""Licence scans in DataFrame functions only.

A file's headers and lines that speak of licensing are compared with templates (declaring sentences, standard notices, titles and
whole short licences) by the cosine of sparse TF-IDF vectors; a file's own licence is its best passage's best template, from the
template's least score on. Passages are single sentences and lines (of an SPDX expression each licence that it names), paragraphs without comment marks, and the whole of a file that is
named as a licence file. Document frequencies are those of all files' passages and the templates. A licence file (by its name, or
because licence passages make up LICENCE_SHARE of its words) gives its licence to its directory, and a file without one of its own takes
that of its nearest ancestor directory, found by joining the distinct directories' ancestor paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidestream.llm import common as C

#: Least cosine of a match, that of a template of few words beside its name; share of a file's words from which passages make it a
#: licence file.
LEAST, LEAST_TAG, LICENCE_SHARE = 0.6, 0.95, 0.5
# Sentences by which licences are declared, the notices and titles that they prescribe, and whole short licences.
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_CLAUSES = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_NO_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'
_NO_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", _CLAUSES + " " + _AS_IS),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", _CLAUSES + " " + _NO_NAMES + " " + _AS_IS),
    ("BSD-3-Clause", _NO_NAMES),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", _ISC),
    ("ISC", _ISC + ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", _GRANT),
    ("MIT", _GRANT + " " + _NO_WARRANTY),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
)
#: Identifiers of licences with versions of a text that may be later ones.
_OR_LATER = ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")
#: What a passage must match to be compared; every template does.
MENTION = r"(?i)licen[cs]|spdx|permission (is|to use)|redistribut|public domain|free software|free to copy|without (any )?warrant|prior written permission"
NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense)(\.[^/]*)?$"
#: An SPDX expression in a line, and what parts the licences that it names: its operators, brackets, and exceptions with their names.
TAG, OPERATORS = r"(?i)SPDX-License-Identifier:[ \t]*([^\r\n]*)", r"(?i)[()]|[ \t]+(?:or|and)[ \t]+|[ \t]+with[ \t]+[^ \t()]+"
#: What parts sentences and lines, and what a paragraph of more than one holds; marks of comments where lines begin and end, and what
#: parts paragraphs.
SENTENCE, MORE = r"\n|(?<=[.!?])\s+", r"(\n|[.!?]\s)[\s\S]*\w"
BEGIN, END, BLANK = r"(^|\n)[ \t]*(?:/\*+|\*+/|\*|//+|#+|--+|;+|%+|<!--)?[ \t]*", r"[ \t]*(\*+/|-->)", r"\n[ \t\r]*\n"


def all_templates() -> list[tuple[str, str, float]]:
    """(licence, text, least score): TEMPLATES, and the tag of each licence, which must stand as it is."""
    names = sorted({n for n, _ in TEMPLATES})
    tags = [(n, n) for n in names] + [(n, f"{n}-{x}") for n in _OR_LATER for x in ("only", "or-later")]
    return [(n, t, LEAST) for n, t in TEMPLATES] + [(n, f"SPDX-License-Identifier: {t}", LEAST_TAG) for n, t in tags]


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9.]+|\\.(?![0-9])", -1), lambda x: x != "")


def _vectors(rows: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """(key, term, weight): unit vectors of the term counts of rows (key, terms) times idf."""
    counts = rows.select(key, F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf")).join(idf, "term")
    norms = counts.groupBy(key).agg(F.sqrt(F.sum((F.col("tf") * F.col("idf")) ** 2)).alias("norm"))
    return counts.join(norms, key).select(key, "term", (F.col("tf") * F.col("idf") / F.col("norm")).alias("weight"))


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(i, *t) for i, t in enumerate(all_templates())]
    return spark.createDataFrame(rows, "template long, licence string, text string, least double").withColumn("terms", terms(F.col("text")))


def tagged(line: Column) -> Column:
    """A tag of its own for each licence that an SPDX expression in line names; other lines as they are."""
    named = F.filter(F.split(F.regexp_extract(line, TAG, 1), OPERATORS, -1), lambda x: x.rlike("[A-Za-z0-9]"))
    return F.when(F.size(named) > 0, F.transform(named, lambda x: F.concat(F.lit("SPDX-License-Identifier: "), F.btrim(x)))).otherwise(F.array(line))


def passages(files: DataFrame) -> DataFrame:
    """(doc_id, path, words, single, id, passage) of the passages that speak of licensing, one row each; single: a sentence or line, else a
    paragraph that is more than that, or a whole licence file."""
    speaking = files.filter(F.col("text").rlike(MENTION))
    bare = F.regexp_replace(F.regexp_replace("text", BEGIN, "$1"), END, "")
    rows = speaking.select("doc_id", "path", "text", F.size(C.word_array(F.col("text"))).alias("words"), bare.alias("bare"))
    unit = lambda single, passage: F.struct(F.lit(single).alias("single"), passage.alias("passage"))
    flat = lambda x: F.btrim(F.regexp_replace(x, r"[ \t\n\x0b\f\r]+", " "))
    lines = F.filter(F.split("text", SENTENCE, -1), lambda x: x.rlike(MENTION))
    singles = F.transform(F.flatten(F.transform(lines, lambda x: tagged(F.btrim(x, F.lit(C.SPACES))))), lambda x: unit(True, x))
    larger = F.transform(F.filter(F.split("bare", BLANK, -1), lambda x: x.rlike(MENTION) & x.rlike(MORE)), lambda x: unit(False, flat(x)))
    whole = F.when(F.col("path").rlike(NAMED), F.array(unit(False, flat(F.col("bare")))))
    found = rows.select("doc_id", "path", "words", F.explode_outer(F.concat(singles, larger, F.coalesce(whole, F.slice(larger, 1, 0)))).alias("u"))
    return found.filter("u is not null").select("doc_id", "path", "words", "u.single", F.md5(F.col("u.passage").cast("binary")).alias("id"), "u.passage")


def scored(found: DataFrame) -> DataFrame:
    """(id, licence, score) of the distinct passages that match a template; ties go to the first licence by name."""
    spark = found.sparkSession
    counts = found.groupBy("id", "passage").agg(F.count("*").alias("files"))  # a passage of many files is compared once
    texts = C.checkpointed(counts.select("id", "files", terms(F.col("passage")).alias("terms")))
    templates = _templates(spark)
    uses = texts.select("files", F.explode(F.array_distinct("terms")).alias("term")).unionByName(templates.select(F.lit(1).cast("long").alias("files"), F.explode(F.array_distinct("terms")).alias("term")))
    total = (texts.agg(F.sum("files")).first()[0] or 0) + len(all_templates())
    idf = C.checkpointed(uses.groupBy("term").agg((F.log((F.lit(1.0) + total) / (F.sum("files") + 1)) + 1).alias("idf")))
    sparse = _vectors(templates, "template", idf).join(templates.select("template", "licence", "least"), "template")  # bounded by TEMPLATES
    shared = _vectors(texts, "id", idf).join(F.broadcast(sparse.withColumnRenamed("weight", "w")), "term")
    cosine = shared.groupBy("id", "template", "licence", "least").agg(F.round(F.sum(F.col("weight") * F.col("w")), 9).alias("score")).filter("score >= least")
    best = cosine.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"))
    return best.select("id", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"))


def _parent(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def licences(files: DataFrame) -> DataFrame:
    """doc_id, path, own_licence, own_score, licence, source_path (the directory it is inherited from, if it is), own_licences (all that any
    of its passages match, by name with blanks between: those of "MIT OR Apache-2.0", of which own_licence is the first; null if none).

    files: doc_id, path, text. Null text: none of its own. Null path: as if in a directory of no parents that it shares
    with none, so it inherits nothing. A directory's licence is that of its licence file with the highest score, then
    of the first path and doc_id. LICENCE_SHARE looks at the single passages' words, or at those of the larger ones that match. Rows are
    told apart by doc_id and path; equal ones take the best of theirs."""
    found = C.checkpointed(passages(files.select("doc_id", "path", "text")))
    best = C.checkpointed(scored(found))
    size = F.col("n")
    sizes = found.select("doc_id", "path", "words", "single", "id", F.size(C.word_array(F.col("passage"))).alias("n"))
    per_file = sizes.join(best, "id", "left").groupBy("doc_id", "path").agg(
        F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("s"), "licence"))).alias("best"),
        F.greatest(F.sum(F.when(F.col("single"), size).otherwise(0)), F.sum(F.when(F.col("score").isNotNull() & ~F.col("single"), size).otherwise(0))).alias("licence_words"),
        F.max("words").alias("words"),
        F.array_join(F.array_sort(F.collect_set("licence")), " ").alias("own_licences"),  # at most as many as TEMPLATES has
    )
    own = C.checkpointed(per_file.filter("best is not null").select("doc_id", "path", F.col("best.licence").alias("own_licence"), (-F.col("best.s")).alias("own_score"), "own_licences", (F.col("path").rlike(NAMED) | (F.col("licence_words") >= LICENCE_SHARE * F.col("words"))).alias("gives")))
    rank = F.struct((-F.col("own_score")).alias("s"), "path", "doc_id", "own_licence")
    given = C.checkpointed(own.filter("gives and path is not null").groupBy(_parent(F.col("path")).alias("ancestor")).agg(F.min(rank).alias("r")).select("ancestor", F.col("r.own_licence").alias("given")))
    directories = C.checkpointed(files.select(_parent(F.col("path")).alias("directory")).filter("directory is not null").distinct())
    steps = F.split("directory", "/", -1)
    above = directories.withColumn("depth", F.explode(F.sequence(F.lit(1), F.size(steps)))).select("directory", "depth", F.array_join(F.slice(steps, 1, F.col("depth")), "/").alias("ancestor"))
    near = C.left_join_small(above, given, "ancestor", F.col("directory")).filter("given is not null")
    near = C.checkpointed(near.groupBy("directory").agg(F.max(F.struct("depth", "given", "ancestor")).alias("n")).select("directory", F.col("n.given").alias("given"), F.col("n.ancestor").alias("ancestor")))
    mine = own.select(F.col("doc_id").alias("__doc"), F.col("path").alias("__path"), "own_licence", "own_score", "own_licences")
    rows = files.select("doc_id", "path", _parent(F.col("path")).alias("directory"))
    rows = rows.join(mine, F.col("doc_id").eqNullSafe(F.col("__doc")) & F.col("path").eqNullSafe(F.col("__path")), "left").drop("__doc", "__path")
    rows = C.left_join_small(rows, near, "directory", F.col("doc_id"))
    inherited = F.col("own_licence").isNull() & F.col("given").isNotNull()
    return rows.select("doc_id", "path", "own_licence", "own_score", F.coalesce("own_licence", "given").alias("licence"), F.when(inherited, F.col("ancestor")).alias("source_path"), "own_licences")
