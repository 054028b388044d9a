"""Licence detection by sparse TF-IDF cosine, with inheritance from the nearest ancestor directory.

What is compared with licence templates: each line that could match, the blocks of 2, 4 and 8
lines that begin, end or have their middle there (headers are wrapped), and the whole of a licence file. A unit matches a
template if its cosine reaches the threshold and it holds the terms that tell the licence from
others (`must`), and leads every other licence by `MARGIN`. A line could match only if it holds
one of the terms without which no template reaches the threshold (`_needed`), so no other line is
taken apart. Document frequencies of the templates' terms are counted over all lines of all
files; other terms count as unseen.

A file has the licence of its best unit; templates of a family (a line that several licences
share) count only where nothing closer matches. A licence file, by name or, if its name has no
ending or that of plain text, because half of its words or more stand in matching lines or
blocks, gives its licence to its directory; a source file with a header does not. A file without
a licence inherits from the nearest ancestor directory that has one (ties: the least path).

DataFrame operations only. Null texts have no lines; a null path has no directory and
inherits nothing; repeated rows get equal results, and an empty table an empty one. Other
columns are ignored. Rows are told apart by 128 bits of a hash of id, path and text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import stored, table

THRESHOLD = 0.6
MARGIN = 0.02
#: Lines in a unit round each line that could match.
BLOCKS = (1, 2, 4, 8)
#: Directories that inherit and are broadcast at most; more are joined by shuffle.
BROADCAST_DIRS = 200_000

# ---- fixed values: public licences' names, headers and short texts. (licence, terms that must be there, text)
_PERMISSION = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_REST = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_TWO = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "it under the terms of the GNU {} as published by the Free Software Foundation"
_GNU_PARAGRAPH = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_NAMES = [  # SPDX id, terms that must be there, name in prose
    ("MIT", "mit", "MIT License"),
    ("Apache-2.0", "apache 2", "Apache License, Version 2.0"),
    ("GPL-2.0", "gpl 2", "GPL-2.0"),
    ("GPL-3.0", "gpl 3", "GPL-3.0"),
    ("GPL-2.0", "general 2", "GNU General Public License, version 2"),
    ("GPL-3.0", "general 3", "GNU General Public License, version 3"),
    ("LGPL-2.1", "lesser 2 1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "lesser 3", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "affero 3", "GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "bsd 2", "BSD 2-Clause License"),
    ("BSD-3-Clause", "bsd 3", "BSD 3-Clause License"),
    ("MPL-2.0", "mozilla 2", "Mozilla Public License 2.0"),
    ("MPL-2.0", "mpl 2", "MPL-2.0"),
    ("ISC", "isc", "ISC License"),
    ("CC0-1.0", "cc0", "CC0 1.0"),
    ("CC-BY-4.0", "cc by 4", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "cc by sa 4", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "cc by nc 4", "CC BY-NC 4.0"),
    ("CC-BY-4.0", "commons attribution 4", "Creative Commons Attribution 4.0 International License"),
    ("Unlicense", "unlicense", "The Unlicense"),
]
_SPDX = [("LGPL-2.1", "lgpl 2 1"), ("LGPL-3.0", "lgpl 3"), ("AGPL-3.0", "agpl 3")]
TEMPLATES: list[tuple[str, str, str]] = [
    *((name, must, text) for name, must, prose in _NAMES for text in (f"Licensed under the {prose}.", f"This work is licensed under the {prose}.", f"Released under the {prose}.")),
    ("MIT", "mit license", "The MIT License (MIT)"),
    ("Apache-2.0", "apache license 2", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "general license 2", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "general license 3", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "lesser license 2 1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "affero license 3", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "mozilla license 2", "Mozilla Public License Version 2.0"),
    *((name, must, f"SPDX-License-Identifier: {name}") for name, must, prose in [*((n, m, "") for n, m, _ in _NAMES if " " not in n and not set(m.split()) & {"general", "lesser", "affero", "mozilla", "commons"}), *((n, m, "") for n, m in _SPDX)]),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "apache 2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MIT", "hereby granted sublicense", _PERMISSION),
    ("MIT", "hereby granted", _PERMISSION.partition(" (the")[0]),
    ("MIT", "hereby granted sublicense", f"{_PERMISSION} {_MIT_REST} {_AS_IS}"),
    ("BSD", "redistribution binary", _BSD),
    ("BSD-2-Clause", "redistribution binary reproduce", f"{_BSD} {_BSD_TWO} {_BSD_END}"),
    ("BSD-3-Clause", "neither endorse promote", _BSD_NAME),
    ("BSD-3-Clause", "redistribution binary neither endorse", f"{_BSD} {_BSD_TWO} {_BSD_NAME} {_BSD_END}"),
    ("GPL", "gnu general", _GNU.format("General Public License")),
    ("LGPL", "gnu lesser", _GNU.format("Lesser General Public License")),
    ("AGPL", "gnu affero", _GNU.format("Affero General Public License")),
    *((f"{name}-{v}.0", f"gnu general {v} program", _GNU_PARAGRAPH.format("General Public License", v)) for name, v in (("GPL", 2), ("GPL", 3))),
    ("LGPL-3.0", "gnu lesser 3", _GNU_PARAGRAPH.format("Lesser General Public License", 3)),
    ("LGPL-2.1", "gnu lesser 2 1", _GNU_PARAGRAPH.format("Lesser General Public License", "2.1")),
    ("AGPL-3.0", "gnu affero 3", _GNU_PARAGRAPH.format("Affero General Public License", 3)),
    ("MPL-2.0", "mozilla 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "mozilla mpl 2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("ISC", "hereby granted fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("0BSD", "hereby granted fee", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "unencumbered domain", "This is free and unencumbered software released into the public domain."),
    ("Zlib", "altered misrepresented", "The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
    ("BSD", "bsd style", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
]
#: Licences that stand for several; they count where no other matches.
FAMILIES = ("BSD", "GPL", "LGPL", "AGPL")

LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
#: Names of files whose words decide; others are source files or data.
PLAIN_FILE = r"(?i)(^|/)[^./]+(\.(txt|md|rst))?$"

Template = tuple[str, str, str]


def terms(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _weights(templates: list[Template], idf: dict[str, float]) -> list[dict[str, float]]:
    """Unit TF-IDF vectors."""
    out = []
    for _, _, text in templates:
        w = {t: n * idf[t] for t, n in Counter(terms(text)).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        out.append({t: x / norm for t, x in w.items()})
    return out


def _needed(templates: list[Template], idf: dict[str, float], threshold: float) -> list[str]:
    """Terms of which any unit with a cosine of `threshold` to some template, and its musts, holds one: the heaviest of each
    template, down to where the rest is too light, or its rarest must where that is rarer."""
    out = set()
    for (_, must, _), w in zip(templates, _weights(templates, idf)):
        rest, own = 0.0, set()
        for t in sorted(w, key=lambda t: (w[t], t)):
            rest += w[t] ** 2
            if math.sqrt(rest) >= threshold:
                own.add(t)
        rarest = max(must.split(), key=lambda t: (idf[t], t))
        out |= own if min(idf[t] for t in own) > idf[rarest] else {rarest}
    return sorted(out)


def _lines(text: Column) -> Column:
    return F.split(F.lower(F.coalesce(text, F.lit(""))), "\n")


def _terms(line: Column) -> Column:
    return F.filter(F.split(line, "[^a-z0-9]+"), lambda t: t != "")


def inverse_frequencies(files: DataFrame, templates: list[Template] = TEMPLATES) -> tuple[dict[str, float], float]:
    """log((1 + lines) / (1 + lines with the term)) + 1 for the templates' terms, and the value of an unseen term."""
    known = sorted({t for _, _, x in templates for t in terms(x)})
    vocabulary = F.array(*(F.lit(t) for t in known))
    lines = files.select(F.explode(_lines(F.col("text"))).alias("line"))
    # an empty string stands for the line itself, so one pass counts both
    held = lines.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(F.split("line", "[^a-z0-9]+"), vocabulary))).alias("term"))
    n = {r["term"]: r["n"] for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a term of the templates
    total = n.get("", 0)
    value = lambda k: math.log((1 + total) / (1 + k)) + 1
    return {t: value(n.get(t, 0)) for t in known}, value(0)


def _units(keyed: DataFrame, needed: str) -> DataFrame:
    """r1, r2, at, size, text: what is compared, of rows whose text has a line that could match; size 0 is the whole file."""
    lines = _lines(F.col("text"))
    begins = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(needed), i)), lambda i: i.isNotNull())
    starts = [(b, before) for b in BLOCKS for before in sorted({0, b // 2, b - 1})]
    places = F.array_distinct(F.flatten(F.transform("begins", lambda i: F.array(*(F.struct(F.greatest(i - before, F.lit(0)).alias("at"), F.lit(b).alias("size")) for b, before in starts)))))
    blocks = F.transform(places, lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"), F.array_join(F.slice("lines", p["at"] + 1, p["size"]), " ").alias("text")))
    whole = F.when(F.col("path").rlike(LICENSE_FILE) | F.col("path").rlike(PLAIN_FILE), F.array(F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lower("text").alias("text")))).otherwise(F.array().cast("array<struct<at:int,size:int,text:string>>"))
    some = keyed.where(F.lower("text").rlike(needed)).withColumn("lines", lines).withColumn("begins", begins)
    return some.select("r1", "r2", F.explode(F.concat(blocks, whole)).alias("u")).select("r1", "r2", "u.*")


def _weighed(units: DataFrame, idf: dict[str, float], unseen: float, threshold: float) -> DataFrame:
    """Of each unit: words, norm, and the templates' terms in it, or none where too little of its weight is theirs for any cosine of `threshold`.

    A unit's terms are sorted and runs of equal ones weighed in its own row; no term is shuffled.
    """
    weights = F.create_map(*(F.lit(x) for t in sorted(idf) for x in (t, idf[t])))
    zero = F.lit(0.0)

    def closed(a: Column) -> tuple[Column, Column]:
        w = F.element_at(weights, a["term"])
        x = F.pow(a["n"] * F.coalesce(w, F.lit(unseen)), 2.0)
        return a["whole"] + x, a["known"] + F.when(w.isNotNull(), x).otherwise(zero)

    def step(a: Column, t: Column) -> Column:
        whole, known = closed(a)
        same = t == a["term"]
        return F.struct(t.alias("term"), F.when(same, a["n"] + 1.0).otherwise(F.lit(1.0)).alias("n"), F.when(same, a["whole"]).otherwise(whole).alias("whole"), F.when(same, a["known"]).otherwise(known).alias("known"))

    start = F.struct(F.lit("").alias("term"), zero.alias("n"), zero.alias("whole"), zero.alias("known"))
    summed = units.withColumn("terms", F.array_sort(_terms(F.col("text")))).withColumn("sums", F.aggregate("terms", start, step, lambda a: F.struct(*(c.alias(n) for n, c in zip(("whole", "known"), closed(a))))))
    can = F.col("sums.known") >= (threshold**2 - 1e-6) * F.col("sums.whole")
    own = F.when(can, F.filter("terms", lambda t: F.element_at(weights, t).isNotNull())).otherwise(F.array().cast("array<string>"))
    return summed.select("r1", "r2", "at", "size", F.size("terms").alias("words"), F.sqrt("sums.whole").alias("norm"), own.alias("terms"))


def scan_licenses(files: DataFrame, threshold: float = THRESHOLD, templates: list[Template] = TEMPLATES) -> DataFrame:
    """id, path, license, score, n_lines, license_file, inherited_from for every row of files (id, path, text).

    n_lines: lines and blocks that match. Longer licence texts can be given as further templates.
    """
    spark = files.sparkSession
    idf, unseen = inverse_frequencies(files, templates)
    vectors = [(i, name, name in FAMILIES, t, idf[t], x, t in must.split(), len(must.split())) for i, ((name, must, _), w) in enumerate(zip(templates, _weights(templates, idf))) for t, x in w.items()]
    vectors = spark.createDataFrame(vectors, "template int, license string, family boolean, term string, idf double, w double, must boolean, musts int")

    needed = "(^|[^a-z0-9])(" + "|".join(_needed(templates, idf, threshold)) + ")([^a-z0-9]|$)"
    given = [F.col("id").isNull(), F.col("path").isNull(), F.col("text").isNull(), "id", "path", "text"]
    keyed = files.select("id", "path", "text", F.xxhash64(*given).alias("r1"), F.xxhash64(F.lit(1), *given).alias("r2"))
    unit = ["r1", "r2", "at", "size"]
    units = stored(_weighed(_units(keyed, needed), idf, unseen, threshold), "units").dropDuplicates(unit)
    counted = units.select(*unit, "words", "norm", F.explode("terms").alias("term")).groupBy(*unit, "words", "norm", "term").agg(F.count(F.lit(1)).alias("tf"))
    counted = counted.join(F.broadcast(vectors), "term").withColumn("x", F.col("tf") * F.col("idf") * F.col("w"))
    dots = counted.groupBy(*unit, "words", "norm", "template", "license", "family", "musts").agg(F.sum("x").alias("dot"), F.count_if("must").alias("held"))
    scored = dots.where(F.col("held") == F.col("musts")).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= threshold)
    by_license = scored.groupBy(*unit, "license", "family").agg(F.max("score").alias("score"), F.first("words").alias("words"))
    ranked = by_license.groupBy(*unit).agg(F.sort_array(F.collect_list(F.struct((~F.col("family")).alias("own"), "score", "license", "words")), asc=False).alias("m"))  # a licence each
    best = F.col("m")[0]
    rival = F.filter("m", lambda x: (x["own"] == best["own"]) & (x["license"] != best["license"]) & (best["score"] - x["score"] < MARGIN))
    won = ranked.where(F.size(rival) == 0).select("r1", "r2", "at", "size", F.struct(best["own"].alias("own"), best["score"].alias("score"), best["words"].alias("words"), best["license"].alias("license")).alias("m"))
    found = won.groupBy("r1", "r2").agg(
        F.max("m").alias("m"), F.count_if(F.col("size") > 0).alias("n_lines"),
        F.max("m.words").alias("block"), F.sum(F.when(F.col("size") == 1, F.col("m.words"))).alias("single"),
    )
    found = found.join(units.where("size = 0").select("r1", "r2", F.col("words").alias("n_words")), ["r1", "r2"], "left")
    own = keyed.drop("text").join(found, ["r1", "r2"], "left").select(
        "id", "path",
        F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).when(F.col("path").isNotNull(), F.lit("")).alias("dir"),
        F.col("m.license").alias("own"), F.col("m.score").alias("score"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.col("m").isNotNull() & (F.col("path").rlike(LICENSE_FILE) | (F.col("path").rlike(PLAIN_FILE) & (2 * F.greatest("block", F.coalesce("single", F.lit(0))) >= F.col("n_words")))), F.lit(False)).alias("license_file"),
    )
    own = stored(own, "files")
    given = own.where(F.col("license_file") & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct("path", "own")).alias("g"))
    # directories are few beside files: each finds its nearest licensed ancestor once
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.struct(i.alias("depth"), F.array_join(F.slice(parts, F.lit(1), i), "/").alias("up")))
    dirs = own.where("dir IS NOT NULL").select("dir").distinct().select("dir", F.explode(above).alias("a")).select("dir", "a.depth", "a.up")
    nearest = stored(dirs.join(given.select(F.col("dir").alias("up"), "g"), "up").groupBy("dir").agg(F.max_by("g", "depth").alias("g")), "nearest")
    if nearest.count() <= BROADCAST_DIRS:  # so that the files of one large directory stay where they are
        nearest = F.broadcast(nearest)
    return own.join(nearest, "dir", "left").select(
        "id", "path", F.coalesce("own", "g.own").alias("license"), "score", "n_lines", "license_file",
        F.when(F.col("own").isNull(), F.col("g.path")).alias("inherited_from"),
    )


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files at source/lang/doc_id; a document that is mostly a licence notice is its directory's licence file."""
    docs = table(spark, sf_dir, "documents")
    files = docs.select(F.col("doc_id").alias("id"), F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text")
    return scan_licenses(files).withColumnRenamed("id", "doc_id")
