"""Licence scans: header lines and licence files against templates, then inheritance by directory.

DataFrame functions only. Header lines are lines that hold a licence word. A passage and every template are
sparse TF-IDF vectors of their words; the template of the highest cosine names the licence if the cosine
reaches the threshold. Passages are the header lines, the whole licence file, and inside both every window of a
template's length. A licence file is compared with full licence texts first. A file without a licence of its
own inherits that of the licence file in its nearest ancestor directory.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from buywave.llm.common import materialize, whole_text

THRESHOLD = 0.6
#: A line without any of these is no header line.
LICENSE_WORDS = ("licens", "licenc", "copyright", "permission", "redistribut", "public domain", "spdx")
LICENSE_FILE = r"(?i)^(un)?licen[cs]es?(\..*)?$|^copying(\..*)?$"

# SPDX names and the notices that name them.
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
    ("CC0-1.0", "Released under CC0 1.0 into the public domain"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]

_AS_PUBLISHED = "License as published by the Free Software Foundation, either version"
# Fixed values too: titles of long licence texts and the usual notices, looked for in windows besides the templates.
NOTICES = [
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("GPL-2.0", "GNU General Public License Version 2, June 1991"),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("GPL-2.0", f"under the terms of the GNU General Public {_AS_PUBLISHED} 2 of the License"),
    ("GPL-3.0", f"under the terms of the GNU General Public {_AS_PUBLISHED} 3 of the License"),
    ("LGPL-2.1", f"under the terms of the GNU Lesser General Public {_AS_PUBLISHED} 2.1 of the License"),
    ("LGPL-3.0", f"under the terms of the GNU Lesser General Public {_AS_PUBLISHED} 3 of the License"),
    ("AGPL-3.0", f"under the terms of the GNU Affero General Public {_AS_PUBLISHED} 3 of the License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
]
#: Words that a window must hold for a template of this licence that has them: a window leaves the rest of
#: its line out, so "released under the license" alone would name one.
NAMES = {
    "MIT": "mit", "Apache-2.0": "apache 2", "GPL-2.0": "gnu 2", "GPL-3.0": "gnu 3", "LGPL-2.1": "lesser 2 1", "LGPL-3.0": "lesser 3",
    "AGPL-3.0": "affero 3", "BSD-2-Clause": "bsd 2", "BSD-3-Clause": "bsd 3", "MPL-2.0": "mozilla 2", "CC-BY-4.0": "cc by 4",
    "CC-BY-SA-4.0": "cc by sa 4", "CC-BY-NC-4.0": "cc by nc 4", "CC-BY-ND-4.0": "cc by nd 4", "CC0-1.0": "cc0", "Unlicense": "unencumbered",
}

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\""
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
    "in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
    "from this software without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
    "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT "
    "HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT "
    "LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Short licences in full, for whole licence files. Only these tell the two BSD licences apart.
FULL_TEXTS = [
    (
        "MIT",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial "
        f"portions of the Software. {_AS_IS}, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR "
        "ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "ISC License. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR "
        "DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
        "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("BSD-2-Clause", f"BSD 2-Clause License. {_BSD_START}{_BSD_END}"),
    ("BSD-3-Clause", f"BSD 3-Clause License. {_BSD_START}{_BSD_THIRD}{_BSD_END}"),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
        "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any "
        "means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in "
        "the software to the public domain. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED.",
    ),
]


def template_terms(templates: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str, float, float]], float]:
    """Rows (template, licence, term, idf, weight / norm), and the idf of a term no template has."""
    counts = [Counter(re.findall("[a-z0-9]+", text.lower())) for _, text in templates]
    df = Counter(t for c in counts for t in c)
    n = len(templates)
    idf = {t: math.log((1 + n) / (1 + d)) + 1 for t, d in df.items()}
    rows = []
    for k, ((name, _), c) in enumerate(zip(templates, counts)):
        norm = math.sqrt(sum((f * idf[t]) ** 2 for t, f in c.items()))
        rows += [(k, name, t, idf[t], f * idf[t] / norm) for t, f in sorted(c.items())]
    return rows, math.log(1 + n) + 1


def mentions_license(text: Column) -> Column:
    lower = F.lower(text)
    found = F.lit(False)
    for word in LICENSE_WORDS:
        found = found | lower.contains(word)
    return found


def postings(templates: list, names: dict[str, str]) -> tuple[list[tuple], float]:
    """Rows (template, license, term, idf, weight, length, named, needs), and the idf of other terms.

    ``length`` is the template's number of words; ``named`` marks the words of its licence's name, of which a passage
    must hold all ``needs``.
    """
    rows, other = template_terms(templates)
    words: dict[int, set[str]] = {}
    for k, _, t, _, _ in rows:
        words.setdefault(k, set()).add(t)
    need = {k: set(names.get(templates[k][0], "").split()) for k in words}
    need = {k: x if x <= words[k] else set() for k, x in need.items()}
    length = [len(re.findall("[a-z0-9]+", text.lower())) for _, text in templates]
    return [(k, name, t, i, w, length[k], int(t in need[k]), len(need[k])) for k, name, t, i, w in rows], other


def _terms(spark: SparkSession, templates: list, names: dict[str, str]) -> tuple[DataFrame, DataFrame, float]:
    """The terms' idf, the templates' postings, and the idf of other terms. Both tables are as large
    as the templates, which are code."""
    rows, other = postings(templates, names)
    idf = spark.createDataFrame(sorted({(r[2], r[3]) for r in rows}), "term string, idf double")
    table = spark.createDataFrame(
        [(k, name, t, *rest) for k, name, t, _, *rest in rows],
        "template int, license string, term string, weight double, length int, named int, needs int",
    )
    return F.broadcast(idf), F.broadcast(table), other


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def match_templates(
    passages: DataFrame, templates: list = TEMPLATES, threshold: float = THRESHOLD, names: dict[str, str] | None = None
) -> DataFrame:
    """The best (license, similarity, template) of each ``key``; ``passages`` has key, part and text.

    A key's parts are compared one by one and the best counts; ties go to the earlier template. Keys
    below the threshold give no row. Grouping is by part, so a key with many parts is no hot key.
    With ``names`` a part must also hold the names of the template's licence.
    """
    idf, posted, other = _terms(passages.sparkSession, templates, names or {})
    counts = passages.select("key", "part", F.explode(_words("text")).alias("term")).groupBy("key", "part", "term").agg(F.count("*").alias("tf"))
    weighed = counts.join(idf, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(other)))
    # The length of the vector needs all terms, the products only those of templates.
    spread = (
        weighed.join(posted, "term", "left")
        .groupBy("key", "part", "template", "license")
        .agg(F.sum(F.col("w") * F.col("weight")).alias("dot"), (F.sum("named") >= F.max("needs")).alias("is_named"))
    )
    norms = weighed.groupBy("key", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    cosine = F.round(F.col("dot") / F.col("norm"), 6)
    best = F.max(F.struct(F.col("similarity"), (-F.col("template")).alias("first"), F.col("license")))
    return (
        spread.filter(F.col("template").isNotNull() & F.col("is_named"))
        .join(norms, ["key", "part"])
        .withColumn("similarity", cosine)
        .filter(F.col("similarity") >= threshold)
        .groupBy("key")
        .agg(best.alias("best"))
        .select("key", "best.license", "best.similarity", (-F.col("best.first")).alias("template"))
    )


def common_weight(templates: list) -> float:
    """The squared idf of the most common term."""
    return min(i for _, _, _, i, _ in template_terms(templates)[0]) ** 2


def windows(passages: DataFrame, templates: list, threshold: float = THRESHOLD) -> DataFrame:
    """(key, part, text): the windows of ``passages`` that may reach the threshold.

    A window has as many words as a template and starts at a word of it, or is the passage's last. It is left
    out only if no cosine of its own template can reach the threshold: the length of its vector is
    at least that of its words taken as all different, unknown ones as the most common term.
    """
    idf, posted, _ = _terms(passages.sparkSession, templates, {})
    common = common_weight(templates)
    words = passages.select("key", "part", _words("text").alias("words"))
    hits = (
        words.select("key", "part", F.size("words").alias("n"), F.posexplode("words").alias("at", "term"))
        .join(idf, "term")
        .join(posted, "term")
        .filter("n >= length")
        .groupBy("key", "part", "template", "length", "n")
        .agg(F.sort_array(F.collect_list(F.struct("at", (F.col("idf") * F.col("weight")).alias("x"), (F.col("idf") * F.col("idf")).alias("y")))).alias("h"))
    )

    def bound(hit: Column, k: Column) -> Column:
        start = F.least(hit["at"], F.col("n") - F.col("length"))
        inside = F.filter(F.slice("h", k + 1, F.col("length")), lambda o: o["at"] < start + F.col("length"))
        dot = F.aggregate(inside, F.lit(0.0), lambda s, o: s + o["x"])
        norm = F.aggregate(inside, F.lit(0.0), lambda s, o: s + o["y"]) + (F.col("length") - F.size(inside)) * F.lit(common)
        return F.struct(start.alias("start"), (dot / F.sqrt(norm)).alias("bound"))

    likely = F.filter(F.transform("h", bound), lambda w: w["bound"] >= threshold - 1e-6)
    found = hits.select("key", "part", "length", F.explode(F.array_distinct(F.transform(likely, lambda w: w["start"]))).alias("start"))
    return (
        found.distinct()
        .join(words, ["key", "part"])
        .select("key", F.struct("part", "start", "length").alias("part"), F.array_join(F.slice("words", F.col("start") + 1, F.col("length")), " ").alias("text"))
    )


SPDX_ONE = r"[a-z0-9.+-]+"
SPDX_LINE = rf"spdx-license-identifier:\s*\(*({SPDX_ONE}(?:\)*\s+(?:or|and|with)\s+\(*{SPDX_ONE})*)"
SPDX_ENDING = r"(-only|-or-later|\+)$"


def spdx_license(text: str, names: list[str]) -> Column:
    """The first of ``names`` in the SPDX expression of a line, else null. Identifiers are compared whole."""
    expression = F.regexp_extract(F.lower(text), SPDX_LINE, 1)
    said = F.transform(F.split(expression, r"[\s()]+"), lambda x: F.regexp_replace(x, SPDX_ENDING, ""))
    known = F.create_map(*[F.lit(x) for name in sorted(set(names)) for x in (name.lower(), name)])
    return F.get(F.filter(F.transform(said, lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()), F.lit(0))


def directory_of(path: Column) -> Column:
    """Everything before the last slash; the empty text at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """Array of (ancestor, depth) of a directory, itself and the root included."""
    steps = F.split(directory, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda n: F.struct(F.array_join(F.slice(steps, F.lit(1), n), "/").alias("ancestor"), n.alias("depth")),
    )


def _own_licenses(files: DataFrame, is_file: Column, templates: list, threshold: float) -> DataFrame:
    """key, license and similarity of the files that have a licence of their own."""
    body = whole_text("text")
    lines = F.filter(F.split(body, "\n"), lambda x: mentions_license(x))
    # Part 0 is the body of a licence file; only this table is read below, not the files' texts.
    # Rows of one key are alike and are read once.
    mentioned = files.filter(F.col("key").isNotNull() & mentions_license(body)).select("key", is_file.alias("is_file"), "text")
    candidates = materialize(
        mentioned.dropDuplicates(["key"])
        .select("key", "is_file", F.posexplode(F.concat(F.array(F.when(F.col("is_file"), body)), lines)).alias("part", "text"))
        .filter(F.col("text").isNotNull()),
        "license-lines",
    )
    # Notices of a licence file may be wrapped, so its windows run over the whole body.
    runs = candidates.filter("is_file = (part = 0)")
    wanted = templates + NOTICES
    cut = materialize(windows(runs, wanted, threshold), "license-windows")
    named = spdx_license("text", [name for name, _ in templates])
    columns = ("key", "license", "similarity", "template")
    found = [
        match_templates(candidates, templates, threshold).select(*columns, F.lit(0).alias("rank")),
        match_templates(cut, wanted, threshold, NAMES).select(*columns, F.lit(0).alias("rank")),
        candidates.select("key", named.alias("license"), F.lit(1.0).alias("similarity"), F.lit(len(wanted)).alias("template"), F.lit(0).alias("rank")).filter("license is not null"),
        match_templates(candidates.filter("part = 0"), FULL_TEXTS, threshold).select(*columns, F.lit(1).alias("rank")),
    ]
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])
    best = F.max(F.struct(F.col("rank"), F.col("similarity"), (-F.col("template")).alias("first"), F.col("license")))
    return every.groupBy("key").agg(best.alias("best")).select("key", "best.license", "best.similarity")


def content_key(path: str = "path", text: str = "text") -> Column:
    """A key for ``scan_licenses`` that only rows of equal path and text share; never null."""
    whole = [F.array(F.col(path).isNull(), F.col(text).isNull()), F.col(path), F.col(text)]
    return F.concat(F.hex(F.xxhash64(*whole)), F.hex(F.xxhash64(*reversed(whole))))


def scan_licenses(
    files: DataFrame, templates: list = TEMPLATES, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()
) -> DataFrame:
    """key, path, ``keep``, license, similarity, found_in and license_dir of every row of ``files`` (key, path, text).

    Rows of one key must agree in path and text (see ``content_key``); all of them come back. ``found_in`` is ``header`` or ``file`` for the file's own licence, ``directory``
    for an inherited one, else null. Whole texts are scanned. Null and empty texts have no licence of
    their own; rows with a null key have none either but inherit, and rows with a null path inherit none. If a directory has several licence files
    the most similar counts, ties by name. Inheritance is worked out once per directory, so files
    of one huge directory cost one lookup row each and no group.
    """
    path = F.col("path")
    name = F.regexp_extract(path, "[^/]*$", 0)
    is_file = F.coalesce(name.rlike(LICENSE_FILE), F.lit(False))
    own = materialize(_own_licenses(files, is_file, templates, threshold), "own-licenses")
    listed = files.select("key", "path", *keep, is_file.alias("is_file"))
    marked = listed.join(own, "key", "left")
    # Only licence files with a licence matter here, and directories are told apart before the join.
    # A table of its own: the join below can then split the root, an ancestor of every directory.
    granted = materialize(
        listed.select("key", "path", "is_file")
        .filter("is_file and path is not null")
        .join(own, "key")
        .groupBy(directory_of(path).alias("ancestor"))
        .agg(F.max(F.struct("similarity", "license")).alias("grant")),
        "granted-licenses",
    )
    dirs = listed.filter("path is not null").select(directory_of(path).alias("dir")).distinct()
    inherited = (
        dirs.select("dir", F.inline(ancestors(F.col("dir"))))
        .join(granted, "ancestor")
        .groupBy("dir")
        .agg(F.max(F.struct("depth", "ancestor", "grant")).alias("nearest"))
        .select("dir", F.col("nearest.ancestor").alias("grant_dir"), F.col("nearest.grant").alias("grant"))
    )
    joined = marked.withColumn("dir", directory_of(path)).join(inherited, "dir", "left")
    has_own = F.col("license").isNotNull()
    return joined.select(
        "key",
        "path",
        *keep,
        F.coalesce("license", "grant.license").alias("license"),
        F.coalesce("similarity", "grant.similarity").alias("similarity"),
        F.when(has_own & F.col("is_file"), "file").when(has_own, "header").when(F.col("grant").isNotNull(), "directory").alias("found_in"),
        F.when(~has_own, F.col("grant_dir")).alias("license_dir"),
    )
