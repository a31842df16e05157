"""Licence scan: headers and licence files against templates, then
inheritance along directories.

The lines of a file that speak of a licence (anywhere in its text) form its
header; a file named as a licence counts with its whole text. Headers are compared to
template texts by the cosine of sparse TF-IDF vectors; the inverse document
frequencies come from all headers of the table. Equal headers are compared
once, whatever their number. SPDX ids, and the standard passages of each licence
(file headers, titles and grants of the full texts), are looked for in the single
lines and sentences of any file with a header, wherever they stand; what they say
comes before the likeness of the joined header, and a single line that is near a
template counts where the joined header is not. A file without a licence of its own takes that of
the nearest directory above it that holds a licence file, found by joining the
ancestors of each directory (not of each file) with the directories that have
one; of several licence files in one directory the best match wins, then the
first name.

DataFrame functions only. Cases: null and empty texts have no header; a null
path is the root directory; ties go to the first template name; equal rows
give equal rows; null ids stay null; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roundlearn.llm.common import written
from roundlearn.session import local_frame

MIN_COSINE = 0.5
CUE = "(?i)licen[sc]e|copyright|\\bspdx\\b|public domain|all rights reserved"
NAMES = "(?i)^(un)?licen[sc]e|^copying|^notice"
#: Template headers: fixed values, the customary notices of each licence.
TEMPLATES = {
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Use of this source code is governed by a BSD 2-Clause license.",
    "BSD-3-Clause": "Use of this source code is governed by a BSD 3-Clause license.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0. Creative Commons Attribution-ShareAlike License.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "EPL-2.0": "Made available under the terms of the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "Licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, v. 2.0.",
    "Proprietary": "Copyright. All rights reserved. Proprietary and confidential.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Unlicense.",
}

#: Passages of the licences' own texts: a form counts if each of its passages is near a sentence or line of a file.
_GRANT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
          "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
          "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
          "permit persons to whom the Software is furnished to do so, subject to the following conditions")
_SOURCE = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"
_BINARY = ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
           "following disclaimer in the documentation and/or other materials provided with the distribution")
_NEITHER = ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission")
_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public "
        "License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version")
_GNU_ONLY = ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU {0}General Public "
             "License version {1} as published by the Free Software Foundation")
PASSAGES: list[tuple[str, tuple[str, ...]]] = [
    ("Apache-2.0", ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                    "compliance with the License",)),
    ("Apache-2.0", ("The ASF licenses this file to You under the Apache License, Version 2.0 (the License); you may not use "
                    "this file except in compliance with the License",)),
    ("Apache-2.0", ("Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",)),
    ("BSD-2-Clause", (_SOURCE, _BINARY)), ("BSD-3-Clause", (_SOURCE, _BINARY, _NEITHER)),
    ("BSL-1.0", ("Boost Software License - Version 1.0 - August 17th, 2003",)),
    ("BSL-1.0", ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
                 "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, "
                 "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties "
                 "to whom the Software is furnished to do so, all subject to the following",)),
    ("BSL-1.0", ("Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at "
                 "http://www.boost.org/LICENSE_1_0.txt)",)),
    ("CC-BY-4.0", ("Creative Commons Attribution 4.0 International Public License",)),
    ("CC-BY-4.0", ("This work is licensed under a Creative Commons Attribution 4.0 International License",)),
    ("CC-BY-NC-4.0", ("Creative Commons Attribution-NonCommercial 4.0 International Public License",)),
    ("CC-BY-NC-4.0", ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",)),
    ("CC-BY-SA-4.0", ("Creative Commons Attribution-ShareAlike 4.0 International Public License",)),
    ("CC-BY-SA-4.0", ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",)),
    ("CC0-1.0", ("Creative Commons Legal Code CC0 1.0 Universal",)), ("CC0-1.0", ("CC0 1.0 Universal",)),
    ("EPL-2.0", ("Eclipse Public License - v 2.0",)),
    ("EPL-2.0", ("This program and the accompanying materials are made available under the terms of the Eclipse Public License "
                 "2.0 which is available at https://www.eclipse.org/legal/epl-2.0",)),
    ("ISC", ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
             "granted, provided that the above copyright notice and this permission notice appear in all copies",)),
    ("MIT", (_GRANT,)),
    ("MPL-2.0", ("Mozilla Public License Version 2.0",)),
    ("MPL-2.0", ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",)),
    ("Unlicense", ("This is free and unencumbered software released into the public domain",)),
    *[(k, (f"GNU {kind}General Public License Version {v}, {day}",)) for k, kind, v, day in (
        ("AGPL-3.0", "Affero ", "3", "19 November 2007"), ("GPL-2.0", "", "2", "June 1991"), ("GPL-3.0", "", "3", "29 June 2007"),
        ("LGPL-2.1", "Lesser ", "2.1", "February 1999"), ("LGPL-3.0", "Lesser ", "3", "29 June 2007"))],
    *[(k, (text.format(kind, v),)) for k, kind, v in (
        ("AGPL-3.0", "Affero ", "3"), ("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"),
        ("LGPL-3.0", "Lesser ", "3")) for text in (_GNU, _GNU_ONLY)],
]
PASSAGE_COSINE = 0.75
SPDX = "(?i)spdx-license-identifier\\s*:\\s*([^\n]+)"
#: What stands before the words of a comment line. Java's matcher recurses for a repeated group unless it is possessive.
_MARKS = "(?m)^[ \\t\\r]*+(?:(?://++|#++|/?\\*++/?|;++|--+|<!--|%++|\\.\\.|(?i:rem|dnl)\\b)[ \\t]*+)*+"


def terms(text: Column) -> Column:
    """Lower-cased words; digits with inner points and hyphens stay whole."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]++(?:[.-][a-z0-9]++)*+"), F.lit(0))
    return words


def header(text: Column) -> Column:
    """The lines of a text that speak of a licence; null if there is none."""
    lines = F.filter(F.split(F.coalesce(text.cast("string"), F.lit("")), "\n"), lambda x: x.rlike(CUE))
    return F.when(F.size(lines) > 0, F.array_join(F.transform(lines, F.trim), "\n"))


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    t = F.explode(F.array(*[F.struct(F.lit(k).alias("license"), F.lit(v).alias("text")) for k, v in sorted(templates.items())]))
    return spark.range(1).select(t.alias("t")).select("t.license", "t.text")


def match_headers(headers: DataFrame, templates: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``headers``: key, text, docs (distinct texts and how many files have
    each). Returns (key, license, cosine) of the best template, if it is near
    enough."""
    t = templates.select("license", F.explode(terms(F.col("text"))).alias("term")).groupBy("license", "term").count()
    total = headers.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n")).first()["n"] + templates.count()
    tf = headers.select("key", "docs", F.explode(terms(F.col("text"))).alias("term")).groupBy("key", "docs", "term").count()
    tf = written(tf, "header-terms")
    df = (tf.select("term", "docs").unionByName(t.select("term", F.lit(1).cast("long").alias("docs")))
          .groupBy("term").agg(F.sum("docs").alias("df")))
    idf = written(df.select("term", (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1).alias("idf")), "idf")
    weight = (F.log1p("count") * F.col("idf")).alias("w")
    tw = t.join(idf, "term").select("license", "term", weight)
    tnorm = tw.groupBy("license").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("t_norm"))
    tw = tw.join(tnorm, "license").select("license", "term", (F.col("w") / F.col("t_norm")).alias("t_w"))   # some 200 rows
    hw = tf.join(idf, "term").select("key", "term", weight)
    norm = hw.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dot = hw.join(F.broadcast(tw), "term").groupBy("key", "license").agg(F.sum(F.col("w") * F.col("t_w")).alias("dot"))
    cos = dot.join(norm, "key").select("key", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
    best = cos.where(F.col("cosine") >= min_cosine).groupBy("key").agg(
        F.min(F.struct((-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("license"), (-F.col("b.c")).alias("cosine"))


def pieces(text: Column) -> Column:
    """The distinct lines and sentences of a text, without comment marks. A
    sentence ends at a blank line, or at a point, colon or the like."""
    plain = F.regexp_replace(text, _MARKS, "")
    return F.array_distinct(F.concat(F.split(plain, "\n"), F.split(plain, "\n[ \\t\\r]*\n|[.:!?][\\s\"')]")))


def spdx_ids(templates: dict[str, str]) -> dict[str, str]:
    """Lower-case SPDX id -> template name."""
    names = {k.lower(): k for k in templates}
    return names | {f"{k}-{x}": v for k, v in names.items() if "gpl-" in k for x in ("only", "or-later")}


def match_passages(texts: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``texts``: tkey, text (distinct). Returns (tkey, strong, p_license,
    p_cosine): the licence that the text's SPDX ids name, else that of the
    form with most passages and then the largest mean cosine; if there is no
    form either, the template that a single line or sentence is nearest to,
    with ``strong`` false."""
    spark = texts.sparkSession
    forms = [(k, p) for k, p in PASSAGES if k in templates]
    # (form, passage, license, passages of the form, text): fixed, some 60 rows
    known = [(i, j, k, len(p), x) for i, (k, p) in enumerate(forms) for j, x in enumerate(p)]
    known += [(len(forms) + i, 0, k, 0, x) for i, (k, x) in enumerate(sorted(templates.items()))]
    term = re.compile("[a-z0-9]+(?:[.-][a-z0-9]+)*")
    bags = [Counter(term.findall(x.lower())) for *_, x in known]
    df = Counter(t for b in {x: b for (*_, x), b in zip(known, bags, strict=True)}.values() for t in b)
    idf = {t: math.log((1 + len(known)) / (1 + n)) + 1 for t, n in df.items()}
    rows = []
    for (form, part, k, n, _), bag in zip(known, bags, strict=True):
        norm = math.sqrt(sum((math.log1p(c) * idf[t]) ** 2 for t, c in bag.items()))
        rows += [(form, part, k, n, t, math.log1p(c) * idf[t] / norm) for t, c in bag.items()]
    tw = local_frame(spark, rows, "form int, part int, license string, n int, term string, t_w double")
    weights = local_frame(spark, list(idf.items()), "term string, idf double")
    unknown, top = math.log(1 + len(known)) + 1, max(idf.values())
    # Words that no passage has only add to a piece's norm. With log1p(c)^2 <= 0.648 c, a piece whose distinct ones are
    # more than ``most`` times its other words cannot reach the cosine, so it is left out before the shuffle.
    most = 0.648 * (1 / PASSAGE_COSINE**2 - 1) * (top / (math.log(2) * unknown)) ** 2
    has = lambda x: x.isin(list(idf))      # noqa: E731
    cut = texts.select("tkey", F.posexplode(pieces(F.col("text"))).alias("piece", "text")).select(
        "tkey", "piece", terms(F.col("text")).alias("t"))
    n_known = F.size(F.filter("t", has))
    cut = cut.where((n_known > 0) & (F.size(F.filter(F.array_distinct("t"), lambda x: ~has(x))) <= n_known * (most + 1e-6)))
    tf = cut.select("tkey", "piece", F.explode("t").alias("term")).groupBy("tkey", "piece", "term").count()
    hw = tf.join(F.broadcast(weights), "term", "left").select(
        "tkey", "piece", "term", (F.log1p("count") * F.coalesce("idf", F.lit(unknown))).alias("w"))
    # one row a piece: its norm and its terms that some passage has
    vec = hw.groupBy("tkey", "piece").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.collect_list(
        F.when(F.col("term").isin(list(idf)), F.struct("term", "w"))).alias("v"))
    dot = (vec.select("tkey", "piece", "norm", F.explode("v").alias("v")).select("tkey", "piece", "norm", "v.term", "v.w")
           .join(F.broadcast(tw), "term").groupBy("tkey", "piece", "norm", "form", "part", "license", "n")
           .agg(F.sum(F.col("w") * F.col("t_w")).alias("dot")))
    near = (dot.select("tkey", "form", "part", "license", "n", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine"))
            .where(F.col("cosine") >= PASSAGE_COSINE).groupBy("tkey", "form", "part", "license", "n")
            .agg(F.max("cosine").alias("cosine")))
    whole = (near.groupBy("tkey", "form", "license", "n").agg(F.count(F.lit(1)).alias("parts"), F.avg("cosine").alias("cosine"))
             .where(F.col("parts") >= F.col("n")).select("tkey", "license", "n", F.round("cosine", 6).alias("cosine")))
    ids = local_frame(spark, sorted(spdx_ids(templates).items()), "id string, license string")
    lines = F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1)))
    named = (texts.select("tkey", lines.alias("x")).select("tkey", F.explode(F.split(F.lower("x"), "[^a-z0-9.-]+")).alias("id"))
             .join(F.broadcast(ids), "id").select("tkey", "license", F.lit(99).alias("n"), F.lit(1.0).alias("cosine")))
    best = whole.unionByName(named).groupBy("tkey").agg(
        F.min(F.struct((-F.col("n")).alias("n"), (-F.col("cosine")).alias("c"), "license")).alias("b"))
    return best.select("tkey", (F.col("b.n") < 0).alias("strong"), F.col("b.license").alias("p_license"), (-F.col("b.c")).alias("p_cosine"))


def parents(directory: Column) -> Column:
    """The directory and all above it, the root last (as "")."""
    parts = F.filter(F.split(directory, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def scan(df: DataFrame, path: Column, is_file: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
         templates: dict[str, str] = TEMPLATES, min_cosine: float = MIN_COSINE) -> DataFrame:
    """One row per file: doc_id, own_license, cosine, license (own or
    inherited) and license_dir (the directory it comes from; null if own).
    Files named as licences, and those of ``is_file``, speak for their
    directory."""
    spark = df.sparkSession
    whole = F.coalesce(path, F.lit(""))
    name = F.element_at(F.split(whole, "/"), -1)
    licence_file = (name.rlike(NAMES) | is_file) if is_file is not None else name.rlike(NAMES)
    src = df.select(F.col(id_col).alias("doc_id"), F.array_join(F.filter(F.split(
        F.regexp_replace(whole, "[^/]*$", ""), "/"), lambda x: x != ""), "/").alias("dir"), name.alias("name"),
        F.coalesce(licence_file, F.lit(False)).alias("is_file"), F.col(text_col).cast("string").alias("text"))
    src = src.withColumn("header", F.when(F.col("name").rlike(NAMES) & (F.trim("text") != ""), F.col("text")).otherwise(header(F.col("text"))))
    # narrow rows: header and text only where there is a header, under the keys of their texts
    rows = written(src.select("doc_id", "dir", "name", "is_file", "header", F.when(
        F.col("header").isNotNull(), F.md5(F.col("header").cast("binary"))).alias("key"), F.when(
        F.col("header").isNotNull(), F.md5(F.col("text").cast("binary"))).alias("tkey"), F.when(
        F.col("header").isNotNull(), F.col("text")).alias("text")), "files")
    headers = rows.where("key is not null").groupBy("key").agg(F.first("header").alias("text"), F.count(F.lit(1)).alias("docs"))
    best = written(match_headers(written(headers, "headers"), template_table(spark, templates), min_cosine), "matches")
    texts = rows.where("tkey is not null").groupBy("tkey").agg(F.first("text").alias("text"))
    said = written(match_passages(written(texts, "texts"), templates), "passages")
    own = rows.drop("header", "text").join(best, "key", "left").join(said, "tkey", "left")
    use = F.coalesce("strong", F.lit(False)) | F.col("license").isNull()
    own = own.select("doc_id", "dir", "name", "is_file", F.when(use, F.col("p_license")).otherwise(F.col("license")).alias("license"),
                     F.when(use, F.col("p_cosine")).otherwise(F.col("cosine")).alias("cosine"))
    own = written(own, "own")
    holders = (own.where("is_file and license is not null").groupBy("dir")
               .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name", "license")).alias("b"))
               .select(F.col("dir").alias("holder"), F.col("b.license").alias("dir_license")))
    above = own.select("dir").distinct().select("dir", F.explode(parents(F.col("dir"))).alias("holder"))
    near = (above.join(holders, "holder").groupBy("dir")
            .agg(F.max(F.struct(F.length("holder").alias("n"), "holder", "dir_license")).alias("b"))
            .select("dir", F.col("b.holder").alias("license_dir"), F.col("b.dir_license").alias("dir_license")))
    got = own.join(written(near, "directories"), "dir", "left")
    return got.select("doc_id", F.col("license").alias("own_license"), "cosine",
                      F.coalesce("license", "dir_license").alias("license"),
                      F.when(F.col("license").isNull(), F.col("license_dir")).alias("license_dir"))
