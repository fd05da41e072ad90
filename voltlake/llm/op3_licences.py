"""Licence scans: TF-IDF cosines of headers and licence files to templates, then inheritance by directory.

A text is compared in passages: each line that speaks of a licence, a copyright or
an SPDX tag, and windows of ``WINDOW`` terms, ``STEP`` apart, that run over line
breaks and comment marks. Of a licence file (by its name, or as the caller says) all windows count, of
other files those that hold such a word; so a header block of several short lines and a licence text
of any length are compared piece by piece. Templates are notices and, of whole
licence texts, their distinctive passages. Inverse document frequencies are counted
over all passages and the templates. A map task then drops the passages whose cosine can't
reach the threshold, by an exact bound that needs the idf of the templates' terms only, and those
that can't state a licence: siblings and versions are told apart by words a passage must or must not
hold (``TELLS``), an SPDX tag by its identifier, BSD variants by the whole file, and denials
("not licensed under") are heeded. The passages left become sparse term rows that are
joined with the idf table and with the templates' terms (a fixed list, so
broadcast), and cosines are sums over the shared terms.

A file takes the licence of its best passage; without one, that of the nearest
ancestor directory with a licence file: each distinct directory is exploded into
its ancestors, joined on the path, and keeps the deepest hit, so the join's size
follows directories, not files.

Edge cases: null texts and paths count as empty; a file without passage or
licensed ancestor has a null licence; ties go to the first template name and the
first path; repeated rows get equal results; extra columns pass through, those named
as an output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import materialise, text_of

#: Notices by which licences are stated and passages of their public texts, by SPDX identifier.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights",
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. \"License\" shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-only SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "SPDX-License-Identifier: GPL-2.0-only SPDX-License-Identifier: GPL-2.0-or-later",
    ),
    "AGPL-3.0": (
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "SPDX-License-Identifier: AGPL-3.0-only SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "LGPL-2.1": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.",
        "SPDX-License-Identifier: LGPL-2.1-only SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "LGPL-3.0": (
        "This library is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007. This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below.",
        "SPDX-License-Identifier: LGPL-3.0-only SPDX-License-Identifier: LGPL-3.0-or-later",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "BSD-2-Clause": (
        "Licensed under the BSD 2-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "SPDX-License-Identifier: BSD-2-Clause",
    ),
    "MPL-2.0": (
        "This file is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0 1. Definitions 1.1. \"Contributor\" means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software. 1.2. \"Contributor Version\" means the combination of the Contributions of others",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0-1.0": ("Released under CC0 1.0.", "To the extent possible under law, the authors have dedicated all copyright and related and neighboring rights to this work to the public domain worldwide under the CC0 1.0 Universal Public Domain Dedication.", "SPDX-License-Identifier: CC0-1.0"),
    "ISC": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ),
    "Unlicense": (
        "Released into the public domain under the Unlicense.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "SPDX-License-Identifier: Unlicense",
    ),
}
#: Words that tell a licence from its siblings and versions: what a passage must hold, and what it must not.
TELLS = {
    "GPL-3.0": (r"version 3\b|\bv3|gpl-?v?3|\b3\.0\b", r"affero|agpl|lesser|lgpl|library general"),
    "GPL-2.0": (r"version 2\b(?!\.1)|\bv2\b(?!\.1)|gpl-?v?2(?!\.1)|\b2\.0\b", r"affero|agpl|lesser|lgpl|library general"),
    "AGPL-3.0": (r"affero|agpl", None),
    "LGPL-3.0": (r"(?=.*(?:lesser|lgpl))(?=.*(?:version 3\b|\bv3|gpl-?v?3|\b3\.0\b))", None),
    "LGPL-2.1": (r"(?=.*(?:lesser|lgpl|library general))(?=.*(?:version 2|\bv2|gpl-?v?2|\b2\.1\b))", None),
    "Apache-2.0": (r"apache", r"\b1\.[01]\b"),
    "MPL-2.0": (r"mozilla|mpl", r"\b1\.[01]\b(?!.*\b2\.0\b)"),
    "CC-BY-4.0": (r"\bby\b|by-4|attribution", r"by-?(?:sa|nc|nd)|\b(?:sa|nc|nd)\b|share-?alike|non-?commercial|no-?deriv"),
    "CC-BY-NC-4.0": (r"by-nc|non-?commercial", r"nc-(?:sa|nd)|share-?alike|no-?deriv"),
    "CC-BY-SA-4.0": (r"by-sa|share-?alike", r"by-nc|non-?commercial"),
    "CC0-1.0": (r"cc0|public domain dedication", None),
    "MIT": (r"\bmit\b|free of charge|to use copy modify merge", None),
}
#: The same of whole files, where siblings share whole passages.
THREE_CLAUSES = r"(?i)neither\s+the\s+name|3[- ]clause|bsd-3|bsd-style|(?:new|modified)\s+bsd"
DENIED = r"(?i)\bnot\s+(?:\S+\s+){0,2}licen[cs]ed\s+under\s+(?:the\s+|an?\s+)?([a-z0-9]+)"
TAGGED = "spdx-license-identifier"
TRIGGER = r"(?i)licen[cs]e|copyright|spdx|public domain"
FILE_NAME = r"(?i)(?:^|/)(?:un)?(?:licen[cs]e|copying|notice)(?:\.[a-z]+)?$"
WINDOW, STEP = 45, 15


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.+-]+|[.,;:]+(?=\s|$)"), lambda t: t != "")


def passages_of(text: Column, special: Column) -> Column:
    """Each passage's terms: the lines with a trigger, and the windows with one; in files named as licence files all windows."""
    lines = F.transform(F.filter(F.split(text, "\n"), lambda line: line.rlike(TRIGGER)), terms)

    def windows(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(STEP))
        cut = F.transform(starts, lambda s: F.slice(words, s, F.lit(WINDOW)))
        return F.filter(cut, lambda w: special | F.exists(w, lambda t: t.rlike(TRIGGER)) | F.array_join(w, " ").contains("public domain"))

    return F.filter(F.concat(lines, F.element_at(F.transform(F.array(terms(text)), windows), 1)), lambda w: F.size(w) > 0)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stated(name: str, passage: str, three_clauses: bool, denied: str) -> bool:
    """Whether a passage (terms joined by spaces) may state the licence and not a sibling of it, in a file of the given traits."""
    if denied and name.lower().startswith(denied):
        return False
    if TAGGED in passage:
        return re.search(rf"{TAGGED} {re.escape(name.lower())}(?:-only|-or-later|\+)?(?: |$)", passage) is not None
    if name in ("BSD-2-Clause", "BSD-3-Clause"):
        return three_clauses == (name == "BSD-3-Clause")
    needs, bars = TELLS.get(name, (None, None))
    return (needs is None or re.search(needs, passage) is not None) and (bars is None or re.search(bars, passage) is None)


def _weight(tf: int, idf: float) -> float:
    return (1 + math.log(tf)) * idf


def near_templates(idf: dict[str, float], threshold: float):
    """Map task: passages that may reach the threshold, with the names they may state.

    The bound is exact. Terms of no template weigh at least 1, so with the idf of the
    templates' terms alone a passage's length is at least what is used here, and its cosine
    at most the quotient.
    """
    models: dict[str, list[tuple[str, dict[str, float], float]]] = {}
    for name, texts in TEMPLATES.items():
        for text in texts:
            weights = {t: _weight(c, idf[t]) for t, c in Counter(split_terms(text)).items()}
            models.setdefault(name, []).append((name, weights, math.sqrt(sum(v * v for v in weights.values()))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep, names = [], []
            for terms_, three, denied in zip(pdf["passage"], pdf["three_clauses"], pdf["denied"], strict=True):
                counts = Counter(terms_)
                known = {t: _weight(c, idf[t]) for t, c in counts.items() if t in idf}
                least = math.sqrt(sum(v * v for v in known.values()) + len(counts) - len(known))
                near = [name for name, variants in models.items() if any(sum(v * m[t] for t, v in known.items() if t in m) >= (threshold - 1e-9) * least * length for _, m, length in variants)]
                text = " ".join(terms_) if near else ""
                found = [n for n in near if stated(n, text, three, denied or "")]
                keep.append(bool(found))
                names.append(found)
            yield pdf.assign(names=names)[keep]

    return run


def split_terms(text: str) -> list[str]:
    """``terms`` of a template in Python."""
    return [t for t in re.split(r"[^\w.+-]+|_|[.,;:]+(?=\s|$)", text.lower()) if t]


def scan_licences(files: DataFrame, path: str = "path", is_licence_file: Column | None = None, threshold: float = 0.5) -> DataFrame:
    """``files`` with licence, cosine, origin ('own', 'inherited' or null) and licence_path (the licence file inherited from)."""
    files = files.drop("licence", "cosine", "origin", "licence_path")
    spark = files.sparkSession
    named = F.coalesce(F.col(path), F.lit(""))
    special = F.coalesce(is_licence_file if is_licence_file is not None else named.rlike(FILE_NAME), F.lit(False))
    keyed = files.select(named.alias("p"), special.alias("special"), text_of().alias("t"))
    base = materialise(keyed.where(F.col("special") | F.col("t").rlike(TRIGGER)).groupBy("p", "special", "t").agg(F.count("*").alias("times")))
    passages = base.select("p", "special", F.xxhash64("t").alias("th"), F.col("t").rlike(THREE_CLAUSES).alias("three_clauses"), F.lower(F.regexp_extract("t", DENIED, 1)).alias("denied"), F.posexplode(passages_of(F.col("t"), F.col("special"))).alias("no", "passage"))

    rows = [(name, i, text) for name, texts in TEMPLATES.items() for i, text in enumerate(texts)]
    template = materialise(spark.createDataFrame(rows, "name string, variant int, text string").select("name", "variant", F.explode(terms(F.col("text"))).alias("term")).groupBy("name", "variant", "term").agg(F.count("*").alias("tf")))
    seen = passages.select(F.explode(F.array_distinct("passage")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    df = materialise(seen.unionByName(template.groupBy("term").agg(F.count("*").alias("df"))).groupBy("term").agg(F.sum("df").alias("df")))
    n = passages.count() + len(rows)
    idf = df.select("term", (F.log(F.lit(n + 1.0) / (F.col("df") + 1)) + 1).alias("idf"))
    known = {r.term: r.idf for r in idf.join(template.select("term").distinct(), "term", "left_semi").collect()}  # the templates' terms: a fixed list

    fields = "p string, special boolean, th long, three_clauses boolean, denied string, no int, passage array<string>"
    near = materialise(passages.mapInPandas(near_templates(known, threshold), f"{fields}, names array<string>"))
    counted = near.select("p", "special", "th", "no", F.explode("passage").alias("term")).groupBy("p", "special", "th", "no", "term").agg(F.count("*").alias("tf"))
    weigh = (F.lit(1.0) + F.log(F.col("tf").cast("double"))) * F.col("idf")
    keyed_idf = idf.select(F.xxhash64("term").alias("j"), F.col("term").alias("__term"), "idf")  # another key than the grouping's, so that a frequent term can be split
    vectors = counted.withColumn("j", F.xxhash64("term")).join(keyed_idf, "j").where("term = __term").select("p", "special", "th", "no", "term", weigh.alias("w"))
    lengths = vectors.groupBy("p", "special", "th", "no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"))
    models = template.join(idf, "term").select("name", "variant", "term", weigh.alias("v"))
    model_len = models.groupBy("name", "variant").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("vlen"))
    models = models.join(model_len, ["name", "variant"])  # a fixed list: a few hundred rows
    dots = vectors.join(F.broadcast(models), "term").groupBy("p", "special", "th", "no", "name", "variant").agg(F.sum(F.col("w") * F.col("v")).alias("dot"), F.max("vlen").alias("vlen"))
    may = near.select("p", "special", "th", "no", F.explode("names").alias("name"))
    cosines = dots.join(lengths, ["p", "special", "th", "no"]).join(may, ["p", "special", "th", "no", "name"]).select("p", "special", "th", "name", F.round(F.col("dot") / (F.col("len") * F.col("vlen")), 9).alias("cosine")).where(F.col("cosine") >= threshold)
    own = materialise(cosines.groupBy("p", "special", "th").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name")).alias("best")).select("p", "special", "th", F.col("best.name").alias("name"), (-F.col("best.c")).alias("cosine")))

    licensed = own.where("special").groupBy(directory(F.col("p")).alias("dir")).agg(F.min(F.struct((-F.col("cosine")).alias("c"), "p", "name")).alias("x")).select("dir", F.col("x.name").alias("__dir_name"), (-F.col("x.c")).alias("__dir_cosine"), F.col("x.p").alias("__dir_path"))
    dirs = keyed.select(directory(F.col("p")).alias("d")).distinct()
    parts = F.split("d", "/")
    chain = dirs.select("d", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("dir")))).alias("a")).select("d", "a.depth", "a.dir")
    nearest = chain.join(licensed, "dir").groupBy("d").agg(F.max(F.struct("depth", "__dir_name", "__dir_cosine", "__dir_path")).alias("x")).select(F.xxhash64("d").alias("__j"), F.col("d").alias("__d"), "x.__dir_name", "x.__dir_cosine", "x.__dir_path")

    left = files.withColumn("__p", named).withColumn("__s", special).withColumn("__th", F.xxhash64(text_of())).withColumn("__d", directory(named))
    mine = own.select(F.col("p").alias("__p"), F.col("special").alias("__s"), F.col("th").alias("__th"), F.col("name").alias("__name"), F.col("cosine").alias("__cosine"))
    joined = left.join(mine, ["__p", "__s", "__th"], "left").withColumn("__j", F.xxhash64("__d")).join(nearest, ["__j", "__d"], "left")  # another key than the grouping's, so that a directory of many files can be split
    return joined.select(
        *(F.col(c) for c in files.columns),
        F.coalesce("__name", "__dir_name").alias("licence"),
        F.coalesce("__cosine", "__dir_cosine").alias("cosine"),
        F.when(F.col("__name").isNotNull(), "own").when(F.col("__dir_name").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("__name").isNull(), F.col("__dir_path")).alias("licence_path"),
    )
