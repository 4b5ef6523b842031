"""License scan: sparse TF-IDF cosine of lines, runs of lines and licence files to notice templates, then
inheritance from the nearest ancestor directory by path joins.

Everything is built from column functions and joins; no Python runs on the executors.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import stored

# Notice templates: fixed values, licence and text.
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted. BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright. CC0 1.0 Universal Public Domain Dedication."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and distribute this software is granted under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. The Unlicense."),
)
_GNU = "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = "Creative Commons {} 4.0 International{}"
# Titles, bodies and standard headers as real files have them: licence, text, and the terms that a unit must
# have, or with ! must not have, to be named by the template.
NOTICES = (
    *[("AGPL-3.0", _GNU.format(w, "Affero General Public License", 3), "affero public license 3") for w in ("program", "file")],
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "affero public license 3"),
    ("AGPL-3.0", "GNU Affero General Public License v3.0", "affero public license v3"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/", "apache license 2"),
    ("Apache-2.0", "Apache License Version 2.0", "apache license 2"),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004", "apache license 2"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "apache license 2"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.', "apache license 2"),
    ("BSD-3-Clause", "BSD 3-Clause License", "bsd 3 clause license !clear"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither endorse !4"),
    ("BSD-3-Clause", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "neither endorse !advertising"),
    ("CC-BY-4.0", "Attribution 4.0 International", "attribution 4 international !noncommercial !sharealike !noderivatives"),
    ("CC-BY-4.0", _CC.format("Attribution", " Public License"), "attribution 4 international !noncommercial !sharealike !noderivatives"),
    ("CC-BY-NC-4.0", "Attribution-NonCommercial 4.0 International", "attribution noncommercial 4 international !sharealike !noderivatives"),
    ("CC-BY-NC-4.0", _CC.format("Attribution-NonCommercial", " Public License"), "attribution noncommercial 4 international !sharealike !noderivatives"),
    ("CC-BY-SA-4.0", "Attribution-ShareAlike 4.0 International", "attribution sharealike 4 international !noncommercial"),
    ("CC-BY-SA-4.0", _CC.format("Attribution-ShareAlike", " Public License"), "attribution sharealike 4 international !noncommercial"),
    ("CC0-1.0", "CC0 1.0 Universal", "cc0 1 universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "gnu public license 2 !lesser !library !affero"),
    ("GPL-2.0", "GNU General Public License v2.0", "gnu public license v2 !lesser !library !affero"),
    *[("GPL-2.0", _GNU.format(w, "General Public License", 2), "gnu public license 2 !lesser !affero") for w in ("program", "file")],
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "gnu public license 2 !lesser !affero"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "gnu public license 3 !lesser !library !affero"),
    ("GPL-3.0", "GNU General Public License v3.0", "gnu public license v3 !lesser !library !affero"),
    *[("GPL-3.0", _GNU.format(w, "General Public License", 3), "gnu public license 3 !lesser !affero") for w in ("program", "file")],
    ("ISC", "ISC License", "isc license"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "fee provided notice"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "lesser public license 3"),
    ("LGPL-3.0", "GNU Lesser General Public License v3.0", "lesser public license v3"),
    *[("LGPL-3.0", _GNU.format(w, "Lesser General Public License", 3), "lesser public license 3") for w in ("program", "library")],
    ("MIT", "MIT License", "mit license"),
    ("MIT", "The MIT License (MIT)", "mit license"),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "charge sublicense"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy", "permission granted charge obtaining !organization"),
    ("MPL-2.0", "Mozilla Public License Version 2.0", "mozilla public license 2"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "mozilla public license 2"),
    ("Unlicense", "This is free and unencumbered software released into the public domain.", "unencumbered public domain"),
    ("Unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "anyone compile"),
)
SPDX = r"SPDX-License-Identifier:\s*\(*([A-Za-z0-9.+-]+)"
#: Lines between runs: those without a term, and claims of copyright.
BETWEEN = r"\n[^\nA-Za-z0-9]*(?:(?i:copyright\W+(?:c\W+)?(?:19|20)\d\d|copyright\W*\(c\)|\(c\)\W*(?:19|20)\d\d|all rights reserved)[^\n]*)?(?=\n|\z)"
#: Cosine from which a text unit counts as a notice.
LEAST = 0.75
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense)([.-].*)?$"
TERM = "[^a-z0-9]+"


def terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), TERM), lambda t: t != "")


def inverse_frequency(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


def anchors(weights: dict[int, dict[str, float]], least: float) -> list[str]:
    """Terms of which a unit must have one to reach the cosine: per template the heaviest ones, until what
    is left of its norm could not reach it any more. Filtering by them loses nothing."""
    found: set[str] = set()
    for vector in weights.values():
        norm = rest = sum(w * w for w in vector.values())
        for t in sorted(vector, key=lambda t: (-vector[t], t)):
            if rest < (least * 0.999) ** 2 * norm:
                break
            found.add(t)
            rest -= vector[t] ** 2
    return sorted(found)


def judged(files: DataFrame, templates: tuple[tuple[str, ...], ...], units: Column, seen: dict[str, int], n: int, least: float) -> DataFrame:
    """(row, text) to (row, license, cosine): the best licence of the units of each row that has one.

    Terms weigh count times ln((1 + N) / (1 + df)) + 1; a term that no template has weighs as if no row had
    it. Of equal cosines (to 6 decimals) the first licence by name wins.
    """
    spark = files.sparkSession
    counts = [Counter(t for t in re.split(TERM, text.lower()) if t) for _, text, *_ in templates]
    asked = [x[2].split() if len(x) > 2 else [] for x in templates]
    known = {t for c in counts for t in c} | {t.lstrip("!") for a in asked for t in a}
    idf = {t: inverse_frequency(n, seen.get(t, 0)) for t in sorted(known)}
    weights = {i: {t: c * idf[t] for t, c in v.items()} for i, v in enumerate(counts)}
    needed = F.array(*[F.lit(t) for t in anchors(weights, least)])
    gated = files.where(F.arrays_overlap(terms(F.coalesce("text", F.lit(""))), needed)).dropDuplicates(["row"]).select("row", F.posexplode(units).alias("unit", "line"))
    gated = gated.select("row", "unit", terms(F.col("line")).alias("terms")).where(F.arrays_overlap("terms", needed))
    tf = gated.select("row", "unit", F.explode("terms").alias("term")).groupBy("row", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    # both tables are as large as the templates, whatever the input
    table = lambda rows, schema: F.broadcast(spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>"))))
    of_term = table([{"term": t, "idf": x} for t, x in sorted(idf.items())], "term:string,idf:double")
    of_template = []
    for i, v in weights.items():
        norm = math.sqrt(sum(x * x for x in v.values()))
        must, not_ = {t for t in asked[i] if t[0] != "!"}, {t[1:] for t in asked[i] if t[0] == "!"}
        # the terms that must be there add up to their number where all are, and none that must not
        for t in sorted({*v, *must, *not_}):
            one = 1 if t in must else -1000 if t in not_ else 0
            of_template.append({"term": t, "template": i, "license": templates[i][0], "share": v.get(t, 0.0) / norm, "all": len(must), "one": one})
    of_template = table(of_template, "term:string,template:int,license:string,share:double,all:int,one:int")
    weighed = tf.join(of_term, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(inverse_frequency(n, 0))))
    norms = weighed.groupBy("row", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = weighed.join(of_template, "term").groupBy("row", "unit", "template", "license", "all")
    dots = dots.agg(F.sum(F.col("w") * F.col("share")).alias("dot"), F.sum("one").alias("have")).where(F.col("have") == F.col("all"))
    best = dots.join(norms, ["row", "unit"]).select("row", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("cosine")).where(F.col("cosine") >= least)
    best = best.groupBy("row").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "license")).alias("best"))
    return best.select("row", "best.license", (-F.col("best.less")).alias("cosine"))


def identifiers(files: DataFrame) -> DataFrame:
    """(row, text) to (row, license, cosine): the first licence by name of the SPDX identifiers of each row."""
    found = files.where(F.col("text").contains("SPDX-License-Identifier:"))
    found = found.select("row", F.explode(F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))).alias("named"))
    found = found.select("row", F.regexp_replace("named", r"(-only|-or-later|\+)$", "").alias("license")).where(F.col("license").isin([t[0] for t in TEMPLATES]))
    return found.groupBy("row").agg(F.min("license").alias("license")).withColumn("cosine", F.lit(1.0))


def notices(files: DataFrame, least: float = LEAST) -> DataFrame:
    """(row, path, text) to (row, license, cosine): the best licence of each row that has one. Rows with
    one `row` value hold the same text; they are judged once, and all count in the statistics.

    Units are the lines of a text, and for a licence file the whole text too; N and df are counted over all
    rows. A row whose units name no licence by TEMPLATES takes that of its SPDX identifiers (cosine 1), or
    else of NOTICES, for which runs of lines count as units besides.
    """
    known = sorted({t for x in (*TEMPLATES, *NOTICES) for t in re.split(TERM, x[1].lower()) if t} | {t.lstrip("!") for x in NOTICES for t in x[2].split()})
    literal = F.array(*[F.lit(t) for t in known])
    seen = files.select(F.explode(F.array_intersect(terms(F.coalesce("text", F.lit(""))), literal)).alias("term"))
    df = {r[0]: r[1] for r in seen.groupBy("term").agg(F.count(F.lit(1))).collect()}  # a row per known term at most
    n = files.count()
    text, name = F.coalesce("text", F.lit("")), F.element_at(F.split("path", "/"), -1)
    lines = F.split(text, "\n")
    lines = F.when(name.rlike(LICENCE_FILE), F.concat(lines, F.array(text))).otherwise(lines)
    # a run of one line is that line
    runs = F.filter(F.split(F.concat(F.lit("\n"), text), BETWEEN), lambda x: x.rlike(r"[^\n]\n"))
    found = [judged(files, TEMPLATES, lines, df, n, least), identifiers(files), judged(files, NOTICES, F.concat(lines, runs), df, n, least)]
    ranked = [x.select("row", F.struct(F.lit(i).alias("i"), "license", "cosine").alias("best")) for i, x in enumerate(found)]
    return ranked[0].union(ranked[1]).union(ranked[2]).groupBy("row").agg(F.min("best").alias("best")).select("row", "best.license", "best.cosine")


def ancestors(directory: Column) -> Column:
    """The directory and those above it, the root (empty) included."""
    parts = F.split(directory, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.array_distinct(F.concat(above, F.array(F.lit(""))))


def scan_licenses(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per row of files: (doc_id, path, license, cosine, via, from_dir).

    via is `own` for a notice in the text itself, `inherited` for the licence of the nearest directory,
    the file's own or one above, that holds a licence file with a notice (of several the clearest, then
    the first by path, then by licence), else `none` with null license. Null texts have no notice; null paths have
    no directory and inherit nothing. Repeated rows are judged alike, each counting in the term
    statistics; no rows give no rows; other columns are not read.
    """
    rows = files.select(F.col(id_col).alias("doc_id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    # rows are known by what they hold, as a notice depends on nothing else
    key = F.concat_ws(":", F.xxhash64("text"), F.octet_length("text"), F.coalesce(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE), F.lit(False)))
    rows = rows.withColumn("row", key)
    found = stored(notices(rows, least), "notices").select(F.col("row").alias("n_row"), "license", "cosine")
    parts = F.split("path", "/")
    keyed = rows.select("row", "doc_id", "path", F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("dir"))
    keyed = stored(keyed, "paths", narrow=False).join(found, F.col("row") == F.col("n_row"), "left").drop("row", "n_row")
    keyed = stored(keyed, "own")
    # a licence per directory that has one; the nearest for every directory; each file asks its own
    holds = keyed.where(F.element_at(F.split("path", "/"), -1).rlike(LICENCE_FILE) & F.col("license").isNotNull())
    holds = holds.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("less"), "path", "license")).alias("best"))
    holds = holds.select(F.col("dir").alias("above"), F.col("best.license").alias("held"), (-F.col("best.less")).alias("held_cosine"))
    above = keyed.where("dir is not null").select("dir").distinct().select("dir", F.explode(ancestors(F.col("dir"))).alias("above"))
    nearest = above.join(holds, "above").groupBy("dir").agg(F.max(F.struct(F.length("above").alias("depth"), "above", "held", "held_cosine")).alias("near"))
    nearest = stored(nearest.select(F.col("dir").alias("n_dir"), "near.*"), "nearest")
    out = keyed.join(nearest, F.col("dir") == F.col("n_dir"), "left")
    own, inherits = F.col("license").isNotNull(), F.col("held").isNotNull()
    return out.select(
        "doc_id",
        "path",
        F.coalesce("license", "held").alias("license"),
        F.coalesce("cosine", "held_cosine").alias("cosine"),
        F.when(own, F.lit("own")).when(inherits, F.lit("inherited")).otherwise(F.lit("none")).alias("via"),
        F.when(~own, F.col("above")).alias("from_dir"),
    )
