"""Licences of files: sparse TF-IDF cosine of licence headers and licence files to templates, and inheritance by directory.

A file's *units* are its lines with a cue word, each by itself and all together, the comment that it begins with and the
paragraphs around cue lines. A *licence file* is one whose name says so, or at least half of which is made of cue
lines; its whole text is a unit too. Units and templates (usual notices, identifiers and whole short licences) are sparse
TF-IDF vectors; a file takes the template of the highest cosine of any of its units if that reaches ``LEAST``. Reserved
rights name a licence only where no other one is near enough. A file without a licence of its own takes that of the nearest
directory above it which has a licence file.

Weights are (1 + ln tf) * idf. Document frequencies of the templates' terms are counted over the headers of all files; a
term that no template has weighs as one that every header has. So what is broadcast is bounded by the templates, and no row is dealt by term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, small_side

LEAST = 0.5
RESERVED = "Proprietary"
#: A line that matches is part of a licence header.
CUE = r"(?i)licen[cs]e|copyright|spdx|all rights reserved|permission is hereby granted|free software|public domain"
#: Names of licence files.
FILE_NAME = r"(?i)(^|/)(un)?(licen[cs]e|copying|copyright|notice)([.-][^/]*)?$"
#: A comment at the beginning of a text: lines that begin with one of the usual marks.
COMMENT = r"^(?:[ \t]*(?:#|//|/\*|\*|--|;|%|<!--)[^\n]*\n?)+"
#: Usual notices and short licences (fixed values: published texts).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-clause license"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD 3-clause license"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    (RESERVED, "Copyright all rights reserved"),
    (RESERVED, "All rights reserved"),
)
#: Notices, and each licence's identifier as the first line of a file names it.
TEMPLATES = (*NOTICES, *((name, f"SPDX-License-Identifier: {name}") for name in dict(NOTICES) if name != RESERVED))


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TEMPLATES)], "template int, license string, text string")


def cue_lines(text: Column) -> Column:
    """The text's lines that name a licence, in order."""
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(CUE))


def cue_paragraphs(text: Column) -> Column:
    """Paragraphs (between empty lines) that name a licence."""
    return F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda p: p.rlike(CUE))


def units_of(text: Column, whole: Column) -> Column:
    """The distinct texts that stand for a file's licence; none for a file that neither has a cue nor is taken ``whole``."""
    lines, comment = cue_lines(text), F.regexp_extract(text, COMMENT, 0)
    parts = F.concat(lines, cue_paragraphs(text), F.array(F.array_join(lines, "\n")), F.when(comment.rlike(CUE), F.array(comment)).otherwise(F.array().cast("array<string>")))
    parts = F.when(text.rlike(CUE), parts).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(parts, F.when(whole, F.array(text)).otherwise(F.array().cast("array<string>"))))


def is_license_file(path: Column, text: Column) -> Column:
    """Whether a file speaks for its directory: by name, or as at least half of its characters stand in cue lines."""
    told = F.aggregate(cue_lines(text), F.lit(0), lambda n, line: n + F.length(line))
    return F.coalesce(path.rlike(FILE_NAME) | (text.rlike(CUE) & (told * 2 >= F.length(text))), F.lit(False))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(text), F.lit(r"([a-z]+|[0-9]+)"), 1)


def vectors(rows: DataFrame, key: str, idf: DataFrame) -> DataFrame:
    """Sparse vectors of unit length, only their terms that ``idf`` has: key, term, weight."""
    counts = rows.select(key, F.explode(terms(F.col("text"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    weighed = counts.join(small_side(idf, idf.count()), "term", "left").withColumn("w", (F.log("tf") + 1.0) * F.coalesce("idf", F.lit(1.0)))
    known = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "w")))  # at most the templates' terms
    sums = weighed.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), known.alias("known"))
    return sums.select(key, "norm", F.explode("known").alias("k")).select(key, F.col("k.term").alias("term"), (F.col("k.w") / F.col("norm")).alias("w"))


def unit_licenses(units: DataFrame, headers: DataFrame, known: DataFrame, least: float = LEAST) -> DataFrame:
    """``unit, license, score, granted, template`` for distinct units (unit, text) that are near enough to a template.

    Document frequencies come from ``headers`` (head, n), each as often as it stands, and all templates. Scores are rounded to
    four digits; of equal ones the lower template wins.
    """
    known = materialize(known.select("template", "license", "text"))
    size = known.count()
    total = (headers.agg(F.sum("n").alias("t")).first()[0] or 0) + size
    vocabulary = materialize(known.select(F.explode(terms(F.col("text"))).alias("term")).distinct())
    once = headers.select("n", F.explode(F.array_distinct(terms(F.col("head")))).alias("term")).join(small_side(vocabulary, vocabulary.count()), "term").select("n", "term")
    df = once.unionAll(known.select(F.lit(1).cast("bigint").alias("n"), F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))).groupBy("term").agg(F.sum("n").alias("df"))
    idf = materialize(df.select("term", (F.log((F.lit(total) + 1.0) / (F.col("df") + 1.0)) + 1.0).alias("idf")))
    right = materialize(vectors(known.select("template", "text"), "template", idf).withColumnRenamed("w", "tw"))
    dots = vectors(units, "unit", idf).join(small_side(right, right.count()), "term").groupBy("unit", "template").agg(F.round(F.sum(F.col("w") * F.col("tw")), 4).alias("score"))
    near = dots.filter(F.col("score") >= least).join(small_side(known.select("template", "license"), size), "template")
    rank = F.struct((F.col("license") != RESERVED).alias("granted"), "score", (-F.col("template")).alias("minus"), "license")
    return near.groupBy("unit").agg(F.max(rank).alias("b"))


def folders(path: Column) -> Column:
    """All directories above a file, each as an array of (directory, depth)."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda d: F.struct(F.array_join(F.slice(parts, F.lit(1), d), "/").alias("dir"), d.alias("depth")))


def scan_licenses(files: DataFrame, key: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST, known: DataFrame | None = None) -> DataFrame:
    """One row per input row: ``doc_id, own_license, own_score, license, inherited_from, license_file``.

    ``own_license`` is null without a unit near enough to a template. ``license`` is the own one, or that of the nearest directory
    above, named in ``inherited_from`` (else null); a directory has the licence that most licence files directly in it have, of equally
    many the first by name. A null or empty text has no units; a null path is the file "" in the root. Texts of any length are
    read whole. Null or repeated keys and repeated rows pass through. Other columns, whatever their names, are ignored; an
    empty table gives an empty result.
    """
    known = templates(files.sparkSession) if known is None else known
    rows = files.select(F.col(key).alias("doc_id"), F.coalesce(F.col(path_col), F.lit("")).alias("path"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("license_file", is_license_file(F.col("path"), F.col("text")))
    folder = F.when(F.instr("path", "/") > 0, F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)).otherwise("")
    head = F.when(F.col("text").rlike(CUE), F.array_join(cue_lines(F.col("text")), "\n"))
    rows = rows.select("doc_id", folder.alias("folder"), "license_file", head.alias("head"), units_of(F.col("text"), F.col("license_file")).alias("units"))
    case = F.when(F.size("units") > 0, F.sha2(F.to_json("units"), 256))  # files with the same units share a case
    rows = materialize(rows.withColumn("case", case))
    cases = materialize(rows.filter("case is not null").groupBy("case").agg(F.first("units").alias("units"), F.first("head").alias("head"), F.count("*").alias("n")))
    units = materialize(cases.select(F.explode("units").alias("text")).distinct().select(F.sha2("text", 256).alias("unit"), "text"))
    best = materialize(unit_licenses(units, cases.filter("head is not null"), known, least))
    own = cases.select("case", F.explode("units").alias("u")).select("case", F.sha2("u", 256).alias("unit")).join(small_side(best, best.count()), "unit").groupBy("case").agg(F.max("b").alias("b"))
    own = materialize(own.select("case", F.col("b.license").alias("license"), F.col("b.score").alias("score")))
    rows = rows.select("doc_id", "folder", "license_file", "case").join(small_side(own, own.count()), "case", "left")
    votes = rows.filter("license_file and license is not null").groupBy("folder", "license").agg(F.count("*").alias("n"))
    by_folder = materialize(votes.groupBy("folder").agg(F.min(F.struct((-F.col("n")).alias("n"), "license")).alias("v")).select(F.col("folder").alias("dir"), F.col("v.license").alias("dir_license")))
    above = rows.select("folder").distinct().select("folder", F.explode(folders(F.concat("folder", F.lit("/x")))).alias("f")).select("folder", "f.dir", "f.depth")
    nearest = materialize(above.join(small_side(by_folder, by_folder.count()), "dir").groupBy("folder").agg(F.max(F.struct("depth", "dir", "dir_license")).alias("near")))
    out = rows.join(small_side(nearest, nearest.count()), "folder", "left")
    free = F.col("license").isNull()
    return out.select("doc_id", F.col("license").alias("own_license"), F.col("score").alias("own_score"), F.coalesce("license", "near.dir_license").alias("license"), F.when(free, F.col("near.dir")).alias("inherited_from"), "license_file")


LISTED = ", ".join("({}, '{}', '{}')".format(i, name, text.replace("'", "''")) for i, (name, text) in enumerate(TEMPLATES))
SQL = rf"""
WITH k(template, license, text) AS (VALUES {LISTED}),
d AS (SELECT doc_id, concat_ws('/', source, lang, doc_id) AS path, coalesce(text, '') AS text, regexp_matches(coalesce(text, ''), '{CUE}') AS cue FROM documents),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{CUE}')) AS lines, list_filter(regexp_split_to_array(text, '\n[ \t\r]*\n'), lambda x: regexp_matches(x, '{CUE}')) AS paras,
  regexp_extract(text, '{COMMENT}') AS comment FROM d WHERE cue),
f AS (SELECT d.doc_id, CASE WHEN contains(d.path, '/') THEN regexp_extract(d.path, '^(.*)/[^/]*$', 1, 's') ELSE '' END AS folder, array_to_string(lines, chr(10)) AS head,
  regexp_matches(d.path, '{FILE_NAME}') OR coalesce(d.cue AND coalesce(list_sum(list_transform(lines, lambda p: length(p))), 0) * 2 >= length(d.text), false) AS license_file, d.text, d.cue, lines, paras, comment FROM d LEFT JOIN l USING (doc_id)),
un AS (SELECT doc_id, unnest(list_distinct(list_concat(CASE WHEN cue THEN list_concat(lines, paras, [head], CASE WHEN regexp_matches(comment, '{CUE}') THEN [comment] ELSE [] END) ELSE [] END, CASE WHEN license_file THEN [text] ELSE [] END))) AS u FROM f),
voc AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]+')) AS term FROM k),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(head), '[a-z]+|[0-9]+'))) AS term FROM f WHERE cue UNION ALL SELECT unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+|[0-9]+'))) FROM k) WHERE term IN (SELECT term FROM voc) GROUP BY term),
n AS (SELECT (SELECT count(*) FROM f WHERE cue) + (SELECT count(*) FROM k) AS total),
idf AS (SELECT term, ln((total + 1.0::DOUBLE) / (df + 1.0::DOUBLE)) + 1.0::DOUBLE AS idf FROM df, n),
tf AS (SELECT 't' || template AS v, term, count(*) AS tf FROM (SELECT template, unnest(regexp_extract_all(lower(text), '[a-z]+|[0-9]+')) AS term FROM k) GROUP BY ALL
  UNION ALL SELECT v, term, count(*) FROM (SELECT 'u' || u AS v, unnest(regexp_extract_all(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z]+|[0-9]+')) AS term FROM (SELECT DISTINCT u FROM un)) GROUP BY ALL),
w AS (SELECT v, term, (ln(tf) + 1.0::DOUBLE) * coalesce(idf, 1.0::DOUBLE) AS w FROM tf LEFT JOIN idf USING (term)),
x AS (SELECT v, term, w / sqrt(sum(w * w) OVER (PARTITION BY v)) AS w FROM w),
dots AS (SELECT substr(a.v, 2) AS u, CAST(substr(b.v, 2) AS INT) AS template, round(sum(a.w * b.w), 4) AS score FROM x a JOIN x b ON a.term = b.term AND a.v[1] = 'u' AND b.v[1] = 't' WHERE a.term IN (SELECT term FROM voc) GROUP BY ALL),
best AS (SELECT doc_id, max(row(license <> '{RESERVED}', score, -template, license)) AS b FROM un JOIN dots USING (u) JOIN k USING (template) WHERE score >= {LEAST} GROUP BY doc_id),
r AS (SELECT f.doc_id, folder, license_file, b[4] AS license, b[2] AS score FROM f LEFT JOIN best USING (doc_id)),
votes AS (SELECT folder AS dir, arg_min(license, row(-n, license)) AS dir_license FROM (SELECT folder, license, count(*) AS n FROM r WHERE license_file AND license IS NOT NULL GROUP BY ALL) GROUP BY folder),
above AS (SELECT folder, array_to_string(string_split(folder, '/')[1:i], '/') AS dir, i FROM (SELECT folder, unnest(range(0, len(string_split(folder, '/')) + 1)) AS i FROM (SELECT DISTINCT folder FROM r))),
near AS (SELECT folder, arg_max(dir, i) AS dir, arg_max(dir_license, i) AS dir_license FROM above JOIN votes USING (dir) GROUP BY folder)
SELECT doc_id, license AS own_license, score AS own_score, coalesce(license, dir_license) AS license, CASE WHEN license IS NULL THEN dir END AS inherited_from, license_file FROM r LEFT JOIN near USING (folder)
"""
