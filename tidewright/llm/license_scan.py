"""Licence scan: TF-IDF cosine of licence statements to templates, then inheritance from the nearest ancestor directory.

In DataFrame expressions only. The whole text of a licence file and the whole leading comment of any other file are
compared with the licences' full wordings and usual headers, fixed lists too, with document frequencies over those
wordings and damped counts of terms; what resembles one closely is the file's own licence. Else lines decide: lines that speak of a licence (headers, and the lines of licence files) are candidates;
each distinct one is a sparse TF-IDF vector, with document frequencies over all candidate lines of the corpus, and is
compared with the vectors of a fixed list of templates by a join on terms; the best template of a file's statements is
its own licence. The licence of a directory comes from its licence file (LICENSE, LICENCE, COPYING, NOTICE; of several
the first by path that has a licence; "unknown" where none of them matches anything), and a file without a licence of its own takes that of the nearest directory
above it, found by a join of its ancestor paths with directories.

Lines are compared once however many files share them, and matches return to files by a salted join on the line.

Defined cases: a licence file that matches nothing has no licence, and what lies below it does not look further up; null or empty texts have no statement; a null path has no directory and inherits nothing; equal scores
take the first template by name; files of one path each keep a row, equal rows too; an empty table has no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import os
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.storage import stored

#: fixed values: licence names and the wording of their usual statements
TEMPLATES = (
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0, Creative Commons Attribution."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Released under the ISC License."),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This file is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: fixed values: full wordings, a file each, and the usual headers of files
WORDINGS = os.path.join(os.path.dirname(os.path.abspath(__file__)), "licenses")
_GNU = (
    "{0} is free software: you can redistribute it and/or modify it under the terms of the GNU {1} as published by the Free Software Foundation; "
    "either version {2} of the License, or (at your option) any later version. ", "{0} is distributed in the hope that it will be useful, but WITHOUT ANY "
    "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1} for more details. ",
    "You should have received a copy of the GNU {1} along with {0}; if not, {3}.")
_LINK, _POST = "see https://www.gnu.org/licenses", "write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA"
HEADERS = (
    *((name, "".join(_GNU[:k]).format(f"this {what}", kind, version, where)) for k, where in ((1, ""), (2, ""), (3, _LINK), (3, _POST)) for name, what, kind, version in (
        ("AGPL-3.0", "program", "Affero General Public License", "3"), ("GPL-2.0", "program", "General Public License", "2"),
        ("GPL-3.0", "program", "General Public License", "3"), ("LGPL-2.0", "library", "Library General Public License", "2"),
        ("LGPL-2.1", "library", "Lesser General Public License", "2.1"), ("LGPL-3.0", "library", "Lesser General Public License", "3"))),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
     "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
     "distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at https://mozilla.org/MPL/2.0/."),
)
CUE = "[Ll][Ii][Cc][Ee][Nn][SsCc][Ee]|[Cc][Oo][Pp][Yy][Rr][Ii][Gg][Hh][Tt]|SPDX|[Pp]ublic [Dd]omain"
TERM = "[a-z0-9]+"
FILE = r"(^|/)(LICENSE|LICENCE|COPYING|NOTICE)[^/]*$"
LEAST = 0.6
LEAST_WHOLE = 0.75
UNKNOWN = "unknown"
#: the leading comment of a file: a block up to its end mark, or lines that begin with a mark
_BLOCK = r"(?s)\A(?:#![^\n]*\n)?\s*+(?:/\*(.*?)\*/|<!--(.*?)-->|\"\"\"(.*?)\"\"\"|'{3}(.*?)'{3}|\{-(.*?)-\}|\(\*(.*?)\*\))"
_HOLDER = r"(?im)^.{0,120}?copyright\s*(?:\(c\)|\u00a9|[0-9]{4}).{0,120}$|^\s{0,9}#!.*$|^.{0,40}-\*-.*-\*-.*$"  # holders, interpreters and modes are no wording
_MARKED = r"^\s*+(?:$|#|//|--|;|%|!|\*|'|\"|(?i:rem|dnl)\b|\.\\\\\")"
_SALTS = 32


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _weighted(terms: DataFrame, idf: DataFrame, key: str) -> DataFrame:
    """(key, term, w, norm): TF-IDF weights and the length of each vector."""
    counted = terms.groupBy(key, "term").agg(F.count("*").alias("tf")).join(idf, "term", "left")
    weights = counted.withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(1.0)))
    norms = weights.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return weights.select(key, "term", "w").join(norms, key)


def _matches(lines: DataFrame) -> DataFrame:
    """(line, license, score) of every distinct line that resembles a template; ``lines`` has (line, n): how often each occurs."""
    templates = lines.sparkSession.createDataFrame(list(TEMPLATES), "license string, wording string")
    own = lines.select("line", "n", F.explode(_terms(F.col("line"))).alias("term"))
    total = lines.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    spread = own.select("line", "n", "term").distinct().groupBy("term").agg(F.sum("n").alias("df"))
    idf = spread.crossJoin(F.broadcast(total)).select("term", (F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1.0).alias("idf"))  # one row of totals
    theirs = _weighted(templates.select("license", F.explode(_terms(F.col("wording"))).alias("term")), idf, "license")
    ours = _weighted(own.select("line", "term"), idf, "line")
    met = ours.join(F.broadcast(theirs.select("license", "term", F.col("w").alias("tw"), F.col("norm").alias("tn"))), "term")  # terms of the fixed list
    scores = met.groupBy("line", "license").agg((F.sum(F.col("w") * F.col("tw")) / (F.first("norm") * F.first("tn"))).alias("score"))
    best = scores.where(F.col("score") >= LEAST).groupBy("line").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "license")).alias("b"))
    return best.select("line", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def _body(path: Column, text: Column) -> Column:
    """What is compared as a whole: a licence file's text, or another file's leading comment; null without one."""
    block = F.concat_ws(" ", *(F.regexp_extract(text, _BLOCK, k) for k in range(1, 7)))
    lines = F.split(text, "\n", -1)
    first = F.array_position(F.transform(lines, lambda x: x.rlike(_MARKED)), False)
    marked = F.array_join(F.when(first == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))), "\n")
    body = F.when(path.rlike(FILE), text).when(text.rlike(_BLOCK), block).when(text.rlike(_MARKED), marked)
    return F.when(body.rlike("(?i)[a-z0-9]"), F.regexp_replace(body, _HOLDER, ""))


def _wordings() -> list[tuple[str, str]]:
    names = sorted(n for n in os.listdir(WORDINGS) if n.endswith(".txt"))
    full = []
    for n in names:
        with open(os.path.join(WORDINGS, n), encoding="utf-8") as f:
            full.append((n.removesuffix(".txt"), f.read()))
    return [*full, *HEADERS]


def _whole(bodies: DataFrame) -> DataFrame:
    """(key, license, score) of every (key, body) that resembles a full wording or a header as a whole."""
    wordings = [(name, Counter(re.findall(TERM, re.sub(_HOLDER, "", text).lower()))) for name, text in _wordings()]
    df = Counter(t for _, c in wordings for t in c)
    idf = {t: math.log((1 + len(wordings)) / (1 + n)) + 1 for t, n in df.items()}
    theirs: dict[str, list] = {t: [] for t in idf}
    for k, (_, counts) in enumerate(wordings):
        w = {t: (1 + math.log(n)) * idf[t] for t, n in counts.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        for t, x in w.items():
            theirs[t].append((k, x / norm))
    spark = bodies.sparkSession
    terms = spark.createDataFrame([(t, idf[t], theirs[t]) for t in sorted(idf)], "term string, idf double, theirs array<struct<k: int, u: double>>")
    names = spark.createDataFrame([(k, name) for k, (name, _) in enumerate(wordings)], "k int, license string")
    counted = bodies.select("key", F.explode(_terms(F.col("body"))).alias("term")).groupBy("key", "term").agg(F.count("*").alias("tf"))
    ours = counted.join(F.broadcast(terms), "term", "left").select(  # terms of the fixed lists
        "key", ((1 + F.log("tf")) * F.coalesce("idf", F.lit(math.log(1 + len(wordings)) + 1))).alias("w"), "theirs")
    norms = ours.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    dots = ours.select("key", "w", F.explode("theirs").alias("t")).groupBy("key", F.col("t.k").alias("k")).agg(F.sum(F.col("w") * F.col("t.u")).alias("dot"))
    scores = dots.join(norms, "key").withColumn("score", F.col("dot") / F.col("norm")).where(F.col("score") >= LEAST_WHOLE).join(F.broadcast(names), "k")
    best = scores.groupBy("key").agg(F.min(F.struct((-F.round("score", 9)).alias("s"), "license")).alias("b"))
    return best.select("key", F.col("b.license").alias("whole_license"), (-F.col("b.s")).alias("whole_score"))


def scan(files: DataFrame) -> DataFrame:
    """(doc_id, path, n_statements, own_license, score, license, inherited_from) of every row of (doc_id, path, text)."""
    text = F.coalesce("text", F.lit(""))
    statements = F.when(text.rlike(CUE), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(CUE)))
    compact = stored(files.select(
        "doc_id", "path", F.monotonically_increasing_id().alias("row"),
        F.coalesce(statements, F.array().cast("array<string>")).alias("lines"), _body(F.coalesce("path", F.lit("")), text).alias("body"))
        .withColumn("key", F.sha2("body", 256)), "statements")
    each = compact.select("row", F.explode("lines").alias("line"))
    matched = _matches(each.groupBy("line").agg(F.count("*").alias("n")))
    salted = matched.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    found = (
        each.withColumn("salt", F.pmod("row", F.lit(_SALTS)).cast("int")).join(salted, ["line", "salt"])
        .groupBy("row").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    )
    bodies = compact.where("key is not null").groupBy("key").agg(F.first("body").alias("body"))  # one of each, equal ones differ in nothing
    alike = _whole(bodies).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    whole = compact.where("key is not null").select("row", "key", F.pmod("row", F.lit(_SALTS)).cast("int").alias("salt")).join(alike, ["key", "salt"])
    rows = (
        compact.select("row", "doc_id", "path", F.size("lines").alias("n_statements")).join(found, "row", "left")
        .join(whole.select("row", "whole_license", "whole_score"), "row", "left")
        .select("row", "doc_id", "path", "n_statements", F.coalesce("whole_license", "b.license").alias("own_license"), F.coalesce("whole_score", -F.col("b.s")).alias("score"))
    )
    rows = stored(rows, "own_licenses")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    directories = (
        rows.where(F.col("path").rlike(FILE)).groupBy(folder.alias("folder"))
        .agg(F.min(F.struct(F.col("own_license").isNull().alias("without"), "path", "own_license")).alias("first"))
        .select("folder", F.coalesce("first.own_license", F.lit(UNKNOWN)).alias("folder_license"))
    )
    parts = F.split(folder, "/")
    above = F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(
        F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))))
    wanting = rows.where("own_license is null and path is not null").select("row", F.explode(above).alias("folder"))
    spread = directories.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    inherited = (
        wanting.withColumn("salt", F.pmod("row", F.lit(_SALTS)).cast("int")).join(spread, ["folder", "salt"])
        .groupBy("row").agg(F.max(F.struct(F.length("folder").alias("depth"), "folder", "folder_license")).alias("near"))
    )
    itself = F.col("path").rlike(FILE) & (F.col("near.folder_license") == UNKNOWN)  # a licence file nobody knows inherits nothing
    near = F.when(~F.coalesce(itself, F.lit(False)), F.col("near"))
    return rows.join(inherited, "row", "left").withColumn("near", near).select(
        "doc_id", "path", F.col("n_statements").cast("long").alias("n_statements"), "own_license", F.round("score", 6).alias("score"),
        F.coalesce("own_license", "near.folder_license").alias("license"), F.col("near.folder").alias("inherited_from"))


def oracle(files: str) -> str:
    """The scan in DuckDB's SQL over a query for (doc_id, path, text)."""
    values = ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)
    return f"""
WITH f AS (SELECT row_number() OVER () AS r, * FROM ({files})),
each AS (SELECT r, line FROM (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM f) WHERE regexp_matches(line, '{CUE}')),
lines AS (SELECT line, count(*) AS n FROM each GROUP BY line),
own AS (SELECT line, n, unnest(regexp_extract_all(lower(line), '{TERM}')) AS term FROM lines),
spread AS (SELECT term, sum(n) AS df FROM (SELECT DISTINCT line, n, term FROM own) GROUP BY term),
idf AS (SELECT term, ln((1.0::DOUBLE + (SELECT coalesce(sum(n), 0) FROM lines)) / (1.0::DOUBLE + df)) + 1.0::DOUBLE AS idf FROM spread),
tt AS (SELECT license, unnest(regexp_extract_all(lower(wording), '{TERM}')) AS term FROM (VALUES {values}) v(license, wording)),
tw AS (SELECT license, term, count(*) * coalesce(any_value(idf), 1.0::DOUBLE) AS w FROM tt LEFT JOIN idf USING (term) GROUP BY license, term),
tn AS (SELECT license, sqrt(sum(w * w)) AS norm FROM tw GROUP BY license),
lw AS (SELECT line, term, count(*) * coalesce(any_value(idf), 1.0::DOUBLE) AS w FROM own LEFT JOIN idf USING (term) GROUP BY line, term),
ln AS (SELECT line, sqrt(sum(w * w)) AS norm FROM lw GROUP BY line),
sc AS (SELECT line, license, round(sum(lw.w * tw.w) / (any_value(ln.norm) * any_value(tn.norm)), 9) AS score, sum(lw.w * tw.w) / (any_value(ln.norm) * any_value(tn.norm)) AS raw
       FROM lw JOIN tw USING (term) JOIN ln USING (line) JOIN tn USING (license) GROUP BY line, license),
bl AS (SELECT line, license, score FROM sc WHERE raw >= {LEAST} QUALIFY row_number() OVER (PARTITION BY line ORDER BY score DESC, license) = 1),
bf AS (SELECT r, license AS own_license, score FROM each JOIN bl USING (line) QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, license) = 1),
cn AS (SELECT r, count(*) AS n_statements FROM each GROUP BY r),
w AS (SELECT f.r, doc_id, path, coalesce(n_statements, 0) AS n_statements, own_license, score, regexp_replace(path, '/?[^/]*$', '') AS folder
      FROM f LEFT JOIN cn USING (r) LEFT JOIN bf USING (r)),
dir AS (SELECT folder, own_license AS folder_license FROM w WHERE regexp_matches(path, '{FILE}') AND own_license IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY folder ORDER BY path, own_license) = 1),
inh AS (SELECT w.r, dir.folder AS inherited_from, folder_license FROM w JOIN dir ON w.own_license IS NULL AND (dir.folder = '' OR w.folder = dir.folder OR starts_with(w.folder, dir.folder || '/'))
        QUALIFY row_number() OVER (PARTITION BY w.r ORDER BY length(dir.folder) DESC) = 1)
SELECT doc_id, path, n_statements, own_license, round(score, 6) AS score, coalesce(own_license, folder_license) AS license, inherited_from FROM w LEFT JOIN inh USING (r)"""
