"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory above.

DataFrame functions only. Units are all lines of a file, its paragraphs and comment blocks of several lines, and the
whole text of a licence file; templates are statements, standard headers, SPDX identifiers and the full texts in `licences`. A unit's vector has its
words' counts times idf; the idf of template words is counted over all files, other words weigh as words of no file. The
cosine to a template is at most the norm of the template's weights of shared words, so `gate` derives words of which a line
that reaches `threshold` holds at least one; other lines needn't be scored. Distinct units are scored once each: the cosine
to each template comes from a join of unit words with the templates' weights, a fixed table of some thousand rows. A file's
own licence is that of its best unit, if the cosine is at least `threshold`. A file without one takes the licence of the licence file in the nearest directory at or
above its own: files' directories and all above are joined with the directories of licence files, and the deepest wins.

A null text has no own licence. A null path inherits nothing and is returned. Ties go to the smaller licence name, then to
the smaller path of a licence file. Repeated paths are rows of their own. Extra columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names and the statements that name them.
STATEMENTS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This work is subject to the Mozilla Public License, version 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
]
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version."
_GNU_REST = " This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
_APACHE_REST = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_FAMILIES = [("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.1", "Lesser ", "2.1"), ("LGPL-3.0", "Lesser ", "3")]
HEADERS = [(name, (_GNU + rest).format(kind, version)) for name, kind, version in _FAMILIES for rest in ("", _GNU_REST)]
HEADERS += [("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_REST)]
HEADERS += [("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.")]
IDENTIFIERS = [(name, f"SPDX-License-Identifier: {name}") for name in ("BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "GPL-2.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0")]
IDENTIFIERS += [(name, f"SPDX-License-Identifier: {name}-{end}") for name, _, _ in _FAMILIES for end in ("only", "or-later")]
TEXTS = [(p.stem, p.read_text()) for p in sorted((Path(__file__).parent / "licences").glob("*.txt"))]
TEMPLATES = STATEMENTS + HEADERS + IDENTIFIERS + TEXTS
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([.-][^/]*)?$"
# Before a line that doesn't begin as a comment.
CODE_LINE = r"\n(?=[ \t]*[^\s#/*;%-])"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


# Words that a unit shares with some template; without any, all its cosines are 0.
SIGNS = sorted({w for _, text in TEMPLATES for w in _template_words(text)})


def gate(vectors: list[dict[str, float]], threshold: float, idf: dict[str, float]) -> list[str]:
    """Words, the rarest first, of which every unit with a cosine of `threshold` or more to one of the vectors (norm 1) holds at least one:
    what is left of each vector has a norm below the threshold."""
    chosen: set[str] = set()
    for v in vectors:
        rest = sum(x * x for w, x in v.items() if w not in chosen)
        for w, x in sorted(v.items(), key=lambda p: (-idf[p[0]], -p[1], p[0])):
            if rest < max(threshold - 1e-6, 0.0) ** 2:
                break
            if w not in chosen:
                chosen.add(w)
                rest -= x * x
    return sorted(chosen)


def directories(path: Column) -> Column:
    """The directory of a path and all above it, the root as an empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def licence_scan(files: DataFrame, licence_file: Column | None = None, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """id, path, licence, score (of the own licence), inherited, licence_path (of the licence file), for every file."""
    spark = files.sparkSession
    is_licence = licence_file if licence_file is not None else files[path_col].rlike(LICENCE_FILE)
    rows = files.select(files[id_col].alias("id"), files[path_col].alias("path"), files[text_col].cast("string").alias("text"), F.coalesce(is_licence, F.lit(False)).alias("grants"))
    rows = rows.withColumn("print", F.xxhash64("text"))  # with id and path it tells rows apart; rows alike in all have one answer

    split = [(k, name, _template_words(text)) for k, (name, text) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws in split for w in ws})
    quoted = ", ".join(f"('{w}')" for w in vocabulary)
    known = F.broadcast(spark.sql(f"SELECT * FROM VALUES {quoted} AS t(w)"))
    counts = rows.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("w")).join(known, "w").groupBy("w").count()
    found = {r["w"]: r["count"] for r in counts.collect()}  # at most the templates' words
    n = rows.count()
    idf = {w: math.log((1 + n) / (1 + found.get(w, 0))) + 1 for w in vocabulary}
    other = math.log(1 + n) + 1
    weights, vectors = [], []
    for k, name, ws in split:
        v = {w: ws.count(w) * idf[w] for w in ws}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({w: x / norm for w, x in v.items()})
        weights += [f"({k}, '{name}', '{w}', {x / norm!r}D)" for w, x in v.items()]
    template = spark.sql(f"SELECT * FROM VALUES {', '.join(weights)} AS t(template, licence, w, weight)")
    rarity = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{w}', {x!r}D)" for w, x in idf.items()) + " AS t(w, idf)")

    held = rf"(?<![a-z0-9])(?:{'|'.join(gate(vectors, threshold, idf))})(?![a-z0-9])"
    low = F.lower("text")
    comments = F.transform(F.split(low, CODE_LINE), lambda piece: F.regexp_replace(piece, r"^[ \t]*[^\s#/*;%-][^\n]*\n", ""))
    blocks = F.concat(F.split(low, r"\n(?:[^a-z0-9\n]*\n)+"), comments, F.regexp_extract_all(low, F.lit(r"(?s)/\*.*?\*/"), 0))
    parts = F.filter(F.concat(F.split(low, "\n"), F.filter(blocks, lambda u: F.contains(u, F.lit("\n")))), lambda u: u.rlike(held))
    parts = F.when(low.rlike(held), parts).otherwise(F.array().cast("array<string>"))
    units = rows.select("id", "path", "print", F.explode(F.array_distinct(F.when(F.col("grants"), F.concat(parts, F.array(low))).otherwise(parts))).alias("u")).withColumn("hash", F.md5("u"))
    # dealt by hash once: words, norms and products are counted where their unit lies
    words = units.groupBy("hash").agg(F.first("u").alias("u")).select("hash", F.explode(_words(F.col("u"))).alias("w"))
    counted = words.groupBy("hash", "w").count().join(F.broadcast(rarity), "w", "left").withColumn("x", F.col("count") * F.coalesce("idf", F.lit(other)))
    norms = counted.groupBy("hash").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = counted.join(F.broadcast(template), "w").groupBy("hash", "template", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    near = dots.join(norms, "hash").select("hash", "licence", F.round(F.col("dot") / F.col("norm"), 9).alias("score")).where(F.col("score") >= threshold)
    best = near.groupBy("hash").agg(F.min(F.struct((-F.col("score")).alias("minus"), "licence")).alias("best"))
    own = units.select("id", "path", "print", "hash").join(best, "hash").groupBy("id", "path", "print").agg(F.min("best").alias("best"))
    own = own.select(F.col("id").alias("i"), F.col("path").alias("p"), F.col("print").alias("t"), F.col("best.licence").alias("own"), (-F.col("best.minus")).alias("score"))

    same = (F.col("print") == F.col("t")) & F.col("id").eqNullSafe(F.col("i")) & F.col("path").eqNullSafe(F.col("p"))
    base = rows.select("id", "path", "print", "grants").join(own, same, "left").drop("i", "p", "t", "print")
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    given = base.where("grants AND own IS NOT NULL AND path IS NOT NULL").groupBy(folder.alias("folder")).agg(F.min(F.struct("path", "own")).alias("from"))
    bare = base.where("own IS NULL AND path IS NOT NULL").select("path").distinct().select("path", F.explode(directories(F.col("path"))).alias("folder"))
    nearest = bare.join(given, "folder").groupBy("path").agg(F.max(F.struct(F.length("folder").alias("depth"), "from")).alias("m")).select(F.col("path").alias("p"), F.col("m.from.path").alias("licence_path"), F.col("m.from.own").alias("above"))
    out = base.join(nearest, (F.col("path") == F.col("p")) & F.col("own").isNull(), "left")
    return out.select(F.col("id").alias(id_col), "path", F.coalesce("own", "above").alias("licence"), "score", (F.col("own").isNull() & F.col("above").isNotNull()).alias("inherited"), "licence_path")
