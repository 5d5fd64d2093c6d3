"""Licence scans: sparse TF-IDF cosine of headers and licence files to templates, then inheritance by path.

The units of a file are its lines, its blocks (runs of two or more lines that hold a term, such as a
comment with its markers or a paragraph) and, for a licence file, its whole text.  Units that hold one of
MARKS are kept, out of one pass over the texts, which are not read again.  A unit's vector has, for every term
of it (lower-case runs of letters, digits and dots, but stop words), its count times ln(1 + N/df), N and df
counted over all units kept; so words that no licence has lower its cosine.  Vectors are rows (unit, term,
weight), templates the same with the weights of the units' terms.  A file's own licence is that of its best unit
and template at THRESHOLD or more (ties: the smaller name); the reservation of all rights stands back
behind any licence.

A file named as a licence file gives its licence to its directory.  A file without a licence of its
own takes that of its nearest ancestor directory that has one: directories, not files, are joined to
their ancestors, so that a directory of a third of all files is one row; files then look up theirs.

All of it is DataFrame functions.

Defined results: a null or blank text has no unit and may inherit; a null path has no directory; a
directory with several licence files takes the best score's (ties: the smaller name); files that
repeat have a row each; other columns are passed on; no rows give no rows; templates without terms
match nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables, salted_join

THRESHOLD = 0.7
#: Words of which a unit must hold one, in lower case.
MARKS = ("licen", "copyright", "rights reserved", "redistribut", "permission", "warrant", "public domain", "spdx")
#: What stands back behind any licence.
RESERVED = "proprietary"
#: Fixed value: words that say nothing about a licence.
STOP = frozenset("a all and any are as at be by for from if in is it its of on or s that the this to under with you your".split())

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION)"
    " HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def _gnu(name: str, version: str) -> list[str]:
    notice = (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
        f" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."
        f" You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )
    return [f"This work is licensed under the {name}, version {version}.", f"{name} Version {version}", notice.partition(" This program is distributed")[0], notice]


# Texts of common licences and the notices that refer to them; the long ones by their notices.
TEMPLATES: dict[str, list[str]] = {
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
        ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "BSD-2-Clause": ["BSD 2-Clause License", f"{_BSD} {_BSD_WARRANTY}"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted.",
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        f"{_BSD}{_BSD_NAMES} {_BSD_WARRANTY}",
    ],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["CC0 1.0 Universal", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain."],
    "GPL-2.0": _gnu("GNU General Public License", "2"),
    "GPL-3.0": _gnu("GNU General Public License", "3"),
    "ISC": [
        "ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES'
        " OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ],
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3"),
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,"
        " and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
        f" The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_WARRANTY}"
        " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
        " In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors."
        f" We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. {_WARRANTY}"
        " IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to <https://unlicense.org>",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."
        " Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"
        " 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required."
        " 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ],
    RESERVED: ["All rights reserved.", "Copyright. All rights reserved."],
}
for _name, _texts in TEMPLATES.items():
    if _name != RESERVED:
        _texts.append(f"SPDX-License-Identifier: {_name}")


def terms_of(text: str) -> list[str]:
    return [t for t in re.findall(r"[a-z0-9]+(?:\.[a-z0-9]+)*", text.lower()) if t not in STOP]


def template_terms(templates: dict[str, list[str] | str] = TEMPLATES) -> list[tuple[str, int, str, int]]:
    """(name, number, term, count) of every template: a few thousand rows."""
    rows, number = [], -1
    for name in sorted(templates):
        texts = [templates[name]] if isinstance(templates[name], str) else templates[name]
        for text in texts:
            terms, number = terms_of(text), number + 1
            rows += [(name, number, t, terms.count(t)) for t in sorted(set(terms))]
    return rows


def _bound(value: Column, body) -> Column:
    """body of a value that it needs more than once, worked out once."""
    return F.transform(F.array(value), body)[0]


def marked(text: Column) -> Column:
    """Whether a text holds one of MARKS."""

    def some(low: Column) -> Column:
        found = F.contains(low, F.lit(MARKS[0]))
        for mark in MARKS[1:]:
            found = found | F.contains(low, F.lit(mark))
        return found

    return F.coalesce(_bound(F.lower(text), some), F.lit(False))


def units(text: Column, whole: Column) -> Column:
    """The marked lines, blocks and, where whole, text of a file."""
    lines = F.split(text, "\r?\n")
    solid = F.array_join(F.transform(lines, lambda x: F.when(F.lower(x).rlike("[a-z0-9]"), x).otherwise("")), "\n")
    blocks = F.filter(F.split(F.regexp_replace(solid, "^\n+|\n+$", ""), "\n\n+"), lambda x: F.contains(x, F.lit("\n")))
    none = F.array().cast("array<string>")
    every = F.concat(lines, blocks, F.when(F.coalesce(whole, F.lit(False)), F.array(text)).otherwise(none))
    return F.when(marked(text), F.filter(every, marked)).otherwise(none)


def own_licenses(files: DataFrame, templates: dict[str, list[str] | str] = TEMPLATES, threshold: float = THRESHOLD, text_col: str = "text", file_col: str | None = None, named: DataFrame | None = None) -> DataFrame:
    """files, but for text_col, with columns license and score (null and 0.0 where no unit reaches threshold).

    file_col tells licence files.  Where it takes a join to tell them, named has their keys (columns of files) instead:
    these meet what the scan leaves, not the texts, and whole texts are then compared by the weights of lines and blocks.
    """
    spark = files.sparkSession
    tables = Tables(spark)
    columns = [c for c in files.columns if c not in ("license", "score", text_col)]
    whole = F.col(file_col) if file_col else F.lit(named is not None)
    # Files are numbered as they are written; every later step reads the numbers.
    found = files.select(F.struct(*columns).alias("file"), units(F.col(text_col).cast("string"), whole).alias("units"))
    found = tables.keep(found.select(F.monotonically_increasing_id().alias("row"), "file", "units"), "units")
    words = F.regexp_extract_all(F.lower("unit"), F.lit(r"([a-z0-9]+(?:\.[a-z0-9]+)*)"), F.lit(1))
    kept = found.select("row", "units", F.size("units").alias("whole_no"))
    if named is not None:  # a whole text is the last unit of any file; only licence files keep theirs
        keys = found.where(F.size("units") > 0).select("row", *[F.col(f"file.{c}").alias(c) for c in named.columns])
        told = keys.join(named.distinct().hint("shuffle_hash"), named.columns, "left_semi").select("row", F.lit(True).alias("told"))
        kept = found.where(F.size("units") > 0).select("row", "units").join(told.hint("shuffle_hash"), "row", "left")
        last = F.size("units") - 1
        kept = kept.select("row", F.when(F.col("told"), F.col("units")).otherwise(F.slice("units", F.lit(1), last)).alias("units"), last.alias("whole_no"))
    held = kept.select("row", "whole_no", F.posexplode("units").alias("unit_no", "unit")).select("row", "unit_no", (F.col("unit_no") < F.col("whole_no")).alias("counts"), F.explode(words).alias("term"))
    held = held.where(~F.col("term").isin(sorted(STOP))).groupBy("row", "unit_no", "counts", "term").agg(F.count("*").alias("tf"))
    held = tables.keep(held, "terms")

    n = held.where("counts").select("row", "unit_no").distinct().count()
    seen = held.where("counts").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.col("tf") * F.ln(1 + F.lit(n) / F.greatest(F.coalesce("df", F.lit(0)), F.lit(1)))
    vectors = tables.keep(salted_join(held, seen, ["term"], "row").select("row", "unit_no", "term", weight.alias("x")), "vectors")
    rows = template_terms(templates)
    given = spark.createDataFrame(rows, "name string, number int, term string, tf long")
    given = given.join(seen, "term", "left").select("name", "number", "term", weight.alias("y"))
    given = tables.keep(given.join(given.groupBy("number").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("length")), "number"), "templates")

    dots = vectors.join(F.broadcast(given), "term").groupBy("row", "unit_no", "name", "number").agg(F.sum(F.col("x") * F.col("y") / F.col("length")).alias("dot"))
    sizes = vectors.groupBy("row", "unit_no").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    scored = dots.join(sizes, ["row", "unit_no"]).select("row", "name", (F.col("dot") / F.col("size")).alias("score")).where(F.col("score") >= threshold)
    best = F.min(F.struct((F.col("name") == RESERVED).alias("reserved"), (-F.round("score", 9)).alias("near"), "name", "score")).alias("best")
    out = found.select("row", "file").join(scored.groupBy("row").agg(best).hint("shuffle_hash"), "row", "left")
    return out.select("file.*", F.col("best.name").alias("license"), F.coalesce("best.score", F.lit(0.0)).alias("score"))


def directory(path: Column) -> Column:
    """The directory of a path; '' at the top."""
    return F.regexp_replace(F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(""), "/+$", "")


def inherited(files: DataFrame, path_col: str = "path", file_col: str = "is_license") -> DataFrame:
    """files (license, score, path_col, file_col) with license_source (own, inherited or none), inherited_from and effective_license."""
    columns = [c for c in files.columns if c not in ("license_source", "inherited_from", "effective_license")]
    placed = files.select(*columns, directory(F.col(path_col)).alias("_dir"))
    given = placed.where(F.col(file_col) & F.col("license").isNotNull())
    given = given.groupBy("_dir").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license").alias("name"))).alias("g")).select(F.col("_dir").alias("_above"), F.col("g.name").alias("_name"))
    parts = F.split("_dir", "/")
    ancestors = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    up = placed.select("_dir").where("_dir is not null").distinct().select("_dir", F.explode(F.array_distinct(ancestors)).alias("_above"))
    nearest = up.join(given, "_above").groupBy("_dir").agg(F.max(F.struct(F.length("_above").alias("n"), F.col("_above"), F.col("_name"))).alias("near"))
    nearest = nearest.select("_dir", F.col("near._above").alias("_from"), F.col("near._name").alias("_name"))
    out = salted_join(placed.withColumn("_row", F.xxhash64(path_col)), nearest, ["_dir"], "_row")
    own = F.col("license").isNotNull()
    return out.select(
        *columns,
        F.when(own, "own").when(F.col("_name").isNotNull(), "inherited").otherwise("none").alias("license_source"),
        F.when(~own, F.col("_from")).alias("inherited_from"),
        F.coalesce("license", "_name").alias("effective_license"),
    )
