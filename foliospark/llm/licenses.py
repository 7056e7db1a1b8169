"""Licence scan: digests of canonical texts, joined with those of known licences. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm.contamination import LOWER, UPPER

#: Known licence texts and notices.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
KNOWN = [
    ("MIT", _MIT), ("MIT", "MIT License\n\n" + _MIT), ("MIT", "The MIT License (MIT)\n\n" + _MIT), ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."), ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC), ("ISC", "ISC License\n\n" + _ISC), ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL), ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL), ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."), ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
]
#: A line that only says who holds the copyright, after lower-casing.
COPYRIGHT = r"^[ \t]*(copyright|\(c\)|©|all rights reserved)([^a-z].*)?$"
#: Equivalent spellings, after lower-casing and before punctuation goes.
SPELLINGS = [(r"licen[cs]e", "license"), (r"organi[sz]ation", "organization"), (r"authori[sz]", "authoriz"), (r"non[- ]infringement", "noninfringement"),
             (r"sub[- ]license", "sublicense"), (r"https://", "http://"), (r"&", " and "), (r"version ([0-9])", "v$1"), (r"v\. ?([0-9])", "v$1")]
#: All that isn't a letter, digit or non-ASCII.
PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F‘’“”–—]+"


def canonical(line: Column) -> Column:
    """One line: lower case (A-Z), no copyright line, one spelling, no punctuation, single blanks."""
    out = F.regexp_replace(F.translate(line, UPPER, LOWER), COPYRIGHT, "")
    for pattern, one in SPELLINGS:
        out = F.regexp_replace(out, pattern, one)
    return F.trim(F.regexp_replace(out, PUNCTUATION, " "))


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that has any."""
    lines = F.split(F.coalesce(text, F.lit("")), "[\n\r]+")
    return F.filter(F.transform(lines, canonical), lambda x: x != "")


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """license and digest of the canonical whole text; a digest is listed once, with the first licence in name order."""
    rows = spark.createDataFrame(known, "license string, text string")
    return rows.select("license", F.sha2(F.array_join(canonical_lines(F.col("text")), " "), 256).alias("digest")).groupBy("digest").agg(F.min("license").alias("license"))


def find_licenses(docs: DataFrame, known: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, text_sha256 (of the canonical whole text), text_license (the known licence whose digest
    that is, else null), n_license_lines (lines that are whole known texts) and licenses (all found, sorted).

    known: license, digest; a bounded reference table, broadcast to a hash join. Each document's lines are summed in the task that
    has made them, so one row of each is shuffled. A null or empty text has no lines; null ids and repeated rows are rows of
    their own. A text of copyright lines only is as an empty one and has no licence.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(doc_id), F.col(text)).alias("_key"), canonical_lines(F.col(text)).alias("lines"))
    own = own.select("doc_id", "_key", F.sha2(F.array_join("lines", " "), 256).alias("text_sha256"), F.size("lines").alias("n"), F.transform("lines", lambda x: F.sha2(x, 256)).alias("digests"))
    # the whole text comes first
    each = own.select("doc_id", "_key", "text_sha256", F.posexplode(F.concat(F.array(F.when(F.col("n") > 0, F.col("text_sha256"))), "digests")).alias("pos", "digest"))
    met = each.join(F.broadcast(known), "digest", "left")
    found = met.groupBy("doc_id", "_key", "text_sha256").agg(
        F.count_if(F.col("pos") == 0).alias("copies"), F.max(F.when(F.col("pos") == 0, F.col("license"))).alias("text_license"),
        F.count_if((F.col("pos") > 0) & F.col("license").isNotNull()).alias("lines"), F.array_sort(F.collect_set("license")).alias("licenses"))
    rows = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return rows.select("doc_id", "text_sha256", "text_license", (F.col("lines") / F.col("copies")).cast("long").alias("n_license_lines"), "licenses")


def _sql(line: str) -> str:
    """canonical() of a line in DuckDB's SQL."""
    out = f"regexp_replace(translate({line}, '{UPPER}', '{LOWER}'), '{COPYRIGHT}', '', 's')"
    for pattern, one in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{one.replace('$', chr(92))}', 'g')"
    return f"trim(regexp_replace({out}, '{PUNCTUATION}', ' ', 'g'))"


def _lines_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(coalesce({text}, ''), '[\\n\\r]+'), lambda x: {_sql('x')}), lambda x: x <> '')"


_QUOTED = [(a, b.replace("'", "''")) for a, b in KNOWN]
ORACLE_SQL = f"""
WITH k AS (SELECT sha256(array_to_string({_lines_sql('t')}, ' ')) AS digest, min(l) AS license FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in _QUOTED)}) AS v(l, t) GROUP BY 1),
d AS (SELECT doc_id, row_number() OVER () AS r, {_lines_sql('text')} AS lines FROM documents),
w AS (SELECT doc_id, r, lines, sha256(array_to_string(lines, ' ')) AS text_sha256 FROM d),
n AS (SELECT r, count(*) AS n, list(license) AS found FROM (SELECT r, unnest(lines) AS line FROM d) JOIN k ON sha256(line) = k.digest GROUP BY r)
SELECT doc_id, text_sha256, k.license AS text_license, coalesce(n, 0) AS n_license_lines,
  coalesce(array_to_string(list_sort(list_distinct(list_filter(list_append(coalesce(found, []), k.license), lambda x: x IS NOT NULL))), ','), '') AS licenses
FROM w LEFT JOIN k ON len(lines) > 0 AND text_sha256 = k.digest LEFT JOIN n USING (r)
"""
