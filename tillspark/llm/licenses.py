"""Licence scans by canonical digest lookup, with DataFrame functions only.

A text is brought to a canonical form (lower case, no punctuation, no copyright lines, one spelling
of words which are spelt in several ways) and its digest is joined with the digests of known
licences, brought to the same form. The whole text and each of its lines are looked up, so both a
licence file and a notice of one line inside a document are found; a notice of several lines inside
a document is not. LICENSES holds six short licences as whole texts and the others by a notice only;
full texts and standard headers of more come as a table (license, text), see `scan`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillspark.llm.scratch import keep, text_of

# Texts of public licences and usual notices, by SPDX identifier.
_GRANT = (
    "Redistribution and use in source and binary forms, with or without modification, are "
    "permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of "
    "conditions and the following disclaimer in the documentation and/or other materials provided "
    "with the distribution.\n"
)
_NO_NAMES = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
    "endorse or promote products derived from this software without specific prior written "
    "permission.\n"
)
_BSD_WARRANTY = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR '
    "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY "
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR "
    "CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY "
    "THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
    "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
    "POSSIBILITY OF SUCH DAMAGE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
    "without fee is hereby granted"
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS '
    "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL "
    "THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
    "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
    "PERFORMANCE OF THIS SOFTWARE."
)
LICENSES = (
    (
        "MIT",
        "MIT License\nPermission is hereby granted, free of charge, to any person obtaining a copy of "
        'this software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:\n"
        "The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, '
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
        "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    ("BSD-2-Clause", _GRANT + _BSD_WARRANTY),
    ("BSD-3-Clause", _GRANT + _NO_NAMES + _BSD_WARRANTY),
    (
        "ISC",
        _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear "
        "in all copies.\n" + _ISC_WARRANTY,
    ),
    ("0BSD", _ISC_GRANT + ".\n" + _ISC_WARRANTY),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event "
        "will the authors be held liable for any damages arising from the use of this software.\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented "
        "as being the original software.\n"
        "3. This notice may not be removed or altered from any source distribution.",
    ),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)
#: One spelling for words spelt in several ways, after punctuation is gone: (pattern, replacement)
#: in the syntax of Java with $; both sides of the lookup pass through the same rules.
SPELLINGS = (
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("copyright owner", "copyright holder"),
    ("whilst", "while"),
    ("judgement", "judgment"),
    ("acknowledgement", "acknowledgment"),
    ("programme", "program"),
    ("https", "http"),
)
SPELLING_RULES = (
    (r"is(e|ed|es|er|ing|ation|ations)( |$)", "iz$1$2"),
    (r"our(s|ed|ing|ite|able|)( |$)", "or$1$2"),
)
_NOT_WORDS = r"[^\p{L}\p{N}]+"
_COPYRIGHT_LINE = r"^(copyright|c copyright|all rights reserved|portions copyright)( .*)?$"


def canonical_lines(text: Column) -> Column:
    """The text's lines in canonical form, without those that are empty or about copyright."""

    def line(raw: Column) -> Column:
        plain = F.trim(F.regexp_replace(F.lower(raw), _NOT_WORDS, " "))
        for was, now in SPELLINGS:
            plain = F.replace(plain, F.lit(was), F.lit(now))
        for was, now in SPELLING_RULES:
            plain = F.regexp_replace(plain, was, now)
        return plain

    lines = F.transform(F.split(text, "\n"), line)
    return F.filter(lines, lambda x: (x != "") & ~x.rlike(_COPYRIGHT_LINE))


def _digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def known_digests(spark: SparkSession, licenses=LICENSES) -> DataFrame:
    """(digest, license) of the known texts; one row for each of them."""
    if isinstance(licenses, DataFrame):
        rows = licenses
    else:
        rows = spark.createDataFrame(list(licenses), "license string, text string")
    whole = _digest(F.array_join(canonical_lines(F.col("text")), " "))
    return rows.select(whole.alias("digest"), "license").distinct()


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", licenses=LICENSES) -> DataFrame:
    """Per row: doc_id, digest of the whole canonical text, license, notices.

    `licenses` holds pairs or is a table (license, text) of any size, such as the SPDX texts and
    headers. `license` is the known licence whose text the whole document is, else null; names which
    share a text are joined by commas. `notices` joins the
    sorted licences of all single lines which are known texts by commas (empty if there is none).
    Null and empty texts have the digest of the empty text and no licence. Findings are those of each
    row by itself, whatever its id: rows may share one or have none.
    """
    spark = docs.sparkSession
    known = known_digests(spark, licenses)
    # Several names may share a text.
    named = known.groupBy("digest").agg(
        F.array_join(F.sort_array(F.collect_set("license")), ",").alias("license")
    )
    # Every row is read once: its whole text and each of its lines become digests to look up. Lines
    # which are no known text fall out before anything is shuffled by row.
    read = docs.select(
        docs[id_col].alias("doc_id"), canonical_lines(text_of(docs, text_col)).alias("lines")
    )
    looked = read.select(
        "doc_id",
        _digest(F.array_join("lines", " ")).alias("digest"),
        F.transform("lines", _digest).alias("lines"),
    )
    if not isinstance(licenses, DataFrame):
        return _looked_up(looked, named)
    return _joined(looked, known, named)


def _looked_up(looked: DataFrame, named: DataFrame) -> DataFrame:
    """Whole texts are joined by hash; lines look in a map of the same few digests, row by row."""
    names = F.create_map(
        *[x for r in named.collect() for x in (F.lit(r["digest"]), F.lit(r["license"]))]
    )  # as many entries as the list of texts
    hits = F.filter(
        F.transform(F.array_distinct("lines"), lambda d: F.try_element_at(names, d)),
        lambda n: n.isNotNull(),
    )
    each = F.array_sort(F.array_distinct(F.flatten(F.transform(hits, lambda n: F.split(n, ",")))))
    return looked.join(F.broadcast(named), "digest", "left").select(
        "doc_id", "digest", "license", F.array_join(each, ",").alias("notices")
    )


def _joined(looked: DataFrame, known: DataFrame, named: DataFrame) -> DataFrame:
    """Findings by joins with a table of any size; rows are told apart by a number given to each."""
    rows = keep(looked.withColumn("_row", F.expr("uuid()")), "license-digests")
    by_line = rows.select("_row", F.explode(F.array_distinct("lines")).alias("digest"))
    hits = (
        by_line.join(known, "digest")
        .groupBy("_row")
        .agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("notices"))
    )
    return (
        rows.join(named, "digest", "left")
        .join(hits, "_row", "left")
        .select("doc_id", "digest", "license", F.coalesce("notices", F.lit("")).alias("notices"))
    )


def scan_sql(licenses=LICENSES) -> str:
    """The same in DuckDB's SQL."""

    def line(x: str) -> str:
        out = f"trim(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
        for was, now in SPELLINGS:
            out = f"replace({out}, '{was}', '{now}')"
        for was, now in SPELLING_RULES:
            out = f"regexp_replace({out}, '{was}', '{now.replace('$', chr(92))}', 'g')"
        return out

    def lines(x: str) -> str:
        each = f"list_transform(string_split({x}, chr(10)), lambda r: {line('r')})"
        return f"list_filter({each}, lambda l: l <> '' AND NOT regexp_matches(l, '{_COPYRIGHT_LINE}'))"

    values = ", ".join(
        "('{}', '{}')".format(n, t.replace("'", "''")) for n, t in licenses
    )
    return f"""
    WITH texts(license, text) AS (VALUES {values}),
    known AS (
        SELECT DISTINCT sha256(array_to_string({lines('text')}, ' ')) AS digest, license FROM texts
    ),
    docs AS (SELECT doc_id, {lines("coalesce(text, '')")} AS ls FROM documents),
    hits AS (
        SELECT doc_id, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
        FROM (SELECT doc_id, sha256(unnest(ls)) AS digest FROM docs) JOIN known USING (digest)
        GROUP BY doc_id
    )
    SELECT d.doc_id, sha256(array_to_string(d.ls, ' ')) AS digest, k.license,
           coalesce(h.notices, '') AS notices
    FROM docs d LEFT JOIN known k ON k.digest = sha256(array_to_string(d.ls, ' '))
    LEFT JOIN hits h ON h.doc_id = d.doc_id
    """
