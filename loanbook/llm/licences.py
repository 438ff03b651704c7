"""Licence scans: entire texts, and entire lines, looked up by the digest of a canonical form.

The canonical form has lower-case words of letters and digits with single spaces between
them, no copyright lines, and one spelling where several mean the same.  The known texts
go through the same expressions, so both sides agree whatever the rules do to a word.
Digests of whole texts and of their lines are hash-joined to those of the known texts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Published licence texts and notices, and pairs of equivalent spellings.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
_ZERO = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.
"""
_ISC_DISCLAIMER = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR
ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its
contributors may be used to endorse or promote products derived from
this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR
SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY,
OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE
OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
claim that you wrote the original software. If you use this software
in a product, an acknowledgment in the product documentation would be
appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""

KNOWN_TEXTS: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n" + _MIT),
    ("ISC", _ISC + _ISC_DISCLAIMER),
    ("ISC", "ISC License\n" + _ISC + _ISC_DISCLAIMER),
    ("0BSD", _ZERO + _ISC_DISCLAIMER),
    ("0BSD", "BSD Zero Clause License\n" + _ZERO + _ISC_DISCLAIMER),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_DISCLAIMER),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_DISCLAIMER),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_DISCLAIMER),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("All-Rights-Reserved", "All rights reserved."),
]
SPELLINGS: list[tuple[str, str]] = [
    ("licenc", "licens"), ("isation", "ization"), ("ising", "izing"), ("ised", "ized"), ("ise", "ize"), ("yse", "yze"),
    ("our", "or"), ("centre", "center"), ("calibre", "caliber"), ("ogue", "og"), ("elled", "eled"),
    ("elling", "eling"), ("dgement", "dgment"), ("whilst", "while"), ("fulfill", "fulfil"), ("programme", "program"),
    ("artefact", "artifact"), ("offence", "offense"), ("defence", "defense"), ("willful", "wilful"), ("https", "http"),
]
PHRASES: list[tuple[str, str]] = [
    ("sub licens", "sublicens"), ("non commercial", "noncommercial"), ("non infring", "noninfring"),
    ("per cent", "percent"), ("copyright owner", "copyright holder"),
]
_RESERVED = "all rights reserved"
_COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n]*(copyright|\(c\)|©)[ \t]*(\(c\)|©|[0-9]{4}|by |<|\[)[^\n]*"
_NO_WORD = r"[^\p{L}\p{N}\n]+"

MOST_KNOWN = 10_000


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), pairs, text)


def canonical_lines(text: Column) -> Column:
    """The text's words, still in their lines."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    words = F.regexp_replace(F.regexp_replace(lower, _COPYRIGHT_LINE, "$1"), _NO_WORD, " ")
    return _replaced(words, SPELLINGS)


def _finished(words: Column) -> Column:
    """Settle phrases, and drop a reservation of rights beside other words."""
    plain = F.trim(_replaced(words, PHRASES))
    return F.when(plain == _RESERVED, plain).otherwise(
        F.trim(F.regexp_replace(F.replace(plain, F.lit(_RESERVED), F.lit(" ")), " +", " "))
    )


def canonical(lines: Column) -> Column:
    return _finished(F.regexp_replace(lines, "[ \n]+", " "))


def digest(words: Column) -> Column:
    return F.sha2(words.cast("binary"), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(known, licence), one row per canonical form; at most ``MOST_KNOWN`` texts."""
    if len(known) > MOST_KNOWN:
        raise ValueError(f"at most {MOST_KNOWN} known texts can be broadcast")
    table = spark.createDataFrame(known, "licence string, body string")
    return (
        table.select(digest(canonical(canonical_lines(F.col("body")))).alias("known"), "licence")
        .groupBy("known")
        .agg(F.min("licence").alias("licence"))
    )


def scan_licences(
    df: DataFrame,
    known: list[tuple[str, str]] = KNOWN_TEXTS,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Per document: the digest of its canonical text, the licence that it entirely is, and
    the licences that entire lines of it name (sorted, separated by blanks).

    A null or empty text has the digest of the empty form and no licence; empty lines are
    none.  Repeated rows come out as often as they went in.  A null id stays null.  An
    empty table gives no rows.  Other columns are ignored.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("id"), canonical_lines(F.col(text_column)).alias("lines"))
    rows = rows.select("id", digest(canonical(F.col("lines"))).alias("text_digest"), "lines")
    units = rows.select(
        "id",
        "text_digest",
        F.explode(F.concat(F.array(F.lit(None).cast("string")), F.split("lines", "\n"))).alias("line"),
    ).withColumn("unit", F.when(F.col("line").isNull(), F.col("text_digest")).otherwise(digest(_finished(F.col("line")))))
    found = units.join(F.broadcast(known_digests(spark, known)), F.col("unit") == F.col("known"), "left")
    found = found.where(F.col("line").isNull() | F.col("licence").isNotNull())
    whole = F.col("line").isNull()
    return (
        found.groupBy("id", "text_digest")
        .agg(
            F.count(F.when(whole, 1)).alias("copies"),
            F.max(F.when(whole, F.col("licence"))).alias("licence"),
            F.array_join(F.sort_array(F.collect_set(F.when(~whole, F.col("licence")))), " ").alias("line_licences"),
        )
        .select(
            F.col("id").alias(id_column),
            "text_digest",
            "licence",
            "line_licences",
            F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"),
        )
        .drop("copy")
    )


def _sql_text(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle(known: list[tuple[str, str]] = KNOWN_TEXTS) -> str:
    def replaced(text: str, pairs: list[tuple[str, str]]) -> str:
        return reduce(lambda t, pair: f"replace({t}, '{pair[0]}', '{pair[1]}')", pairs, text)

    def lines(text: str) -> str:
        lower = f"lower(coalesce({text}, ''))"
        kept = rf"regexp_replace({lower}, '{_COPYRIGHT_LINE}', '\1', 'g')"
        return replaced(f"regexp_replace({kept}, '{_NO_WORD}', ' ', 'g')", SPELLINGS)

    plain = f"trim({replaced('words', PHRASES)}, ' ')"
    return f"""
WITH known_texts(licence, body) AS (VALUES {", ".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in known)}),
canon AS (SELECT row_number() OVER () AS row_no, doc_id, {lines("text")} AS words FROM documents),
units AS (
  SELECT NULL AS row_no, NULL AS doc_id, NULL AS line_no, licence,
         regexp_replace({lines("body")}, '[ \n]+', ' ', 'g') AS words FROM known_texts
  UNION ALL
  SELECT row_no, doc_id, 0, NULL, regexp_replace(words, '[ \n]+', ' ', 'g') FROM canon
  UNION ALL
  SELECT row_no, doc_id, 1, NULL, unnest(string_split(words, chr(10))) FROM canon),
plain AS (SELECT row_no, doc_id, line_no, licence, {plain} AS words FROM units),
finished AS (
  SELECT row_no, doc_id, line_no, licence,
         sha256(CASE WHEN words = '{_RESERVED}' THEN words
                     ELSE trim(regexp_replace(replace(words, '{_RESERVED}', ' '), ' +', ' ', 'g'), ' ') END) AS digest
  FROM plain),
known AS (SELECT digest, min(licence) AS licence FROM finished WHERE row_no IS NULL GROUP BY digest)
SELECT f.doc_id, any_value(f.digest) FILTER (WHERE line_no = 0) AS text_digest,
       max(k.licence) FILTER (WHERE line_no = 0) AS licence,
       coalesce(string_agg(DISTINCT k.licence, ' ' ORDER BY k.licence) FILTER (WHERE line_no = 1), '') AS line_licences
FROM finished f LEFT JOIN known k ON f.digest = k.digest
WHERE f.row_no IS NOT NULL
GROUP BY f.row_no, f.doc_id
"""
