"""License scan by canonical digest (DataFrame operations only).

A text is brought to a canonical form: lower case, punctuation runs to one
space, copyright lines dropped, equivalent spellings mapped to one. SHA-256 of
the form is joined to the digests of known licence texts. Two kinds of units
are looked up, each as a whole: the document, and each of its lines (licence
notices are one line). No part of a text is ever matched.

Defined results: null and empty texts have the digest of the empty form and no
licence; rows that repeat keep one result each; an empty table gives an empty
result; other columns are ignored. Where several known texts share a digest,
the smallest licence id is taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import plain_text

# Spellings that count as equal, applied in this order to the
# lower-cased text before punctuation goes.
SPELLINGS = [
    ("©", " copyright "), ("licence", "license"), ("licens or", "licensor"), ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"), ("authorisation", "authorization"), ("copyright holder", "copyright owner"),
    ("favour", "favor"), ("fulfilment", "fulfillment"), ("non-commercial", "noncommercial"),
    ("organisation", "organization"), ("per cent", "percent"), ("recognise", "recognize"), ("sub-license", "sublicense"),
    ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"), ("https:", "http:"),
]
OTHER_THAN_WORDS = r"[^\p{L}\p{N}\n]+"
COPYRIGHT_LINE = r"^ ?(copyright|c) (copyright |c )*[0-9]{4}( |$)"

_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
    "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n"
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
    "the Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
    "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
    "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
    "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE "
    "SOFTWARE.")
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.\n")
_ISC_END = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING "
    "ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
    "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE.")

_BSD_GRANT = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
              "following conditions are met:\n")
_BSD_TERMS = [
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution.",
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.",
]
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
    "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE "
    "OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")


def _bsd(n_terms: int, numbered: bool) -> str:
    """The terms as a numbered list, or as one whose marks are punctuation."""
    terms = [f"{i}. {t}\n" if numbered else f"* {t}\n" for i, t in enumerate(_BSD_TERMS[:n_terms], 1)]
    return _BSD_GRANT + "".join(terms) + _BSD_END


_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
    "liable for any damages arising from the use of this software.\n"
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter "
    "it and redistribute it freely, subject to the following restrictions:\n"
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If "
    "you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not "
    "required.\n"
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original "
    "software.\n"
    "3. This notice may not be removed or altered from any source distribution.")
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n"
    "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
    "as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n"
    "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright "
    "interest in the software to the public domain. We make this dedication for the benefit of the public at large and to "
    "the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity "
    "of all present and future rights to this software under copyright law.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE "
    "LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
    "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n"
    "For more information, please refer to <https://unlicense.org>")

# Known licence texts and one-line notices. A caller can pass a
# table of any size instead.
KNOWN = [
    ("MIT", "MIT License\n" + _MIT_GRANT),
    ("MIT", _MIT_GRANT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", "ISC License\n" + _ISC_GRANT + _ISC_END),
    ("ISC", _ISC_GRANT + _ISC_END),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
             "hereby granted.\n" + _ISC_END),
    ("0BSD", "SPDX-License-Identifier: 0BSD"),
    *[(f"BSD-{n}-Clause", title + _bsd(n, numbered)) for n in (2, 3) for numbered in (True, False)
      for title in ("", f"BSD {n}-Clause License\n")],
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Zlib", "SPDX-License-Identifier: Zlib"),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", "SPDX-License-Identifier: Unlicense"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-only"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("All-Rights-Reserved", "All rights reserved."),
]
BROADCAST_TEXTS = 100_000  # up to so many known texts (64 bytes of digest each) are broadcast; more are shuffled


def known_licenses(spark: SparkSession) -> DataFrame:
    """(license_id, text) of the built-in list."""
    return spark.createDataFrame(KNOWN, "license_id string, text string")


def canonical_lines(text: Column) -> Column:
    """Canonical form of each line that has words, copyright lines left out."""
    text = F.lower(text)
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    lines = F.split(F.regexp_replace(text, OTHER_THAN_WORDS, " "), "\n")
    return F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike(COPYRIGHT_LINE))


def digest(canonical: Column) -> Column:
    return F.sha2(canonical, 256)


def scan_licenses(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(id, digest, license_id, notices) for each row: the licence whose entire
    text the document is, and the licences whose notice one of its lines is
    (distinct ids, sorted, comma-joined; empty if none)."""
    spark = docs.sparkSession
    known = known_licenses(spark) if known is None else known
    named = (known.where(F.col("license_id").isNotNull())
             .select("license_id", digest(F.array_join(canonical_lines(plain_text(known)), " ")).alias("d"))
             .where(F.col("d") != F.sha2(F.lit(""), 256)).groupBy("d").agg(F.min("license_id").alias("license_id")))
    if known.limit(BROADCAST_TEXTS + 1).count() <= BROADCAST_TEXTS:
        named = F.broadcast(named)

    # the id of the row holds the units of one row together until they are counted
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), docs[id_col].alias("id"),
                       canonical_lines(plain_text(docs, text_col)).alias("lines"))
    units = rows.select("rid", "id", F.posexplode(
        F.concat(F.array(F.array_join("lines", " ")), F.array_distinct("lines"))).alias("at", "unit"))
    units = units.select("rid", "id", (F.col("at") == 0).alias("whole"), digest(F.col("unit")).alias("d"))
    found = units.join(named, "d", "left")
    return (found.groupBy("rid").agg(
        F.first("id").alias(id_col), F.max(F.when(F.col("whole"), F.col("d"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("license_id"))).alias("license_id"),
        F.array_join(F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("license_id")))), ",").alias("notices"))
        .drop("rid"))


def _sql_lines(text: str) -> str:
    expr = f"lower(coalesce({text}, ''))"
    for a, b in SPELLINGS:
        expr = f"replace({expr}, '{a}', '{b}')"
    return (f"list_filter(list_transform(string_split(regexp_replace({expr}, '{OTHER_THAN_WORDS}', ' ', 'g'), chr(10)), "
            f"lambda x: trim(x)), lambda x: x <> '' and not regexp_matches(x, '{COPYRIGHT_LINE}'))")


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''").replace("\n", "' || chr(10) || '")) for i, t in KNOWN)
    return f"""
with known(license_id, text) as (values {values}),
named as (select sha256(array_to_string({_sql_lines('text')}, ' ')) as d, min(license_id) as license_id
          from known group by 1),
docs as (select row_number() over () as rid, doc_id, {_sql_lines('text')} as lines from documents),
wholes as (select rid, doc_id, sha256(array_to_string(lines, ' ')) as digest from docs),
units as (select rid, sha256(unnest(lines)) as d from docs),
notes as (select rid, string_agg(distinct license_id, ',' order by license_id) as notices
          from units join named using (d) group by rid)
select w.doc_id, w.digest, n.license_id, coalesce(t.notices, '') as notices
from wholes w left join named n on n.d = w.digest and w.digest <> sha256('')
left join notes t on t.rid = w.rid"""
