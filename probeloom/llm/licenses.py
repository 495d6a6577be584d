"""Operator 6: licence scans by canonical digests, with DataFrame functions only.

A text is made canonical line by line (ASCII case folded, copyright lines dropped, equivalent spellings
unified, all that is neither letter nor digit one space), and the digest of the whole is hash-joined to
the digests of known licence texts. The digests of single lines find one-line licence notices the same way.

Up to ``MAX_KNOWN`` known digests are broadcast, and documents stay where they are; a larger table of digests is
joined by a shuffle of the documents' digests. The listed texts are those of MIT, BSD-2-Clause, BSD-3-Clause, ISC
and 0BSD and the header of Apache-2.0, besides one-line notices; further licences come as a table of digests, which
``digests_of`` makes from their texts.

Defined results: a null text counts as empty; a text without letters and digits has the digest of the
empty string and no licence; texts of any length are scanned whole; repeated rows are scanned alike; of several
licences with one text the first by name counts; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts at most; so the broadcast side has a fixed bound.
MAX_KNOWN = 10_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COPYRIGHT = r"^[^\p{L}\p{N}(©]*(?:copyright *(?:\(c\)|©|:|[0-9<\[{])|\(c\)|©)"
#: Spellings that count as equal, as whole words after folding.
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("favour", "favor"), ("modelled", "modeled"), ("labelled", "labeled"), ("programme", "program"), ("cancelled", "canceled"), ("fulfil", "fulfill"), ("whilst", "while"), ("v2", "version 2"), ("v3", "version 3"))

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
#: Whole licence texts and headers: (identifier, text).
TEXTS = (
    ("MIT", _MIT), ("MIT", f"MIT License\n\n{_MIT}"), ("MIT", f"The MIT License (MIT)\n\n{_MIT}"),
    ("BSD-2-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD}"), ("BSD-2-Clause", f"BSD 2-Clause License\n{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD}"),
    ("BSD-3-Clause", f"{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD}"), ("BSD-3-Clause", f"BSD 3-Clause License\n{_BSD_HEAD}\n{_BSD_1}\n{_BSD_2}\n{_BSD_3}\n{_BSD}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"), ("ISC", f"ISC License\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}"),
    ("0BSD", f"{_ISC_GRANT}.\n{_ISC_END}"), ("Apache-2.0", _APACHE),
)
#: Names of licences in notices of one line: (identifier, names).
NAMES = (
    ("MIT", ("MIT License", "MIT", "The MIT License")), ("Apache-2.0", ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license")),
    ("GPL-2.0", ("GNU General Public License, version 2", "GPL v2", "GPL version 2")), ("GPL-3.0", ("GNU General Public License, version 3", "GPL v3", "GPL version 3")),
    ("LGPL-3.0", ("GNU Lesser General Public License, version 3",)), ("BSD-3-Clause", ("BSD 3-Clause License", "3-clause BSD license")), ("BSD-2-Clause", ("BSD 2-Clause License", "2-clause BSD license")),
    ("MPL-2.0", ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0")), ("ISC", ("ISC License",)),
    *((f"CC-{k.replace(' ', '-')}-4.0", (f"CC {k} 4.0", f"CC-{k} 4.0", f"CC {k} 4.0 license")) for k in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND")),
    ("CC0-1.0", ("CC0 1.0", "CC0")),
)
OPENINGS = ("Licensed under", "Licensed under the", "Released under", "Released under the", "Distributed under the", "Available under the", "This work is licensed under", "This work is licensed under the", "This software is licensed under the", "This content is licensed under", "SPDX-License-Identifier:")


def notices() -> list[tuple[str, str]]:
    """Every notice of one line: (identifier, text)."""
    return [(i, f"{o} {n}") for i, names in NAMES for n in (*names, i) for o in OPENINGS]


def canonical_line(line: Column) -> Column:
    folded = F.translate(line, _UPPER, _LOWER)
    plain = F.concat(F.lit(" "), F.regexp_replace(folded, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))  # a space on either side of each word
    unified = plain
    for a, b in SPELLINGS:
        unified = F.replace(unified, F.lit(f" {a} "), F.lit(f" {b} "))
    unified = F.when(plain.rlike(f" (?:{'|'.join(a for a, _ in SPELLINGS)}) "), unified).otherwise(plain)  # few lines have any
    return F.when(folded.rlike(COPYRIGHT), "").otherwise(F.trim(F.replace(unified, F.lit("  "), F.lit(" "))))


def canonical(text: str) -> tuple[Column, Column]:
    """The canonical lines that are not empty, and the canonical whole text."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), canonical_line), lambda x: x != "")
    return lines, F.array_join(lines, " ")


def digests_of(texts: DataFrame) -> DataFrame:
    """digest, license_id, size of known texts (license_id, text), one row for each digest."""
    rows = texts.select("license_id", canonical("text")[1].alias("known"))
    return rows.groupBy(F.sha2("known", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("known")).alias("size"))


def _listed(spark: SparkSession, texts: list[tuple[str, str]]) -> DataFrame:
    if len(texts) > MAX_KNOWN:
        raise ValueError(f"over {MAX_KNOWN} texts in the code: give them as a table of digests")
    return digests_of(spark.createDataFrame(texts, "license_id string, text string"))


def scan(docs: DataFrame, texts: list[tuple[str, str]] | None = None, lines: list[tuple[str, str]] | None = None, digests: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id (of the whole text, else null), n_notices and notices of every document.

    ``texts`` are known whole texts (TEXTS and the notices by default), ``lines`` known notices of one line, and
    ``digests`` a table (digest, license_id) of more whole texts. n_notices counts the lines that are known notices;
    notices lists their licences, each once, by comma.
    """
    spark = docs.sparkSession
    lines = notices() if lines is None else lines
    listed = _listed(spark, [*TEXTS, *lines] if texts is None else texts)
    short = _listed(spark, lines).collect()  # MAX_KNOWN rows at most
    lookup = F.map_from_arrays(F.array(*(F.lit(r.digest) for r in short)), F.array(*(F.lit(r.license_id) for r in short)))
    longest = max((r.size for r in short), default=-1)
    rows = docs.select("doc_id", canonical("text")[0].alias("lines"))
    found = F.filter(F.transform(F.filter("lines", lambda x: F.length(x) <= longest), lambda x: F.try_element_at(lookup, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.sha2(F.array_join("lines", " "), 256).alias("digest"), (found if short else F.array().cast("array<string>")).alias("found"))
    known = listed.select("digest", "license_id")
    if digests is not None:
        known = known.union(digests.select("digest", "license_id")).groupBy("digest").agg(F.min("license_id").alias("license_id"))
    small = digests is None or digests.limit(MAX_KNOWN + 1).count() <= MAX_KNOWN
    rows = rows.join(F.broadcast(known) if small else known, "digest", "left")  # broadcast: 2 * MAX_KNOWN rows at most
    return rows.select("doc_id", "digest", "license_id", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices"))


def oracle() -> str:
    """DuckDB SQL for ``scan``."""
    folded = f"translate(x, '{_UPPER}', '{_LOWER}')"
    line = f"' ' || regexp_replace({folded}, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g') || ' '"
    for a, b in SPELLINGS:
        line = f"replace({line}, ' {a} ', ' {b} ')"
    line = f"CASE WHEN regexp_matches({folded}, '{COPYRIGHT}') THEN '' ELSE trim(replace({line}, '  ', ' ')) END"
    lines = f"list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {line}), lambda x: x <> '')"
    values = lambda rows: ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in rows)
    table = lambda name, rows: f"{name} AS (SELECT sha256(array_to_string({lines}, ' ')) AS digest, min(license_id) AS license_id FROM (VALUES {values(rows)}) v(license_id, text) GROUP BY 1)"
    return f"""WITH {table('listed', [*TEXTS, *notices()])},
{table('short', notices())},
d AS (SELECT row_number() OVER () AS r, doc_id, {lines} AS ls FROM documents),
w AS (SELECT r, doc_id, sha256(array_to_string(ls, ' ')) AS digest FROM d),
f AS (SELECT r, count(*) AS n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices FROM (SELECT r, sha256(unnest(ls)) AS digest FROM d) JOIN short USING (digest) GROUP BY r)
SELECT doc_id, digest, license_id, coalesce(n, 0) AS n_notices, coalesce(notices, '') AS notices FROM w LEFT JOIN listed USING (digest) LEFT JOIN f USING (r)"""
