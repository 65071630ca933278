"""Operator 7: licence scan by canonical digests, in the JVM throughout.

A text's canonical form is lower case, without copyright lines (with or without year and sign), the markers of
list items and a first line that is but the licence's title, with equivalent spellings made one and with every run
of punctuation and white space as one space. Its SHA-256 is looked up, by a hash join, among the digests of known
licences in the same form; so the whole text must be the licence. Each line of a document is a text of its own as
well: that finds licence notices inside documents.

Known are the texts of KNOWN, or of a table or dictionary that is given, and long licences by the digests of their
canonical form (DIGESTS). Null, empty and purely punctuated texts have an empty canonical form and match nothing.
Repeated rows are looked up alike. Very long texts are read whole. An empty table gives an empty result. Columns
other than key and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Equivalent spellings, the second stands for both. Whole words, applied in this order.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"), ("sub licensing", "sublicensing"),
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("favour", "favor"), ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"), ("fulfil", "fulfill"), ("owner", "holder"), ("owners", "holders"), ("while", "whilst"), ("http", "https"),
)

_WARRANTY = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_AUTHOR = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'

#: Known licence texts and notices by SPDX name. Texts over several lines are joined by newlines.
KNOWN: dict[str, list[str]] = {
    "MIT": [
        f"MIT License\n{_MIT}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY}",
        f"{_MIT}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY}",
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "SPDX-License-Identifier: MIT",
    ],
    "MIT-0": [f"MIT No Attribution\n{_MIT.removesuffix(', subject to the following conditions:')}.\n{_WARRANTY}"],
    "ISC": [f"ISC License\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_AUTHOR}", "SPDX-License-Identifier: ISC"],
    "0BSD": [f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_AUTHOR}"],
    "BSD-2-Clause": [f"{_BSD_HEAD}\n1. {_BSD_1}\n2. {_BSD_2}\n{_BSD_END}", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": [f"{_BSD_HEAD}\n1. {_BSD_1}\n2. {_BSD_2}\n3. {_BSD_3}\n{_BSD_END}", "SPDX-License-Identifier: BSD-3-Clause"],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ],
    "GPL-3.0-or-later": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\nYou should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."],
    "GPL-3.0-only": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: SHA-256 and length of the canonical form of long licences, by SPDX name.
DIGESTS: dict[str, tuple[str, int]] = {
    "Apache-2.0": ("7040b111f80824f2aaf0bfef2ab0c499fd13b122c5c1aab40f3f2445f8e35beb", 9789),
    "Artistic-1.0-Perl": ("cf26acbda59f115a92f808cf0762393f18488fca1d85d63a28911c675e877a76", 5797),
    "CC0-1.0": ("4780432fcfe5902eed28a47cb6882b28a8d3ba1fb607aebe70c08cd2196cdf54", 6676),
    "GFDL-1.2-only": ("7bfeaa19832e026a8bcf8e3df509b94be02443200572e26ee202f000002b8d72", 19532),
    "GFDL-1.3-only": ("8d84c447668435a25b5af22efdb7741575118e8f35290419b8c38c3da6ddfff0", 21963),
    "GPL-1.0-only": ("725f470e712031deaf5e4e04f314a0995bb3d2a94130f17428a18420f2dd1220", 11663),
    "GPL-2.0-only": ("2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee", 17074),
    "GPL-3.0-only": ("078889cdc7650edb6538ef0c1b71bc6fef94e8976c79fd6ad58d4314a0fe4a4d", 33261),
    "LGPL-2.0-only": ("e571dc581b27c79cb2ae89273287405def1f756d64504fd626dd89c9aa5e05ed", 24008),
    "LGPL-2.1-only": ("f3bc191900fb70c1c2b7ef8d04569f8599e0cecbda43459b7db100577a094aea", 25091),
    "LGPL-3.0-only": ("cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45", 7064),
    "MPL-1.1": ("7343a92bd8c1b0b931150495f312e19ec338f7987d112b8ecfcb8353f0e00bf7", 22260),
    "MPL-2.0": ("9023c82198f2c9c1e62d85950faf2dc9739e4a50ec6b6dd104c66ca441f94007", 14235),
}

#: Lines (ended by a newline only) that name a copyright holder: not those that go on as sentences of licences do.
_GOES_ON = "notice|notices|holder|holders|owner|owners|license|licenses|licence|licences|law|laws|interest|interests|statement|statements|protection|treaty|disclaimer|and|or|in|is|to|of|on|as|for|by"
_NOTICE = rf"^[^\p{{L}}\p{{N}}\n]*(?:copyright(?![a-z])(?![ \t]+(?:{_GOES_ON})(?![\p{{L}}\p{{N}}]))|\(c\)|©)[^\n]*$"
#: "All rights reserved" alone, and what marks an item of a list.
_RESERVED = r"^[^\p{L}\p{N}\n]*all rights reserved[^\p{L}\p{N}\n]*$"
_MARKER = r"^[ \t]*(?:[0-9]{1,2}[.)]|\(?[a-z][.)]|\([0-9ivx]{1,4}\)|[*•·–-])(?:[ \t]|$)"
#: A first line that is but a title.
_TITLE = r"\A[ \t\r\n\f\x0B]*(?:the[ \t]+)?(?:mit|expat|isc|zlib|apache|bsd(?:[ -][0-9][ -]clause)?|[0-9][ -]clause[ ]bsd|(?:new|modified|revised|simplified)[ ]bsd)(?:[ \t]+licen[cs]e)?(?:[ \t]*\([a-z0-9. -]{1,24}\))?[ \t\r]*\n"


def canonical(text: Column) -> Column:
    """The canonical form of a text; null counts as empty."""
    x = F.lower(F.coalesce(text, F.lit("")))
    x = F.regexp_replace(x, "(?md)" + _NOTICE, " ")
    x = F.regexp_replace(x, "(?md)" + _RESERVED, " ")
    x = F.regexp_replace(x, "(?md)" + _MARKER, " ")
    x = F.regexp_replace(x, _TITLE, " ")
    x = F.trim(F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "))
    # a space at both ends, so that whole words can be replaced by plain text
    x = F.concat(F.lit(" "), x, F.lit(" "))
    for one, other in SPELLINGS:
        x = F.replace(x, F.lit(f" {one} "), F.lit(f" {other} "))
    return F.trim(x)


Licences = dict[str, list[str]] | DataFrame


def known(spark: SparkSession, licences: Licences | None = None) -> DataFrame:
    """licence, digest, length: one row per known text. licences: names with texts, or a table (licence, text)."""
    if not isinstance(licences, DataFrame):
        licences = spark.createDataFrame([(name, text) for name, texts in (licences or KNOWN).items() for text in texts], "licence string, text string")
    form = licences.select("licence", canonical(F.col("text")).alias("form"))
    stored = spark.createDataFrame([(name, *x) for name, x in DIGESTS.items()], "licence string, digest string, length int")
    every = form.filter("form <> ''").select("licence", F.sha2("form", 256).alias("digest"), F.length("form").alias("length")).unionByName(stored)
    return every.groupBy("digest").agg(F.min("licence").alias("licence"), F.min("length").alias("length"))


def scan(docs: DataFrame, licences: Licences | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key, licence_digest, licence (of the whole text) and notices (array of those of its lines, in order of names).

    A table of licences is small beside any corpus (names and digests of some thousand texts at most), so its
    digests reach the driver: the lines of a document are looked up in it as a map, its whole text by a join. Lines
    are digested only where their canonical length is that of some known text; no replacement makes a text twice as
    long, so none is lost.
    """
    spark = docs.sparkSession
    names = known(spark, licences).collect()  # as many rows as known texts
    lengths = sorted({r["length"] for r in names}) or [0]
    lookup = spark.createDataFrame([(r["digest"], r["licence"]) for r in names], "licence_digest string, licence string")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    whole = F.sha2(canonical(F.col("text")), 256)
    lines = F.transform(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.length(x) >= min(lengths) // 2), lambda x: canonical(x))
    fit = F.filter(lines, lambda x: F.length(x).isin(lengths))
    out = rows.select("key", whole.alias("licence_digest"), F.transform(fit, lambda x: F.sha2(x, 256)).alias("marks"))
    out = out.join(F.broadcast(lookup), "licence_digest", "left")
    table_ = F.create_map(*[F.lit(v) for r in names for v in (r["digest"], r["licence"])]) if names else F.create_map().cast("map<string,string>")
    notices = F.array_sort(F.array_distinct(F.filter(F.transform("marks", lambda m: table_[m]), lambda x: x.isNotNull())))
    return out.select(F.col("key").alias(key), "licence_digest", "licence", notices.alias("notices"))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: digest of its canonical text, the licence that it is, and the notices among its lines."""
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licence_digest", "licence", F.array_join("notices", ",").alias("notices"))


def _sql(text: str) -> str:
    """The canonical form in DuckDB: line by line, with patterns of its own (its regular expressions cannot look ahead)."""
    head = "^[^\\p{L}\\p{N}]*"
    copyright = f"regexp_matches(l, '{head}(\\(c\\)|©)') OR (regexp_matches(l, '{head}copyright') AND NOT regexp_matches(l, '{head}copyright([a-z]|[ \t]+({_GOES_ON})([^\\p{{L}}\\p{{N}}]|$))'))"
    reserved = "regexp_full_match(l, '[^\\p{L}\\p{N}]*all rights reserved[^\\p{L}\\p{N}]*')"
    marker = "regexp_replace(l, '^[ \t]*([0-9]{1,2}[.)]|[a-z][.)]|\\([a-z][.)]|\\([0-9ivx]{1,4}\\)|[*•·–-])([ \t]|$)', ' ')"
    lines = f"list_transform(string_split(lower(coalesce({text}, '')), chr(10)), lambda l: CASE WHEN {copyright} OR {reserved} THEN ' ' ELSE {marker} END)"
    names = "mit|expat|isc|zlib|apache|bsd|bsd[ -][0-9][ -]clause|[0-9][ -]clause bsd|new bsd|modified bsd|revised bsd|simplified bsd"
    x = f"regexp_replace(array_to_string({lines}, chr(10)), '^[ \t\r\n\f\v]*(the[ \t]+)?({names})([ \t]+licen[cs]e)?([ \t]*\\([a-z0-9. -]{{1,24}}\\))?[ \t\r]*\n', ' ')"
    x = f"concat(' ', trim(regexp_replace({x}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    for one, other in SPELLINGS:
        x = f"replace({x}, ' {one} ', ' {other} ')"
    return f"trim({x})"


def oracle() -> str:
    rows = ", ".join(f"('{name}', '{text}')" for name, texts in KNOWN.items() for text in texts)
    stored = ", ".join(f"('{name}', '{x[0]}')" for name, x in DIGESTS.items())
    return f"""
WITH known AS (SELECT digest, min(name) AS name FROM (SELECT sha256({_sql("text")}) AS digest, name FROM (VALUES {rows}) AS k(name, text) UNION ALL SELECT digest, name FROM (VALUES {stored}) AS s(name, digest)) GROUP BY 1),
line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l FROM documents),
hit AS (SELECT line.doc_id, string_agg(DISTINCT known.name, ',' ORDER BY known.name) AS notices
        FROM (SELECT doc_id, sha256({_sql("l")}) AS digest FROM (SELECT doc_id, l AS l FROM line)) AS line JOIN known USING (digest) GROUP BY 1)
SELECT d.doc_id, d.licence_digest, known.name AS licence, coalesce(hit.notices, '') AS notices
FROM (SELECT doc_id, sha256({_sql("text")}) AS licence_digest FROM documents) AS d
LEFT JOIN known ON known.digest = d.licence_digest LEFT JOIN hit ON hit.doc_id = d.doc_id
"""
