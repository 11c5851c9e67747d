"""Licence scan by canonical digests.

A text is normalised (case, punctuation, copyright notices, equivalent spellings, white
space) and hashed as a whole; the digest is joined to those of known licence texts,
which went through the same normalisation. The same is done for each line and for each
run of whole lines (but all of them) that begins like a known text and is as long, so that a licence or a
statement within a longer text is found as well, however it is wrapped. Nothing is
compared by parts. The known texts are few: their digests go to every task.

Defined results: a null text is empty, and an empty text (or one that normalises to
nothing) has no licence. Rows that repeat doc_id and text give one row. A digest that
several known names share gives all names. An empty table gives no rows. Only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import product
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence texts and statements as their publishers give them.
KNOWN = (
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.\n\nYou should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
)

# Spellings that count as one, after lower-casing.
SPELLINGS = (
    ("licence", "license"), ("sub-licens", "sublicens"), ("organisation", "organization"), ("authoris", "authoriz"), ("favour", "favor"),
    ("non-infringement", "noninfringement"), ("non-commercial", "noncommercial"), ("https:", "http:"), ("&", " and "),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_COPYRIGHT = r"\n[^a-z0-9\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
# A notice: a line of copyright or a sign with a year, a further sign or a place for one; or, where a paragraph or a
# notice stands before it, with a holder, which begins with none of the words that follow copyright in licences.
_NOTICE = (
    r"\n[^a-z0-9\n]*(?:all rights reserved|©|(?:copyright|\(c\))[^a-z0-9\n]*(?:(?:by|years?)[^a-z0-9\n]+)?"
    r"(?:©|(?<=\()c\)|\bcopyright|(?:\d{4}|yyyy|year)(?![a-z0-9])|[\[<{][^\n]*[\]>}]))[^\n]*"
)
_HOLDER = (
    r"(?:\G|\n[^a-z0-9\n]*)\n[^a-z0-9\n]*copyright[^a-z0-9\n]+(?:by[^a-z0-9\n]+)?"
    r"(?!(?:notices?|holders?|owners?|licen[cs]es?|laws?|statements?|interests?|protections?|patents?|treat(?:y|ies)|permissions?|ownership|claims?|infringements?|"
    r"disclaimers?|rights?|and|or|in|on|of|to|for|as|is|are|was|act|may|shall|must|will|that|which|this|these|with|under|from)(?![a-z0-9]))[a-z0-9][^\n]*"
)
_PUNCTUATION = r"[\x00-\x09\x0b-\x20!-/:-@\[-`{-~“”‘’–—…«»]+"
_BREAKS = r" ?\n[ \n]*"


def canonical(text: Column) -> Column:
    """The normalised text, one line for each line that is not empty then."""
    out = F.translate(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), _UPPER, _LOWER)
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    for pattern, new in ((_NOTICE, "\n"), (_HOLDER, "\n"), (_PUNCTUATION, " "), (_BREAKS, "\n")):
        out = F.regexp_replace(out, pattern, new)
    return F.btrim(out, F.lit(" \n"))


# Full texts as their publishers give them, one file for each licence, and the title lines that usually stand above those without one.
TEXTS = Path(__file__).parent / "license_texts"
TITLES = {
    "MIT": ("MIT", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "Zlib": ("zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License", "The zlib/libpng License (Zlib)"),
    "0BSD": ("0BSD", "Zero-Clause BSD", "BSD Zero Clause License", "BSD Zero Clause License (0BSD)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", "Simplified BSD License", "BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", "New BSD License", "BSD License"),
    "Unlicense": ("Unlicense", "The Unlicense"),
}
# Wordings in use beside that of the text: (licence, words, other words). All combinations count.
WORDINGS = (
    ("MIT", "and this permission notice shall", "and this permission notice (including the next paragraph) shall"),
    ("ISC", "and/or distribute", "and distribute"),
    ("BSD", "PROVIDED BY THE COPYRIGHT HOLDERS AND", "PROVIDED BY THE COPYRIGHT HOLDER AND"),
    ("BSD", "SHALL THE COPYRIGHT HOLDER OR", "SHALL THE COPYRIGHT HOLDERS OR"),
    ("BSD", "SHALL THE COPYRIGHT HOLDER OR", "SHALL THE COPYRIGHT OWNER OR"),
    ("BSD", "1. Redist|2. Redist|3. Neither", "Redist|Redist|Neither"),
    ("BSD-3", "Neither the name of the copyright holder nor the names of its", "The names of its"),
    ("BSD-3", "Neither the name of the copyright holder nor", "Neither the names of the copyright holders nor"),
    ("BSD-3", "Neither the name of the copyright holder nor", "Neither the name of the copyright owner nor"),
)
_TERMS_END = "END OF TERMS AND CONDITIONS"


def _wordings(name: str, text: str) -> set[str]:
    texts, flat = {text}, " ".join(text.split())  # texts with other wordings hold no copyright lines
    choices = [(a, b) for start, a, b in WORDINGS if name.startswith(start) and all(x in flat for x in a.split("|"))]
    for taken in product((False, True), repeat=len(choices)) if choices else ():
        other = flat
        for (old, new), use in zip(choices, taken, strict=True):
            for x, y in zip(old.split("|"), new.split("|"), strict=True):
                other = other.replace(x, y) if use else other
        texts.add(other)
    return texts


def full_licenses() -> list[tuple[str, str]]:
    """(license_id, text) of the full licences: other wordings, with titles, and without what follows the terms."""
    files = [(path.stem, path.read_text("utf-8")) for path in sorted(TEXTS.glob("*.txt"))]
    out = set()
    for name, text in [*files, *((a, b) for a, b in KNOWN if a in ("MIT", "ISC", "Zlib") and "\n" in b)]:
        bodies = _wordings(name, text)
        if _TERMS_END in text:
            end = text.index(_TERMS_END)
            bodies |= {text[:end], text[:end] + _TERMS_END}
        out |= {(name, f"{title}\n\n{body}".lstrip("\n")) for body in bodies for title in ("", *TITLES.get(name, ()))}
    return sorted(out)


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([*KNOWN, *full_licenses()], "license_id string, text string")


def _runs(heads: dict[str, list[int]], width: int):
    """Digests of the runs of whole lines that begin with a head and have one of its lengths."""
    start = re.compile("\n(?=(" + "|".join(re.escape(h).replace("\\ ", "[ \n]") for h in sorted(heads)) + "))")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for body in batch.column("body").to_pylist():
                flat, some = None, set()
                for m in start.finditer("\n" + body) if heads else ():
                    flat = flat or body.replace("\n", " ")
                    at = m.start()  # in the body, which has no line break before it
                    for n in heads[flat[at:at + width]]:
                        if at + n <= len(body) and n < len(body) and body[at + n:at + n + 1] in ("", "\n"):
                            some.add(hashlib.sha256(flat[at:at + n].encode()).hexdigest())
                found.append(sorted(some))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("body"), pa.array(found, type=pa.list_(pa.string()))], names=["doc_id", "body", "runs"])

    return find


def scan_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, text_digest, license_id (of the whole text, null if unknown), statements (licences of runs of whole lines, comma-joined)."""
    whole = lambda c: F.sha2(F.replace(c, F.lit("\n"), F.lit(" ")).cast("binary"), 256)
    texts = known.select("license_id", F.replace(canonical(F.col("text")), F.lit("\n"), F.lit(" ")).alias("flat")).filter("flat <> ''").distinct().collect()
    width = min([24, *(len(r.flat) for r in texts)])
    heads = defaultdict(set)
    for r in texts:
        heads[r.flat[:width]].add(len(r.flat))
    units = [(r.license_id, hashlib.sha256(r.flat.encode()).hexdigest()) for r in texts]
    digests = known.sparkSession.createDataFrame(units, "license_id string, unit string")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), canonical(F.col("text")).alias("body"))
    rows = rows.mapInArrow(_runs({h: sorted(n) for h, n in heads.items()}, width), "doc_id bigint, body string, runs array<string>")
    rows = rows.select("doc_id", whole(F.col("body")).alias("text_digest"), F.split("body", "\n").alias("lines"), "runs")
    units = F.concat(F.array("text_digest"), F.transform("lines", lambda x: F.sha2(x.cast("binary"), 256)), "runs")
    found = rows.select("doc_id", "text_digest", F.posexplode(units).alias("place", "unit")).join(digests, "unit", "left")
    named = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("license_id")))), ",")
    return found.groupBy("doc_id", "text_digest").agg(
        F.nullif(named(F.col("place") == 0), F.lit("")).alias("license_id"), named(F.col("place") > 0).alias("statements")
    )


def _sql(text: str) -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    out = f"translate(chr(10) || coalesce({text}, ''), '{_UPPER}', '{_LOWER}')"
    for old, new in SPELLINGS:
        out = f"replace({out}, {quote(old)}, {quote(new)})"
    for pattern, new in ((_COPYRIGHT, "chr(10)"), (_PUNCTUATION, "' '"), (_BREAKS, "chr(10)")):
        out = f"regexp_replace({out}, {quote(pattern)}, {new}, 'g')"
    return f"trim({out}, ' ' || chr(10))"


def sql() -> str:
    """The scan for the statements and texts of ``KNOWN``, line by line, in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
WITH known AS (
  SELECT DISTINCT license_id, sha256(replace(body, chr(10), ' ')) AS unit
  FROM (SELECT license_id, {_sql('text')} AS body FROM (VALUES {values}) AS k(license_id, text)) WHERE body <> ''),
bodies AS (SELECT doc_id, {_sql('text')} AS body FROM documents),
found AS (
  SELECT doc_id, sha256(replace(body, chr(10), ' ')) AS text_digest, k.license_id AS license_id, NULL AS statement
  FROM bodies LEFT JOIN known k ON k.unit = sha256(replace(body, chr(10), ' '))
  UNION ALL
  SELECT doc_id, text_digest, NULL, k.license_id
  FROM (SELECT doc_id, sha256(replace(body, chr(10), ' ')) AS text_digest, unnest(string_split(body, chr(10))) AS line FROM bodies) JOIN known k ON k.unit = sha256(line))
SELECT doc_id, text_digest, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS license_id,
       coalesce(string_agg(DISTINCT statement, ',' ORDER BY statement), '') AS statements
FROM found GROUP BY doc_id, text_digest
"""
