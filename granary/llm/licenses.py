"""License scans: canonical text, its digest, and a hash join to the digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import table

_MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"""
_MIT_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_GRANT = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_WARRANTY = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

# Titles and texts of known licences and, below, one-line notices, by identifier.
LICENSES = {
    "MIT": ("MIT License", f"{_MIT_GRANT}, subject to the following conditions:\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_MIT_WARRANTY}"),
    "MIT-0": ("MIT No Attribution", f"{_MIT_GRANT}.\n{_MIT_WARRANTY}"),
    "ISC": ("ISC License", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_WARRANTY}"),
    "0BSD": ("Zero-Clause BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n{_ISC_WARRANTY}"),
    "BSD-2-Clause": ("BSD 2-Clause License", f"{_BSD_GRANT}\n{_BSD_WARRANTY}"),
    "BSD-3-Clause": ("BSD 3-Clause License", f"{_BSD_GRANT}\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n{_BSD_WARRANTY}"),
    "Zlib": ("zlib License", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
    "WTFPL": ("", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004\nEveryone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    "Unlicense": ("", _UNLICENSE),
    "BSL-1.0": ("Boost Software License - Version 1.0 - August 17th, 2003", _BOOST),
}
NOTICES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.",),
    "CC0-1.0": ("Released under CC0 1.0.", "Dedicated to the public domain under CC0 1.0."),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License."),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
}
# Spellings that count as the same word.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("merchantibility", "merchantability"),
    ("organisation", "organization"),
    ("programme", "program"),
    ("recognised", "recognized"),
    ("whilst", "while"),
)
#: A copyright line (in lower case): the word is followed, anywhere in the line, by a year or its placeholder, or at once by a
#: sign or "by"; a sign alone by a year. A licence's own lines have neither.
COPYRIGHT = r"(?m)^[^a-z0-9\n]*(?:portions[ \t]+)?(?:copyright\b(?:[^\n]*(?:[0-9]{4}|yyyy|<year>|\[year\])|[ \t]*(?:\(c\)|©)|[ \t]+by\b)|(?:\(c\)|©)[^\n]*[0-9]{4})[^\n]*"
RESERVED = r"all rights reserved"
#: Licence texts that a caller may add.
MOST = 10_000
# Digests of the canonical whole texts of longer licences, with what follows their terms and without.
DIGESTS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2", "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0"),
    "GPL-2.0": ("efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34"),
    "GPL-3.0": ("eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a", "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636"),
    "LGPL-2.1": ("4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891", "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4"),
    "LGPL-3.0": ("aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",),
    "MPL-2.0": ("f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",),
    "CC0-1.0": ("96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",),
    "Artistic-1.0": ("e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2",),
    "GFDL-1.3": ("a92fdbaeafedd9cbeb812ebbded06ee07e3b1427c81cfc333e682109c594d826",),
}


def canonical(text: Column) -> Column:
    """Lower case; no copyright lines; letters and digits only, single spaces; one spelling of each word."""
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), RESERVED, " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, r"[^\p{L}\p{N}]+", "  "), F.lit(" "))
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return F.trim(F.replace(out, F.lit("  "), F.lit(" ")))


def entries() -> list[tuple[str, str]]:
    """(license, text) of all texts that are written out above: with title, without, and the notices."""
    rows = [(name, f"{title}\n{text}" if title else text) for name, (title, text) in LICENSES.items()]
    rows += [(name, text) for name, (title, text) in LICENSES.items() if title]
    return rows + [(name, text) for name, texts in NOTICES.items() for text in texts]


def known(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """digest, license: the lookup table, a row for each digest; made by the same expressions as the texts' digests.

    ``more`` has further whole texts (license, text), MOST at most: the table is broadcast. A
    digest of several licences goes by the first of them.
    """
    texts = spark.createDataFrame(entries(), "license string, text string")
    if more is not None:
        if more.count() > MOST:
            raise ValueError(f"more than {MOST} licence texts")
        texts = texts.unionByName(more.select("license", "text"))
    rows = texts.select(F.sha2(canonical(F.col("text")), 256).alias("_digest"), "license")
    rows = rows.unionAll(spark.createDataFrame([(d, name) for name, digests in DIGESTS.items() for d in digests], "_digest string, license string")) if DIGESTS else rows
    return rows.groupBy("_digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """doc_id, digest of the canonical whole text, its license (null: none known) and the licences of whole lines.

    The digests of entire texts are joined by hash to the known ones (a fixed table, so it is
    broadcast); a text's lines, each taken as an entire text, are looked up in the same table,
    and their licences given once each, in order, joined by commas ("" if none). Null, empty
    and blank texts have the digest of an empty text and no license. Repeated rows and null
    ids stay; other columns are ignored; an empty table gives no rows. ``more``: see ``known``.
    """
    spark = docs.sparkSession
    rows = sorted(map(tuple, known(spark, more).collect()))  # at most MOST rows and the fixed ones
    lookup = spark.createDataFrame(rows, "_digest string, license string")
    entries = F.create_map(*(F.lit(x) for r in rows for x in r))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.split("text", "\n").alias("_lines"))
    digests = F.transform("_lines", lambda x: F.sha2(canonical(x), 256))
    found = F.array_sort(F.array_distinct(F.filter(F.transform(digests, lambda d: F.element_at(entries, d)), lambda x: x.isNotNull())))
    rows = rows.select("doc_id", "digest", F.array_join(found, ",").alias("notices"))
    return rows.join(F.broadcast(lookup), rows["digest"] == lookup["_digest"], "left").select("doc_id", "digest", "license", "notices")


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(x: str) -> str:
    out = f"regexp_replace(regexp_replace(lower({x}), {_sql_text(COPYRIGHT)}, ' ', 'g'), {_sql_text(RESERVED)}, ' ', 'g')"
    out = rf"concat(' ', regexp_replace({out}, '[^\p{{L}}\p{{N}}]+', '  ', 'g'), ' ')"
    for old, new in SPELLINGS:
        out = f"replace({out}, ' {old} ', ' {new} ')"
    return f"trim(replace({out}, '  ', ' '))"


def _sql() -> str:
    rows = entries()
    values = ",\n".join(f"({_sql_text(a)}, {_sql_text(b)})" for a, b in rows)
    digests = ", ".join(f"('{name}', '{d}')" for name, found in DIGESTS.items() for d in found)
    return f"""
WITH known AS (
  SELECT min(license) AS license, digest
  FROM (SELECT license, sha256({_sql_canonical('text')}) AS digest FROM (VALUES {values}) AS v(license, text) UNION ALL SELECT * FROM (VALUES {digests})) GROUP BY digest),
d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
hits AS (
  SELECT r, string_agg(license, ',' ORDER BY license) AS notices
  FROM (SELECT DISTINCT r, license FROM lines JOIN known ON sha256({_sql_canonical('line')}) = known.digest) GROUP BY r),
w AS (SELECT r, doc_id, sha256({_sql_canonical('text')}) AS digest FROM d)
SELECT doc_id, w.digest, known.license, coalesce(notices, '') AS notices
FROM w LEFT JOIN known ON w.digest = known.digest LEFT JOIN hits USING (r)
"""


SQL = _sql()
