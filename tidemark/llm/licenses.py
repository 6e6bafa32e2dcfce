"""Licence scans: whole texts against the digests of known licence texts.

A text is made canonical (lower case, without copyright notices, equivalent spellings made one, punctuation and white
space reduced to single spaces) and digested; a broadcast hash join finds the licence that has the same digest.  The
unit is the entire document; each of its lines, as an entire notice, is looked up the same way.  The list of known
texts is a parameter; its size is checked before it is broadcast, and a larger list is joined by shuffle.

A copyright notice is a line that begins with the word and a year, "(c)" or its sign, or with "(c)" and a year; a line
that merely begins with the word, as wrapped licence texts have them, stays.  So a text's digest does not depend on how
its paragraphs are wrapped, as long as a notice keeps its own line.

DataFrame expressions throughout.  Lines are pre-aggregated to their document where they are made, so a document of
many lines, or many documents with one line, cost no more than others.

Defined results: a null text is an empty one, and empty texts match nothing; null identifiers and repeated rows keep a
row each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Spellings that count as one (applied in this order, in lower case).
SPELLINGS = [
    ("licence", "license"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("organisation", "organization"), ("authoris", "authoriz"),
    ("favour", "favor"), ("honour", "honor"), ("merchantibility", "merchantability"), ("non-infringement", "noninfringement"), ("https://", "http://"),
]
_YEAR = r"(?:[<\[{]?(?:year|yyyy)|[0-9]{4})"
COPYRIGHT = rf"(?m)^[ \t]*(?:[*#/;-]+[ \t]*)?(?:copyright[ \t:]+(?:\(c\)|©|{_YEAR})|\(c\)[ \t]+{_YEAR}|©)[^\n]*$"
#: Phrases that count as one, or as nothing, once white space is single (applied in this order).
PHRASES = [("copyright holder", "copyright owner"), ("all rights reserved ", "")]
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
MOST_BROADCAST = 10_000

#: Notices and licence texts known from the start.
KNOWN: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        """MIT License

Copyright (c) the authors

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC0-1.0": ["Released under CC0 1.0."],
    "ISC": [
        """ISC License

Copyright (c) the authors

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "BSD-2-Clause": [
        """BSD 2-Clause License

Copyright (c) the authors

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "BSD-3-Clause": [
        """BSD 3-Clause License

Copyright (c) the authors

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    ],
    "0BSD": [
        """Zero-Clause BSD

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ],
    "Zlib": [
        """zlib License

Copyright (c) the authors

This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.""",
    ],
}

#: Digests of the canonical form of licences too long to quote, as their publishers distribute them.
DIGESTS: dict[str, str] = {
    "Apache-2.0": "75acde0fb516a7ba4597dfc23680cf78281f7fae7f3b74a78e06ef83c1c375c6",
    "Artistic-1.0-Perl": "bc4d0c00d493021b9f3b1041689fa28b4bf980cf2e37601f7cb475a7265e3b93",
    "CC0-1.0": "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    "GFDL-1.2": "b6270c129be9b0e0172ebf4f39b974d927f155b0569e6689a4fd15068977ecdd",
    "GFDL-1.3": "7a546845f0b9175c013adbd275ab046668c2cd62fa85809f866f6d3218d6adcd",
    "GPL-1.0": "37f380f152339f34a15db620545eb53f0b5c7d9e6a9542aa09ed0d22f186920f",
    "GPL-2.0": "ae2be2aaa68f5e52ef402874fc8c7c691879b445cb12e49d84f88168cc2d7dd6",
    "GPL-3.0": "ee0d2b91860148fdc6916d4fbea5723c7b0c7330d7a45ee71fabe123ce7175f8",
    "LGPL-2.0": "bea988245c65edbddad6f43ff12ca2472c232324e916d42648b90eac944d833e",
    "LGPL-2.1": "ed875dac9045cba09a17867210991f3a4a82f80b82096b054560a3a8dae9d692",
    "LGPL-3.0": "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    "MPL-1.1": "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    "MPL-2.0": "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
}


def _without_title(text: str) -> str:
    """The text without its first paragraph, if it has others."""
    return text.partition("\n\n")[2] or text


def canonical(text: Column) -> Column:
    """The canonical form, its lines still apart; ``flat`` makes it one line."""
    text = F.lower(text)
    for a, b in SPELLINGS:
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.regexp_replace(text, "(?d)" + COPYRIGHT, "")  # lines end at \n only
    return F.regexp_replace(text, PUNCTUATION, " ")


def flat(canonical_text: Column) -> Column:
    text = F.concat(F.regexp_replace(canonical_text, r"[ \n]+", " "), F.lit(" "))
    for a, b in PHRASES:
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.btrim(text)


def _known() -> list[tuple[str, str]]:
    """Each known text, with and without its title."""
    return sorted({(name, form) for name, texts in KNOWN.items() for text in texts for form in (text, _without_title(text))})


def known_licenses(spark: SparkSession) -> DataFrame:
    """license_id, text or, of the longest licences, the canonical text's digest."""
    rows = [(name, text, None) for name, text in _known()] + [(name, None, digest) for name, digest in DIGESTS.items()]
    return spark.createDataFrame(rows, "license_id string, text string, digest string")


def scanned(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest (of the canonical text), license_id (of the entire text, or null), n_license_lines, line_licenses."""
    spark = docs.sparkSession
    known = known if known is not None else known_licenses(spark)
    digest = F.sha2(flat(canonical(F.col("text"))), 256)
    digest = F.coalesce("digest", digest) if "digest" in known.columns else digest
    listed = known.select("license_id", digest.alias("known")).where("known IS NOT NULL").groupBy("known").agg(F.min("license_id").alias("license_id"))
    if known.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        listed = F.broadcast(listed)
    text = F.coalesce(store.column(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), store.column(id_col).alias("doc_id"), canonical(text).alias("text"))
    whole = rows.select("row", "doc_id", F.split("text", "\n", -1).alias("lines"), flat(F.col("text")).alias("flat"))
    whole = whole.select("row", "doc_id", "lines", F.sha2("flat", 256).alias("digest"), (F.col("flat") != "").alias("some"))
    lines = whole.select("row", "doc_id", "digest", "some", F.explode("lines").alias("line")).withColumn("line", flat(F.col("line")))
    lines = lines.withColumn("line_digest", F.when(F.col("line") != "", F.sha2("line", 256)))
    found = lines.join(listed.select(F.col("known").alias("line_digest"), F.col("license_id").alias("line_license")), "line_digest", "left")
    own = found.groupBy("row", "doc_id", "digest", "some").agg(F.count("line_license").alias("n_license_lines"), F.array_join(F.sort_array(F.collect_set("line_license")), "|").alias("line_licenses"))
    own = own.withColumn("known", F.when(F.col("some"), F.col("digest")))
    return own.join(listed, "known", "left").select("doc_id", "digest", "license_id", "n_license_lines", "line_licenses")


def _sql_canonical(text: str) -> str:
    out = f"lower({text})"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    out = f"regexp_replace({out}, '{COPYRIGHT}', '', 'g')"
    return f"regexp_replace({out}, '{PUNCTUATION}', ' ', 'g')"


def _sql_flat(text: str) -> str:
    out = f"regexp_replace({text}, '[ \\n]+', ' ', 'g') || ' '"
    for a, b in PHRASES:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim({out}, ' ')"


def oracle() -> str:
    """DuckDB SQL for the scan of ``documents`` with the known texts."""
    quoted = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in _known())
    digests = ", ".join(f"('{name}', '{digest}')" for name, digest in DIGESTS.items())
    return f"""
WITH k AS (SELECT known, min(i) AS license_id FROM (SELECT i, sha256({_sql_flat(_sql_canonical('t'))}) AS known FROM (VALUES {quoted}) AS v(i, t) UNION ALL SELECT * FROM (VALUES {digests}) AS w(i, known)) GROUP BY 1),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_sql_canonical("coalesce(text, '')")} AS c FROM documents),
f AS (SELECT rid, doc_id, c, {_sql_flat('c')} AS flat FROM d),
l AS (SELECT rid, {_sql_flat('x')} AS line FROM (SELECT rid, unnest(string_split(c, chr(10))) AS x FROM d)),
m AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license_id, '|' ORDER BY license_id) AS ids FROM l JOIN k ON line <> '' AND sha256(line) = known GROUP BY rid)
SELECT doc_id, sha256(flat) AS digest, license_id, CAST(coalesce(n, 0) AS BIGINT) AS n_license_lines, coalesce(ids, '') AS line_licenses
FROM f LEFT JOIN m USING (rid) LEFT JOIN k ON flat <> '' AND sha256(flat) = known"""
