"""Licence scan by canonical digests of entire texts.

A text is made canonical (lower case; lines that only state a copyright dropped; equivalent spellings replaced;
everything but letters and digits turned into single spaces, so that line breaks don't count) and its SHA-256 is joined
to the digests of known licence texts, made canonical in the same way. Two kinds of entire text are looked up: the whole
document, and each whole line of it (short notices stand on a line of their own). A line whose canonical length equals
no known length cannot match and isn't joined.

Known texts are given as texts (KNOWN) or, for long licences, as digests of their canonical form (DIGESTS; folder_texts
and canonical_digests make such lists from a folder of texts). Both are parameters; their number and not the corpus sets
the size of the broadcast. Longer lists (more than MAX_KNOWN) are refused. Defined results: null text counts as empty;
an empty canonical text matches nothing; an empty table gives an empty result; equal texts give equal rows, a row for
each; of two ids of one digest the smaller is given; long texts are read whole; input columns other than the two named
are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axolin.llm.common import table

MAX_KNOWN = 10_000

#: Spellings that count as equal: a pattern of canonical words and what replaces it.
SPELLINGS = (
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("merchantibility", "merchantability"),
    ("copyright owner", "copyright holder"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("acknowledgement", "acknowledgment"),
    ("whilst", "while"),
    ("gpl", "gnu general public license"),
    ("creative commons", "cc"),
    ("http", "https"),
)

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_BSD_HEAD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_TAIL = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'

#: (identifier, entire text). Licences first, then the notices that stand on a line of their own.
KNOWN = (
    ("MIT", f"MIT License\n\nCopyright (c) <year> <holder>\n\n{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT", f"{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n{_AS_IS}"),
    ("MIT-0", f"{_GRANT}.\n\n{_AS_IS}"),
    ("ISC", f"ISC License\n\n{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_ISC_AS_IS}"),
    ("0BSD", f"{_ISC_GRANT}.\n\n{_ISC_AS_IS}"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
)

#: Long licences: identifier, SHA-256 and length of the canonical text, with and without what follows its terms.
#: Fixed values, derived from the published texts (a test derives them again where those are installed).
DIGESTS = (
    ("Apache-2.0", "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5", 9888),
    ("Apache-2.0", "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809", 8843),
    ("Apache-2.0", "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93", 8871),
    ("Artistic-1.0-Perl", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2", 5833),
    ("BSD-3-Clause", "21ce5e311a0ef74591e636cf6d0a236029bcaa0ee86324ac68d5748657aa8651", 1361),
    ("CC0-1.0", "bcf1ca6bfc638eb154167518097e0e35e99b24f6b9bb4b2a6cb9b919bfda843a", 6622),
    ("GFDL-1.2", "5379e6f33e826ba185b23fd11a414555c2161fda481478babd1e73a3ae098a71", 19584),
    ("GFDL-1.3", "c952713ff6d87747f07b50ab6bbb6002a9cda8c2b9126a48feb4d6a32921766b", 21992),
    ("GPL-1.0", "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc", 9415),
    ("GPL-1.0", "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70", 9387),
    ("GPL-1.0", "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224", 11765),
    ("GPL-2.0", "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808", 14455),
    ("GPL-2.0", "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34", 14483),
    ("GPL-2.0", "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821", 17117),
    ("GPL-3.0", "670e75cc2d7d4bec40833b2ff3da80b59d9599b098ec4fb0811fbdd53d4b7e3d", 31078),
    ("GPL-3.0", "97447ff9ab7a0f2868dc653b7aa354a724157ccb24e183a6a313e119eed2d2b8", 33570),
    ("GPL-3.0", "a700ef9a30824c85306cfff3b2fbfc67435cfef60233323af5131b7a8dc1ab48", 31106),
    ("LGPL-2.0", "54a6c3821aef50c4ea766df5c9d96a2034836ea458ad32d4d67fd58efd3ea7ec", 22295),
    ("LGPL-2.0", "66b4416fed722b119c08a4c93164fe7e4393904ddfebd70b7c5d67f55c9c341b", 22323),
    ("LGPL-2.0", "ef41ee09d8aa8771b7e357e916630e2a3c47e12518e13badeab697b8caa28812", 24176),
    ("LGPL-2.1", "651c34f3244a526ba2541f9d69d4ed35e3d889ba59c8c58d7197b0922210effb", 23360),
    ("LGPL-2.1", "827c0ba8dd815a7441fe91c3331b2098760cc0b9e11f7918bfab0f8188c45b56", 23388),
    ("LGPL-2.1", "f920b7f157c3c3764246eab6e78c087f9a160d61050b2eb4c717003890a2d562", 25240),
    ("LGPL-3.0", "3ede7494a82fe6f9c1d0a28646ae309d51b9cc301b39d60d0de3be5c1869bd38", 7334),
    ("MPL-1.1", "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986", 22448),
    ("MPL-2.0", "9eab7902f21bef0326dee4ed0cae1402c781cbf1f8e3dbeed6fbe176d641bb13", 14342),
)

#: A line that only states who holds the copyright: the word or sign with a year, a sign or a place for one, or the
#: authors of something; or that all rights are reserved. The word alone may begin a line of a licence's own text.
_YEAR = r"(\d{4}|<year>|\[yyyy\]|\[year\]|\{yyyy\})"
COPYRIGHT_LINE = r"^[^\p{L}\p{N}(©]*((copyright|copr)[.:]?[ \t]*(\(c\)|©|&copy;)|(copyright|copr)[.:]?[ \t]*(by[ \t]+)?" + _YEAR + r"|copyright[ \t]+the[ \t][^\n]*[ \t](authors|contributors|developers|foundation)[.]?[ \t\r]*\z|(\(c\)|©)[ \t]*(copyright[ \t]*)?" + _YEAR + r"|all rights reserved[^\p{L}\p{N}]*\z)"


def _wide(words: str) -> str:
    return "  ".join(["", *words.split(), ""])[1:-1]


def _canonical_line(line: Column) -> Column:
    low = F.lower(line)
    low = F.when(low.rlike(COPYRIGHT_LINE), F.lit("")).otherwise(low)
    # two spaces between words, so that neighbours which are both replaced don't share one
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", "  ")), F.lit(" "))
    for a, b in SPELLINGS:
        words = F.replace(words, F.lit(_wide(a)), F.lit(_wide(b)))
    return F.trim(F.replace(words, F.lit("  "), F.lit(" ")))


def canonical_lines(text: Column) -> Column:
    """The canonical form of each line, empty ones left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), _canonical_line), lambda x: x != "")


def canonical_digests(spark: SparkSession, known) -> DataFrame:
    """(license_id, known_digest, chars) of (identifier, entire text) pairs; empty ones are left out."""
    rows = spark.createDataFrame([tuple(x) for x in known], "license_id string, body string")
    canon = rows.select("license_id", F.array_join(canonical_lines(F.col("body")), " ").alias("body")).where("body != ''")
    return canon.select("license_id", F.sha2("body", 256).alias("known_digest"), F.length("body").alias("chars"))


def folder_texts(spark: SparkSession, folder: str, ids: dict[str, str] | None = None) -> list[tuple[str, str]]:
    """(identifier, entire text) of the files of a folder, by file name or its entry in ids; a text that has matter
    after its terms is listed a second time without it."""
    files = spark.read.text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("name"), "value").limit(MAX_KNOWN + 1).collect()
    if len(files) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known texts")
    out = []
    for f in sorted(files):
        name = (ids or {}).get(f.name, f.name)
        terms, mark, _ = f.value.partition("END OF TERMS AND CONDITIONS")
        out += [(name, f.value), *[(name, terms + mark), (name, terms)] * bool(mark)]
    return out


def known_digests(spark: SparkSession, known=KNOWN, digests=DIGESTS) -> DataFrame:
    """(known_digest, license_id, chars): one row for each different digest, the smallest id on a tie."""
    if len(known) + len(digests) > MAX_KNOWN:
        raise ValueError(f"at most {MAX_KNOWN} known texts")
    given = spark.createDataFrame([tuple(x) for x in digests], "license_id string, known_digest string, chars int")
    return canonical_digests(spark, known).unionByName(given).groupBy("known_digest", "chars").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, known=KNOWN, doc_id: str = "doc_id", text: str = "text", digests=DIGESTS) -> DataFrame:
    """(doc_id, n_words, digest, license_id, notices): notices lists the ids of matching lines, sorted, by comma."""
    spark = docs.sparkSession
    digests = known_digests(spark, known, digests)
    lengths = sorted(r.chars for r in digests.select("chars").distinct().collect())  # as many as there are known texts at most
    lines = docs.select(F.col(doc_id).alias("doc_id"), canonical_lines(F.col(text)).alias("lines"))
    whole = lines.select("doc_id", "lines", F.array_join("lines", " ").alias("body"))
    whole = whole.select("doc_id", F.when(F.col("body") == "", 0).otherwise(F.size(F.split("body", " "))).cast("bigint").alias("n_words"), F.sha2("body", 256).alias("digest"), F.transform(F.filter("lines", lambda x: F.length(x).isin(lengths)), lambda x: F.sha2(x, 256)).alias("line_digests"))
    pairs = F.broadcast(digests.agg(F.map_from_entries(F.collect_list(F.struct("known_digest", "license_id"))).alias("ids")))
    named = whole.join(F.broadcast(digests.select(F.col("known_digest").alias("digest"), "license_id")), "digest", "left").crossJoin(pairs)
    found = F.array_sort(F.array_distinct(F.filter(F.transform("line_digests", lambda x: F.element_at("ids", x)), lambda x: x.isNotNull())))
    return named.select("doc_id", "n_words", "digest", "license_id", F.array_join(found, ",").alias("notices"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: licence ids of every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def oracle() -> str:
    def canon(x: str) -> str:
        out = f"' ' || trim(regexp_replace(CASE WHEN regexp_matches(lower({x}), '{COPYRIGHT_LINE}') THEN '' ELSE lower({x}) END, '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' '"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{_wide(a)}', '{_wide(b)}')"
        return f"trim(replace({out}, '  ', ' '))"

    def lines(x: str) -> str:
        return f"list_filter(list_transform(string_split(coalesce({x}, ''), chr(10)), lambda x: {canon('x')}), lambda y: y <> '')"

    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    given = "".join(f" UNION ALL SELECT '{d}', '{i}'" for i, d, _ in DIGESTS)
    return f"""
WITH raw(license_id, body) AS (VALUES {values}),
k0 AS (SELECT license_id, array_to_string({lines('body')}, ' ') AS body FROM raw),
known AS (SELECT known_digest, min(license_id) AS license_id FROM (SELECT sha256(body) AS known_digest, license_id FROM k0{given}) GROUP BY 1),
d AS (SELECT doc_id, {lines('text')} AS lines FROM documents),
w AS (SELECT doc_id, lines, coalesce(array_to_string(lines, ' '), '') AS body FROM d),
n AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(license_id))), ',') AS notices
      FROM (SELECT doc_id, unnest(lines) AS line FROM d) u JOIN known ON known_digest = sha256(line) GROUP BY doc_id)
SELECT w.doc_id, CASE WHEN body = '' THEN 0 ELSE CAST(len(string_split(body, ' ')) AS BIGINT) END AS n_words, sha256(body) AS digest,
       known.license_id, coalesce(notices, '') AS notices
FROM w LEFT JOIN known ON known_digest = sha256(body) LEFT JOIN n USING (doc_id)"""
