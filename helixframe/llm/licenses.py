"""Licence scan by canonical digests.

A text is made canonical: letters lower, copyright notices dropped (also behind the sign of a
comment, but no line of a licence's body that begins with such a word), punctuation and white space
turned into single spaces, spellings that count as equal turned into one, also where a line breaks
between their words. The SHA-256 of the result
is hash-joined to the digests of known licences, made canonical by the same expression. So are the
lines of a text to the digests of known notices, which stand for a licence without its text.

Known are the licences in KNOWN: short ones here, longer ones in license_texts. Any other table will do.

Defined results: null text counts as empty, and an empty canonical text matches nothing; texts of any
length are read whole; equal rows each get a row; an empty table of texts or licences gives an empty
result or no matches; of licences with equal canonical texts the first name counts. Of the columns
carried along, those named digest, license or notices give way to the result's; others, of whatever
name, don't matter.
"""

from __future__ import annotations

from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Canonical spelling of what counts as equal, as beginnings of words after punctuation is gone: single words, and pairs of words,
#: which may stand on two lines.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authoris", "authoriz"), ("calibre", "caliber"), ("cancelled", "canceled"), ("capitalis", "capitaliz"),
    ("catalogue", "catalog"), ("categoris", "categoriz"), ("centre", "center"), ("emphasis", "emphasiz"), ("favour", "favor"), ("fulfil ", "fulfill "), ("fulfilment", "fulfillment"), ("honour", "honor"), ("https", "http"),
    ("initialis", "initializ"), ("judgement", "judgment"), ("labell", "label"), ("labour", "labor"), ("licence", "license"), ("modell", "model"), ("offence", "offense"), ("optimis", "optimiz"), ("organis", "organiz"),
    ("practise", "practice"), ("programme", "program"), ("realis", "realiz"), ("recognis", "recogniz"), ("signall", "signal"), ("utilis", "utiliz"), ("whilst", "while"), ("wilful", "willful"),
)
PAIRS = (("sub license", "sublicense"), ("non commercial", "noncommercial"), ("copyright owner", "copyright holder"), ("per cent", "percent"))

_PERMIT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_DISCLAIM = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
    "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_3 = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY '
    "AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: (licence, text of the whole licence)
LICENSES = (
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    ("ISC", f"ISC License\n\n{_PERMIT}, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_DISCLAIM}"),
    ("0BSD", f"{_PERMIT}.\n\n{_DISCLAIM}"),
    ("BSD-2-Clause", _BSD + _BSD_END),
    ("BSD-3-Clause", _BSD + _BSD_3 + _BSD_END),
    (
        "MIT-0",
        "MIT No Attribution\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH "
        "THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Zlib",
        "zlib License\n\nThis software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\n"
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n"
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n"
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "BSL-1.0",
        "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        '(the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\n'
        "The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, "
        "unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. '
        "IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "Unlicense",
        "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
        "commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\n"
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
        "IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\n"
        "For more information, please refer to <https://unlicense.org>",
    ),
)
#: Where the terms of a longer licence end, and advice on how to apply it may follow or be left out.
TERMS_END = "END OF TERMS AND CONDITIONS"


def longer_licenses() -> list[tuple[str, str]]:
    """(licence, text) of the files in license_texts, as a whole and up to the end of the terms."""
    out = []
    for file in sorted(resources.files(__package__).joinpath("license_texts").iterdir(), key=lambda f: f.name):
        text = file.read_text("utf-8")
        name = file.name.removesuffix(".txt")
        out.append((name, text))
        if TERMS_END in text:
            out.append((name, text[: text.index(TERMS_END)] + TERMS_END))
    return out


#: All of them: (licence, text).
KNOWN = (*LICENSES, *longer_licenses())
#: (licence, line that names it)
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
#: A line that begins with a word of a copyright notice, perhaps after a comment sign (lower case).
_NOTICE_HEAD = r"[ \t]*(?:(?:[#*/;%!|-]+|<!--)[ \t]*)?"
#: Words that go on a sentence of a licence's body which has "copyright" at the beginning of a line, and those that begin an item (c).
_SENTENCE = (
    r"[ \t,;]+(?:(?:holders?|owners?|notices?|statements?|disclaimers?|claims?|laws?|licen[cs]es?|protection|rights?|interests?|patents?|trademarks?|permissions?|treaty|treaties|doctrines?|ownership|infringement|resulting|and|or|in|is|are|to|of|for|on|as|by|that|which|under|if|with|applies)\b"
    r"|the[ \t]+(?:software|program|library|work|code)\b)"
)
_ITEM = r"[ \t]+(?:you|any|the|an?|to|if|in|this|that|these|each|all|for|must|not|no|use|when|where|neither|redistributions?|it|your|they|under|accompany|give|prominently|rename|make|provide|cause|convey|such|moral|database|rights|other|publicity|affirmer|subject|contributors?|representations?)\b"
_YEAR = r"\b(?:19|20)[0-9]{2}\b"
NOTICE_LINE = rf"(^|\n){_NOTICE_HEAD}(?:copyright(?![a-z]|{_SENTENCE})|\(c\)(?=[^\n]*{_YEAR}|[ \t]*(?:copyright|©))|\(c\)(?!{_ITEM})|©|all rights reserved)[^\n]*"
#: Capitals whose lower case is not one letter in every context, and what stands for them.
_CASE = ("İΣ", "iσ")
#: Everything but letters, digits, line breaks and what isn't ASCII; and typographic signs. The same in Java's and RE2's syntax.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F“”‘’«»–—©®™•·…\x{A0}]+"


def canonical(text: Column) -> Column:
    """Canonical text, its lines still apart: words with single spaces between."""
    c = F.lower(F.translate(F.coalesce(text.cast("string"), F.lit("")), *_CASE))
    c = F.regexp_replace(c, NOTICE_LINE, "\n")
    c = F.concat(F.lit(" "), F.replace(F.regexp_replace(c, PUNCTUATION, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for have, want in SPELLINGS + PAIRS:
        c = F.replace(c, F.lit(f" {have}"), F.lit(f" {want}"))
    return F.trim(F.regexp_replace(c, r" *\n[ \n]*", "\n"))


def whole(canon: Column) -> Column:
    """Canonical text as one line, in which a pair of words may have stood on two."""
    c = F.concat(F.lit(" "), F.trim(F.translate(canon, "\n", " ")))
    for have, want in PAIRS:
        c = F.replace(c, F.lit(f" {have}"), F.lit(f" {want}"))
    return F.trim(c)


def scan(docs: DataFrame, carry: list[str], licenses: DataFrame, notices: DataFrame) -> DataFrame:
    """carry, digest, license (null if the text is none that is known), notices (licences that lines name, sorted, comma-joined)."""
    carry = [c for c in carry if c not in ("digest", "license", "notices")]
    docs = docs.select(*[F.col(f"`{c}`").alias(f"_carried_{i}") for i, c in enumerate(carry)], "text")
    back = [F.col(f"_carried_{i}").alias(c) for i, c in enumerate(carry)]
    known = licenses.select("license", F.sha2(whole(canonical(F.col("text"))), 256).alias("_digest")).groupBy("_digest").agg(F.min("license").alias("license"))
    lines = notices.select("license", canonical(F.col("text")).alias("_line")).groupBy("_line").agg(F.min("license").alias("license"))
    got = docs.select(*docs.columns[:-1], canonical(F.col("text")).alias("_canon"))
    got = got.withColumn("digest", F.sha2(whole(F.col("_canon")), 256))
    # The notices are a parameter: one row with a map from digests, and the length beyond which no line is one.
    lookup = lines.agg(
        F.map_from_entries(F.collect_list(F.struct(F.sha2("_line", 256), "license"))).alias("_known"),
        F.coalesce(F.max(F.length("_line")), F.lit(0)).alias("_longest"),
    )
    got = got.crossJoin(F.broadcast(lookup))  # a single row
    short = F.filter(F.split(F.col("_canon"), "\n"), lambda x: (F.length(x) > 0) & (F.length(x) <= F.col("_longest")))
    named = F.array_sort(F.array_distinct(F.array_compact(F.transform(short, lambda x: F.try_element_at(F.col("_known"), F.sha2(F.trim(x), 256))))))
    got = got.withColumn("notices", F.array_join(named, ","))
    return got.join(known, (F.col("digest") == F.col("_digest")) & (F.col("_canon") != ""), "left").select(*back, "digest", "license", "notices")


def known_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return tuple(spark.createDataFrame([*x], "license string, text string") for x in (KNOWN, NOTICES))


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"), ["doc_id"], *known_tables(spark))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_canonical(text: str) -> str:
    """The same, its lines judged one by one, as this dialect's patterns can't look ahead."""
    case = ", ".join(map(_quoted, _CASE))
    begins = _quoted(f"^{_NOTICE_HEAD}(?:copyright(?:[^a-z]|$)|\\(c\\)|©|all rights reserved)")
    goes_on = _quoted(f"^{_NOTICE_HEAD}(?:copyright(?:{_SENTENCE})|\\(c\\)(?:{_ITEM}))")
    dated = _quoted(f"^{_NOTICE_HEAD}\\(c\\)(?:.*{_YEAR}|[ \\t]*(?:copyright|©))")
    c = f"[CASE WHEN regexp_matches(l, {begins}) AND (NOT regexp_matches(l, {goes_on}) OR regexp_matches(l, {dated})) THEN '' ELSE l END for l in string_split(lower(translate(coalesce({text}, ''), {case})), chr(10))]"
    c = f"(' ' || replace(regexp_replace(array_to_string({c}, chr(10)), {_quoted(PUNCTUATION)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' ')"
    for have, want in SPELLINGS + PAIRS:
        c = f"replace({c}, ' {have}', ' {want}')"
    return f"trim(regexp_replace({c}, ' *\\n[ \\n]*', chr(10), 'g'), ' ')"


def _sql_whole(canon: str) -> str:
    c = f"(' ' || trim(translate({canon}, chr(10), ' '), ' '))"
    for have, want in PAIRS:
        c = f"replace({c}, ' {have}', ' {want}')"
    return f"trim({c}, ' ')"


def _sql_values(rows: tuple[tuple[str, str], ...]) -> str:
    return ", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in rows)


ORACLE = f"""
WITH known AS (
  SELECT sha256({_sql_whole("c")}) AS k, min(license) AS license
  FROM (SELECT license, {_sql_canonical("text")} AS c FROM (VALUES {_sql_values(KNOWN)}) t(license, text)) GROUP BY 1
), notice AS (
  SELECT c, min(license) AS license FROM (SELECT license, {_sql_canonical("text")} AS c FROM (VALUES {_sql_values(NOTICES)}) t(license, text)) GROUP BY 1
), doc AS (
  SELECT row_number() OVER () AS r, doc_id, {_sql_canonical("text")} AS c FROM documents
), line AS (
  SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices
  FROM (SELECT r, trim(unnest(string_split(c, chr(10))), ' ') AS l FROM doc) JOIN notice ON l = notice.c GROUP BY r
)
SELECT doc_id, sha256({_sql_whole("doc.c")}) AS digest, license, coalesce(notices, '') AS notices
FROM doc LEFT JOIN known ON k = sha256({_sql_whole("doc.c")}) AND doc.c <> '' LEFT JOIN line USING (r)
"""
