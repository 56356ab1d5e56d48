"""Licence scan by canonical digests, native: only DataFrame functions.

A text is normalised (case, punctuation, white space, copyright lines, equivalent spellings) and
hashed with SHA-256. Known licence texts and notices pass through the same expression, so a lookup
is an equality of digests: whole texts are joined to the known digests, whose number is fixed, hence the
broadcast; lines, as a finer unit, are looked up in the same few digests as a constant map.

Defined results: a null text counts as empty; an empty canonical text matches nothing; a text of any length
is hashed whole; a digest that two known texts share goes to the smaller name; repeated rows give repeated results;
an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

# Public licence texts and the notices commonly placed in files.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
_BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

#: (licence, text): whole texts and notices, looked up alike.
KNOWN: list[tuple[str, str]] = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("BSL-1.0", _BOOST),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + _BOOST),
    ("Apache-2.0", _APACHE_NOTICE),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0."),
]
#: (licence, digest of the canonical form) of texts too long to stand here: as published, and without what follows the
#: terms. tests/llm holds them against the texts where the system has them.
LONG_TEXTS: list[tuple[str, str]] = [
    ("Apache-2.0", "e63d14e1ca71411d11150dc8861f024a6ec6441f1ee18291e92489d17c350087"),
    ("Apache-2.0", "1e8f4981e4c9d8c419eb0a8c36ad86071d44663baa7771ca1fadb11466ea54ec"),
    ("Apache-2.0", "10907b41771c0b51fb389ca61bbd802b43b3adbe997a32ee84018e1e5a4a10fc"),
    ("GPL-2.0", "934972ded335989187c0bb24accac7705d4bf1d429a9a3fe67e79fb5b7b5bb35"),
    ("GPL-2.0", "fdd0ddf956d2ebd34f9b90442a44e98785fa0b2f7862bd4a72d015d528cd2557"),
    ("GPL-2.0", "c426a542386492c50e3108f338b0c78a6b6ad4b2a7b50515015b04945bfb8827"),
    ("GPL-3.0", "4065a5b41900d867403bb6bf9094b1f9893ed70c8dcf5a12fd1a88a3bb63e37c"),
    ("GPL-3.0", "773827e711c1451a8ccf78f542d5462c230022ba89aa5bc3529f0bab34b41d22"),
    ("GPL-3.0", "df019b66fae7b7d52c03c4cdfdab47b4f6433b7e86b02a26746f9631ddad10f4"),
    ("LGPL-2.0", "94778254b307c7946efd0a84a7e875e5b3b89aefe54e7563be7cac8d3ac41dc9"),
    ("LGPL-2.0", "62b7ef274cb596b6f6002c5091246c95332aec4ccb9c4e9225c664927a65f3fa"),
    ("LGPL-2.0", "71d979dfc4301d801e1aa1c0946be1e166d76b0f87073bf6a22d1aaafca09cff"),
    ("LGPL-2.1", "073e92d27d3070cc2f7512cd4d499323a1b169166ddf858b3e5b0179460047da"),
    ("LGPL-2.1", "83de7f57e0d470e54ceeaf1e7679c21c2e944f77be5a0387d7b562259f027693"),
    ("LGPL-2.1", "1f3b517fd30ba5bd154f358fcaec0a2405d513d7f5abea590c6728b42c4e0615"),
    ("LGPL-3.0", "04fbfafabca014c4a64256b62acef8da80a16221a8b883adf24173d0e00e6332"),
    ("MPL-1.1", "9be262e497ceec5b57c65e7c50341c9b1bb6cb3df98c4091c0664877ae706d38"),
    ("MPL-2.0", "a5490b3d721dcb99af383dc678cf64839fc9c8bca40025b071940900080d9a83"),
    ("CC0-1.0", "f1e61fdb045270c3694853272efdba9107f8854bda65dc153a8ab1c2e43c8db7"),
    ("GFDL-1.2", "7c5001441e52048420ea7ac2237b88610b71af1291bf257ecf067b40847303d0"),
    ("GFDL-1.3", "501a789e12e32356e53afa7c9623bfa5c00b7e35bb47a46cd3d43cc9d605eeb8"),
    ("GPL-1.0", "30080754a6b701a003867beb185b253f9c7244cc5cdde70e731dd167fdbba0a6"),
    ("GPL-1.0", "73f645b64cd12c24a630337362ba5ca560c5bb2d117a186a1d91974865af4b7e"),
    ("GPL-1.0", "d4909d6d780696d091923db9a1152f911d6acff43e6454bf30264421ab4d9d1c"),
]
#: (pattern, canonical spelling), applied to lower-case words parted by single blanks, in this order.
SPELLINGS: list[tuple[str, str]] = [
    (r"\b(all rights reserved)\b", " "),
    (r"\b(acknowledgement)\b", "acknowledgment"),
    (r"\b(licence)", "license"),
    (r"\b(organisation)", "organization"),
    (r"\b(authoris)", "authoriz"),
    (r"\b(merchantibility)\b", "merchantability"),
    (r"\b(non infringement)\b", "noninfringement"),
    (r"\b(sub license)", "sublicense"),
    (r"\b(copyright owner)", "copyright holder"),
    (r"\b(per cent)\b", "percent"),
    (r"\bversion ([0-9])", "v $1"),
    (r"\bhttps\b", "http"),
    (r"\b(and or)\b", "and"),
    (r"  +", " "),
]
_SPELT = "|".join(p for p, _ in SPELLINGS[:-1])
#: A line that only states whose work it is: the mark with a sign, a year or "by" behind it, or with a name, unless
#: the name is a word of the law, as where a licence text is wrapped before "COPYRIGHT HOLDERS".
MARKED = r"(?i)^[^\p{L}\p{N}]{0,8}(©|\(c\)[ \t]*[0-9]{4}|copyright[ \t,:]*(\(c\)|©|[0-9]|by[ \t]))"
NAMED = r"^[^\p{L}\p{N}]{0,8}([Cc]opyright|COPYRIGHT)[ \t,:]+\p{Lu}"
LEGAL = r"(?i)^[^\p{L}\p{N}]{0,8}copyright[ \t,:]+(notice|holder|owner|law|licen[sc]e|interest|statement|act|protection|and|or|in|of|is|the|to)s?\b"
#: A copyright line has this many words at most; in a longer one, as where a text is unwrapped, only the mark, the years
#: and the holder go: up to the opening of a licence text if one follows soon, else to the end of the sentence.
LINE_WORDS = 20
OPENINGS = r"permission (?:is|to)|redistribution and|redistributions? of|licensed under|released under|this (?:software|program|library|work|file|is)|everyone is|the above|all rights|you may|provided"
PHRASE = rf"(?i)(?:copyright[ \t,:]*(?:\(c\)|©|[0-9]{{4}}|by[ \t])|©|\(c\)[ \t]*[0-9]{{4}})(?:.{{0,300}}?\b({OPENINGS})|.*?\p{{L}}{{3}}[.!?](?:[ \t]|$)|.*$)"
_LONG = rf"^[^\x20\x09-\x0D]*(?:[\x20\x09-\x0D]+[^\x20\x09-\x0D]+){{{LINE_WORDS}}}"
_ANY_MARK = r"(?i)copyright|©|\(c\)"
#: What no word holds; line ends part lines until the words are joined.
_BETWEEN = r"[^\p{L}\p{N}\n]+"


def _without_copyright(text: Column) -> Column:
    mine = lambda x: x.rlike(_LONG) | ~(x.rlike(MARKED) | (x.rlike(NAMED) & ~x.rlike(LEGAL)))
    cut = lambda x: F.when(x.rlike(_LONG) & x.rlike(_ANY_MARK), F.regexp_replace(x, PHRASE, "$1")).otherwise(x)
    return F.when(text.rlike(_ANY_MARK), F.array_join(F.transform(F.filter(F.split(text, "\n"), mine), cut), "\n")).otherwise(text)


def _lines(text: Column) -> Column:
    """Lower-case words parted by single blanks, line by line, no copyright lines."""
    return F.lower(F.regexp_replace(_without_copyright(text), _BETWEEN, " "))


def _spelt(words: Column) -> Column:
    """Equivalent spellings as one; texts without any are left as they are."""
    out = words
    for pattern, spelling in SPELLINGS:
        out = F.regexp_replace(out, pattern, spelling)
    return F.trim(F.when(words.rlike(_SPELT), out).otherwise(words))


def _joined(lines: Column) -> Column:
    return _spelt(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")))


def canonical(text: Column) -> Column:
    """The normal form that is hashed: lower-case words parted by single blanks, no copyright lines."""
    return _joined(_lines(text))


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def known_digests(spark) -> DataFrame:
    """(digest, license) of KNOWN, through the same expression as the documents, and of LONG_TEXTS."""
    rows = spark.createDataFrame(KNOWN, "license string, text string")
    long_ = spark.createDataFrame([(d, name) for name, d in LONG_TEXTS], "digest string, license string")
    return rows.select(digest(F.col("text")).alias("digest"), "license").unionByName(long_).groupBy("digest").agg(F.min("license").alias("license"))


#: Every canonical known text holds one of these, so a canonical line without them needs no digest.
HINT = r"license|permission|redistribution|released|provided"


def license_scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, digest of the whole text, its licence or null, the number of
    lines that are known notices and their licences, sorted and joined by commas."""
    spark = docs.sparkSession
    known = known_digests(spark)
    # A constant of fixed size: each line is looked up where it stands, without a row per line.
    pairs = [x for r in known.orderBy("digest").collect() for x in (F.lit(r["digest"]), F.lit(r["license"]))]

    def found(lines: Column) -> Column:
        hinted = F.filter(F.transform(F.filter(F.split(lines, "\n"), lambda x: x.rlike(HINT + "|licence")), lambda x: _spelt(F.trim(x))), lambda x: x.rlike(HINT))
        return F.filter(F.transform(hinted, lambda x: F.element_at(F.create_map(*pairs), F.sha2(x, 256))), lambda x: x.isNotNull())

    t = docs.select(F.col(id_col).alias("doc_id"), let(_lines(F.coalesce(F.col(text_col), F.lit(""))), lambda x: F.struct(F.sha2(_joined(x), 256).alias("text_digest"), found(x).alias("found"))).alias("c"))
    t = t.select("doc_id", "c.*")
    whole = t.join(F.broadcast(known), t.text_digest == known.digest, "left").drop("digest")
    return whole.select(
        "doc_id",
        "text_digest",
        F.col("license").alias("text_license"),
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.sort_array(F.array_distinct("found")), ",").alias("notice_licenses"),
    )


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql_canonical(x: str) -> str:
    """The same form for DuckDB, every spelling applied to every text."""
    kept = f"list_filter(string_split({x}, chr(10)), lambda y: regexp_matches(y, '{_LONG}') OR NOT (regexp_matches(y, '{MARKED}') OR (regexp_matches(y, '{NAMED}') AND NOT regexp_matches(y, '{LEGAL}'))))"
    kept = f"list_transform({kept}, lambda y: CASE WHEN regexp_matches(y, '{_LONG}') THEN regexp_replace(y, '{PHRASE}', '\\1', 'g') ELSE y END)"
    out = rf"trim(regexp_replace(lower(array_to_string({kept}, chr(10))), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"
    for pattern, spelling in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{spelling.replace('$', chr(92))}', 'g')"
    return f"trim({out})"


def _sql_oracle() -> str:
    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in KNOWN)
    long_ = ", ".join(f"('{name}', '{d}')" for name, d in LONG_TEXTS)
    return f"""
WITH known AS (SELECT min(license) AS license, digest FROM (SELECT license, sha256({_sql_canonical('text')}) AS digest FROM (VALUES {rows}) AS v(license, text) UNION ALL SELECT * FROM (VALUES {long_}) AS w(license, digest)) GROUP BY digest),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, sha256({_sql_canonical('x')}) AS digest FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d)),
n AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS names FROM l JOIN known USING (digest) GROUP BY 1)
SELECT d.doc_id, sha256({_sql_canonical('d.text')}) AS text_digest, k.license AS text_license, coalesce(n.n, 0)::BIGINT AS n_notices, coalesce(names, '') AS notice_licenses
FROM d LEFT JOIN known k ON k.digest = sha256({_sql_canonical('d.text')}) LEFT JOIN n ON n.doc_id = d.doc_id
"""


ORACLE = _sql_oracle()
