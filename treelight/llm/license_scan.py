"""License scans by canonical digests: entire texts are normalised, hashed and joined with the digests of known licences.

Normalising lower-cases, spells equivalent words alike, drops copyright lines (where a known text or notice follows on the same
line, only the statement before it), turns every run of other characters than
letters and digits into one space, and trims. The same SQL expressions normalise the known texts and the documents, so
both sides agree by construction. Short notices (a line such as "Released under the MIT License.") are
looked up in the same way, each line of a document as a text of its own.

The table of known digests has a fixed size (the lists below and what the caller adds), so it's broadcast; documents
aren't shuffled. The main path is built-in functions only.

Defined results: a null text counts as the empty text; a text without letters or digits (after normalising) matches nothing; a
very long text is normalised whole; of names with one digest the first in code-point order counts; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored whatever their names.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treelight.llm.common import text_of

#: Spellings that count as the same word, as (pattern, spelling), on lower-case text.
EQUIVALENT = [
    (r"\blicence", "license"),
    (r"\bsub-license", "sublicense"),
    (r"\bnon-commercial", "noncommercial"),
    (r"\bper cent\b", "percent"),
    (r"\bcopyright holders\b", "copyright holder"),
    (r"\bcopyright owners?\b", "copyright holder"),
    (r"\bauthors?\b", "author"),
    (r"\bfavour", "favor"),
    (r"\bversion (\d)", "v$1"),
    (r"\bv\.? ?(\d)", "v$1"),
    (r"\bhttps\b", "http"),
]

#: The texts of short public licences, as published.
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.
"""
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_TAIL = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.
"""
_MIT_BODY = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
_UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
"""
_MPL_NOTICE = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
TEXTS = [
    ("MIT", _MIT_BODY),
    ("MIT", "MIT License\n" + _MIT_BODY),
    ("MIT", "The MIT License (MIT)\n" + _MIT_BODY),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_HEAD + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_HEAD + _BSD_THIRD + _BSD_TAIL),
    ("ISC", _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("ISC", "ISC License\n" + _ISC_GRANT + ", provided that the above copyright notice and this permission notice appear in all copies." + _ISC_TAIL),
    ("0BSD", _ISC_GRANT + "." + _ISC_TAIL),
    ("Zlib", _ZLIB),
    ("Zlib", "zlib License\n" + _ZLIB),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE_NOTICE),
    ("MPL-2.0", _MPL_NOTICE),
]
#: Digests of the normalised texts of long public licences, as published: entire, as one line where that differs (copyright
#: statements end elsewhere), and up to "END OF TERMS AND CONDITIONS" with and without these words. AGPL-3.0 and the CC BY family are missing.
DIGESTS = [
    ("Apache-2.0", "4fee98e709bcce54c6f142874574d03e1c430270855b6293646e78477738b3e3"),
    ("Apache-2.0", "5b6cb1f6b98266597bce32b807caa24d11ec4a7459c595b2550a4671a1397a42"),  # the appendix filled in
    ("Apache-2.0", "5068e6aa281b14fd8b22622fa3d8c9083674f05897c0586d1c01b5e6f4989733"),
    ("Apache-2.0", "4ecef2d4ddc0e3f0ff546c44c95fafa01b8eb22392227da8887afe59c07d4991"),
    ("GPL-2.0", "666c1a66fed41fc3a2aaf6dedcea9bd22a3f2abdbbc2ef9b6534acd4bfe5f795"),
    ("GPL-2.0", "57558057a7f6541098f3ccaba65a78acbb1f6a3855d9ba4795c2b906d629321e"),
    ("GPL-2.0", "02aa3ad491a6f9cdf61455e7c963a387803c7c1e9022b1cdaac2fee9af725d4a"),
    ("GPL-2.0", "e719eb9d4224d6c36814b3a3a73f776e45bc0158ad895df4dc2ef9364499d4fd"),
    ("GPL-3.0", "3100733a27bd0c2a21b00dbf04c87762858c9b1a4283afaddcb33fa54d47df46"),
    ("GPL-3.0", "2ae1bcfa33fa1a2d5daf855c5efeb6c2df741f93eace8458d69d9949db3d7a06"),
    ("GPL-3.0", "4a61e054210300a271d542f579639fce7df853d3164d611b4c6c9d1eb9427429"),
    ("GPL-3.0", "ac9ca532dfa651f015b318562adce7738c87792757aff9794f3f12be47b918a5"),
    ("LGPL-2.1", "37f00d23c5a7696b167e05e31c05c7d9e4ab182adcc9441511219b504b0e149d"),
    ("LGPL-2.1", "9d014ee850092b940b5f07618b9b52ca14d0dad7def13e02c0d5ce392441a54c"),
    ("LGPL-2.1", "b409c1c030a9e96dd195c57961846e0fc259f28ff506d3316e39f1a516ac6a75"),
    ("LGPL-2.1", "c0ce6f9865aa6164a5038e538bfe897afe4c6732ce66c046975f7286a29c12e1"),
    ("LGPL-3.0", "b9d017245d5b6307f6fc2b6dc02be9744eb7e632f313cf7b809a2cd3996db0f6"),
    ("CC0-1.0", "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f"),
    ("MPL-2.0", "5a8102e063bb1e519103b55e1c4a9fa391cf30752ee2c8757d9edc7a5794c944"),
]
#: Names of licences in one-line notices, with their identifiers.
NAMES = [
    ("MIT", "MIT License"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, Version 2.0"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("Unlicense", "Unlicense"),
    ("CC0-1.0", "CC0 1.0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("CC-BY-ND-4.0", "CC BY-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "CC BY-NC-SA 4.0"),
    ("CC-BY-NC-ND-4.0", "CC BY-NC-ND 4.0"),
]
#: How one-line notices begin.
PHRASES = ["", "Licensed under ", "Released under ", "Distributed under ", "Available under ", "This work is licensed under ", "This software is released under ", "This project is licensed under "]


def notices() -> list[tuple[str, str]]:
    """Every phrase with every name, with and without "the"; also the identifier tags that source files carry."""
    out = [(i, p + the + n) for i, n in NAMES for p in PHRASES for the in ("", "the ")]
    return out + [(i, f"SPDX-License-Identifier: {i}{x}") for i, _ in NAMES for x in ("", "-only", "-or-later")]


#: A line that is a copyright notice, as a pattern on lower-case text.
COPYRIGHT_LINE = r"(?m)^[^\n\p{L}\p{N}©]*(portions )?(copyright|©|\(c\))[^\n]*(\d{4}|©|\(c\)|all rights reserved)[^\n]*$|(?m)^[^\n\p{L}\p{N}]*all rights reserved[^\n]*$"


#: So many words of a known text count as its opening.
OPENING_WORDS = 4
#: Where the long licences go on after the copyright statements inside them.
FURTHER_OPENINGS = ["Everyone is permitted to copy", "This program is free software", "This library is free software"]
#: How far from a copyright statement's year or sign a known text may begin.
HOLDER_CHARS = 300


def openings(texts: list[tuple[str, str]] | None = None) -> str:
    """A pattern on lower-case text: where a known text (the caller's, if given) or a notice begins; mere names only after punctuation."""
    known = [t for _, t in (TEXTS if texts is None else texts)] + FURTHER_OPENINGS + PHRASES
    names = [n for _, n in NAMES] + ["SPDX-License-Identifier"]
    split = [re.findall(r"[^\W_]+", t.lower())[:OPENING_WORDS] for t in known]

    def pattern(words: list[str]) -> str:
        return r"[^\p{L}\p{N}\n]+".join(re.sub("licen[sc]e", "licen[sc]e", w) for w in words)

    long = sorted({pattern(w) for w in split if len(w) > 1})
    short = sorted({pattern(w) for w in [*(re.findall(r"[^\W_]+", n.lower()) for n in names), *split] if w and pattern(w) not in long})
    return rf"(?<=[^\p{{L}}\p{{N}}])(?:{'|'.join(long)}|(?<=[.,;:|)] )(?:the )?(?:{'|'.join(short)}))(?![\p{{L}}\p{{N}}])"


#: A copyright statement up to its year or sign, on lower-case text: at the beginning of a line, or with the year or sign next to the word.
_STATEMENT = (
    r"(?:(?m:^)[^\n\p{L}\p{N}©]*(?:portions )?copyright[^\n]{0,120}?\d{4}"
    r"|(?<![\p{L}\p{N}])(?:portions )?(?:(?:(?:copyright|©|\(c\))[ \t:,]*)+\d{4}|copyright[ \t:]*(?:©|\(c\))|©))"
)


def canonical(text: Column, texts: list[tuple[str, str]] | None = None) -> Column:
    """The normalised text; texts are the known ones, if not TEXTS."""
    out = F.lower(text)
    before_known = rf"{_STATEMENT}[^\n]{{0,{HOLDER_CHARS}}}?(?={openings(texts)})"
    says = F.contains(out, F.lit("copyright")) | F.contains(out, F.lit("©")) | F.contains(out, F.lit("(c)"))
    out = F.when(says, F.regexp_replace(out, before_known, " ")).otherwise(out)
    out = F.regexp_replace(out, COPYRIGHT_LINE, " ")
    for pattern, spelling in EQUIVALENT:
        out = F.regexp_replace(out, pattern, spelling)
    return F.btrim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def digest(text: Column) -> Column:
    """sha256 of the normalised text; null where nothing is left."""
    return F.when(text != "", F.sha2(text, 256))


def known_digests(spark, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id and license_digest, one row per digest."""
    said = json.dumps(TEXTS + notices() if texts is None else [list(x) for x in texts])
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(said), "array<array<string>>")).alias("x"))
    known = rows.select(F.col("x")[0].alias("license_id"), digest(canonical(F.col("x")[1], texts)).alias("license_digest"))
    if texts is None:
        long = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(DIGESTS)), "array<array<string>>")).alias("x"))
        known = known.union(long.select(F.col("x")[0], F.col("x")[1]))
    return (
        known.where("license_digest is not null")
        .groupBy("license_digest")
        .agg(F.min("license_id").alias("license_id"))
    )


#: Texts that a caller may add; their digests are a constant of the plan and broadcast.
MOST_TEXTS = 50_000
#: Lines are looked up only where they can match: every notice known here has one of these words. A caller's texts may have others.
NOTICE_WORDS = r"licen[sc]e|\bcc\b|\bcc0\b|mozilla"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per row of docs: doc_id, text_digest, license_id (of the entire text, else null), n_notices, notice_ids (sorted, comma-joined)."""
    spark = docs.sparkSession
    if texts is not None and len(texts) > MOST_TEXTS:
        raise ValueError(f"more than {MOST_TEXTS} texts")
    known = known_digests(spark, texts)
    # the known digests as one constant map of fixed size: lines look themselves up without being exploded
    lookup = F.from_json(F.lit(json.dumps({x["license_digest"]: x["license_id"] for x in known.collect()})), "map<string,string>")
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        digest(canonical(text, texts)).alias("text_digest"),
        F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.lower(x).rlike(NOTICE_WORDS) if texts is None else x != "").alias("lines"),
    )
    rows = rows.join(F.broadcast(known), F.col("text_digest") == F.col("license_digest"), "left")
    found = F.filter(F.transform("lines", lambda x: F.try_element_at(lookup, digest(canonical(x, texts)))), lambda x: x.isNotNull())
    return rows.select("doc_id", "text_digest", "license_id", found.alias("found")).select(
        "doc_id",
        "text_digest",
        "license_id",
        F.size("found").cast("long").alias("n_notices"),
        F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notice_ids"),
    )
