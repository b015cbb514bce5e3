"""Licence scan by canonical digests [native].

A text is brought to a canonical form - lower case, copyright lines left out, equivalent spellings
made one, everything but letters and digits one space - and the SHA-256 of the whole form is joined
with the digests of known licence texts, which go through the same expressions. Only DataFrame
functions are used; the known texts are a handful of rows and are broadcast. Lines that are wholly
a known licence statement are found by the same digests, looked up in a map.

Defined results: null texts have no digest and no licence; a text without letters or digits has the
digest of the empty form and no licence; repeated rows are matched each; known texts with one
canonical form (the same licence under two names) give the name that sorts first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitweave.llm.common import free_of

# The standard texts of short public licences, without their copyright lines.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_NAMES = """
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
BSD_WARRANTY = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.

In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.

For more information, please refer to <https://unlicense.org>"""
APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
WTFPL = """DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
Version 2, December 2004

Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.

DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION

0. You just DO WHAT THE FUCK YOU WANT TO."""

KNOWN = {
    "MIT": MIT,
    "MIT (titled)": "MIT License\n\n" + MIT,
    "MIT (titled The)": "The MIT License (MIT)\n\n" + MIT,
    "ISC": ISC,
    "ISC (titled)": "ISC License\n\n" + ISC,
    "BSD-2-Clause": BSD_CONDITIONS + BSD_WARRANTY,
    "BSD-2-Clause (titled)": "BSD 2-Clause License\n\n" + BSD_CONDITIONS + BSD_WARRANTY,
    "BSD-3-Clause": BSD_CONDITIONS + BSD_NAMES + BSD_WARRANTY,
    "BSD-3-Clause (titled)": "BSD 3-Clause License\n\n" + BSD_CONDITIONS + BSD_NAMES + BSD_WARRANTY,
    "Zlib": ZLIB,
    "Zlib (titled)": "zlib License\n\n" + ZLIB,
    "Unlicense": UNLICENSE,
    "Apache-2.0 (notice)": APACHE_NOTICE,
    "WTFPL": WTFPL,
}

# Digests of the canonical forms of long licences, each whole and, where there is more
# after the terms (how to apply them, exhibits), without that. AGPL-3.0 is missing.
LONG = {
    "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25": "Apache-2.0",
    "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40": "Apache-2.0",
    "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821": "GPL-2.0",
    "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34": "GPL-2.0",
    "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a": "GPL-3.0",
    "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636": "GPL-3.0",
    "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891": "LGPL-2.1",
    "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4": "LGPL-2.1",
    "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be": "LGPL-3.0",
    "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a": "MPL-2.0",
    "075fcdf87448c49dbad8c5f7963f0eb6907a3d8eae1b431ba2988508499ec0de": "MPL-2.0",
}

# Names of licences in statements, and the statements' forms.
STATED = {
    "MIT License": "MIT", "Apache License, Version 2.0": "Apache-2.0", "Apache License 2.0": "Apache-2.0", "BSD License": "BSD", "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "ISC License": "ISC", "Mozilla Public License, version 2.0": "MPL-2.0",
    "GNU General Public License, version 2": "GPL-2.0", "GNU General Public License, version 3": "GPL-3.0", "GNU Lesser General Public License, version 3": "LGPL-3.0", "GNU Affero General Public License, version 3": "AGPL-3.0",
    "CC BY 4.0": "CC-BY-4.0", "CC BY-SA 4.0": "CC-BY-SA-4.0", "CC BY-NC 4.0": "CC-BY-NC-4.0", "CC BY-ND 4.0": "CC-BY-ND-4.0", "CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0",
}
FORMS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This project is licensed under the {}", "Distributed under the {}", "Available under the {}"]
#: What every line that is a statement contains, whatever stands between its words.
MARK = "(?s)licen|(?:released|distributed|available).*under"

# Spellings that licence matching guidelines hold equivalent, longer ones first.
SPELLINGS = [
    ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("per cent", "percent"), ("copyright owner", "copyright holder"), ("sub license", "sublicense"), ("sub licence", "sublicense"), ("wilful", "willful"), ("fulfil", "fulfill"),
    ("acknowledgement", "acknowledgment"), ("analogue", "analog"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"), ("calibre", "caliber"), ("cancelled", "canceled"), ("catalogue", "catalog"), ("categorise", "categorize"), ("centre", "center"), ("emphasised", "emphasized"), ("favour", "favor"), ("favourite", "favorite"), ("initialise", "initialize"), ("judgement", "judgment"), ("labelling", "labeling"), ("labour", "labor"), ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("maximise", "maximize"), ("modelled", "modeled"), ("modelling", "modeling"), ("offence", "offense"), ("optimise", "optimize"), ("organisation", "organization"), ("organise", "organize"), ("practise", "practice"), ("programme", "program"), ("realise", "realize"), ("recognise", "recognize"), ("signalling", "signaling"), ("utilisation", "utilization"), ("whilst", "while"), ("https", "http"),
]

#: A line that names a holder of copyright: it starts, after marks, with the word or the sign.
COPYRIGHT_LINE = "(?m)^[^a-z0-9\\n]*(?:copyright|\\(c\\)|©|portions copyright)[^\\n]*(?:\\(c\\)|©|[0-9][0-9][0-9][0-9]|<year>|\\[year\\]|all rights reserved)[^\\n]*$"
RESERVED_LINE = "(?m)^[^a-z0-9\\n]*all rights reserved[^a-z0-9\\n]*$"


def canonical(text: Column) -> Column:
    """The canonical form; null stays null."""
    t = F.regexp_replace(F.lower(text), "\\r\\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, COPYRIGHT_LINE, ""), RESERVED_LINE, "")
    # each word has spaces of its own, so that neighbours are all found
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, "[^\\p{L}\\p{N}]+", "  ")), F.lit(" "))
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(spaced(old)), F.lit(spaced(new)))
    return F.trim(F.replace(t, F.lit("  "), F.lit(" ")))


def spaced(words: str) -> str:
    return " " + words.replace(" ", "  ") + " "


def digest(text: Column) -> Column:
    return F.sha2(canonical(text).cast("binary"), 256)


def known(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(known_digest, licence_id) of the known texts: as many rows as texts at most."""
    rows = spark.createDataFrame(sorted((texts or KNOWN).items()), "name string, body string")
    name = F.trim(F.regexp_replace("name", " \\(titled.*$", ""))
    return rows.select(digest(F.col("body")).alias("known_digest"), name.alias("licence_id")).groupBy("known_digest").agg(F.min("licence_id").alias("licence_id"))


def statements(spark: SparkSession) -> dict[str, str]:
    """Licence by digest of each known statement."""
    rows = spark.createDataFrame([(f.format(n), i) for n, i in STATED.items() for f in FORMS], "body string, licence_id string")
    return {r["d"]: r["licence_id"] for r in rows.select(digest(F.col("body")).alias("d"), "licence_id").collect()}


def scan(docs: DataFrame, text: str = "text", keep: list[str] | None = None, texts: dict[str, str] | None = None) -> DataFrame:
    """The columns keep (default: all) of docs with canonical_digest, licence_id (null: the whole
    text is no known licence) and stated_licences (those of its lines that are a statement). A column
    of docs that has one of these names is not kept: the new ones win."""
    keep = free_of(docs.columns if keep is None else keep, ("canonical_digest", "licence_id", "stated_licences"))
    names = [f"_keep{i}" for i in range(len(keep))]
    by_digest = F.create_map(*(F.lit(x) for pair in sorted(statements(docs.sparkSession).items()) for x in pair))
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\r\n|\r|\n"), lambda x: F.lower(x).rlike(MARK))
    stated = F.array_sort(F.array_distinct(F.array_compact(F.transform(lines, lambda x: F.element_at(by_digest, digest(x))))))
    found = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), digest(F.col(text)).alias("canonical_digest"), stated.alias("stated_licences"))
    listed = known(docs.sparkSession, texts)
    if texts is None:
        listed = listed.unionByName(docs.sparkSession.createDataFrame(sorted(LONG.items()), listed.schema))
    listed = F.broadcast(listed)
    return found.join(listed, found["canonical_digest"] == listed["known_digest"], "left").select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), "canonical_digest", "licence_id", "stated_licences")


def canonical_sql(text: str) -> str:
    """The canonical form in DuckDB SQL."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    t = f"regexp_replace(lower({text}), '\\r\\n?', chr(10), 'g')"
    for line in (COPYRIGHT_LINE, RESERVED_LINE):
        t = f"regexp_replace({t}, {q(line)}, '', 'g')"
    # words as a list, each by the table of spellings, with the next one where two are spelt as one
    words = f"string_split(trim(regexp_replace({t}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    pairs, single = [x for x in SPELLINGS if " " in x[0]], [x for x in SPELLINGS if " " not in x[0]]
    table = lambda rows: "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in rows) + "}"
    step = f"""CASE WHEN len(a) > 0 AND ({table(pairs)})[a[-1] || ' ' || w] IS NOT NULL THEN list_concat(a[:-2], string_split(({table(pairs)})[a[-1] || ' ' || w], ' ')) ELSE list_append(a, w) END"""
    joined = f"list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform({words}, lambda w: [w])), lambda a, x: {step.replace('w]', 'x[1]]').replace(', w)', ', x[1])')})"
    return f"CASE WHEN {text} IS NOT NULL THEN array_to_string(list_transform({joined}, lambda w: coalesce(({table(single)})[w], w)), ' ') END"


def oracle_sql() -> str:
    """DuckDB SQL for scan() over documents."""
    q = lambda x: "'" + x.replace("'", "''") + "'"
    whole = ", ".join(f"({q(n.split(' (titled')[0])}, {q(t)})" for n, t in sorted(KNOWN.items()))
    stated = ", ".join(f"({q(i)}, {q(f.format(n))})" for n, i in STATED.items() for f in FORMS)
    return f"""
WITH known AS (SELECT sha256({canonical_sql('body')}) AS d, min(name) AS licence_id FROM (VALUES {whole}) AS k(name, body) GROUP BY 1),
stated AS (SELECT sha256({canonical_sql('body')}) AS d, min(name) AS licence_id FROM (VALUES {stated}) AS k(name, body) GROUP BY 1),
rows AS (SELECT row_number() OVER () AS r, doc_id, text, sha256({canonical_sql('text')}) AS canonical_digest FROM documents),
lines AS (SELECT r, unnest(string_split_regex(coalesce(text, ''), '\r\n|\r|\n')) AS line FROM rows),
found AS (SELECT r, string_agg(DISTINCT s.licence_id, ',' ORDER BY s.licence_id) AS stated FROM lines JOIN stated s ON s.d = sha256({canonical_sql('line')}) GROUP BY r)
SELECT doc_id, canonical_digest, licence_id, coalesce(stated, '') AS stated_licences
FROM rows LEFT JOIN known ON known.d = canonical_digest LEFT JOIN found USING (r)"""
