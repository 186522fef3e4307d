"""Licence scans with a positional index of rare words, in built-in functions only.

Templates are word sequences: whole public licence texts, notices and one-line
references. Each is indexed under its rarest words (by inverse document frequency
over the whole corpus) with their positions. A file looks up every word of the index
that it holds; each hit at word i of a posting at position p proposes that the
template lies at i - p. Proposals that agree on the relative position are one
candidate, which is verified: its key phrase must stand word for word where the
alignment puts it. Its coverage is the IDF weight of the template's words that stand
in place, by its own alignment or by one of the same template up to DRIFT words
away (a holder's name may be longer or shorter than the template's).

The base phrases are templates that are all key phrase, so no place of a phrase can
be missed.

Everything happens within a row: a file of any length is one array, nothing is
shuffled but the document frequencies (one row a licence word).

Edge cases: null text counts as empty and has no words, no label and score 0; a
label occurs once however often it is found; words of equal frequency are indexed
in alphabetical order; repeated rows give equal rows; an empty table gives no rows;
extra columns are ignored by the query and kept by ``scan``, whose result takes
another name where one has its own.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import table, unused

#: Fixed by the contract: phrase -> label.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public licence texts, notices and references, each with the key phrase that must stand in it.
_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;
OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the
following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution."""
_GNU = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the
Free Software Foundation, either version {1} of the License, or (at your option) any later version. This program is distributed in
the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU {0} for more details. You should have received a copy of the GNU {0} along with this program."""
TEMPLATES = {
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", "Apache License, Version 2.0"),
    "apache-2.0-notice": (
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
        License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law
        or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
        CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
        "you may not use this file except in compliance with the License",
    ),
    "bsd": (_BSD.split(": 1.")[0], "Redistribution and use in source and binary forms"),
    "bsd-2-clause": (f"{_BSD} {_DISCLAIMER}", "Redistribution and use in source and binary forms"),
    "bsd-3-clause": (
        f"""{_BSD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote
        products derived from this software without specific prior written permission. {_DISCLAIMER}""",
        "may be used to endorse or promote products derived from this software",
    ),
    "bsl-1.0": (
        """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying
        documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to
        do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above
        license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in
        part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor.""",
        "to any person or organization obtaining a copy of the software",
    ),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", "CC BY-NC"),
    "cc-by-sa": ("Licensed under CC BY-SA 4.0", "CC BY-SA"),
    "gpl-2.0-notice": (_GNU.format("General Public License", "2"), "either version 2 of the License"),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", "GNU General Public License, version 3"),
    "gpl-3.0-notice": (_GNU.format("General Public License", "3"), "either version 3 of the License"),
    "agpl-3.0-notice": (_GNU.format("Affero General Public License", "3"), "GNU Affero General Public License as published"),
    "lgpl-3.0-notice": (_GNU.format("Lesser General Public License", "3"), "GNU Lesser General Public License as published"),
    "isc": (
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS"
        AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS
        ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
        "for any purpose with or without fee is hereby granted",
    ),
    "mit-grant": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "Permission is hereby granted, free of charge"),
    "mit-text": (
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
        files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
        is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
        included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY
        KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
        NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
        "to deal in the Software without restriction",
    ),
    "mpl-2.0": (
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
        with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "Mozilla Public License",
    ),
    "unlicense": (
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
        sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means.""",
        "free and unencumbered software",
    ),
    "zlib": (
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any
        damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of
        this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in
        a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions
        must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be
        removed or altered from any source distribution.""",
        "must not claim that you wrote the original software",
    ),
}
#: What stands between words: all ASCII but digits and small letters.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Rare words that index a template, least coverage of a label, words by which alignments of one template may differ.
INDEX_WORDS, COVERAGE, DRIFT = 5, 0.6, 16
_SHIFT, _ZERO = 1 << 40, 1 << 20  # a candidate is template * _SHIFT + _ZERO + start


def words(text: Column) -> Column:
    """The words of a text in lower case.

    lower() is A-Z plus other scripts; of the latter only the Kelvin sign would
    become an ASCII letter, so it is replaced by another non-ASCII letter first.
    """
    return F.array_remove(F.split(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u03c9"))), GAP), "")


def idf(docs: DataFrame, vocabulary: list[str], text: str = "text") -> dict[str, float]:
    """Inverse document frequency of each licence word, over all documents."""
    known = F.array(*map(F.lit, vocabulary))
    found = docs.select(F.explode(F.concat(F.array_intersect(known, words(F.col(text))), F.array(F.lit("")))).alias("w")).groupBy("w").count().collect()
    count = {r["w"]: r["count"] for r in found}
    return {w: math.log((count.get("", 0) + 1) / (count.get(w, 0) + 1)) for w in vocabulary}


def _find(sequence: list[str], part: list[str]) -> int:
    return next(i for i in range(len(sequence)) if sequence[i : i + len(part)] == part)


def template_words(text: str) -> list[str]:
    """The words of a template, by the same rule as :func:`words`."""
    return [w for w in re.split(GAP, text.lower()) if w]


def scan(docs: DataFrame, text: str = "text", out: str = "scan") -> DataFrame:
    """All columns, with ``out``: struct of n_words, places (start, label), labels and score."""
    names = [*PHRASES.values(), *TEMPLATES]
    bodies = [p.split() for p in PHRASES] + [template_words(t) for t, _ in TEMPLATES.values()]
    keys = [p.split() for p in PHRASES] + [template_words(k) for _, k in TEMPLATES.values()]
    key_at = [_find(b, k) for b, k in zip(bodies, keys)]
    weight = idf(docs, sorted({w for b in bodies for w in b}), text)
    base = len(PHRASES)
    postings: dict[str, list[tuple[int, int]]] = {}
    for t, body in enumerate(bodies):
        rare = sorted(set(body), key=lambda w: (-weight[w], w))[: 1 if t < base else INDEX_WORDS]
        for w in rare:
            postings.setdefault(w, []).extend((t, p) for p, x in enumerate(body) if x == w)
    ranked = sorted(postings, key=lambda w: (-weight[w], w))
    strings = lambda x: F.array(*map(F.lit, x))
    split = lambda x, kind: F.split(F.lit(" ".join(map(str, x))), " ").cast(f"array<{kind}>")
    index = F.create_map(*[y for w in ranked for y in (F.lit(w), split([t * _SHIFT + _ZERO - p for t, p in postings[w]], "long"))])
    body_of, key_of, start_of = F.array(*[split(b, "string") for b in bodies]), F.array(*[split(k, "string") for k in keys]), split(key_at, "int")
    mass = [sum(max(weight[w], 1e-9) for w in b) for b in bodies]
    share = F.array(*[split([max(weight[w], 1e-9) / m for w in b], "double") for b, m in zip(bodies, mass)])

    taken = list(docs.columns)
    words_, spots_, found_, stands_, out_ = (taken.append(n := unused(c, taken)) or n for c in ("words", "spots", "found", "stands", out))
    w = F.col(words_)
    prepared = docs.withColumn(words_, words(F.col(f"`{text}`")))
    spots = F.filter(F.transform(w, lambda x, i: F.when(x.isin(ranked), i)), lambda i: i.isNotNull())
    # Only the rows that hold a word of the index go through their words one by one.
    prepared = prepared.withColumn(spots_, F.when(F.arrays_overlap(w, strings(ranked)), spots).otherwise(F.array().cast("array<int>")))
    proposals = F.flatten(F.transform(spots_, lambda i: F.transform(F.element_at(index, F.get(w, i)), lambda p: p + i)))
    prepared = prepared.withColumn(found_, F.array_distinct(proposals))
    which = lambda c: F.floor(c / F.lit(_SHIFT)).cast("int")
    start = lambda c: ((c % F.lit(_SHIFT)) - F.lit(_ZERO)).cast("int")

    def verified(c: Column) -> Column:
        key = F.get(key_of, which(c))
        at = start(c) + F.get(start_of, which(c))
        return (at >= 0) & (F.slice(w, F.greatest(at, F.lit(0)) + 1, F.size(key)) == key)

    def coverage(c: Column) -> Column:
        body, part = F.get(body_of, which(c)), F.get(share, which(c))
        near = F.filter(found_, lambda d: F.abs(d - c) <= DRIFT)  # far apart candidates of other templates are further away
        stands = lambda j: F.exists(near, lambda d: F.get(w, start(d) + j) == F.get(body, j))
        return F.aggregate(F.sequence(F.lit(0), F.size(body) - 1), F.lit(0.0), lambda acc, j: acc + F.when(stands(j), F.get(part, j)).otherwise(F.lit(0.0)))

    # (start, label index, coverage) of what stands; a base phrase is all key phrase, so its coverage is whole.
    stands = F.filter(F.transform(F.filter(F.col(found_), verified), lambda c: F.struct(start(c).cast("long").alias("start"), which(c).alias("t"), F.least(F.when(which(c) < base, F.lit(1.0)).otherwise(coverage(c)), F.lit(1.0)).alias("coverage"))), lambda s: s["coverage"] >= COVERAGE)
    prepared = prepared.withColumn(stands_, stands)
    label = strings(names)
    result = F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.transform(F.filter(stands_, lambda s: s["t"] < base), lambda s: F.struct(s["start"].alias("start"), F.get(label, s["t"]).alias("label"))).alias("places"),
        F.array_sort(F.array_distinct(F.transform(stands_, lambda s: F.get(label, s["t"])))).alias("labels"),
        F.coalesce(F.array_max(F.transform(stands_, lambda s: s["coverage"])), F.lit(0.0)).alias("score"),
    )
    return prepared.withColumn(out_, result).drop(words_, spots_, found_, stands_)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    s = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    places, starts = F.col("scan.places"), F.transform("scan.places", lambda p: p["start"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return s.select(
        "doc_id",
        F.col("scan.n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        joined(F.transform(places, lambda p: p["label"])).alias("base_labels"),
        joined(F.col("scan.labels")).alias("labels"),
        F.col("scan.score").alias("score"),
    )
