"""License notices and texts in whole documents: MinHash bands over overlapping windows, then exact containment.

Words are runs of a-z and 0-9 after lower-casing; shingles are five words. A text matches a template if it holds at least
``threshold`` of the template's shingles, wherever they stand: words inserted into a notice, once or often, few
or many, break only the shingles that they part.

Windows only find what is compared. For a template of m words they have m + 2 s - 1 words, one every s = m // 4 (at least
1). A text and a template are compared where any of the text's windows agrees with the template in any of BANDS one-row
MinHash bands. A match that lies in one window has a Jaccard of at least 0.3 with it; one that is torn into k far parts
has at least about 0.3 / k in k windows or more, whose bands are drawn apart. So all bands of all windows differ with
chance under exp(-0.3 * BANDS), 5e-9, in how many parts ever a match may be. What is compared is compared exactly, over all of
the text.

Two exact tests save most of the hashing. More than 1 - ``threshold`` of each template's shingles have one of
:func:`telling` words, so a text with none of them holds no match. And a window agrees in a band only if it has the very shingle
from which the template's value in that band comes, so windows without any of these shingles need no bands. All is Spark SQL;
templates are literals, at most 1000.

Cases: null and blank texts match nothing; rows without id are left out; a template under five words is
one shingle, matched where its words follow each other; one without words matches nothing; without templates
the result is empty; several places of one notice in a text are one row with the number of its windows, which repeated rows add to; of rows that share an id, equal or not, the
greatest containment and the first place count; a very long text is scanned whole; an empty table gives an empty table; other input columns, whatever their names, are not
read.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, BANDS = 5, 64
#: Notices by which works state their licenses, and whole license texts.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    "mit": "Released under the MIT License",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "proprietary": "All rights reserved. No part of this work may be reproduced",
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to
        use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the
        Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF
        ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE
        AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY,
        WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR
        OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND
        THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND
        FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
        WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
        ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-3-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3.
        Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
        from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
        CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF
        MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
        LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
        PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY
        THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT
        OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list
        of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS
        SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT
        NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
        THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
        DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
        INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING
        NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
        DAMAGE.""",
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def template_words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))


def telling(templates: dict[str, str], threshold: float) -> list[str]:
    """Words that the shingles of each template without any of them are fewer than ``threshold`` of all: greedily,
    those in many shingles, long ones first."""
    left, most = {}, {}
    for name, t in templates.items():
        w = template_words(t)
        k = min(WORDS, len(w))
        shingles = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        left[name], most[name] = [set(x) for x in shingles], threshold * len(shingles)
    chosen = []
    while open_ := [x for name, xs in left.items() if len(xs) >= most[name] for x in xs]:
        count: dict[str, int] = {}
        for shingle in open_:
            for w in shingle:
                count[w] = count.get(w, 0) + 1
        best = max(sorted(count), key=lambda w: count[w] * len(w) ** 3)
        chosen.append(best)
        left = {name: [x for x in xs if best not in x] for name, xs in left.items()}
    return sorted(chosen)


def _words(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, UPPER, LOWER), "[^a-z0-9]+", " ")
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _shingles(ws: Column, k: int = WORDS) -> Column:
    """Hashes of the k-word shingles by place."""
    return F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - (k - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(ws, i + j) for j in range(1, k)]))


def _least(shingles: Column, k: Column) -> Column:
    """The value of band ``k``."""
    return F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, k)))


def _bands(shingles: Column) -> Column:
    """Each band with its value and the shingle that this comes from."""
    source = lambda k: F.array_min(F.transform(shingles, lambda s: F.struct(F.xxhash64(s, k).alias("v"), s.alias("s"))))
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda k: F.struct(k.alias("k"), source(k)["v"].alias("v"), source(k)["s"].alias("s")))


FOUND = "license string, containment double, n_shingles long, first_word long, n_windows long, first_window long"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.75) -> DataFrame:
    """(doc_id, license, containment, n_shingles, first_word, n_windows, first_window): every notice found, with the share and the
    number of its shingles that the text holds, and the place of the first of these in the text, in words from 0. Of the windows of
    m + m // 4 - 1 words, one every m // 4, ``n_windows`` hold the notice by themselves, the first at ``first_window``; a notice in
    far parts may have none."""
    templates = {k: t for k, t in (TEMPLATES if templates is None else templates).items() if template_words(t)}
    if len(templates) > 1000:
        raise ValueError("templates are literals of the plan: at most 1000")
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is over 0 and at most 1")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.col("doc_id").isNotNull())
    if not templates:
        return docs.sparkSession.createDataFrame([], f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {FOUND}")
    tell = telling(templates, threshold)
    rows = rows.filter(F.col("text").rlike(f"(?i)(?<![a-z0-9])(?:{'|'.join(tell)})(?![a-z0-9])")).select("doc_id", _words(F.col("text")).alias("w"))
    long = {k: t for k, t in templates.items() if len(template_words(t)) >= WORDS}
    found = [_long_found(rows.filter(F.size("w") >= WORDS), long, threshold)] if long else []
    found += [_short_found(rows, k, " ".join(template_words(t))) for k, t in templates.items() if k not in long]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _short_found(rows: DataFrame, name: str, phrase: str) -> DataFrame:
    """Where the words of a template under five words follow each other."""
    ws = phrase.split(" ")
    here = F.filter(F.sequence(F.lit(0), F.size("w")), lambda i: F.array_join(F.slice("w", i + 1, len(ws)), " ") == phrase)
    at = rows.select("doc_id", F.explode(here).alias("start"))
    return at.groupBy("doc_id").agg(F.lit(name).alias("license"), F.lit(1.0).alias("containment"), F.lit(1).cast("long").alias("n_shingles"), F.min("start").cast("long").alias("first_word"), F.count(F.lit(1)).alias("n_windows"), F.min("start").cast("long").alias("first_window"))


def _long_found(rows: DataFrame, templates: dict[str, str], threshold: float) -> DataFrame:
    known = rows.sparkSession.createDataFrame([(k, len(template_words(t)), t) for k, t in templates.items()], "license string, m int, text string")
    known = known.select("license", "m", F.array_distinct(_shingles(_words(F.col("text")))).alias("s")).select("license", "m", "s", _bands(F.col("s")).alias("bands")).collect()
    # Literals are folded by the optimizer.
    bands_of = lambda r: F.from_json(F.lit(json.dumps([b.asDict() for b in r["bands"]])), "array<struct<k: int, v: bigint, s: bigint>>")
    shingles_of = lambda r: F.from_json(F.lit(json.dumps(r["s"])), "array<bigint>")

    def agrees(r) -> Column:
        """Whether some window and the template agree in a band: the least value of the window is the template's. Only bands
        and windows that have a shingle in common are looked at, one after the other up to the first that agrees."""
        step, sources = max(1, r["m"] // 4), sorted({b["s"] for b in r["bands"]})
        width = r["m"] + 2 * step - WORDS
        told = F.filter(F.transform("s", lambda x, i: F.when(x.isin(sources), F.struct(i.alias("at"), x.alias("s")))), lambda p: p.isNotNull())
        first = lambda p: F.ceil(F.greatest(p - width + 1, F.lit(0)) / step).cast("int") * step
        same = lambda b: lambda i: _least(F.slice(F.col("s"), i + 1, width), b["k"]) == b["v"]
        near = lambda p: lambda b: F.exists(F.sequence(first(p["at"]), p["at"] - p["at"] % step, F.lit(step)), same(b))
        return F.exists(told, lambda p: F.exists(F.filter(bands_of(r), lambda b: b["s"] == p["s"]), near(p)))

    every = sorted({b["s"] for r in known for b in r["bands"]})
    rows = rows.select("doc_id", _shingles(F.col("w")).alias("s"))
    met = F.filter(F.array(*[F.when(agrees(r), F.lit(j)) for j, r in enumerate(known)]), lambda j: j.isNotNull())
    met = F.when(F.exists("s", lambda x: x.isin(every)), met)  # as a filter it would go below and make every word again for every shingle
    all_ = F.array(*[F.struct(F.lit(r["license"]).alias("license"), F.lit(r["m"]).alias("m"), shingles_of(r).alias("t")) for r in known])
    each = rows.select("doc_id", "s", F.explode(met).alias("j")).select("doc_id", "s", F.get(all_, F.col("j")).alias("x"))
    held = each.select("doc_id", "s", "x.license", "x.m", F.size("x.t").alias("k"), F.array_intersect("x.t", "s").alias("held")).filter(F.size("held") / F.col("k") >= threshold)
    first = F.array_min(F.transform("held", lambda x: F.array_position("s", x))) - 1
    step = F.greatest(F.lit(1), F.floor(F.col("m") / 4).cast("int"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("s") - 1, F.lit(0)), step)
    within = lambda i: F.size(F.array_intersect("held", F.slice("s", i + 1, F.col("m") + step - WORDS))) / F.col("k") >= threshold
    held = held.withColumn("windows", F.filter(starts, within))
    return held.groupBy("doc_id", "license").agg(
        F.round(F.max(F.size("held") / F.col("k")), 6).alias("containment"), F.max(F.size("held")).cast("long").alias("n_shingles"), F.min(first).cast("long").alias("first_word"),
        F.sum(F.size("windows")).cast("long").alias("n_windows"), F.min(F.array_min("windows")).cast("long").alias("first_window"),
    )
