"""License scanning by MinHash bands over overlapping text windows, in DataFrame operations only.

Each template has a window length of WIDE times its words or a little more (so that templates share lengths), and windows start
every half length. An occurrence may be stretched by other words up to that length; of two neighbouring windows that hold it together, one
has half of it. A window that holds 0.4 of a template's shingles has a Jaccard similarity with it of at least 0.4 t / (w + 0.6 t) for t
template and w window shingles; the number of one-row bands is chosen so that all of them miss such a window with a probability
under MISS. A retrieved template is verified on the window and one window length to either side, by the exact share of its shingles there.

Texts that hold no guard word, and windows further than a window length from one, are passed over without loss: of each template,
guard words stand in more than a fifth of the shingles, so 0.8 of the shingles can't be there without one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

# Public license notices, by name.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "bsd-3-clause-third": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "lgpl-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "cc0-1.0": "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
    "boost-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
}
WORDS = 5
PERCENT = 80
WIDE = 2
MISS = 1e-7


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def window_words(n: int) -> int:
    """The window length of a template of n words: WIDE times n, rounded up on a scale of 10 * 1.5 ** k."""
    size = 10
    while size < WIDE * n:
        size = math.ceil(size * 1.5 / 2) * 2
    return size


def guards(words: list[str], size: int = WORDS, percent: int = PERCENT) -> list[str]:
    """Words of which every large enough part of the shingles holds one; long and frequent ones first."""
    n = max(1, len(words) - size + 1)
    shingles = [set(words[i : i + size]) for i in range(n)]
    left, out = shingles, []
    while 100 * len(left) >= percent * n:
        best = max(sorted({w for s in left for w in s}), key=lambda w: (len(w) >= 6, sum(w in s for s in left), len(w)))
        out.append(best)
        left = [s for s in left if best not in s]
    return out


def bands(window: int, sizes: list[int]) -> int:
    """One-row bands needed for the least similar window of `window` words with half an occurrence of a template of `sizes` words."""
    shingles = [(max(1, n - WORDS + 1), math.ceil(0.4 * max(1, n - WORDS + 1))) for n in sizes]
    least = min(both / (window - WORDS + 1 + t - both) for t, both in shingles)
    return math.ceil(math.log(MISS) / math.log(1 - least))


def shingle_hashes(words: Column) -> Column:
    """array<bigint>: a hash of each run of WORDS words."""
    n = F.size(words)
    at = F.when(n >= WORDS, F.sequence(F.lit(1), n - (WORDS - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(F.array_join(F.slice(words, i, WORDS), " ")))


def minima(hashes: Column, n: int) -> Column:
    """array<bigint>: the least of each of n hashes of the hashes."""
    return F.array(*[F.array_min(_rehashed(hashes, i)) for i in range(n)])


def _rehashed(hashes: Column, i: int) -> Column:
    return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(i)))


def _starts(words: Column, wanted: Column, size: int, step: int) -> Column:
    """For each wanted word, the starts of the windows within `size` words of it."""
    places = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(wanted, w), i)), lambda i: i.isNotNull())
    first = lambda p: F.greatest(F.lit(0), F.ceil((p - (2 * size - 1)) / step)).cast("int")
    return F.transform(places, lambda p: F.transform(F.sequence(first(p), F.floor((p + size) / step).cast("int")), lambda k: k * step))


def _occurrences(places: Column, total: Column, span: Column) -> Column:
    """array<struct<start, shared>>: non-overlapping occurrences, from left to right, each with PERCENT of a template's shingles.

    places are struct<p, k, lone> in order: a shingle of the template at p, its number k from 1, and whether the template holds
    it once. Shingles gather within `span` places, each at its last place, until there are enough; a shingle that comes again
    then starts the next occurrence, together with those before it that stand where that one's start should be.
    """
    enough = lambda c: F.size(c) * 100 >= total * PERCENT

    def step(acc: Column, x: Column) -> Column:
        now = acc["now"]
        here = F.exists(now, lambda c: c["k"] == x["k"])
        ends = enough(now) & ((here & x["lone"]) | (x["p"] - F.get(now, F.lit(0))["p"] >= span))
        ours = lambda c: (c["p"] > x["p"] - x["k"]) & (c["k"] < x["k"])
        rest = F.filter(now, lambda c: ~ours(c))
        done = F.when(enough(rest), rest).otherwise(now)
        one = F.array(F.struct(F.get(done, F.lit(0))["p"].alias("start"), F.size(done).alias("shared")))
        begun = F.when(enough(rest), F.concat(F.filter(now, ours), F.array(x))).otherwise(F.array(x))
        kept = F.concat(F.filter(now, lambda c: (c["k"] != x["k"]) & (c["p"] > x["p"] - span)), F.array(x))
        return F.struct(F.when(ends, begun).when(enough(now) & here, now).otherwise(kept).alias("now"), F.when(ends, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.array().cast("array<struct<p: int, k: int, lone: boolean>>").alias("now"), F.array().cast("array<struct<start: int, shared: int>>").alias("out"))
    last = lambda now: F.when(enough(now), F.array(F.struct(F.get(now, F.lit(0))["p"].alias("start"), F.size(now).alias("shared")))).otherwise(F.array().cast("array<struct<start: int, shared: int>>"))
    return F.aggregate(places, start, step, lambda acc: F.concat(acc["out"], last(acc["now"])))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, body, license, shared, containment, start_word): every occurrence of each template found in docs(doc_id, text).

    body is a hash of the text, which tells rows of one doc_id apart; equal rows give one result. Occurrences of one template
    don't overlap; start_word is the place of one's first shared shingle, in words from 0. Null, empty and short texts match nothing; a
    template of under WORDS words can't match and is refused, and no templates find nothing. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    known = {name: words_of(text) for name, text in (TEMPLATES if templates is None else templates).items()}
    if any(len(w) < WORDS for w in known.values()):
        raise ValueError(f"templates need {WORDS} words")
    if not known:
        return docs.select("doc_id", F.lit(0).cast("long").alias("body"), F.lit("").alias("license"), F.lit(0).alias("shared"), F.lit(0.0).alias("containment"), F.lit(0).alias("start_word")).where("false")
    window = {name: window_words(len(w)) for name, w in known.items()}
    by_size = {size: sorted(name for name in known if window[name] == size) for size in sorted(set(window.values()))}
    # The templates' own signatures: as many rows as templates, computed by the same expressions.
    own = {}
    for size, names in by_size.items():
        n = bands(size, [len(known[x]) for x in names])
        rows = spark.createDataFrame([(x, known[x]) for x in names], "license string, words array<string>")
        own[size] = n, rows.withColumn("h", F.array_distinct(shingle_hashes(F.col("words")))).withColumn("m", minima(F.col("h"), n)).select("license", "h", "m").orderBy("license").collect()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = fresh(docs, "_low")
    words = sorted({g for w in known.values() for g in guards(w)})
    held = F.lit(False)
    for g in words:
        held = held | F.contains(F.col(low), F.lit(g))
    near = docs.select(F.col("doc_id"), F.xxhash64(text).alias("body"), F.lower(text).alias(low)).where(held)
    split = F.array_remove(F.split(F.col(low), "[^a-z0-9]+"), "")
    near = near.select("doc_id", "body", split.alias("words")).where(F.size("words") >= WORDS).dropDuplicates(["doc_id", "body"])
    # Written once: each length of windows starts from these rows, not from the documents.
    near = written(near.withColumn("s", shingle_hashes(F.col("words"))))
    out = None
    for size, names in by_size.items():
        step, span = size // 2, size - WORDS + 1
        n, here = own[size]
        wanted = F.array(*[F.lit(g) for g in sorted({g for x in names for g in guards(known[x])})])
        part = near.select("doc_id", "body", "s", F.explode(F.array_distinct(F.flatten(_starts(F.col("words"), wanted, size, step)))).alias("at"))
        part = part.where(F.col("at") < F.size("s")).select("doc_id", "body", F.greatest(F.col("at") - size, F.lit(0)).alias("low"), F.slice("s", F.col("at") + 1, span).alias("w"), "s")
        # The window retrieves; the text around it is what templates are verified on.
        part = part.select("doc_id", "body", "low", minima(F.col("w"), n).alias("m"), F.slice("s", F.col("low") + 1, span + 2 * size).alias("w"))
        found = []
        for r in here:
            t = F.array(*[F.lit(h) for h in r["h"]])
            hit = F.exists(F.zip_with("m", F.array(*[F.lit(x) for x in r["m"]]), lambda a, b: a == b), lambda e: e)
            runs = [tuple(known[r["license"]][i : i + WORDS]) for i in range(len(known[r["license"]]) - WORDS + 1)]
            lone = F.array(*[F.lit(runs.count(x) == 1) for x in dict.fromkeys(runs)])
            found.append(F.when(hit, F.struct(F.lit(r["license"]).alias("license"), F.size(F.array_intersect(F.col("w"), t)).alias("shared"), F.lit(len(r["h"])).alias("total"), t.alias("t"), lone.alias("lone"))))
        part = part.select("doc_id", "body", "low", "w", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).where(F.col("x.shared") * 100 >= F.col("x.total") * PERCENT)
        k = F.transform("w", lambda h, i: F.struct((F.col("low") + i).cast("int").alias("p"), F.array_position(F.col("x.t"), h).cast("int").alias("k")))
        places = F.transform(F.filter(k, lambda y: y["k"] > 0), lambda y: F.struct(y["p"], y["k"], F.element_at(F.col("x.lone"), y["k"]).alias("lone")))
        part = part.select("doc_id", "body", "x.license", "x.total", F.lit(span).alias("span"), places.alias("places"))
        out = part if out is None else out.unionByName(part)
    all_ = out.groupBy("doc_id", "body", "license", "total", "span").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"))
    each = all_.select("doc_id", "body", "license", "total", F.explode(_occurrences(F.col("places"), F.col("total"), F.col("span"))).alias("o"))
    return each.select("doc_id", "body", "license", "o.shared", (F.col("o.shared") / F.col("total")).alias("containment"), F.col("o.start").alias("start_word"))
