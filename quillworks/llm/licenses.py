"""License notices: MinHash bands over overlapping word windows retrieve templates, exact shingle containment decides. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

#: Notices in common use, by name.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0": "Licensed under CC BY-ND 4.0.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved.",
}
#: The wording that ends permissive licences.
_NO_WARRANTY = (
    "THE SOFTWARE IS PROVIDED “AS IS”, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_NO_DAMAGES = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS “AS IS” AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_TWO_CLAUSES = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
#: Licences whose whole text is short, from their first word after the copyright line.
WHOLE = {
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the “Software”), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _NO_WARRANTY,
    "bsd-2-clause-text": _TWO_CLAUSES + _NO_DAMAGES,
    "bsd-3-clause-text": _TWO_CLAUSES
    + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
    + _NO_DAMAGES,
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
    "THE SOFTWARE IS PROVIDED “AS IS” AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
    "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "zlib-text": "This software is provided ‘as-is’, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
    "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
    "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
#: Hash functions of a signature; each is a band. A window that holds 0.8 of a template has a Jaccard similarity of 0.5
#: or more with it, so a band in sixteen agrees with a probability of 1 - 0.5 ** 16 at least.
BANDS = 16
SHINGLE = 5


def words_of(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, width: int) -> Column:
    """Hashes of each ``width`` words on end."""
    last = F.size(words) - width
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(words[i + k] for k in range(width))))
    return F.when(last >= 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _signed(shingles: Column) -> Column:
    """The MinHash signature: for each band, the least rehash."""
    band = lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(b))))
    return F.array(*map(band, range(BANDS)))


def template_bands(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(width, shingle, license, shingles, length, signature): a row for each shingle that is the least of some band.

    A template of fewer than five words is one shingle of all its words. As many rows as templates times BANDS at most.
    """
    rows = spark.createDataFrame(list(templates.items()), "license string, text string").withColumn("words", words_of(F.col("text")))
    rows = rows.withColumn("width", F.least(F.size("words"), F.lit(SHINGLE))).where("width > 0")
    by_width = F.when(F.col("width") == SHINGLE, shingles_of(F.col("words"), SHINGLE))
    for w in range(1, SHINGLE):
        by_width = by_width.when(F.col("width") == w, shingles_of(F.col("words"), w))
    rows = rows.withColumn("shingles", F.array_distinct(by_width)).withColumn("length", F.size("words"))
    rows = rows.withColumn("signature", _signed(F.col("shingles")))
    least = F.filter(F.col("shingles"), lambda x: F.exists(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda b: F.xxhash64(x, b) == F.col("signature")[b]))
    return rows.select("width", F.explode(least).alias("shingle"), "license", "shingles", "length", "signature")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, word): the notices that a document holds, and the first word of the best window.

    For a template of m words, windows start every m / 4 words (at least 1) and are that much longer than it, so one of
    them holds any occurrence whole. A window is a candidate if a band of its signature equals the template's. Of all
    windows, only those around a shingle that is some band's least in a template can be; a broadcast join finds these
    shingles, and signatures are computed there alone. A notice is held if ``share`` of the template's shingles of
    five words are in the window, and no better held notice overlaps it. Templates, by default TEMPLATES and WHOLE, are a parameter of the caller, and small: their bands are broadcast.

    Null or empty text, or fewer words than a shingle: no rows. Null ids: reported with a null id. Rows that share an
    id are one document. An empty table gives no rows. Other columns are ignored.
    """
    spark, templates = docs.sparkSession, {**TEMPLATES, **WHOLE} if templates is None else templates
    scratch = Scratch(spark, "licenses")
    bands = scratch.write(template_bands(spark, templates), "bands")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = []
    for (width,) in bands.select("width").distinct().orderBy("width").collect():  # five at most
        some = bands.where(F.col("width") == width)
        rows = docs
        if width < SHINGLE:  # only texts with all of a short template's words can hold it
            short = [[w.lower() for w in _plain(t)] for t in templates.values()]
            cover = [x for x in short if len(x) == width]
            rows = rows.where(" or ".join("(" + " and ".join(f"contains(lower(text), '{w}')" for w in x) + ")" for x in cover))
        # explode keeps the steps apart: in one expression the words would be split anew for every shingle.
        rows = rows.select("id", F.explode(F.array(words_of(F.col("text")))).alias("words")).select("id", F.explode(F.array(shingles_of(F.col("words"), width))).alias("all")).select("id", "all", F.posexplode("all").alias("at", "shingle"))
        hits = rows.join(F.broadcast(some), "shingle")
        step = F.greatest(F.lit(1), F.floor(F.col("length") / 4)).cast("int")
        wide = F.col("length") - width + 1 + F.col("step")  # shingles of a window
        hits = hits.withColumn("step", step).withColumn("wide", wide)
        first = F.greatest(F.lit(0), F.ceil((F.col("at") - F.col("wide") + 1) / F.col("step"))).cast("int")
        starts = F.transform(F.sequence(first, F.floor(F.col("at") / F.col("step")).cast("int")), lambda k: k * F.col("step"))
        windows = hits.withColumn("start", F.explode(starts)).withColumn("window", F.slice("all", F.col("start") + 1, F.col("wide")))
        windows = windows.withColumn("own", _signed(F.col("window")))
        windows = windows.where(F.exists(F.zip_with("own", "signature", lambda a, b: a == b), lambda same: same))
        held = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
        found.append(windows.select("id", "license", held.alias("containment"), "start", "length").where(F.col("containment") >= share))
    if not found:
        return spark.createDataFrame([], f"{id_col} {docs.schema['id'].dataType.simpleString()}, license string, containment double, word long")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    best = every.groupBy("id", "license").agg(F.max(F.struct("containment", "length", (-F.col("start")).alias("place"))).alias("b"))
    # At most a row a template for each document.
    mine = best.groupBy("id").agg(F.collect_list(F.struct("license", "b.containment", "b.length", (-F.col("b.place")).alias("start"))).alias("all"))
    ends = lambda x: x["start"] + x["length"]
    better = lambda x, y: (y["start"] < ends(x)) & (x["start"] < ends(y)) & (y["containment"] > x["containment"])
    kept = F.filter("all", lambda x: ~F.exists("all", lambda y: better(x, y)))
    return mine.select(F.col("id").alias(id_col), F.explode(kept).alias("x")).select(id_col, "x.license", "x.containment", F.col("x.start").cast("long").alias("word"))


def _plain(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text).split()
