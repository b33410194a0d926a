"""License scans by MinHash over text windows, with DataFrame operations only.

Texts become lower-case words without punctuation and shingles of ``SHINGLE`` words.
Shingles are dealt into blocks of ``BLOCK``; a window is two neighbouring blocks, so any
notice of at most ``BLOCK + 1`` shingles lies whole in a window, and windows overlap by
half. A window's signature has ``HASHES`` minima, found per block and merged, and every
minimum is a band of its own: a window of 16 shingles that holds a notice of 3 shares
each minimum with it with probability 3/16, so that the notice is retrieved with
probability 1 - (13/16)**40 = 0.9997; longer notices are cut into windows in the same way
and share far more. A notice of one or two shingles, which bands would miss too often, is
retrieved by its shingles themselves, always. Bands only retrieve: a template is reported where at least
``CONTAINED`` of its shingles, counted exactly, occur in the retrieved windows.

A minimum over h XOR c for a constant c is the shingle whose hash is nearest to c, each
shingle being equally likely over random constants, which is what a band needs.

Defined cases: null, empty and short texts have no shingles and no licenses; a null
doc_id is a value like any other; rows that repeat a doc_id are scanned together; ties
between templates are all reported; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_or_empty

SHINGLE, BLOCK, HASHES, CONTAINED = 3, 8, 40, 0.8
#: Templates of fewer shingles are retrieved by these.
SHORT = 3
#: Up to so many values of the templates are also put into the plan, which sorts windows out before any join; beyond that the joins do it all.
LITERALS = 20_000
#: XOR constants of the minima.
SEEDS = [random.Random(20240 + k).getrandbits(64) - (1 << 63) for k in range(HASHES)]

#: Notices of public licenses.
TEMPLATES = {
    "AFL-3.0": "Licensed under the Academic Free License version 3.0",
    "AGPL-3.0": "licensed under the GNU Affero General Public License, version 3",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "Artistic-2.0": "Licensed under the Artistic License 2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-notice": "Released under the BSD License",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-short": "Licensed under CC BY 4.0",
    "CC-BY-NC-short": "Licensed under CC BY-NC 4.0",
    "CC-BY-NC-ND-short": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-NC-SA-short": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-ND-short": "Licensed under CC BY-ND 4.0",
    "CC-BY-SA-short": "Licensed under CC BY-SA 4.0",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "EPL-2.0": "made available under the terms of the Eclipse Public License 2.0",
    "GPL": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "GPL-notice": "under the terms of the GNU General Public License as published by the Free Software Foundation",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "LGPL": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MIT": "Released under the MIT License",
    "MIT-terms": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved. No part of this publication may be reproduced",
    "reserved-short": "All rights reserved",
    "BSD-2-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Unlicense": "This is free and unencumbered software released into the public domain",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty",
}


def _with_shingles(df: DataFrame, *keys: str) -> DataFrame:
    """keys and ``shingles``: hashes of the shingles of ``text``, in order."""
    words = F.filter(F.split(F.regexp_replace(F.lower(text_or_empty()), r"[^\p{L}\p{M}\p{N}]+", " "), " "), lambda w: w != "")
    # a column of its own, which the optimizer keeps as it is used more than once: not computed anew for each shingle
    hashed = df.select(*keys, F.transform(words, lambda w: F.xxhash64(w)).alias("_hashed"))
    starts = F.sequence(F.lit(0), F.size("_hashed") - SHINGLE)
    each = F.transform(starts, lambda i: F.xxhash64(*(F.get("_hashed", i + k) for k in range(SHINGLE))))
    return hashed.select(*keys, F.when(F.size("_hashed") >= SHINGLE, each).otherwise(F.array().cast("array<long>")).alias("shingles"))


def _windows(df: DataFrame, *keys: str) -> DataFrame:
    """keys, win, bands, own (the window's shingles) for every window of a column ``shingles``."""
    count = F.ceil(F.size("shingles") / BLOCK).cast("int")
    # null, hence no windows, where there are no shingles: a filter would be pushed down and compute them anew
    blocks = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)), lambda i: F.slice("shingles", i * BLOCK + 1, BLOCK))
    seeds = F.array(*map(F.lit, SEEDS))
    minima = F.transform(blocks, lambda b: F.transform(seeds, lambda s: F.array_min(F.transform(b, lambda h: h.bitwiseXOR(s)))))
    rows = df.select(*keys, "shingles", minima.alias("minima"))

    def window(i: Column) -> Column:
        left, right = F.get("minima", i), F.coalesce(F.get("minima", i + 1), F.get("minima", i))
        bands = F.zip_with(left, right, lambda a, b: F.least(a, b))
        return F.struct(i.alias("win"), bands.alias("bands"), F.slice("shingles", i * BLOCK + 1, 2 * BLOCK).alias("own"))

    starts = F.when(F.col("minima").isNotNull(), F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("minima") - 2)))
    each = F.transform(starts, window)
    return rows.select(*keys, F.explode(each).alias("w")).select(*keys, "w.*")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, license, containment, first_window of every license found in every document."""
    spark = docs.sparkSession
    named = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "license string, text string")
    known = _with_shingles(named, "license").withColumn("shingles", F.array_distinct("shingles")).withColumn("size", F.size("shingles"))
    band = lambda df, *keys: df.select(*keys, F.posexplode("bands").alias("k", "band"))
    short = known.where(F.col("size") < SHORT).select("license", F.lit(-1).alias("k"), F.explode("shingles").alias("band"))
    lookup = materialize(band(_windows(known, "license"), "license").unionByName(short).distinct(), "bands")
    alone, wanted = ([r[0] for r in rows.select("band").distinct().limit(LITERALS + 1).collect()] for rows in (lookup.where("k = -1"), lookup))
    windows = _windows(_with_shingles(docs, "doc_id"), "doc_id")
    short_ones = F.col("own")
    if len(wanted) <= LITERALS:
        # a band is its place and value; values alone, of all places, sort out nearly all windows at once
        windows = windows.where(F.exists("bands", lambda b: b.isin(wanted)) | F.exists("own", lambda h: h.isin(alone)))
        short_ones = F.filter("own", lambda h: h.isin(alone))
    keyed = F.concat(F.transform("bands", lambda b, k: F.struct(k.alias("k"), b.alias("band"))), F.transform(short_ones, lambda h: F.struct(F.lit(-1).alias("k"), h.alias("band"))))
    # Spark broadcasts the templates where their written size allows it
    near = windows.select("doc_id", "win", "own", F.explode(keyed).alias("b")).select("doc_id", "win", "own", "b.k", "b.band").join(lookup, ["k", "band"]).select("doc_id", "win", "own", "license")
    near = materialize(near.dropDuplicates(["doc_id", "win", "license"]), "near")
    common = near.join(materialize(known, "templates"), "license").select("doc_id", "win", "license", "size", F.explode(F.array_intersect("own", "shingles")).alias("shingle"))
    counted = common.groupBy("doc_id", "license", "size", "shingle").agg(F.min("win").alias("win"))
    total = counted.groupBy("doc_id", "license", "size").agg(F.count(F.lit(1)).alias("n"), F.min("win").alias("first_window"))
    return total.where(F.col("n") >= contained * F.col("size")).select("doc_id", "license", (F.col("n") / F.col("size")).alias("containment"), "first_window")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document with licenses."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.groupBy("doc_id").agg(
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.count_distinct("license").alias("n_licenses"), F.max("containment").alias("containment")
    )


def words_of(text: str) -> list[str]:
    """The words that the scan sees, for tests and reports."""
    return re.sub(r"[\W_]+", " ", text.lower()).split()
