"""License notices in documents: MinHash bands over text windows fetch templates, exact containment decides.

DataFrame functions only. For a template of T words, windows of T + s - 1 words begin at every s-th word, s
being a quarter of T, so each stretch of T words lies whole in a window. A window that holds
80 % of the template's shingles has a Jaccard similarity of 0.6 with it at least; with 16 bands of one
row the chance to miss it is below 1e-6. A window can only agree with a template in a band if it holds
the very shingle that is the template's minimum there, so documents without any such
shingle have no windows to look at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .session import written

BANDS, WIDTH, PERCENT = 16, 5, 80
#: Up to so many templates are carried in the plan; more are joined to it.
TEMPLATES = 500
#: Public license notices, short forms and whole texts.
NOTICES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-whole": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def _shingles(words: str, width: int) -> Column:
    """Hashes of ``width`` words in a row, in order; none for shorter texts."""
    w = F.col(words)
    hashed = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + j) for j in range(1, width)]))
    return F.slice(hashed, F.lit(1), F.greatest(F.size(w) - (width - 1), F.lit(0)))


def _seeded(shingles: Column, band: int) -> Column:
    return F.transform(shingles, lambda h: F.xxhash64(h, F.lit(band)))


def _minima(shingles: Column, bands: int) -> Column:
    return F.array(*[F.array_min(_seeded(shingles, b)) for b in range(bands)])


def _joined(docs: DataFrame, known: DataFrame, width: int, percent: int, bands: int) -> DataFrame:
    """The same for more templates than a plan should carry: they meet the documents by their deciding shingles.

    A window agrees with a template in a band only if it holds the shingle that is the template's minimum there; so those
    shingles are joined, and each window around a hit is tried in the band of the hit.
    """
    known = known.where(F.when(F.size("shingles") == 0, F.raise_error(F.concat(F.lit("template of too few words: "), "license")).cast("boolean")).otherwise(True))
    band = F.explode(F.sequence(F.lit(0), F.lit(bands - 1)))
    deciding = known.withColumn("band", band).withColumn("minimum", F.get("minima", F.col("band")))
    deciding = deciding.select("license", "n_words", "band", "minimum", F.explode("shingles").alias("h")).where(F.xxhash64("h", "band") == F.col("minimum"))
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(words_of(F.col("text").cast("string")))).alias("words"))
    held = written(text.select("doc_id", _shingles("words", width).alias("all")).where(F.size("all") > 0).withColumn("row", F.monotonically_increasing_id()), "license-shingles")
    hits = held.select("row", F.posexplode("all").alias("p", "h")).join(deciding, "h")
    step = F.greatest(F.lit(1), F.floor(F.col("n_words") / 4)).cast("int")
    hits = hits.withColumn("step", step).withColumn("span", F.col("n_words") + F.col("step") - width)
    first = F.greatest(F.lit(0), F.ceil((F.col("p") - F.col("span") + 1) / F.col("step")).cast("int"))
    near = hits.withColumn("start", F.explode(F.sequence(first, F.floor(F.col("p") / F.col("step")).cast("int")))).withColumn("start", F.col("start") * F.col("step"))
    tried = near.select("row", "license", "band", "minimum", "start", "span").distinct().join(held, "row").withColumn("window", F.slice("all", F.col("start") + 1, F.col("span")))
    least = F.array_min(F.transform("window", lambda h: F.xxhash64(h, F.col("band"))))
    fetched = tried.where(least == F.col("minimum")).select("doc_id", "row", "license", "start", "window").dropDuplicates(["row", "license", "start"])
    met = fetched.join(known.select("license", "shingles"), "license").select("doc_id", "license", "start", F.size("shingles").alias("n_shingles"), F.size(F.array_intersect("window", "shingles")).alias("n"))
    return met.where(F.col("n") * 100 >= F.col("n_shingles") * percent).groupBy("doc_id", "license", "n_shingles").agg(F.max("n").alias("n_matched"), F.min("start").alias("first_word"))


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, width: int = WIDTH, percent: int = PERCENT, bands: int = BANDS) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, license, n_shingles, n_matched, first_word), one row for each match.

    Words are runs of a-z and 0-9 after lower-casing. A template matches where a window holds ``percent`` of
    its n_shingles distinct ``width``-word shingles; n_matched is the most that one window holds and
    first_word the start of the first window that matches, in words from 0. Null, empty and short texts
    match nothing; rows of one doc_id (null too) are taken together; copies all match. Whole texts
    of any length are scanned. An empty table gives no rows. Further columns are not read.
    """
    templates = NOTICES if templates is None else templates
    spark = docs.sparkSession
    known = spark.createDataFrame(sorted(templates.items()), "license string, text string").withColumn("words", words_of(F.col("text")))
    known = known.withColumn("ordered", _shingles("words", width)).withColumn("shingles", F.array_distinct("ordered"))
    known = known.select("license", F.size("words").alias("n_words"), "shingles", _minima(F.col("shingles"), bands).alias("minima"), F.transform("shingles", lambda h: F.array(*[F.xxhash64(h, F.lit(b)) for b in range(bands)])).alias("hashed"))
    if len(templates) > TEMPLATES:
        return _joined(docs, known, width, percent, bands)
    rows = known.collect()
    if short := [r.license for r in rows if not r.shingles]:
        raise ValueError(f"templates of fewer than {width} words: {short}")
    if not rows:
        return docs.limit(0).select(F.col("doc_id").cast("long"), F.lit("").alias("license"), *[F.lit(0).alias(c) for c in ("n_shingles", "n_matched", "first_word")])
    deciding = sorted({r.shingles[i] for r in rows for i, h in enumerate(r.hashed) if any(h[b] == r.minima[b] for b in range(bands))})

    # exploding an array of one keeps the optimiser from copying the words into each use of them
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(F.array(words_of(F.col("text").cast("string")))).alias("words"))
    held = text.select("doc_id", _shingles("words", width).alias("all")).where(F.arrays_overlap("all", F.array(*[F.lit(x) for x in deciding])))
    held = written(held, "license-shingles")  # few documents; computed once, and not anew inside expressions
    found = []
    for size in sorted({r.n_words for r in rows}):
        step = max(1, size // 4)
        span = size + step - 1 - (width - 1)
        own = [r for r in rows if r.n_words == size]
        near = F.array(*[F.lit(x) for x in sorted({x for r in own for x in r.shingles})])
        starts = F.filter(F.sequence(F.lit(0), F.size("all") - 1, F.lit(step)), lambda i: F.arrays_overlap(F.slice("all", i + 1, F.lit(span)), near))
        windows = held.select("doc_id", F.explode(starts).alias("start"), "all").select("doc_id", "start", F.slice("all", F.col("start") + 1, F.lit(span)).alias("window"))
        signed = windows.withColumn("signature", _minima(F.col("window"), bands))
        entry = lambda r: F.struct(F.lit(r.license).alias("license"), F.array(*[F.lit(x) for x in r.minima]).alias("minima"), F.array(*[F.lit(x) for x in r.shingles]).alias("shingles"))
        fetched = F.filter(F.array(*[entry(r) for r in own]), lambda t: F.exists(F.zip_with(t["minima"], F.col("signature"), lambda x, y: x == y), lambda same: same))
        met = signed.select("doc_id", "start", "window", F.explode(fetched).alias("t"))
        found.append(met.select("doc_id", "start", F.col("t.license").alias("license"), F.size("t.shingles").alias("n_shingles"), F.size(F.array_intersect("window", F.col("t.shingles"))).alias("n")))
    every = found[0]
    for x in found[1:]:
        every = every.unionByName(x)
    kept = every.where(F.col("n") * 100 >= F.col("n_shingles") * percent)
    return kept.groupBy("doc_id", "license", "n_shingles").agg(F.max("n").alias("n_matched"), F.min("start").alias("first_word"))
