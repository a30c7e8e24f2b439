"""License scans by MinHash bands over overlapping windows, in built-in functions alone.

A text is a sequence of words; a shingle is five words in a row. A template is known by the signatures of its first,
middle and last half (a short one by that of the whole), so words that were put between halves cost nothing. For each
size of these pieces, windows of that many shingles start at every quarter of it. A window without a shingle of any
template has similarity 0 to all of them, so only windows that hold one are hashed. Windows that agree with a piece in
a band of its MinHash signature retrieve the template; exact containment of all its shingles in the text around the
window decides.

A window lies within an eighth of its size of where a piece starts. A text that keeps four fifths of a template's
shingles keeps four fifths of one of its halves, and if words were replaced only, that half's similarity to a window
is (0.8 - 0.125) / (2 - 0.8 + 0.125) = 0.509 or more: with BANDS bands of ROWS rows it is missed with a probability
under 7e-5 (miss_probability). Words put into one half leave the other to find it by; if that has lost two fifths, its
similarity is 0.31 or more and the probability under 0.05.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a shingle, MinHash bands and rows, and the share of a template's shingles that a match holds.
WORDS, BANDS, ROWS, CONTAINED = 5, 32, 2, 0.8
#: Shingles from which a template is known by its halves.
HALVED = 8
#: Words that may stand inside a passage, besides as many as the template has.
GAP = 64

#: Notices and opening passages of public licenses.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

#: What separates words: everything but letters, digits and points within numbers or versions.
_GAP = r"(?:[^\p{L}\p{N}.]|\.(?![0-9]))+"


def miss_probability(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """That no band of a window with this similarity to a template agrees."""
    return (1 - similarity**rows) ** bands


def _shingle(i: str) -> str:
    return f"xxhash64({', '.join(f'w[{i} + {k}]' for k in range(WORDS))})"


def _signature(hashes: str) -> str:
    """Bands of an array of shingle hashes: each the hash of its rows' minima."""
    minimum = f"array_min(transform({hashes}, g -> xxhash64(g, b * {ROWS} + m)))"
    rows = f"transform(sequence(0, {ROWS - 1}), m -> {minimum})"
    return f"transform(sequence(0, {BANDS - 1}), b -> xxhash64(b, {rows}))"


def templates(spark, texts: dict[str, list[str]]) -> DataFrame:
    """template, license, shingles (distinct ones of the whole), size and signature of a piece; a row for each piece of
    each template of five words or more."""
    rows = [(k, name, t) for k, (name, t) in enumerate((n, t) for n, ts in texts.items() for t in ts)]
    words = spark.createDataFrame(rows, "template int, license string, text string").select("template", "license", F.expr(_WORDS_SQL).alias("w"))
    whole = words.where(f"size(w) >= {WORDS}").withColumn("all", F.expr(f"transform(sequence(0, size(w) - {WORDS}), i -> {_shingle('i')})"))
    half = "int(ceil(size(all) / 2))"
    cut = f"if(size(all) < {HALVED}, array(all), transform(array(0, (size(all) - {half}) div 2, size(all) - {half}), a -> slice(all, a + 1, {half})))"
    pieces = whole.select("template", "license", F.array_distinct("all").alias("shingles"), F.explode(F.expr(cut)).alias("piece"))
    return pieces.select("template", "license", "shingles", F.size("piece").alias("size"), F.expr(_signature("piece")).alias("signature"))


_WORDS_SQL = "filter(split(lower(coalesce(text, '')), '" + _GAP.replace("\\", "\\\\") + "'), x -> x != '')"


def scan(docs: DataFrame, texts: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, license, n_passages, containment (of the best passage) and first_word, for each license found
    in a document's whole text. A passage that fits several templates counts for the one it holds most of.

    Null and short texts hold none; rows that share a doc_id, or have none, are one document whose different texts are
    each scanned, equal texts once; documents without a license give no row; other columns are ignored. The templates
    are a bounded list, collected and broadcast; their shingles become one set in the plan."""
    spark = docs.sparkSession
    known = [r.asDict() for r in templates(spark, texts or TEMPLATES).collect()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, license string, n_passages long, containment double, first_word int"
    if not known:
        return spark.createDataFrame([], shape)
    sizes = sorted({r["size"] for r in known})
    vocabulary = sorted({s for r in known for s in r["shingles"]})
    # Each step binds its input to a lambda variable, so that no rewrite of the plan can repeat it inside a loop.
    anchors = f"if(size(w) < {WORDS}, array(), filter(sequence(0, size(w) - {WORDS}), i -> {_shingle('i')} in ({', '.join(f'{v}L' for v in vocabulary)})))"

    def starts(n: int) -> str:
        """The windows of n shingles that hold an anchor; a step is a quarter of the size. Around: two sizes and GAP
        words before it, three and GAP behind it, where the rest of a template of two pieces is and what parts them."""
        step = max(1, n // 4)
        first = f"array_distinct(flatten(transform(at, a -> sequence(greatest(0, (a - {n} + {step}) div {step}), a div {step}))))"
        window = f"named_struct('size', {n}, 'start', j * {step}, 'v', slice(w, j * {step} + 1, {n + WORDS - 1}), 'around', slice(w, greatest(1, j * {step} + 1 - {2 * n + GAP}), {6 * n + 2 * GAP + WORDS - 1}))"
        return f"transform({first}, j -> {window})"

    found_in = f"transform(array(w), w -> transform(array({anchors}), at -> concat({', '.join(starts(n) for n in sizes)}))[0])[0]"
    own_text = [F.col("doc_id"), F.xxhash64("text").alias("text_key")]
    windows = docs.select(*own_text, F.explode_outer(F.expr(f"transform(array({_WORDS_SQL}), w -> {found_in})[0]")).alias("win")).where("win is not null and size(win.v) >= " + str(WORDS))
    own = f"transform(sequence(0, size(v) - {WORDS}), i -> {_shingle('i').replace('w[', 'v[')})"
    signed = f"transform(array(win.v), v -> transform(array({own}), h -> {_signature('h')})[0])[0]"
    probes = windows.select("doc_id", "text_key", F.col("win.size").alias("size"), F.col("win.start").alias("start"), F.col("win.around").alias("w"), F.posexplode_outer(F.expr(signed)).alias("band", "mark"))
    bands = spark.createDataFrame([(r["template"], r["license"], r["size"], r["shingles"], b, s) for r in known for b, s in enumerate(r["signature"])], "template int, license string, t_size int, shingles array<long>, band int, mark long")
    hits = probes.join(F.broadcast(bands), (probes["band"] == bands["band"]) & (probes["mark"] == bands["mark"]) & (probes["size"] == bands["t_size"]))
    found = hits.groupBy("doc_id", "text_key", "license", "template", "size", "start").agg(F.first("w").alias("w"), F.first("shingles").alias("shingles"))
    around = f"transform(sequence(0, size(w) - {WORDS}), i -> {_shingle('i')})"
    exact = found.withColumn("containment", F.expr(f"size(array_intersect(shingles, {around})) / size(shingles)")).where(f"containment >= {CONTAINED}")
    place = exact.withColumn("offset", F.expr(f"greatest(0, start - 2 * size - {GAP}) + aggregate(sequence(0, size(w) - {WORDS}), -1, (p, i) -> if(p < 0 and array_contains(shingles, {_shingle('i')}), i, p))"))
    # where several templates start at one word, the passage is the one it holds most of
    passages = place.groupBy("doc_id", "text_key", "offset").agg(F.max_by("license", F.struct("containment", F.size("shingles"), "template")).alias("license"), F.max("containment").alias("containment"))
    return passages.groupBy("doc_id", "license").agg(
        F.count(F.lit(1)).cast("long").alias("n_passages"), F.max("containment").alias("containment"), F.min("offset").cast("int").alias("first_word")
    )
