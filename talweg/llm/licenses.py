"""License scans in DataFrame functions alone: MinHash bands over overlapping word windows, then exact containment.

Words are runs of letters and digits in lower case; shingles are five of them. A template of L words is looked for in
windows of W words, every g words: W = L and g = 1 for up to 12 words, else W = ceil(1.25 L) and g = L // 8; the last
windows of a text end with it. A template is found in a window that holds at least 0.8 of its distinct shingles.

Retrieval: windows and templates have 16 MinHash values, each a band of one row. Where 0.8 of a template is in a
window their similarity is over 0.5, so that a band collides with a probability over 1 - 2e-5 (a template of one
shingle is in a window of that one shingle). Each collision is verified by the shingles themselves. Templates are
broadcast in blocks of at most `BLOCK_WORDS` words (one template at least), 8 bytes a word and 16 bands a template; each
block is one pass over the documents, so there is no limit to the number of templates or to their length.

Only windows that can hold a match are made. For each template some of its words (`anchors`) are chosen such that
fewer than 0.8 of its shingles hold none of them; a window without any such word can't match, so texts without
one are passed over, and other texts are cut around those words only.

Null texts and those of fewer than five words have no shingle and no match; so have templates of fewer than five words.
Results are per doc_id (null is one): rows that repeat an id are joined. Very long texts are whole; no templates, or an
empty table, give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from talweg.llm.common import id_and_text, table

SHINGLE, SHARE, BANDS, BLOCK_WORDS = 5, 0.8, 16, 1_000_000

#: Notices by which licences are recognised, from the public texts of those licences.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def words_of(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(r"[^\W_]+", text.lower())


def window_of(length: int) -> tuple[int, int]:
    """Words in a window and between windows, for a template of `length` words."""
    return (length, 1) if length <= 12 else (math.ceil(1.25 * length), length // 8)


def needed(n: int) -> int:
    """How many of n shingles are 0.8 of them."""
    return -(-4 * n // 5)


def anchors(templates: dict[str, str]) -> list[str]:
    """Words of which each match of each template holds one: those that cover most shingles of most templates first."""
    left: dict[str, set[tuple]] = {}
    holds: dict[str, Counter] = {}
    most = {}
    for name, text in templates.items():
        w = words_of(text)
        left[name] = {tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}
        most[name], holds[name] = needed(len(left[name])), Counter(x for s in left[name] for x in set(s))
    found: list[str] = []
    while open_ := [k for k in left if left[k] and len(left[k]) >= most[k]]:
        gain, templates_of = Counter(), Counter()
        for k in open_:
            gain.update(holds[k])
            templates_of.update(holds[k].keys())
        best = max(gain, key=lambda w: (len(w) > 6, templates_of[w], gain[w], w))
        found.append(best)
        for k in left:
            for s in [s for s in left[k] if best in s] if holds[k][best] else ():
                left[k].remove(s)
                for x in set(s):
                    holds[k][x] -= 1
            holds[k] = +holds[k]
    return found


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    many = F.size(words) - SHINGLE + 1
    each = lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])
    return F.when(many > 0, F.transform(F.sequence(F.lit(0), many - 1), each)).otherwise(F.array().cast("array<long>"))


def _bands(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))))


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are worked out once. As plain projections they would be put into each expression that uses them, and there into the functions that run for each element."""
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, width, step, shingles, bands; one row per template of at least five words."""
    rows = [(k, len(w), *window_of(len(w)), t) for k, t in templates.items() if len(w := words_of(t)) >= SHINGLE]
    df = spark.createDataFrame(rows, "license string, length int, width int, step int, text string")
    held = _held(_held(_held(df, words=_words(F.col("text"))), every=_shingles(F.col("words"))), shingles=F.array_distinct("every"))
    return _held(held, bands=_bands(F.col("shingles"))).select("license", "width", "step", "shingles", "bands")


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, n_windows, containment (the best), first_word and last_word (of the windows that hold it)."""
    found = [_scan(docs, block) for block in blocks(TEMPLATES if templates is None else templates)]
    return reduce(DataFrame.unionAll, found)


def blocks(templates: dict[str, str], most: int | None = None) -> list[dict[str, str]]:
    """The templates in order, in blocks of at most `most` words, one template at least."""
    out, held, most = [{}], 0, most or BLOCK_WORDS
    for name, text in templates.items():
        n = len(words_of(text))
        if out[-1] and held + n > most:
            out.append({})
            held = 0
        out[-1][name] = text
        held += n
    return out


def _scan(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    known = template_table(docs.sparkSession, templates)
    marks = anchors(templates)
    low = F.lower("text")
    gate = F.lit(False)
    for m in marks:
        gate = gate | low.contains(m)
    texts = _held(id_and_text(docs).where(gate), words=_words(F.col("text"))).select("doc_id", "words").where("size(words) >= 5")
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(marks))
    cut = _held(_held(texts, at=at).where("size(at) > 0"), all=_shingles(F.col("words"))).select("doc_id", "all", "at")
    sizes = sorted({window_of(len(w)) for t in templates.values() if len(w := words_of(t)) >= SHINGLE})
    each = F.array(*[F.struct(F.lit(w).alias("width"), F.lit(g).alias("step")) for w, g in sizes]).cast("array<struct<width:int,step:int>>")
    size = F.explode(each).alias("size")
    sized = cut.select("doc_id", "all", "at", size).select("doc_id", "all", "at", "size.width", "size.step")
    # the windows around an anchor at word p start at the multiples of step from p - width + 1 to p
    lowest = lambda p: F.greatest(F.lit(0), F.ceil((p - F.col("width") + 1) / F.col("step"))).cast("int")
    starts = F.array_distinct(F.flatten(F.transform("at", lambda p: F.transform(F.sequence(lowest(p), F.greatest(lowest(p), F.floor(p / F.col("step")).cast("int"))), lambda k: k * F.col("step")))))
    windows = sized.select("doc_id", "all", "width", F.explode(starts).alias("start"))
    own = F.array_distinct(F.slice("all", F.col("start") + 1, F.col("width") - SHINGLE + 1))
    hashed = _held(windows, own=own).select("doc_id", "width", "start", "own").where("size(own) > 0")
    hashed = hashed.select("doc_id", "width", "start", "own", F.posexplode(_bands(F.col("own"))).alias("band", "value"))
    banded = known.select("license", F.col("width").alias("w"), F.posexplode("bands").alias("b", "v"))
    met = hashed.join(F.broadcast(banded), (F.col("width") == F.col("w")) & (F.col("band") == F.col("b")) & (F.col("value") == F.col("v")))
    met = met.join(F.broadcast(known.select("license", "shingles")), "license")
    share = F.size(F.array_intersect("own", "shingles")) / F.size("shingles")
    found = _held(met, share=share).select("doc_id", "license", "start", "width", "share").where(F.col("share") >= SHARE)
    once = found.groupBy("doc_id", "license", "start", "width").agg(F.max("share").alias("share"))
    return once.groupBy("doc_id", "license").agg(
        F.count(F.lit(1)).alias("n_windows"), F.max("share").alias("containment"), F.min("start").cast("long").alias("first_word"), F.max(F.col("start") + F.col("width") - 1).cast("long").alias("last_word")
    )


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licences of all documents."""
    return scan_licenses(table(spark, sf_dir, "documents"))
