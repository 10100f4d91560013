"""Operator 1. License scans: MinHash bands over text windows retrieve templates, exact shingle containment verifies. DataFrame functions only."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import Scratch, inner, others

#: Words of a shingle (a shorter template is one shingle), and the least share of a template's shingles in a window.
SHINGLE, CONTAINMENT = 5, 0.8
#: Greatest probability that a window that holds a template shares none of its bands (of one MinHash row each).
MISS = 1e-6

# Public license notices: name -> text that is looked for. A parameter of scan_licenses().
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-text": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-text": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Proprietary": "All rights reserved.",
}
_SPLIT = r"[^\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(text), _SPLIT), "")


def _plain(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def anchors(templates: dict[str, str]) -> list[str]:
    """Words such that every text that holds CONTAINMENT of a template's shingles holds one of them.

    Long words are taken, first those that another template already needs, until the
    shingles without any are fewer than CONTAINMENT of the template's.
    """
    chosen: list[str] = []
    for text in templates.values():
        words = _plain(text)
        k = min(SHINGLE, len(words))
        shingles = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
        ranked = sorted(set(words), key=lambda w: (w not in chosen, -len(w), w))
        for word in ranked:
            bare = sum(1 for s in shingles if not any(c in s for c in chosen))
            if bare < CONTAINMENT * len(shingles):
                break
            if word not in chosen:
                chosen.append(word)
    return chosen


def shingles_of(words: Column, k: int) -> Column:
    """Hashes of the distinct k-word shingles."""
    slots = F.sequence(F.lit(1), F.size(words) - (k - 1))
    return F.when(F.size(words) >= k, F.array_distinct(F.transform(slots, lambda i: F.xxhash64(F.slice(words, i, k))))).otherwise(F.array().cast("array<bigint>"))


def bands_for(window: int, k: int, templates: list[str]) -> int:
    """Bands by which windows of so many words miss a held template with a probability of at most MISS.

    A window that holds CONTAINMENT of a template's n shingles, and has at most window - k + 1, has with it a Jaccard
    similarity of at least need / (n + window - k + 1 - need); it is missed by one band with 1 less that.
    """
    least = 1.0
    for text in templates:
        words = _plain(text)
        n = len({tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
        need = math.ceil(CONTAINMENT * n - 1e-9)
        least = min(least, need / (n + max(0, window - k + 1 - need)))
    return 1 if least >= 1 else math.ceil(math.log(MISS) / math.log(1 - least))


def bands_of(shingles: Column, bands: int) -> Column:
    """For each band its least rehashed shingle, hashed with the band's number."""
    least = lambda b: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(b))))
    return F.array(*[F.xxhash64(F.lit(b), least(b)) for b in range(bands)])


def scan_licenses(df: DataFrame, text: str, keep: list[str], templates: dict[str, str] | None = None, scratch: Scratch | None = None) -> DataFrame:
    """(keep, license, containment, word): for every row and template that it holds, the best window.

    A template is held by a window of the text's words (letters and digits, lower case)
    that has at least CONTAINMENT of its distinct shingles. Windows are made per class of
    template length (a power of two): one and a half times that long, overlapping by two
    thirds, so each occurrence lies in one whole. Texts, and then windows, without an
    anchor word cannot hold a template and are left out first. A null or empty text
    holds none; repeated rows give repeated results; an empty table gives an empty one.
    Templates without a word are an error. word is where the best window begins, from 0;
    of equally good windows the first. Columns in keep named like a new one, in any case, are replaced.
    """
    templates = TEMPLATES if templates is None else templates
    if any(not _plain(t) for t in templates.values()):
        raise ValueError("a template needs a word")
    spark = df.sparkSession
    row = "row_id"
    words = anchors(templates)
    low = F.lower(F.col("__text"))
    some = F.lit(False)
    for w in words:
        some = some | low.contains(w)
    # Written once: every class of templates reads these words, and most texts have no anchor.
    scratch = scratch or Scratch(spark, "licenses")
    docs, names, back = inner(df, others(keep, "license", "containment", "word"), F.col(text).alias("__text"))
    docs = docs.withColumn(row, F.monotonically_increasing_id()).where(some).withColumn("__words", words_of(F.col("__text"))).drop("__text")
    docs = scratch.write(docs)
    classes: dict[tuple[int, int], dict[str, str]] = {}
    for name, t in templates.items():
        n = len(_plain(t))
        classes.setdefault((1 << max(2, (n - 1).bit_length()), min(SHINGLE, n)), {})[name] = t
    marks = F.array(*map(F.lit, words))
    parts = []
    for (size, k), own in sorted(classes.items()):
        half = size // 2
        bands = bands_for(3 * half, k, list(own.values()))
        # Starts are multiples of half; those are kept whose window of three halves holds an anchor.
        at = F.filter(F.transform("__words", lambda w, i: F.when(F.array_contains(marks, w), F.floor(i / F.lit(half)).cast("int"))), lambda i: i.isNotNull())
        starts = F.array_distinct(F.flatten(F.transform(at, lambda i: F.array(i, F.greatest(i - 1, F.lit(0)), F.greatest(i - 2, F.lit(0))))))
        windows = docs.withColumn("word", F.explode(starts)).withColumn("word", F.col("word") * half)
        windows = windows.withColumn("__window", F.slice("__words", F.col("word") + 1, 3 * half)).drop("__words")
        windows = windows.withColumn("__shingles", shingles_of(F.col("__window"), k)).where(F.size("__shingles") > 0).drop("__window")
        known = spark.createDataFrame([(name, t) for name, t in own.items()], "license string, template string")
        known = known.select("license", shingles_of(words_of(F.col("template")), k).alias("__wanted"))
        table = known.select("license", "__wanted", F.explode(bands_of(F.col("__wanted"), bands)).alias("__band"))
        # So many rows for each template of the class: as large as the templates given, whatever the input.
        hits = windows.withColumn("__band", F.explode(F.array_distinct(bands_of(F.col("__shingles"), bands)))).join(F.broadcast(table), "__band")
        share = F.size(F.array_intersect("__shingles", "__wanted")) / F.size("__wanted")
        parts.append(hits.withColumn("containment", share).where(F.col("containment") >= CONTAINMENT).select(row, *names, "license", "containment", F.col("word").cast("long").alias("word")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    best = F.max(F.struct(F.col("containment"), -F.col("word"))).alias("__best")
    rest = [F.first(F.col(f"`{c}`")).alias(c) for c in names]
    return found.groupBy(row, "license").agg(best, *rest).select(*back, "license", F.col("__best")["containment"].alias("containment"), (-F.col("__best")["col2"]).alias("word"))


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs, "text", ["doc_id"])


QUERIES = {"op1_licenses": op1_licenses}
ORACLE_SQL: dict[str, str] = {}
