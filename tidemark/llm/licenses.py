"""Licence families of paragraphs: sparse n-gram regression, an unknown class, template comparison; scored with DataFrame functions alone."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UNKNOWN = "unknown"
#: Paragraphs of documents that serve as examples of the unknown class at most, and how many of one document.
NEGATIVES, NEGATIVES_EACH = 2000, 40
#: Lines that may name several licences, and where they are cut; the pieces are scored besides the whole line.
SEVERAL = r"(?i)licen[sc]e|spdx|\bgpl|copyright"
CUTS = r"(?i)(?<=[.;])\s+|\s+(?:or|and)\s+|\s*/\s*(?=[A-Za-z])"

#: Usual wordings of notices, by family.
TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE for details.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
        "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    ],
    "LGPL": [
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "SPDX-License-Identifier: LGPL-2.1-only",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.",
    ],
    "AGPL": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": [
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-2-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    ],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Public-Domain": ["This work is in the public domain.", "Dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
    "Proprietary": ["All rights reserved.", "Copyright by the authors. All rights reserved.", "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."],
}
FAMILIES = tuple(TEMPLATES)


def _words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.translate({i: i + 32 for i in range(65, 91)})) if w]


def _grams(words: list[str]) -> list[str]:
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def _examples(negatives: list[str]) -> tuple[list[list[str]], list[int]]:
    """Templates whole, in long runs and framed by other words; as unknown: other paragraphs, and runs that say too little to tell."""
    rng = np.random.default_rng(11)
    x, y = [], []
    for k, family in enumerate(FAMILIES):
        for text in TEMPLATES[family]:
            w = _words(text)
            for start in {0, len(w) // 4, len(w) // 2}:
                if len(w) - start >= max(3, (3 * len(w)) // 5) or start == 0:
                    x += [w[start:]] * 2
                    y += [k] * 2
            frame = _words(negatives[int(rng.integers(len(negatives)))])[:6] if negatives else []
            x += [frame + w, w + frame]
            y += [k, k]
            x.append(w[:1])
            y.append(len(FAMILIES))
    for text in negatives:
        x.append(_words(text))
        y.append(len(FAMILIES))
    return x, y


def train(negatives: list[str], steps: int = 150, ridge: float = 0.02) -> tuple[list[tuple[str, list[float], int]], list[float]]:
    """(gram, class weights, bits of the families whose templates hold it) per gram, and the biases, the last of the unknown class.

    Grams are those of the templates that fewer than two negative paragraphs hold. Full-batch gradient steps on presence features; a
    temperature fitted on every third example, which the weights don't learn from, calibrates the probabilities.
    """
    known = {g for texts in TEMPLATES.values() for t in texts for g in _grams(_words(t))}
    vocabulary = sorted(known - _common(negatives))
    place = {g: i for i, g in enumerate(vocabulary)}
    x, y = _examples(negatives)
    m = np.zeros((len(x), len(vocabulary) + 1))
    m[:, -1] = 1
    for row, w in enumerate(x):
        for g in _grams(w):
            if g in place:
                m[row, place[g]] = 1
    target = np.eye(len(FAMILIES) + 1)[y]
    held = np.arange(len(x)) % 3 == 2
    weights = np.zeros((m.shape[1], len(FAMILIES) + 1))
    a, t = m[~held], target[~held]
    share = 1 / np.maximum(t.sum(axis=0), 1)  # classes weigh alike
    each = (t @ share)[:, None] / (len(FAMILIES) + 1)
    for _ in range(steps):
        s = a @ weights
        e = np.exp(s - s.max(axis=1, keepdims=True))
        weights -= 8.0 * (a.T @ ((e / e.sum(axis=1, keepdims=True) - t) * each) + ridge / len(a) * weights)

    def loss(temperature: float) -> float:
        s = (m[held] @ weights) / temperature
        s -= s.max(axis=1, keepdims=True)
        return float(-((s - np.log(np.exp(s).sum(axis=1, keepdims=True))) * target[held]).sum())

    weights /= min((0.25 * 1.25**i for i in range(14)), key=loss)
    bits = {g: sum(1 << k for k, f in enumerate(FAMILIES) if any(g in _grams(_words(t)) for t in TEMPLATES[f])) for g in vocabulary}
    return [(g, weights[i].tolist(), bits[g]) for g, i in place.items()], weights[-1].tolist()


def _common(negatives: list[str]) -> set[str]:
    """Grams that at least two negative paragraphs hold."""
    seen: dict[str, int] = {}
    for text in negatives:
        for g in set(_grams(_words(text))):
            seen[g] = seen.get(g, 0) + 1
    return {g for g, n in seen.items() if n >= 2}


def _gram_hashes(paragraph: Column) -> Column:
    words = F.array_remove(F.split(ascii_lower(paragraph), SEPARATORS), "")

    def grams(w: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.concat_ws(" ", F.slice(w, i, F.lit(2)))))
        return F.concat(F.transform(w, lambda x: F.xxhash64(x)), F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<bigint>")))

    return let(words, grams)


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, confirmation: float = 0.5, negatives: int = NEGATIVES) -> DataFrame:
    """One row per row of ``docs``: id, n_paragraphs, n_scored (paragraphs and pieces with a gram of the vocabulary), families (confirmed), unconfirmed (families), best (largest probability of a family).

    Every paragraph, a line of the whole text, and every piece of a line about licences that holds several sentences or
    alternatives is scored by a softmax regression over the word 1- and 2-grams that it
    holds; an unknown class takes what no family explains. A family of probability ``threshold`` or more is confirmed if
    at least ``confirmation`` of the paragraph's grams, or all but one of a template's, are in the family's templates.
    The model is fitted on the templates and at most ``negatives`` paragraphs, up to ``NEGATIVES_EACH`` of each of a tenth
    as many documents, chosen by hashes; its vocabulary is bounded by the
    templates and broadcast.

    Null and empty texts have no paragraphs. Repeated rows give one result each. Documents without a licence have empty
    lists and best 0. An empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    few = docs.orderBy(F.xxhash64(f"`{id_col}`"), f"`{id_col}`").select(text.alias("text")).limit(max(1, negatives // 10))
    some = F.slice(F.sort_array(F.transform(F.split("text", "\n"), lambda x: F.struct(F.xxhash64(x).alias("h"), x.alias("x")))), 1, NEGATIVES_EACH)
    lines = few.select(F.explode(some).alias("s")).select(F.col("s.x").alias("line")).where(~F.lower("line").rlike("licen[sc]|copyright|rights reserved|public domain|spdx|gpl|cc by|cc0") & (F.length("line") > 0))
    model, bias = train([r.line for r in lines.limit(negatives).collect()])
    k_all = len(FAMILIES) + 1
    spark = docs.sparkSession
    schema = "gram string, " + ", ".join(f"w{k} double" for k in range(k_all)) + ", bits long"
    vocabulary = spark.createDataFrame([(g, *w, b) for g, w, b in model], schema).withColumn("h", F.xxhash64("gram")).drop("gram")

    src = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n")).alias("paragraphs"))
    cut_lines = F.filter("paragraphs", lambda x: x.rlike(SEVERAL) & x.rlike(CUTS))
    pieces = F.flatten(F.transform(cut_lines, lambda x: F.split(x, CUTS)))
    # position -1 stands for the document itself, so that one without matches keeps its row
    each = src.select("row", "id", F.size("paragraphs").alias("n_paragraphs"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "paragraphs", pieces)).alias("at", "paragraph"))
    grams = each.select("row", "id", "n_paragraphs", (F.col("at") - 1).alias("at"), F.array_distinct(_gram_hashes(F.coalesce("paragraph", F.lit("")))).alias("grams"))
    every = grams.select("row", "id", "n_paragraphs", "at", F.size("grams").alias("n_grams"), F.explode(F.concat(F.when(F.col("at") < 0, F.array(F.lit(None).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), "grams")).alias("h"))
    found = every.join(F.broadcast(vocabulary), "h", "left").where("at < 0 or bits is not null")
    sums = [F.sum(f"w{k}").alias(f"s{k}") for k in range(k_all)]
    shared = [F.sum(F.shiftright("bits", k).bitwiseAND(1)).alias(f"c{k}") for k in range(len(FAMILIES))]
    scored = found.groupBy("row", "id", "n_paragraphs", "at").agg(F.max("n_grams").alias("n_grams"), *sums, *shared)
    logits = F.array(*[F.col(f"s{k}") + b for k, b in enumerate(bias)])
    counts = F.array(*[F.col(f"c{k}") for k in range(len(FAMILIES))])
    named = F.array(*map(F.lit, (*FAMILIES, UNKNOWN)))

    def judged(s: Column) -> Column:
        best = F.array_position(s, F.array_max(s)).cast("int")
        total = F.aggregate(s, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(s)))
        return F.struct(F.get(named, best - 1).alias("family"), (1 / total).alias("p"), F.get(F.col("counts"), best - 1).alias("count"))

    judged_rows = scored.select("row", "id", "n_paragraphs", "at", "n_grams", logits.alias("logits"), counts.alias("counts")).select(
        "row", "id", "n_paragraphs", "at", "n_grams", F.when(F.col("at") >= 0, let(F.col("logits"), judged)).alias("j")
    )
    sizes = F.create_map(*[x for f in FAMILIES for x in (F.lit(f), F.lit(min(len(set(_grams(_words(t)))) for t in TEMPLATES[f])))])
    sure = (F.col("j.family") != UNKNOWN) & (F.col("j.p") >= threshold)
    confirmed = (F.col("j.count") >= confirmation * F.col("n_grams")) | (F.col("j.count") >= sizes[F.col("j.family")] - 1)
    none = F.array().cast("array<string>")
    out = judged_rows.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n_paragraphs").alias("n_paragraphs"),
        F.sum((F.col("at") >= 0).cast("int")).alias("n_scored"),
        F.sort_array(F.collect_set(F.when(sure & confirmed, F.col("j.family")))).alias("families"),
        F.sort_array(F.collect_set(F.when(sure & ~confirmed, F.col("j.family")))).alias("unconfirmed"),
        F.coalesce(F.max(F.when(sure, F.col("j.p"))), F.lit(0.0)).alias("best"),
    )
    return out.select(F.col("id").alias(id_col), F.col("n_paragraphs").cast("long").alias("n_paragraphs"), F.col("n_scored").cast("long").alias("n_scored"), F.coalesce("families", none).alias("families"), F.coalesce("unconfirmed", none).alias("unconfirmed"), "best")
