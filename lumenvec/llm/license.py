"""Licence scans: a trained paragraph classifier, in DataFrame functions and Spark's own learning library only.

The paragraphs that are judged are windows: in each line, every word that is a licence cue with WINDOW words on either side, as far as the line goes.
Their words (of letters and digits, lower-cased), and the pairs and triples of neighbours, are hashed into a sparse vector; multinomial logistic regression gives the probability of each licence
family and of `unknown`. A window shows a licence if the best family is not `unknown`, its probability reaches the
calibrated threshold, and the comparison with that family's templates confirms it: of the word pairs of one template, as many as fit
on one side of a cue, the share `confirm` must occur in the window, two pairs at least. Overlapping windows that show one family are one notice.

The model is fitted on windows of texts made from the templates below (with bounds: VARIANTS a family) and of made texts
that speak of licences without being one; one in five is held out, and the threshold is the lowest at which the held-out
precision is min_precision. So fitting costs the same for every corpus. Scanning is row by row; only the result is grouped, by row of the input.

Defined cases: a null or empty text has no licence; a very long text, line or word is scanned whole, in time in proportion to its length; texts in capitals or with symbols between words are
compared by their letters and digits; of families with equal probability the first in order is taken; repeated rows, and rows with equal or null ids, are scanned alike and give a row each; an empty table gives no rows; columns other
than the id and the text are not read, so their names may be any.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Notices by which licences are named or granted, by family.
TEMPLATES = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
        "This project is released under the Apache 2.0 license.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This code is licensed under the MIT license.",
        "SPDX-License-Identifier: MIT",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "Licensed under the GNU GPL v3 or later.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Content is available under CC BY-NC-SA 4.0 for non commercial use only license.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License CC BY-SA 4.0.",
    ),
    "public-domain": (
        "This work is released into the public domain under the CC0 1.0 Universal license.",
        "This is free and unencumbered software released into the public domain; see the Unlicense license.",
    ),
}
# Sentences that hold a cue and name no licence.
ORDINARY = (
    "The driver showed a license to the officer before the trip.", "A fishing license is required for the lake.", "Copyright law was discussed in the second chapter.", "She got permission from her parents to go.",
    "The warranty covers two years of normal use.", "All rights reserved.", "The licensed premises close at midnight.", "Poetic license allows a version of events.", "The public was granted access to the general records.",
    "The tower helicopter is an apache.", "He studied at MIT and then moved away.", "The gnu is an animal of the general savanna.", "You may obtain a license plate at the office under these terms.", "The work was published under the terms of the contract.",
    "This license expired in 2019 and the copy was returned.", "An attribution error is common in public debates about copyright.", "The domain name was released to the public with a license key.", "Please enter the license key of your copy of the software.",
)
#: A line with a cue; a word that is one; and the first words of two that are.
CUE = r"(?i)licen[sc]|copyright|\bspdx|redistribut|permission|warrant|public[^\p{L}\p{N}]+domain|general[^\p{L}\p{N}]+public|creative[^\p{L}\p{N}]+commons"
CUE_WORD = r"licen[sc]|copyright|^spdx|redistribut|permission|warrant"
CUE_PAIRS = ("public domain", "general public", "creative commons")
UNKNOWN, DIMENSIONS, VARIANTS, WINDOW = "unknown", 1 << 14, 100, 12


def tokens(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def grams(words: Column, n: int) -> Column:
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(words, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def featured(rows: DataFrame) -> DataFrame:
    """Adds features from words."""
    terms = rows.withColumn("_terms", F.concat(F.col("words"), grams(F.col("words"), 2), grams(F.col("words"), 3)))
    return HashingTF(numFeatures=DIMENSIONS, inputCol="_terms", outputCol="features", binary=True).transform(terms).drop("_terms")


def _made(seed: int) -> list[tuple[str, int, int]]:
    """Texts, their class (0: unknown), and whether held out, one in five."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("th", "an", "er", "on", "in", "re", "es", "ti", "le", "de", "que", "und", "ch")) for _ in range(rng.randint(1, 4)))
    noise = lambda n: " ".join(word() for _ in range(rng.randrange(n + 1)))
    out = []
    for k, texts in enumerate([ORDINARY, *TEMPLATES.values()]):
        for n in range(VARIANTS * (4 if k == 0 else 1)):
            words = texts[n % len(texts)].split()
            if len(words) > 12 and rng.random() < 0.5:  # a part of a long notice
                at = rng.randrange(len(words) - 11)
                words = words[at : at + rng.randint(12, 30)]
            if k == 0 and rng.random() < 0.5:
                words += rng.choice(ORDINARY).split()
            if k == 0 and rng.random() < 0.2:
                words = [rng.choice(("license", "licensed", "copyright", "permission"))] + noise(20).split()
            elif rng.random() < 0.3 and len(words) > 6:
                words.pop(rng.randrange(len(words)))
            out.append((f"{noise(WINDOW)} {' '.join(words)} {noise(WINDOW)}", k, int(rng.random() < 0.2)))
    return out


@lru_cache(maxsize=4)
def trained(spark: SparkSession, seed: int = 3, min_precision: float = 0.99) -> tuple[LogisticRegressionModel, float]:
    """The model, and the least probability at which a family is believed."""
    made = json.dumps([{"t": t, "label": k, "held": h} for t, k, h in _made(seed)])  # one literal: a plan of few nodes
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(made), "array<struct<t: string, label: double, held: int>>")))
    windows = rows.select("label", "held", F.inline(candidates(F.col("t"))))
    data = featured(windows).select("label", "held", "features").repartition(1).persist()
    model = LogisticRegression(family="multinomial", regParam=0.0001, maxIter=60).fit(data.where("held = 0"))
    scored = model.transform(data.where("held = 1")).select("label", "prediction", F.array_max(vector_to_array("probability")).alias("p")).where("prediction > 0").collect()
    data.unpersist()
    ranked = sorted(((r["p"], r["label"] == r["prediction"]) for r in scored), reverse=True)
    threshold, right = 0.5, 0
    for n, (p, good) in enumerate(ranked, 1):
        right += good
        if right >= min_precision * n:
            threshold = p
    return model, max(0.3, min(threshold, 0.95))


def candidates(text: Column) -> Column:
    """The windows of a text (line, at, words): around every cue, at its place among the words of the line."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x, n: F.struct(n.alias("line"), x.alias("text"))), lambda x: x["text"].rlike(CUE))

    def windows(line: Column, words: Column) -> Column:
        pair = lambda i: F.get(words, i).isin([p.split()[0] for p in CUE_PAIRS]) & F.concat_ws(" ", F.slice(words, i + 1, F.lit(2))).isin(list(CUE_PAIRS))
        cued = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).rlike(CUE_WORD) | pair(i))
        around = lambda i: F.slice(words, F.greatest(i - WINDOW, F.lit(0)) + 1, F.least(i, F.lit(WINDOW)) + WINDOW + 1)
        return F.transform(cued, lambda i: F.struct(line.alias("line"), i.alias("at"), around(i).alias("words")))

    # an array of one binds the words, so that they are split once
    found = F.flatten(F.transform(lines, lambda x: F.flatten(F.transform(F.array(tokens(x["text"])), lambda words: windows(x["line"], words)))))
    return F.when(text.rlike(CUE), found).otherwise(F.array().cast("array<struct<line:int,at:int,words:array<string>>>"))


def _template_pairs() -> Column:
    """family: the word pairs of each of its templates."""
    known = {k: [[" ".join(p) for p in zip(w, w[1:], strict=False)] for w in map(_plain_tokens, texts)] for k, texts in TEMPLATES.items()}
    return F.from_json(F.lit(json.dumps(known)), "map<string, array<array<string>>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", confirm: float = 0.5) -> DataFrame:
    """For each row: id, n_candidates, n_licenses, families (sorted, comma-joined; empty if none), score (of the surest notice, else 0)."""
    model, threshold = trained(docs.sparkSession)
    families = [UNKNOWN, *TEMPLATES]
    numbered = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))  # before the candidates, which would be numbered otherwise
    rows = numbered.select("id", "row", F.explode_outer(candidates(F.col("text"))).alias("c")).select("id", "row", "c.*")
    probed = model.transform(featured(rows.withColumn("shown", F.col("words").isNotNull()).withColumn("words", F.coalesce("words", F.array().cast("array<string>")))))
    p = vector_to_array("probability")
    family = F.element_at(F.split(F.lit(",".join(families)), ","), F.col("prediction").cast("int") + 1)
    own = grams(F.col("words"), 2)
    covers = lambda t: F.size(F.array_intersect(t, own)) >= F.greatest(F.lit(2.0), F.lit(confirm) * F.least(F.size(F.array_distinct(t)), F.lit(WINDOW)))
    score = F.element_at(p, F.col("prediction").cast("int") + 1)
    sure = F.col("shown") & (F.col("prediction") > 0) & (score >= threshold) & F.exists(_template_pairs()[family], covers)
    told = probed.select("id", "row", "shown", F.when(sure, family).alias("f"), F.when(sure, F.struct(family.alias("f"), "line", "at")).alias("w"), F.when(sure, score).alias("s"))
    first = lambda w: F.filter(w, lambda x, i: (i == 0) | (x["f"] != F.get(w, i - 1)["f"]) | (x["line"] != F.get(w, i - 1)["line"]) | (x["at"] - F.get(w, i - 1)["at"] > 2 * WINDOW))
    notices = F.element_at(F.transform(F.array(F.sort_array(F.collect_list("w"))), lambda w: F.size(first(w))), 1)
    return told.groupBy("row", "id").agg(
        F.count(F.when(F.col("shown"), 1)).alias("n_candidates"), notices.cast("long").alias("n_licenses"), F.concat_ws(",", F.sort_array(F.collect_set("f"))).alias("families"), F.coalesce(F.max("s"), F.lit(0.0)).alias("score")
    ).drop("row").withColumnRenamed("id", id_col)


def _plain_tokens(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()
