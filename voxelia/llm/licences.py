"""Licence scans with a trained paragraph classifier, with DataFrame functions and JVM estimators only.

Paragraphs are lines. A multinomial logistic regression over sparse word n-grams (one and two words),
fitted here to the templates below, worn copies of them and a bounded sample of other paragraphs, gives
each paragraph a licence family or "unknown"; the acceptance threshold is calibrated on paragraphs held
out of the fit. A prediction counts only if one of the family's templates confirms it by shared word pairs.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Standard notices of licence families, in lower case or not, one paragraph each.
TEMPLATES = {
    "Apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "SPDX-License-Identifier: Apache-2.0", "This software is distributed under the Apache 2.0 license."],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.', "SPDX-License-Identifier: MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.", "You should have received a copy of the GNU General Public License along with this program.", "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL, version 2."],
    "LGPL": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License.", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it under the terms of the GNU Affero General Public License.", "SPDX-License-Identifier: AGPL-3.0-only"],
    "BSD": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "SPDX-License-Identifier: MPL-2.0"],
    "CC": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "This text is available under the Creative Commons Attribution-ShareAlike License.", "Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-NC-ND 4.0.", "SPDX-License-Identifier: CC-BY-4.0"],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.", "SPDX-License-Identifier: ISC"],
    "EPL": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "SPDX-License-Identifier: EPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has dedicated all copyright to this work to the public domain under CC0."],
}
#: Paragraphs that speak of licences without granting a known one.
NEAR_MISSES = ["All rights reserved.", "She got her driving license at the age of eighteen.", "The license fee is due at the end of the month.", "The software may not be copied without permission.", "Please read the terms and conditions.", "This program was shown on public television.", "He works at the university and holds a general license to trade.", "Copyright is a matter of law in most countries.", "Free of charge for members.", "A copy of this notice was sent to any person concerned."]
UNKNOWN = "unknown"
WORDS = r"[^\p{L}\p{N}.+-]+|\.(?=\s|$)"


@dataclass
class Classifier:
    """weights: (ngram, w array<double>), one weight a class; intercepts and classes in that order."""

    weights: DataFrame
    intercepts: list[float]
    classes: list[str]
    threshold: float


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), WORDS), lambda x: x != "")


def pairs(w: Column) -> Column:
    """Two words in a row; none for fewer than two words."""
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))


def ngrams(w: Column) -> Column:
    return F.concat(w, pairs(w))


def worn(paragraph: str, r: random.Random, filler: list[str]) -> str:
    """A copy with words lost or put in, in some letter case, perhaps inside other words."""
    out = [w for w in paragraph.split() if r.random() > 0.08]
    for _ in range(r.randint(0, 2)):
        out.insert(r.randint(0, len(out)), r.choice(filler))
    if r.random() < 0.3:
        out = r.choices(filler, k=r.randint(1, 6)) + out
    if r.random() < 0.3:
        out = out + r.choices(filler, k=r.randint(1, 6))
    text = " ".join(out)
    return r.choice([text, text, text.upper(), text.lower()])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", copies: int = 12, sample: int = 200, others: int = 1500, seed: int = 17) -> Classifier:
    """Fit the classifier: ``copies`` worn copies of every template and, as the unknown class, at most
    ``others`` paragraphs without licence words from the ``sample`` documents whose ids have the least
    hashes. These bounds hold for any input. A quarter of the rows is held out to calibrate the threshold."""
    spark: SparkSession = docs.sparkSession
    r = random.Random(seed)
    ids = docs.select(id_col).where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(sample)
    some = docs.select(id_col, text_col).join(F.broadcast(ids.distinct()), id_col, "left_semi")
    plain = some.select(F.explode(F.split(text_col, "\n")).alias("p")).where((F.length(F.trim("p")) > 0) & (F.length("p") < 5000) & ~F.col("p").rlike("(?i)licen[cs]|copyright|redistribut|public domain|copyleft"))
    plain = plain.distinct().orderBy(F.xxhash64("p")).limit(others)
    filler = "the a and of new old see also note here file code data text part".split()
    rows = [(f, t, k % 4 == 0) for f, own in TEMPLATES.items() for p in own for k, t in enumerate([p, *[worn(p, r, filler) for _ in range(copies)]])]
    rows += [(UNKNOWN, t, k % 4 == 0) for p in NEAR_MISSES for k, t in enumerate([p, *[worn(p, r, filler) for _ in range(copies)]])]
    given = spark.createDataFrame(rows, "family string, p string, held boolean")
    given = given.union(plain.select(F.lit(UNKNOWN), "p", F.pmod(F.xxhash64("p", F.lit(1)), F.lit(4)) == 0))
    classes = [*TEMPLATES, UNKNOWN]
    number = F.element_at(F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (c, float(k))]), F.col("family"))
    data = given.select(number.alias("label"), "family", "held", ngrams(words(F.col("p"))).alias("grams")).repartition(2).cache()
    fit = data.where(~F.col("held"))
    # n-grams that ordinary paragraphs use often say nothing and would only cost time
    usual = fit.where(F.col("family") == UNKNOWN).select(F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").count().where(F.col("count") > 20).select("g")
    telling = fit.where(F.col("family") != UNKNOWN).select(F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").count().where(F.col("count") > 2).join(usual, "g", "left_anti").select("g")
    vocabulary = sorted(x.g for x in telling.collect())  # bounded by the templates
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    model = LogisticRegression(family="multinomial", regParam=0.002, elasticNetParam=0.5, maxIter=60).fit(counter.transform(fit))
    matrix = model.coefficientMatrix.toArray()
    intercepts = [float(x) for x in model.interceptVector]
    weights = [(g, [float(x) for x in matrix[:, k]]) for k, g in enumerate(vocabulary) if abs(matrix[:, k]).max() > 1e-6]
    classifier = Classifier(spark.createDataFrame(weights, "ngram string, w array<double>"), intercepts, classes, 0.5)
    held = data.where("held").withColumn("row", F.monotonically_increasing_id())
    judged = held.select("row", "family").join(classify(held.select("row", "grams"), classifier, ["row"]), "row")
    # least threshold that at most one in two hundred held-out unknown paragraphs passes
    high = judged.where(F.col("family") == UNKNOWN).agg(F.percentile("probability", F.lit(0.995))).first()[0]
    classifier.threshold = float(min(0.95, max(0.5, high or 0.5)))
    data.unpersist()
    return classifier


def classify(grams: DataFrame, c: Classifier, keys: list[str]) -> DataFrame:
    """(keys, predicted, probability) of the likeliest family; rows whose n-grams the model doesn't know
    are left out, as they are unknown by the intercepts alone. The weights are bounded by the templates,
    so they are broadcast."""
    each = grams.select(*keys, F.explode(F.array_distinct("grams")).alias("ngram")).join(F.broadcast(c.weights), "ngram")
    n = len(c.classes)
    logits = each.groupBy(*keys).agg(*[F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(n)])
    powers = [F.exp(F.col(f"s{k}") + c.intercepts[k]) for k in range(n)]
    parts = logits.select(*keys, F.array(*[F.struct(p.alias("p"), F.lit(x).alias("family")) for p, x in zip(powers, c.classes, strict=True)]).alias("all"))
    total = F.aggregate("all", F.lit(0.0), lambda a, x: a + x["p"])
    best = F.array_max(F.filter("all", lambda x: x["family"] != UNKNOWN))
    return parts.select(*keys, best["family"].alias("predicted"), (best["p"] / total).alias("probability"))


def scan(docs: DataFrame, c: Classifier, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, paragraph, family, probability, similarity): licence paragraphs, numbered from 0 by line.

    similarity is the share of word pairs in common with the family's closest template, of the shorter of
    the two; from ``confirm`` on, with three pairs or all of the template's, it confirms the prediction.
    Null and empty texts have no paragraphs; repeated rows give repeated results, also without an id;
    ties between families go to the later name. Other columns are dropped.
    """
    lines = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\n")).alias("paragraph", "line"))
    keys = ["row", "id", "paragraph", "line"]
    grams = lines.select(*keys, ngrams(words(F.col("line"))).alias("grams"))
    own = classify(grams, c, keys).where(F.col("probability") >= c.threshold)
    rows = [(f, p) for f, own_ in TEMPLATES.items() for p in own_]
    templates = docs.sparkSession.createDataFrame(rows, "family string, template string").select("family", F.array_distinct(pairs(words(F.col("template")))).alias("theirs"))
    own = own.withColumn("pairs", F.array_distinct(pairs(words(F.col("line")))))
    both = own.join(F.broadcast(templates), F.col("predicted") == F.col("family"))
    shared = F.size(F.array_intersect("pairs", "theirs"))
    close = F.when(shared >= F.least(F.lit(3), F.size("theirs")), shared / F.greatest(F.least(F.size("pairs"), F.size("theirs")), F.lit(1))).otherwise(0.0)
    best = both.groupBy("row", "id", "paragraph", "family", "probability").agg(F.max(close).alias("similarity"))
    return best.where(F.col("similarity") >= confirm).select(F.col("id").alias(id_col), "paragraph", "family", "probability", "similarity")
