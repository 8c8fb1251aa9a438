"""Licence scan: a trained paragraph classifier, confirmed by comparison with templates.

Paragraphs are split into words; word n-grams (one and two words) are sparse features of a
multinomial logistic regression with an L1 penalty, whose classes are licence families and
``unknown``. It learns from the templates below and, as ``unknown``, from all distinct paragraphs
of the corpus that have no word of licences in them and sentences that speak of licences without
naming one. Only n-grams of the templates are features, so paragraphs with the same ones become
one row, weighted by their number. A family is predicted only over a probability that (nearly) no
unknown paragraph reached, and a prediction is confirmed if enough of the paragraph's n-grams
stand in one template.

Most paragraphs hold no word that could lift them over that threshold. Such anchor words are
derived from the weights: without one of them, the sum of everything else stays below the
threshold, so paragraphs without anchors are left out of scoring and results don't change.

Everything runs on DataFrame and SQL functions and JVM-side ML stages. Defined cases: null or
empty texts have no paragraphs; a null id is carried through; repeated rows give repeated
results; without documents the result is empty; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmatch.llm.shared import fresh, settled

UNKNOWN = "unknown"
#: Tasks that train at least, and training rows of a task.
TRAINING_TASKS, TRAINING_ROWS = 2, 20_000
#: Words in a larger share of the corpus paragraphs are common.
COMMON = 0.001
#: Words of licences; paragraphs that hold one teach nothing about ``unknown``.
NAMED = ("licen", "copyright", "spdx", "redistribut")
#: Share of the unknown paragraphs under the threshold, and bins of a probability to find it.
UNDER, BINS = 0.999, 100_000
# Phrases of public licence notices, by family.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "This project is licensed under the MIT License",
        "SPDX-License-Identifier: MIT",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Released under the Apache License 2.0",
        "Apache License Version 2.0, January 2004",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",
        "SPDX-License-Identifier: GPL-3.0-only",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "LGPL-3.0": [
        "Licensed under the GNU Lesser General Public License, version 3.",
        "SPDX-License-Identifier: LGPL-3.0-only",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Released under the BSD License.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the author has waived all copyright and related rights to this work.",
        "Released under CC0 1.0 Universal Public Domain Dedication.",
        "SPDX-License-Identifier: CC0-1.0",
    ],
}
# Sentences about licences that name no family.
UNNAMED = [
    "All rights reserved.",
    "See the LICENSE file for details.",
    "This software is provided under a commercial license.",
    "Licensed under the terms of your agreement.",
    "He lost his driving license in the city.",
    "The general public was free to use the work.",
    "The software was released under pressure.",
    "You may not copy this work without permission.",
]


@dataclass(frozen=True)
class Scanner:
    model: PipelineModel
    families: list[str]
    threshold: float
    anchors: list[str]


def cut(paragraph: Column) -> Column:
    """Words in lower case; the first and last can be empty."""
    return F.split(F.lower(paragraph), r"[^\p{L}\p{Nd}]+")


def terms(paragraph: Column) -> Column:
    """Distinct words and pairs of neighbouring words, in lower case."""
    words = F.filter(cut(paragraph), lambda w: w != "")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.concat(words, pairs))


def paragraphs(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def template_table(spark: SparkSession) -> DataFrame:
    rows = [(family, phrase) for family, phrases in TEMPLATES.items() for phrase in phrases]
    return spark.createDataFrame(rows, "family string, phrase string")


def unknown_groups(documents: DataFrame, vocabulary, text_col: str) -> DataFrame:
    """``(features, n)``: the distinct corpus paragraphs without a word of licences, by features."""
    corpus = documents.select(F.explode(paragraphs(F.col(text_col))).alias("phrase")).where("phrase != ''")
    lowered = F.lower("phrase")
    for part in NAMED:
        corpus = corpus.where(~F.contains(lowered, F.lit(part)))
    told = vocabulary.transform(corpus.select(F.xxhash64("phrase").alias("hash"), terms(F.col("phrase")).alias("terms")))
    # paragraphs are told apart by a hash, so texts are not shuffled
    return told.select("hash", "features").distinct().groupBy("features").agg(F.count(F.lit(1)).alias("n"))


def reached(scored: DataFrame, total: int) -> float:
    """The probability under which all but few of the weighted rows lie; 0 if it is below 0.5."""
    bins = scored.where("value >= 0.5").groupBy(F.floor(F.col("value") * BINS).alias("bin"))
    tail = sorted(tuple(r) for r in bins.agg(F.max("value"), F.sum("n")).select("max(value)", "sum(n)").collect())
    passed, needed = total - sum(n for _, n in tail), ceil(UNDER * total)
    for value, n in tail:
        if passed >= needed:
            break
        passed += n
        if passed >= needed:
            return value
    return 0.0


def fitted(documents: DataFrame, penalty=2e-4, text_col="text") -> Scanner:
    spark = documents.sparkSession
    unnamed = spark.createDataFrame([(UNKNOWN, x) for x in UNNAMED], "family string, phrase string")
    known = template_table(spark).unionByName(unnamed).select("family", terms(F.col("phrase")).alias("terms"))
    # The vocabulary is that of the templates; corpus paragraphs can only have fewer features.
    vocabulary = CountVectorizer(inputCol="terms", outputCol="features", binary=True, minDF=1.0).fit(known)
    groups = settled(unknown_groups(documents, vocabulary, text_col), "licence-groups")
    rows, total = groups.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    unknown = total + len(UNNAMED)
    families = sorted({UNKNOWN, *TEMPLATES})
    at = families.index(UNKNOWN)
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    worth = F.when(F.col("family") == UNKNOWN, 1.0).otherwise(max(1.0, unknown / 200))
    training = vocabulary.transform(known).select(label.cast("double").alias("label"), "features", worth.alias("worth"))
    training = training.unionByName(groups.select(F.lit(float(at)).alias("label"), "features", F.col("n").cast("double").alias("worth")))
    training = training.coalesce(max(TRAINING_TASKS, ceil(rows / TRAINING_ROWS)))
    regression = LogisticRegression(regParam=penalty, elasticNetParam=1.0, maxIter=60, family="multinomial", standardization=False, weightCol="worth")
    trained = regression.fit(training)
    model = PipelineModel([vocabulary, trained])
    others = groups.unionByName(vocabulary.transform(known.where(F.col("family") == UNKNOWN)).select("features", F.lit(1).cast("long").alias("n")))
    scored = likeliest(trained.transform(others), families, "p").select("p.value", "n")
    threshold = min(0.95, max(0.5, reached(scored, unknown)))
    shares = groups.select(Summarizer.mean(F.col("features"), F.col("n").cast("double"))).first()[0].toArray() if rows else []
    common = {w for w, share in zip(vocabulary.vocabulary, shares) if " " not in w and share > COMMON}
    common |= {w for text in UNNAMED for w in text.lower().rstrip(".").split()}
    return Scanner(model, families, threshold, anchor_words(trained, vocabulary.vocabulary, at, threshold, common))


def anchor_words(trained, vocabulary: list[str], unknown: int, threshold: float, common: set[str]) -> list[str]:
    """Words of which a paragraph needs one to be predicted as any family.

    The odds of a family against ``unknown`` are its intercept plus its terms' weights; what
    terms of words outside the anchors add at most must stay under the odds of the threshold.
    Words that are common in the corpus stay out as long as that holds.
    """
    weights, offsets = trained.coefficientMatrix.toArray(), trained.interceptVector.toArray()
    words = sorted({w for t in vocabulary for w in t.split()})
    anchors = [w for w in words if w not in common]
    rest = [w for w in words if w in common]
    while True:
        chosen = set(anchors)
        free = [k for k, t in enumerate(vocabulary) if not chosen & set(t.split())]
        worst = -1e9
        for family in range(len(offsets)):
            if family != unknown:
                gain = weights[family][free] - weights[unknown][free]
                worst = max(worst, offsets[family] - offsets[unknown] + gain[gain > 0].sum())
        if worst < log(threshold / (1 - threshold)) or not rest:
            return anchors
        gains = {w: sum(max(0.0, (weights[:, k] - weights[unknown, k]).max()) for k in free if w in vocabulary[k].split()) for w in rest}
        best = max(rest, key=lambda w: (gains[w], w))
        rest.remove(best)
        anchors.append(best)


def likeliest(scored: DataFrame, families: list[str], name: str) -> DataFrame:
    """Add ``struct<value, family>`` of the likeliest licence family.

    It is generated from a column of its own, so that filters on it don't score rows again.
    """
    share = fresh(scored, "_share")
    found = F.array(*[F.struct(F.col(share)[k].alias("value"), F.lit(x).alias("family")) for k, x in enumerate(families) if x != UNKNOWN])
    rows = scored.withColumn(share, vector_to_array("probability"))
    return rows.select("*", F.explode(F.array(F.array_max(found))).alias(name)).drop(share)


def scanned(documents: DataFrame, scanner: Scanner, similarity=0.6, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per licence paragraph: id, paragraph number, family, probability, similarity,
    confirmed."""
    spark = documents.sparkSession
    anchors = F.array(*map(F.lit, scanner.anchors)).cast("array<string>")
    rows = documents.select(F.col(id_col).alias("id"), F.posexplode(paragraphs(F.col(text_col))).alias("paragraph", "phrase"))
    rows = rows.where(F.arrays_overlap(cut(F.col("phrase")), anchors)).select("id", "paragraph", terms(F.col("phrase")).alias("terms"))
    rows = likeliest(scanner.model.transform(rows), scanner.families, "best")
    rows = rows.where(F.col("best.value") >= scanner.threshold)
    templates = template_table(spark).groupBy("family").agg(F.collect_list(terms(F.col("phrase"))).alias("own"))
    rows = rows.select("id", "paragraph", "terms", "best.family", F.col("best.value").alias("probability"))
    rows = rows.join(F.broadcast(templates), "family")
    alike = F.array_max(F.transform("own", lambda t: F.size(F.array_intersect(t, "terms")) / F.size("terms")))
    return rows.select(
        F.col("id").alias(id_col), "paragraph", "family", "probability", alike.alias("similarity"), (alike >= similarity).alias("confirmed")
    )


def licences(documents: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    return scanned(documents, fitted(documents, text_col=text_col), id_col=id_col, text_col=text_col)
