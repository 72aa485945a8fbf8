"""Licence notices: a trained paragraph classifier, confirmed by templates; DataFrame functions and Spark ML only.

Lines are cut into passages of up to 64 words that overlap by half. Paragraphs of several lines, without the comment
marks their lines begin with, are cut into passages of up to 48 words besides, 16 words apart, so a wrapped notice of up to
32 words is whole in one of them. Passages with one of the gate stems are classified; all others are no notices by definition. Features are the words and
word pairs of a passage, the classifier is a sparse multinomial logistic regression over licence families and an
unknown class. It is trained on the templates below, varied by a hash: words dropped, and words of
corpus lines put around them; the unknown class is trained on general talk about licences and on
corpus lines, varied the same way. A held-out part of the variants calibrates the smallest
probability a family needs: at most one in a hundred held-out unknown passages reaches it. A prediction is
confirmed if the passage contains at least ``similarity`` of the word pairs of a template of its family.

The corpus lines for training are a hash-chosen sample of ``SAMPLE`` lines; every text is scanned whole.

Nulls: a null text has no passages; a null ``doc_id`` is kept as it is. Repeated rows are scanned each.
An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import SPACE, words
from panelloom.session import checkpointed

#: The usual wording of notices, by SPDX name.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GPL version 3.",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
    ),
    "LGPL-3.0": ("This library is licensed under the GNU Lesser General Public License, version 3.",),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3.",),
    "BSD-3-Clause": (
        "Released under the 3-Clause BSD License.",
        "Licensed under the BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License 2.0."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC0-1.0": ("Released under CC0 1.0.", "Dedicated to the public domain under the CC0 1.0 Universal license."),
}
UNKNOWN = "unknown"
#: Sentences with the same words that grant nothing known.
GENERAL = (
    "All rights reserved. Copyright by the authors.",
    "The driver must hold a valid license for this class of vehicle.",
    "Permission to enter the building was denied without warranty of access.",
    "The license fee is due at the end of each year.",
    "Please read the license agreement before you install the software.",
    "Licensed under our own terms, see the company handbook.",
    "Released under the terms agreed with the publisher.",
    "This work is licensed to the buyer for personal use only.",
    "The company may redistribute the shares among its owners.",
    "A general public hearing on the license was held.",
)
GATE = ("licen", "copyright", "permission", "redistribut", "warrant", "public domain", "released under", "spdx")
SIZE, SAMPLE, VARIANTS = 64, 2_000, 120
WRAPPED, STEP = 48, 16
MARKS = "^[\\s/*#;%<!>-]+"
SIMILARITY = 0.8


def plain_words(text: Column) -> Column:
    """Lower-case words without punctuation at their ends."""
    return F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}.+-]+"), lambda w: F.trim(w, F.lit(".+-")) != "")


def trimmed(text: Column) -> Column:
    return F.transform(plain_words(text), lambda w: F.trim(w, F.lit(".-")))


def grams(w: Column) -> Column:
    """Words and word pairs."""
    pairs = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))
    return F.concat(w, F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def gated(text: Column) -> Column:
    low = F.lower(text)
    hit = low.contains(GATE[0])
    for stem in GATE[1:]:
        hit = hit | low.contains(stem)
    return hit


def passages(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``line``, ``last_line``, ``part``, ``passage`` for every passage with a gate stem. Those of a paragraph have its first and last line."""
    # a stem of two words may be wrapped too
    hits = docs.filter(gated(F.regexp_replace(F.col(text), "\\n[\\s/*#;%<!>-]*", " "))).select(F.col(key).alias("doc_id"), F.split(text, "\n", -1).alias("lines"))
    return of_lines(hits).unionByName(of_paragraphs(hits))


def of_paragraphs(hits: DataFrame) -> DataFrame:
    bare = hits.select("doc_id", F.transform("lines", lambda x: F.trim(F.regexp_replace(x, MARKS, ""), F.lit(SPACE))).alias("lines"))
    blank = lambda i: F.coalesce(F.get(F.col("lines"), i), F.lit("")) == ""  # noqa: E731  before the first and after the last too
    all_ = F.sequence(F.lit(0), F.size("lines") - 1)
    ends = F.filter(all_, lambda i: ~blank(i) & blank(i + 1))
    starts = F.filter(all_, lambda i: ~blank(i) & blank(i - 1))
    spans = bare.select("doc_id", "lines", F.explode(F.arrays_zip(starts.alias("a"), ends.alias("b"))).alias("span")).filter("span.b > span.a")
    body = F.array_join(F.slice("lines", F.col("span.a") + 1, F.col("span.b") - F.col("span.a") + 1), " ")
    cut = spans.select("doc_id", F.col("span.a").alias("line"), F.col("span.b").alias("last_line"), body.alias("body")).filter(gated(F.col("body")))
    cut = cut.select("doc_id", "line", "last_line", words(F.col("body")).alias("w"))
    return windowed(cut, WRAPPED, STEP, WRAPPED - STEP)


def of_lines(hits: DataFrame) -> DataFrame:
    hits = hits.select("doc_id", F.posexplode("lines").alias("line", "body"))
    cut = hits.filter(gated(F.col("body"))).select("doc_id", "line", F.col("line").alias("last_line"), words(F.col("body")).alias("w"))
    return windowed(cut, SIZE, SIZE // 2, SIZE // 2)


def windowed(cut: DataFrame, size: int, step: int, overlap: int) -> DataFrame:
    """The words ``w`` in passages of ``size``, ``step`` words apart, that have a gate stem."""
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - overlap, F.lit(1)), F.lit(step))
    parts = cut.select("doc_id", "line", "last_line", "w", F.posexplode(starts).alias("part", "start"))
    parts = parts.select("doc_id", "line", "last_line", "part", F.concat_ws(" ", F.slice("w", F.col("start"), F.lit(size))).alias("passage"))
    return parts.filter(gated(F.col("passage")))


def fixed_rows(spark) -> DataFrame:
    rows = [(family, i, t) for family, ts in TEMPLATES.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows + [(UNKNOWN, i, t) for i, t in enumerate(GENERAL)], "family string, template int, body string")


def training_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``family``, ``grams``, ``held``: varied templates, and corpus lines for the unknown class. ``SAMPLE`` and ``VARIANTS`` bound them."""
    spark = docs.sparkSession
    lines = docs.select(F.explode(F.split(F.col(text), "\n")).alias("body")).filter(F.length("body").between(20, 400) & ~gated(F.col("body")))
    keyed = lines.withColumn("h", F.xxhash64("body", F.lit(3))).filter(F.pmod("h", F.lit(64)) == 0).groupBy("h").agg(F.any_value("body").alias("body"))
    sample = checkpointed(keyed.orderBy("h").limit(SAMPLE))
    numbered = sample.select(F.pmod(F.xxhash64("h"), F.lit(VARIANTS)).alias("v"), "h", words(F.col("body")).alias("around"))
    around = numbered.groupBy("v").agg(F.min_by("around", "h").alias("around"))  # one line for each variant
    varied = fixed_rows(spark).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn("v", F.col("v").cast("long")).join(around, "v", "left")
    keep = lambda share: lambda w, i: F.pmod(F.xxhash64(w, i, "v", "template"), F.lit(100)) >= share
    body = F.filter(words(F.col("body")), keep(8))
    outer = F.coalesce("around", F.array().cast("array<string>"))
    before = F.slice(outer, F.lit(1), F.pmod(F.xxhash64("v", "family"), F.lit(9)).cast("int"))
    after = F.slice(outer, F.lit(10), F.pmod(F.xxhash64("v", "body"), F.lit(9)).cast("int"))
    rows = varied.select("family", F.concat_ws(" ", F.concat(before, body, after)).alias("passage"), (F.pmod("v", F.lit(4)) == 0).alias("held"))
    plain = sample.select(F.lit(UNKNOWN).alias("family"), F.col("body").alias("passage"), (F.pmod("h", F.lit(256)) < 64).alias("held"))
    both = rows.unionByName(plain).withColumn("w", trimmed(F.col("passage")))
    return checkpointed(both.select("family", grams(F.col("w")).alias("grams"), "held"))


class Classifier:
    """A fitted model, the names of its classes and the calibrated threshold."""

    def __init__(self, rows: DataFrame):
        names = [*TEMPLATES, UNKNOWN]
        self.names = names
        label = F.array_position(F.array(*map(F.lit, names)), F.col("family")) - 1
        data = rows.withColumn("label", label.cast("double"))
        stages = [
            CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=3.0, vocabSize=8_192),
            LogisticRegression(maxIter=60, regParam=0.002, elasticNetParam=0.5, family="multinomial"),
        ]
        self.model = Pipeline(stages=stages).fit(data.filter(~F.col("held")))
        top = self.scored(rows.filter(F.col("held") & (F.col("family") == UNKNOWN))).select(F.percentile(F.when(F.col("predicted") != UNKNOWN, F.col("probability")).otherwise(0.0), 0.99).alias("t")).first()
        self.threshold = max(0.5, float(top.t or 0.0))

    def scored(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the best class ``predicted`` and its ``probability``."""
        out = self.model.transform(rows).withColumn("p", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")
        best = F.array_max("p")
        predicted = F.get(F.array(*map(F.lit, self.names)), F.array_position("p", best).cast("int") - 1)
        return out.withColumn("predicted", predicted).withColumn("probability", best).drop("p")


def scan_licenses(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per passage with a gate stem: ``doc_id``, ``line``, ``last_line``, ``part``, ``passage``, ``family`` (or unknown), ``predicted``,
    ``probability``, ``template`` (the nearest of its family), ``similarity``, ``confirmed``."""
    spark = docs.sparkSession
    classifier = Classifier(training_rows(docs))
    found = passages(docs).withColumn("grams", grams(trimmed(F.col("passage"))))
    scored = classifier.scored(found)
    pairs = lambda g: F.array_distinct(F.filter(g, lambda x: x.contains(" ")))
    kinds = fixed_rows(spark).filter(F.col("family") != UNKNOWN).select("family", "template", pairs(grams(trimmed(F.col("body")))).alias("pairs"))
    kinds = kinds.groupBy(F.col("family").alias("predicted")).agg(F.collect_list(F.struct("template", "pairs")).alias("kinds"))
    joined = scored.join(F.broadcast(kinds), "predicted", "left")  # as many rows as families
    own = pairs(F.col("grams"))
    nearest = F.array_max(F.transform("kinds", lambda k: F.struct((F.size(F.array_intersect(k["pairs"], own)) / F.size(k["pairs"])).alias("s"), (-k["template"]).alias("t"))))
    near = joined.withColumn("near", nearest).withColumn("similarity", F.coalesce(F.col("near.s"), F.lit(0.0)))
    sure = (F.col("predicted") != UNKNOWN) & (F.col("probability") >= classifier.threshold)
    confirmed = sure & (F.col("similarity") >= similarity)
    return near.select(
        "doc_id", "line", "last_line", "part", "passage", F.when(confirmed, F.col("predicted")).otherwise(UNKNOWN).alias("family"),
        "predicted", "probability", F.when(F.col("near").isNotNull(), -F.col("near.t")).alias("template"), "similarity", confirmed.alias("confirmed"),
    )
