"""Licence families of paragraphs: a trained classifier, confirmed against templates.

A paragraph is a line. Its sparse 1- to 3-word n-grams feed a multinomial logistic
regression with a class for everything else, and a template of the predicted family must
share most of its 3-word runs with the paragraph. All of it is DataFrame code and Spark's
own estimators.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm.store import written

UNKNOWN = "unknown"
_TOKEN = "[a-z0-9]+"
_PROBABILITY_BITS = 53  # a double from 0.5 to 1 is a whole number of 2 ** -53
_DIGITS = (40, 27, 14, 0)  # places of such a number at which its digits begin

# How works commonly state these licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Distributed under the MIT License. See LICENSE for more information."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "This project is released under the Apache 2.0 license."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("GPL-3.0", "Licensed under the GNU GPL v3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("LGPL", "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"),
    ("LGPL", "Licensed under the GNU Lesser General Public License."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Licensed under the BSD 3-Clause License."),
    ("BSD", "Released under the BSD license."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND", "Licensed under CC BY-ND 4.0."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related rights. Dedicated to the public domain under CC0 1.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."),
    ("proprietary", "All rights reserved."),
)


@dataclass(frozen=True)
class Settings:
    background: int = 2000  # a word that one of twice as many paragraphs has is common; with
    # as many or more, all unknown paragraphs together weigh as much as the templates
    confirmed: float = 0.7  # share of a template's 3-word runs that the paragraph must have
    false_alarms: float = 0.001  # of the background that the calibrated threshold lets pass
    iterations: int = 40


@dataclass(frozen=True)
class Model:
    counter: CountVectorizerModel
    regression: LogisticRegressionModel
    classes: list[str]
    words: list[str]  # every n-gram that counts has one of these
    threshold: float  # least probability of a family, from held-out background
    settings: Settings


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))


def _runs(tokens: Column, n: int) -> Column:
    """Different runs of n neighbouring tokens, as text."""
    starts = F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
    return F.array_distinct(
        F.transform(
            starts, lambda x, i: F.concat_ws(" ", *(F.get(tokens, i + k) for k in range(n)))
        )
    )


def _literals(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def _features(tokens: Column, words: list[str]) -> Column:
    """1- to 3-word runs with at least one of ``words``."""
    grams = F.concat(*(_runs(tokens, n) for n in (1, 2, 3)))
    return F.filter(grams, lambda g: F.arrays_overlap(F.split(g, " "), _literals(words)))


def _templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*(F.struct(F.lit(f).alias("family"), F.lit(t).alias("t")) for f, t in TEMPLATES))
    return spark.range(1).select(F.inline(rows)).select("family", _tokens(F.col("t")).alias("tokens"))


def _paragraphs(docs: DataFrame) -> DataFrame:
    """text_key, tokens and paragraph_key of each line of ``docs`` (text)."""
    # cut into words inside explode: what is made there is never computed again further up
    lines = F.transform(
        F.split("text", "\n", -1),
        lambda x: F.struct(F.xxhash64(x).alias("paragraph_key"), _tokens(x).alias("tokens")),
    )
    return docs.select(F.xxhash64("text").alias("text_key"), F.inline(lines))


def fit_licences(docs: DataFrame, settings: Settings | None = None) -> Model:
    """Train on the templates and on every different paragraph of ``docs`` (text).

    The background is all paragraphs but those with a 3-word run of a template. A template's
    words that are common there (see ``Settings``) are no features by themselves, so a
    paragraph without any of the others has no feature and is unknown without being scored.
    Features are the templates' runs of words with one of the others. Half of the background
    trains the unknown class, half calibrates the threshold: all but ``false_alarms`` of it
    must stay below. Paragraphs with equal features are one row with their number, and those
    without a feature only counted. The driver holds a row per word of the templates.
    """
    settings = settings or Settings()
    known = _templates(docs.sparkSession)
    runs, words = known.select(
        F.array_distinct(F.flatten(F.collect_list(_runs(F.col("tokens"), 3)))).alias("runs"),
        F.array_distinct(F.flatten(F.collect_list("tokens"))).alias("words"),
    ).first()
    half = F.pmod("paragraph_key", F.lit(2)).alias("half")
    others = ~F.arrays_overlap(_runs(F.col("tokens"), 3), _literals(runs))
    paragraphs = _paragraphs(docs.select("text"))
    rest = written(
        paragraphs.where("size(tokens) > 0")
        .where(others)
        .select("paragraph_key", F.array_intersect("tokens", _literals(words)).alias("words"))
        .distinct(),
        "licence-background",
    )
    sizes = {r["half"]: r["n"] for r in rest.groupBy(half).agg(F.count("*").alias("n")).collect()}
    having = rest.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    least = sum(sizes.values()) / (2 * settings.background)
    common = {r["word"] for r in having.where(F.col("n") >= least).collect()}
    words = sorted(set(words) - common)
    grams = _features(F.col("tokens"), words).alias("grams")
    examples = known.select("family", grams)
    counter = CountVectorizer(inputCol="grams", outputCol="features", binary=True, minDF=1.0)
    counter = counter.fit(examples)
    near = written(
        paragraphs.where(F.arrays_overlap("tokens", _literals(words)))
        .where(others)
        .select("paragraph_key", grams)
        .select(
            "paragraph_key",
            F.array_sort(F.array_intersect("grams", _literals(counter.vocabulary))).alias("grams"),
        )
        .distinct()
        .groupBy(half, "grams")
        .agg(F.count("*").alias("n")),
        "licence-near-background",
    )
    unknown = near.where("half = 0").select(F.lit(UNKNOWN).alias("family"), "grams", "n")
    featureless = sizes.get(0, 0) - (unknown.agg(F.sum("n")).first()[0] or 0)
    if featureless:
        row = docs.sparkSession.range(1).select(
            F.lit(UNKNOWN).alias("family"), _literals([]).alias("grams"), F.lit(featureless).alias("n")
        )
        unknown = unknown.union(row)
    each = len(TEMPLATES) / max(sizes.get(0, 0), settings.background)
    weighed = examples.withColumn("weight", F.lit(1.0)).union(
        unknown.select("family", "grams", F.col("n") * F.lit(each))
    )
    index = StringIndexer(inputCol="family", outputCol="label").fit(weighed)
    regression = LogisticRegression(
        maxIter=settings.iterations, regParam=0.002, family="multinomial", weightCol="weight"
    ).fit(index.transform(counter.transform(weighed)))
    model = Model(counter, regression, list(index.labels), words, 0.5, settings)
    alarms = _scored(near.where("half = 1"), model).select("n", "probability")
    allowed = int(settings.false_alarms * max(sizes.get(1, 0), settings.background))
    return replace(model, threshold=_calibrated(written(alarms, "licence-alarms"), allowed))


def _calibrated(alarms: DataFrame, allowed: int) -> float:
    """The highest probability that more than ``allowed`` alarms reach; 0.5 at least.

    ``alarms`` counts in ``n`` the paragraphs of a probability. It is selected digit by
    digit: a round collects one count per digit, 2 ** 14 at most.
    """
    place = (F.col("probability") * F.lit(float(1 << _PROBABILITY_BITS))).cast("bigint")
    inside = alarms.where("probability >= 0.5").select(place.alias("place"), "n")
    found = 0
    for shift in _DIGITS:
        digit = F.shiftright("place", shift).alias("digit")
        counts = inside.groupBy(digit).agg(F.sum("n").alias("n")).orderBy(F.desc("digit"))
        for found, n in counts.collect():
            if n > allowed:
                break
            allowed -= n
        else:
            return 0.5
        inside = inside.where(digit == found)
    return found / (1 << _PROBABILITY_BITS)


def _scored(near: DataFrame, model: Model) -> DataFrame:
    """``near`` (grams and other columns) with the likeliest family and its probability."""
    scored = model.regression.transform(model.counter.transform(near))
    chance = vector_to_array("probability")
    best = F.greatest(
        *(
            F.struct(chance[i].alias("probability"), F.lit(name).alias("family"))
            for i, name in enumerate(model.classes)
            if name != UNKNOWN
        )
    )
    return scored.select(*near.columns, best.alias("best")).select(*near.columns, "best.*")


def _classified(paragraphs: DataFrame, model: Model) -> DataFrame:
    """paragraph_key, family, probability and runs of the paragraphs that have a feature."""
    near = paragraphs.select(
        "paragraph_key",
        _features(F.col("tokens"), model.words).alias("grams"),
        _runs(F.col("tokens"), 3).alias("runs"),
    ).where(F.size("grams") > 0)
    return _scored(near, model).drop("grams")


def _confirmed(settings: Settings) -> Column:
    """Whether a template of the predicted family shares enough of its runs."""
    found = F.lit(False)
    for family, text in TEMPLATES:
        tokens = re.findall(_TOKEN, text.lower())
        runs = sorted({" ".join(tokens[i : i + 3]) for i in range(len(tokens) - 2)})
        shared = F.size(F.array_intersect("runs", _literals(runs)))
        found = found | ((F.col("family") == family) & (shared >= settings.confirmed * len(runs)))
    return found


def licence_scan(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_licences, licences and probability of every row of ``docs``.

    ``licences`` are the families that a paragraph was predicted as, with at least the
    calibrated probability, and confirmed by a template; sorted. ``n_licences`` counts the
    different paragraphs that name one, ``probability`` is the highest of them, null without.
    A paragraph that fails either test is unknown and not listed. Null and empty texts have
    none, equal texts get equal answers, other columns are dropped, an empty table gives an
    empty one. Paragraphs are classified once each, however many documents share them, and
    only those with a feature move.
    """
    source = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")
    )
    near = written(
        _paragraphs(source.select("text"))
        .where(F.arrays_overlap("tokens", _literals(model.words)))
        .select("text_key", "paragraph_key", "tokens")
        .dropDuplicates(["text_key", "paragraph_key"]),
        "licence-paragraphs",
    )
    unique = near.groupBy("paragraph_key").agg(F.first("tokens").alias("tokens"))
    sure = _classified(unique, model).where(F.col("probability") >= model.threshold)
    families = sure.where(_confirmed(model.settings)).select(
        "paragraph_key", "family", "probability"
    )
    by_text = (
        near.select("text_key", "paragraph_key")
        .join(families, "paragraph_key")
        .groupBy("text_key")
        .agg(
            F.count("*").alias("n_licences"),
            F.sort_array(F.collect_set("family")).alias("licences"),
            F.max("probability").alias("probability"),
        )
    )
    keyed = source.select("doc_id", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("text_key"))
    return keyed.join(by_text, "text_key", "left").select(
        "doc_id",
        F.coalesce("n_licences", F.lit(0)).alias("n_licences"),
        F.coalesce("licences", F.array().cast("array<string>")).alias("licences"),
        "probability",
    )
