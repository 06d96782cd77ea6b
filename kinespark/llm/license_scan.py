"""Licence scans: a trained paragraph classifier and template comparison.

Lines, cut into overlapping windows where long, are word 1- and 2-grams. A sparse
multinomial logistic regression (elastic net) tells licence families from an
``unknown`` class; it learns from the templates below, alone and amid other
words, and from a bounded sample of the corpus. A temperature fitted on held-out
examples calibrates the probabilities, and with them how readily unknown is
said. A predicted family is confirmed by comparing the window with the family's
templates: 2-grams of a template found in it, as a share of the template.

Nothing here runs Python on executors.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinespark.session import materialise

UNKNOWN = "unknown"
#: Customary notices of licence families.
TEMPLATES: dict[str, list[str]] = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Released under the Apache License 2.0", "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License", "Licensed under the MIT License", "SPDX-License-Identifier: MIT", "This project is licensed under the terms of the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License", "Released under the BSD License", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 2", "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ],
    "lgpl": ["Licensed under the GNU Lesser General Public License, version 3", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "agpl": ["Licensed under the GNU Affero General Public License, version 3", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Released under CC BY 3.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Released under CC BY-SA 3.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Released under CC BY-NC 3.0"],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"],
    "cc0": ["Released into the public domain under CC0 1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "reserved": ["All rights reserved. No part of this publication may be reproduced or transmitted without prior written permission", "Proprietary and confidential, all rights reserved"],
}
#: Words of a window and between windows; hash buckets; corpus sample; surroundings drawn for each template.
WINDOW, STRIDE, FEATURES, SAMPLE, SURROUNDINGS = 48, 36, 1 << 13, 2000, 24
CONFIRM, MIN_PROBABILITY = 0.6, 0.5
TEMPERATURES = [0.25, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0, 4.0]


def words_of(line: Column) -> Column:
    """Lower-cased words: letters and digits, joined by dots, dashes or pluses."""
    return F.regexp_extract_all(F.lower(line), F.lit(r"[\p{L}\p{N}]+(?:[.+-][\p{L}\p{N}]+)*"), F.lit(0))


def pairs_of(words: Column) -> Column:
    """2-grams in order."""
    return F.when(F.size(words) > 1, F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat_ws(" ", F.get(words, i), F.get(words, i + 1)))).otherwise(
        F.array().cast("array<string>"))


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, words): lines with a word, the long ones in overlapping windows."""
    lines = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("paragraph", "line")).select("doc_id", "paragraph", words_of(F.col("line")).alias("all"))
    n = F.size("all")
    starts = F.when(n <= WINDOW, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n - 1, F.lit(STRIDE)))
    return lines.where(n > 0).select("doc_id", "paragraph", F.explode(F.transform(starts, lambda at: F.slice("all", at + 1, F.lit(WINDOW)))).alias("words"))


def _features(rows: DataFrame) -> DataFrame:
    grams = rows.withColumn("grams", F.concat("words", pairs_of(F.col("words"))))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=FEATURES, binary=True).transform(grams).drop("grams")


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(i, f, t) for i, (f, t) in enumerate((f, t) for f, ts in TEMPLATES.items() for t in ts)]
    t = spark.createDataFrame(rows, "template int, family string, notice string").coalesce(1)
    return t.select("template", "family", words_of(F.col("notice")).alias("words")).withColumn("pairs", F.array_distinct(pairs_of(F.col("words"))))


class Scanner:
    """Fitted on templates and at most ``sample`` windows of ``docs``."""

    def __init__(self, docs: DataFrame, sample: int = SAMPLE):
        spark = docs.sparkSession
        self.families = [UNKNOWN, *TEMPLATES]
        self.templates = _templates(spark)
        known = F.array(*[F.lit(f) for f in self.families])
        label = lambda f: (F.array_position(known, f) - 1).cast("double")
        some = windows(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(8)) == 0)).limit(sample)
        noise = materialise(some.select("words", F.monotonically_increasing_id().alias("n")), "licence-noise")
        # all 2-grams of the templates, a few hundred
        cues = self.templates.agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("pairs")))).alias("cues")).first()["cues"]
        self.cues = cues
        cue = F.array(*[F.lit(c) for c in cues])
        # a sampled window with many pairs of the templates may itself be a notice
        plain = noise.where(F.size(F.array_intersect(pairs_of(F.col("words")), cue)) < 2).withColumn("k", F.pmod(F.xxhash64("words"), F.lit(SURROUNDINGS)))
        around = plain.groupBy("k").agg(F.min("words").alias("around"))  # one for each k
        alone = self.templates.select("words", "family")
        amid = self.templates.select("words", "family", F.explode(F.sequence(F.lit(0), F.lit(SURROUNDINGS - 1))).alias("k")).join(around, "k").select(
            F.concat(F.slice("around", 1, F.pmod(F.col("k") * 5, F.lit(18)).cast("int")), "words", F.slice("around", 20, F.pmod(F.col("k") * 7, F.lit(20)).cast("int"))).alias("words"), "family")
        rows = materialise(alone.union(amid).union(plain.select("words", F.lit(UNKNOWN).alias("family"))).withColumn("label", label(F.col("family"))).withColumn(
            "held", F.pmod(F.xxhash64("words", F.lit("held")), F.lit(4)) == 0), "licence-examples")
        data = _features(rows)
        fit = LogisticRegression(maxIter=20, regParam=1e-4, elasticNetParam=0.5, family="multinomial")
        self.model: LogisticRegressionModel = fit.fit(data.where(~F.col("held") | (F.size("words") < 16)))
        raw = self.model.transform(data.where("held")).select("label", vector_to_array("rawPrediction").alias("raw"))
        loss = [F.avg(-F.log(F.greatest(F.get(self._softmax(F.col("raw"), t), F.col("label").cast("int")), F.lit(1e-12)))).alias(str(i)) for i, t in enumerate(TEMPERATURES)]
        losses = raw.agg(*loss).first()
        self.temperature = min((x, abs(t - 1), t) for x, t in zip(losses, TEMPERATURES))[2] if losses[0] is not None else 1.0

    @staticmethod
    def _softmax(raw: Column, temperature: float) -> Column:
        """Each class's probability, as 1 over a sum: no part is computed twice."""
        return F.transform(raw, lambda x: 1 / F.aggregate(raw, F.lit(0.0), lambda a, y: a + F.exp((y - x) / temperature)))

    def scan(self, docs: DataFrame, confirm: float = CONFIRM, min_probability: float = MIN_PROBABILITY) -> DataFrame:
        """(doc_id, paragraph, family, probability, similarity) of confirmed paragraphs.

        A window without any 2-gram of the templates can't be confirmed whatever the
        classifier says, so it isn't classified."""
        named = F.array(*[F.lit(f) for f in self.families])
        some = windows(docs).where(F.exists(pairs_of(F.col("words")), lambda p: p.isin(self.cues)))
        scored = self.model.transform(_features(some)).withColumn("pairs", pairs_of(F.col("words"))).where("prediction > 0").select(
            "doc_id", "paragraph", "pairs", F.get(named, F.col("prediction").cast("int")).alias("family"),
            vector_to_array("rawPrediction").alias("raw")).withColumn("probability", F.array_max(self._softmax(F.col("raw"), self.temperature))).where(F.col("probability") >= min_probability)
        # the templates are this module's constants, a row a family
        families = self.templates.groupBy("family").agg(F.collect_list("pairs").alias("templates"))
        share = lambda t: F.size(F.array_intersect(t, F.col("pairs"))) / F.greatest(F.size(t), F.lit(1))
        return (
            scored.join(families, "family").withColumn("similarity", F.array_max(F.transform("templates", share))).where(F.col("similarity") >= confirm)
            .groupBy("doc_id", "paragraph", "family").agg(F.max("probability").alias("probability"), F.max("similarity").alias("similarity"))
        )


def scan(docs: DataFrame, sample: int = SAMPLE, **how) -> DataFrame:
    """doc_id, paragraph (line number from 0), family, probability, similarity.

    Null and empty texts and lines without words give no row; null ids stay null, and
    rows that repeat an id are scanned as one document; other columns aren't read."""
    docs = docs.select("doc_id", "text")
    return Scanner(docs, sample).scan(docs, **how)
