"""Licence scans by a trained paragraph classifier.

Paragraphs (single lines, and runs of lines without a blank one between them) are classified by
multinomial logistic regression over word n-grams. Its features are the word pairs and triples of the
licence templates that hardly any sampled paragraph of the corpus has, and always so many that no
paragraph which confirms a template is without one. A paragraph without a feature is of the unknown
class, and texts without one are passed over after a single look at their word pairs. Probabilities are
calibrated by a temperature that is fitted on examples held back: copies of the templates that are
altered in another way than those of the fit, other lines of the corpus, and legal prose that the fit has
not seen. A prediction counts only if a template of its family confirms it better than those of all
others, and if the paragraph does not deny it ("not licensed under").

The model is fitted on a bounded set: VARIANTS altered copies of each template paragraph and at most
MAX_NEGATIVES paragraphs of the corpus. Only DataFrame functions and Spark's own estimators are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_table
from .quality import LOWER, UPPER, _let

UNKNOWN = "unknown"
VARIANTS = 60
MAX_NEGATIVES = 4000
#: Documents whose paragraphs are sampled as negatives.
NEGATIVE_DOCS = 1000
#: A template n-gram in more than this share of the negatives is no feature, as long as its template keeps enough others.
COMMON = 0.002
#: Share of negatives that may pass for a licence, before templates are compared.
FALSE_POSITIVES = 0.001
#: Share of a template's pairs and triples that a confirmed paragraph holds.
CONFIRM = 0.6
TEMPERATURES = (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)

# Characteristic paragraphs of public licences, by family, and legal prose of no licence.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under the Creative Commons CC0 1.0 Universal dedication.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
}
GNU = {"gpl": ("General", "program"), "lgpl": ("Lesser General", "library"), "agpl": ("Affero General", "program")}
CC = {
    "cc-by": ("BY", "Attribution"),
    "cc-by-sa": ("BY-SA", "Attribution-ShareAlike"),
    "cc-by-nd": ("BY-ND", "Attribution-NoDerivatives"),
    "cc-by-nc": ("BY-NC", "Attribution-NonCommercial"),
    "cc-by-nc-sa": ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "cc-by-nc-nd": ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
}
OTHER_LEGAL = (
    "All rights reserved. No part of this publication may be reproduced, stored or transmitted in any form without the prior permission of the publisher.",
    "This agreement shall be governed by and construed in accordance with the laws of the state in which the seller resides.",
    "The licensed driver must carry a valid driving licence at all times and show it on request.",
    "By using this site you agree to the terms of service and the privacy policy.",
    "The licensee shall pay an annual fee for the licence to sell food and drink under the terms of the local council.",
    "The software is licensed, not sold, and you may not copy or redistribute it without a written agreement with the company.",
    "Subject to the terms of this agreement, the company grants you a limited licence to use the service for your own purposes.",
    "The general public is not admitted to the public library without a card of the foundation.",
    "You should have received a copy of the invoice along with this parcel; either return it or keep it at your option.",
    "Permission to film in the building must be obtained in writing from the owner, and a copy of the permission must be kept.",
    "Source and binary files of the archive are provided with the documentation and other materials of the course.",
    "In no event shall the seller be liable for any damages arising in any way out of the use of these goods.",
)
#: Pairs of a word of the first kind and one of the second deny the licence that the paragraph names.
DENIALS = (("not", "never", "longer", "nor", "t"), ("licensed", "released", "covered", "available", "governed", "offered", "subject"))


def _ruled_templates() -> dict[str, tuple[str, ...]]:
    """The templates of families whose notices follow one wording."""
    out = {}
    for family, (name, work) in GNU.items():
        out[family] = (
            f"This work is licensed under the GNU {name} Public License, version 3.",
            f"Released under the GNU {name} Public License.",
            f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
            f"This {work} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
            f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} Public License for more details.",
            f"You should have received a copy of the GNU {name} Public License along with this {work}.",
        )
    for family, (short, long) in CC.items():
        out[family] = (
            f"Licensed under CC {short} 4.0.",
            f"Licensed under CC {short} 3.0.",
            f"This work is licensed under CC {short} 4.0.",
            f"This work is licensed under a Creative Commons {long} 4.0 International License.",
            f"This work is licensed under a Creative Commons {long} 3.0 Unported License.",
        )
    return out


TEMPLATES |= _ruled_templates()
FAMILIES = tuple(sorted(TEMPLATES))
_WORD, _NO_WORD = "[\\p{L}\\p{N}¶]", "[^\\p{L}\\p{N}¶]"


def paragraph_words(text: Column) -> Column:
    """Words of a paragraph or text, A-Z lower-cased, split at all but letters, digits and dots within numbers; a line end is the word `¶`."""
    lower = F.translate(text, UPPER, LOWER)
    marked = F.regexp_replace(F.regexp_replace(lower, "\n", " ¶ "), "[^\\p{L}\\p{N}¶]+", " ")
    return F.filter(F.split(marked, " "), lambda w: w != "")


def paragraphs(text: Column) -> Column:
    """The lines of a text, and after them its runs of two or more lines with words, each joined to one line; a line without a letter or digit ends a run."""
    runs = F.filter(F.split(text, f"\n{_NO_WORD}*\n"), lambda x: x.rlike(f"{_WORD}{_NO_WORD}*\n{_NO_WORD}*{_WORD}"))
    return F.concat(F.split(text, "\n"), F.transform(runs, lambda x: F.translate(x, "\n", " ")))


def _pairs(words: Column) -> Column:
    return _let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.xxhash64(F.slice(w, i, 2))))


def _triples(words: Column) -> Column:
    return _let(words, lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.xxhash64(F.slice(w, i, 3))))


def n_grams(words: Column) -> Column:
    """Distinct hashes of the word pairs and triples; empty for fewer than two words."""
    none = F.array().cast("array<bigint>")
    triples = F.when(F.size(words) > 2, _triples(words)).otherwise(none)
    return F.when(F.size(words) > 1, F.array_distinct(F.concat(_pairs(words), triples))).otherwise(none)


@dataclass
class Model:
    """Rows of (h, weights by class) and of (h, templates), and what turns sums into decisions. Bounded by the templates."""

    weights: list[tuple[int, list[float]]]
    templates: list[tuple[int, list[int]]]
    sizes: list[int]  # n-grams of each template
    owners: list[int]  # class of each template
    pairs: list[int]  # the features that are word pairs
    intercepts: list[float]
    temperature: float
    threshold: float
    denials: list[int]  # word pairs that deny a licence


def _templates(spark: SparkSession) -> DataFrame:
    rows = [(k, FAMILIES.index(f), t) for k, (f, t) in enumerate((f, t) for f in FAMILIES for t in TEMPLATES[f])]
    return spark.createDataFrame(rows, "template int, label int, text string").withColumn("words", paragraph_words(F.col("text"))).coalesce(1)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", max_negatives: int = MAX_NEGATIVES) -> Model:
    """A model of the templates against a bounded sample of the paragraphs of `docs`, taken by hash of the id.

    Null texts give no paragraph; rows without an id are of one hash, and taken or left alike. Repeated
    rows give repeated paragraphs. Empty table: a model of the templates against legal prose alone.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel

    spark = docs.sparkSession
    unknown = len(FAMILIES)
    templates = _templates(spark)
    grams = templates.select("template", "label", F.explode(n_grams(F.col("words"))).alias("h"))
    by_gram = {r["h"]: r["t"] for r in grams.groupBy("h").agg(F.collect_set("template").alias("t")).collect()}
    sizes = [r["n"] for r in templates.select("template", F.size(n_grams(F.col("words"))).alias("n")).orderBy("template").collect()]
    owners = [FAMILIES.index(f) for f in FAMILIES for _ in TEMPLATES[f]]
    is_pair = {r["h"] for r in templates.select(F.explode(_pairs(F.col("words"))).alias("h")).distinct().collect()}
    triple_pairs = {
        r["t"]: (r["a"], r["b"])
        for r in templates.filter(F.size("words") > 2).select("words", F.explode(F.sequence(F.lit(1), F.size("words") - 2)).alias("i"))
        .select(F.xxhash64(F.slice("words", F.col("i"), 3)).alias("t"), F.xxhash64(F.slice("words", F.col("i"), 2)).alias("a"), F.xxhash64(F.slice("words", F.col("i") + 1, 2)).alias("b")).distinct().collect()
    }

    known = F.array(*[F.lit(h) for h in sorted(by_gram)])
    n_docs = docs.count()
    share = min(1.0, NEGATIVE_DOCS / max(1, n_docs))
    chosen = docs.filter(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(F.col(text_col).alias("text"))
    lines = chosen.select(F.explode(F.split("text", "\n")).alias("text")).withColumn("words", paragraph_words(F.col("text"))).filter(F.size("words") > 1)
    lines = lines.withColumn("grams", n_grams(F.col("words"))).filter(2 * F.size(F.array_intersect("grams", known)) < F.size("grams"))
    # a longer line may embed a whole notice: what confirms a template is no negative
    for k, size in enumerate(sizes):
        own = F.array(*[F.lit(h) for h in sorted(h for h, t in by_gram.items() if k in t)])
        lines = lines.filter(F.size(F.array_intersect("grams", own)) < CONFIRM * size)
    negatives = stage_table(lines.select("words", "grams").orderBy(F.xxhash64("grams"), F.xxhash64("words")).limit(max_negatives), "negatives")
    n_negatives = negatives.count()
    common = {
        r["h"]
        for r in negatives.select(F.explode(F.array_intersect("grams", known)).alias("h")).groupBy("h").count()
        .filter(F.col("count") > COMMON * n_negatives).collect()
    }
    pairs, features = _features(by_gram, sizes, is_pair, triple_pairs, common)

    legal = spark.createDataFrame(list(enumerate(OTHER_LEGAL)), "k int, text string").withColumn("words", paragraph_words(F.col("text")))
    copies = F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v")
    # every fifth copy is held back, and of legal prose the copies of every second sentence
    positive = templates.select("label", "words", copies).withColumn("held", F.col("v") % 5 == 0)
    prose = legal.select(F.lit(unknown).alias("label"), "words", copies, (F.col("k") % 2 == 1).alias("held"))
    variants = positive.unionByName(prose)
    # each copy loses up to a quarter of its words; those held back also gain foreign ones between them
    dice = lambda w, i, salt: F.pmod(F.xxhash64(w, i, F.col("v"), F.lit(salt)), F.lit(100))
    thinned = F.filter("words", lambda w, i: dice(w, i, 0) >= F.pmod(F.col("v"), F.lit(25)))
    mingled = F.flatten(F.transform(thinned, lambda w, i: F.when(dice(w, i, 1) < 6, F.array(F.concat(F.lit("x"), dice(w, i, 2).cast("string")), w)).otherwise(F.array(w))))
    examples = variants.select("label", "held", n_grams(F.when(F.col("held"), mingled).otherwise(thinned)).alias("grams")).unionByName(
        negatives.select(F.lit(unknown).alias("label"), (F.pmod(F.xxhash64("grams"), F.lit(5)) == 0).alias("held"), "grams")
    )
    examples = examples.select("label", "held", F.transform("grams", lambda g: g.cast("string")).alias("terms"))
    vectors = CountVectorizerModel.from_vocabulary([str(h) for h in features], inputCol="terms", outputCol="features", minTF=1.0)
    vectors.setBinary(True)
    data = stage_table(vectors.transform(examples).select("label", "held", "features"), "licence-examples")
    fitted = LogisticRegression(maxIter=80, regParam=2e-4, elasticNetParam=0.2, family="multinomial", labelCol="label").fit(data.filter("NOT held"))
    matrix, intercepts = fitted.coefficientMatrix.toArray(), [float(x) for x in fitted.interceptVector.toArray()]

    from pyspark.ml.functions import vector_to_array

    held = fitted.transform(data.filter("held")).select("label", vector_to_array("rawPrediction").alias("z"))
    held = held.withColumn("label", F.col("label").cast("int"))
    loss = [_log_loss(F.col("z"), F.col("label"), t).alias(f"t{k}") for k, t in enumerate(TEMPERATURES)]
    losses = held.agg(*loss).first()
    temperature = min(zip([x if x is not None else math.inf for x in losses], TEMPERATURES, strict=True))[1]
    prob = _softmax(F.col("z"), temperature)
    passing = held.filter(F.col("label") == unknown).select(F.array_max(F.slice(prob, 1, unknown)).alias("p"))
    cut = passing.agg(F.max("p").alias("m"), F.percentile_approx("p", 1.0 - FALSE_POSITIVES, 10_000).alias("q")).first()
    threshold = max(0.5, min(0.95, float(cut["q"] or 0.0)))
    weights = [(h, [float(x) for x in matrix[:, i]]) for i, h in enumerate(features)]
    denied = spark.createDataFrame([(a, b) for a in DENIALS[0] for b in DENIALS[1]], "a string, b string").select(F.xxhash64(F.array("a", "b")).alias("h"))
    return Model(weights, [(h, sorted(t)) for h, t in sorted(by_gram.items())], sizes, owners, pairs, intercepts, temperature, threshold, sorted(r["h"] for r in denied.collect()))


def _features(by_gram: dict, sizes: list[int], is_pair: set, triple_pairs: dict, common: set) -> tuple[list[int], list[int]]:
    """The word pairs that are features, and all features.

    A template whose n-grams without a feature could confirm it keeps all of them, however common they are.
    """
    while True:
        pairs = {h for h in is_pair if h not in common}
        features = pairs | {h for h in by_gram if h in triple_pairs and h not in common and any(p in pairs for p in triple_pairs[h])}
        without = [sum(k in t for h, t in by_gram.items() if h not in features) for k in range(len(sizes))]
        short = {k for k, n in enumerate(without) if n >= CONFIRM * sizes[k]}
        if not short:
            return sorted(pairs), sorted(features)
        common = {h for h in common if not short & set(by_gram[h])}


def _log_loss(z: Column, label: Column, temperature: float) -> Column:
    """Mean of -log of the probability of the true class."""
    top = F.array_max(z)
    mass = F.aggregate(z, F.lit(0.0), lambda a, x: a + F.exp((x - top) / temperature))
    return F.avg(F.log(mass) - (F.element_at(z, label + 1) - top) / temperature)


def _softmax(z: Column, temperature: float) -> Column:
    shifted = F.transform(z, lambda x: F.exp((x - F.array_max(z)) / temperature))
    return _let(shifted, lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y)))


def scan(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of `docs`: id, n_paragraphs (with a feature), families (distinct confirmed ones, ascending),
    family (that of the highest probability; `unknown` if none is confirmed), score (its calibrated probability, else 0).

    A paragraph is a line, or a run of several lines that no blank line parts, so that wrapped notices are
    found. Ties of probability go to the first family by name. Null or empty text: no paragraph, `unknown`.
    Null and repeated ids: a row each. Empty table: no rows. Other columns are not read. Whole texts are
    scanned, and every paragraph that has a feature is scored.
    """
    spark = docs.sparkSession
    n = len(FAMILIES)
    wanted = F.array(*[F.lit(h) for h in model.pairs]) if model.pairs else F.array().cast("array<bigint>")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # pairs across line ends as well: a notice may be wrapped anywhere
    words = rows.select("id", "text", paragraph_words(F.translate(F.coalesce("text", F.lit("")), "\n", " ")).alias("words"))
    found = F.when(F.size("words") > 1, F.size(F.array_intersect(_pairs(F.col("words")), wanted)) > 0).otherwise(False)
    # texts without a feature go on without their text
    kept = stage_table(words.select("id", F.monotonically_increasing_id().alias("row"), F.when(found, F.col("text")).alias("text")), "licence-texts")

    features = spark.createDataFrame(model.weights or [(0, [0.0] * (n + 1))], "h long, w array<double>")
    marks = spark.createDataFrame([(h, t, False) for h, t in model.templates] + [(h, [], True) for h in model.denials], "h long, t array<int>, denial boolean")
    lookup = F.broadcast(marks.join(features, "h", "left"))  # the templates' n-grams: some hundreds
    lines = kept.filter("text IS NOT NULL").select("row", F.posexplode(paragraphs(F.col("text"))).alias("line", "text"))
    grams = lines.select("row", "line", F.explode(n_grams(paragraph_words(F.col("text")))).alias("h"))
    hits = grams.join(lookup, "h")
    sums = [F.coalesce(F.sum(F.get("w", F.lit(k))), F.lit(0.0)) + F.lit(model.intercepts[k]) for k in range(n + 1)]
    share = [F.sum(F.array_contains("t", k).cast("int")) / F.lit(float(size)) for k, size in enumerate(model.sizes)]
    scored = hits.groupBy("row", "line").agg(
        F.array(*sums).alias("z"), F.count("w").alias("n_features"), F.max("denial").alias("denied"),
        *[F.greatest(F.lit(0.0), *[share[k] for k, o in enumerate(model.owners) if o == f]).alias(f"m{f}") for f in range(n)],
    ).filter("n_features > 0")
    scored = scored.withColumn("p", F.slice(_softmax(F.col("z"), model.temperature), 1, n)).withColumn("m", F.array(*[f"m{f}" for f in range(n)]))
    scored = scored.withColumn("best", F.array_position("p", F.array_max("p")).cast("int")).withColumn("p", F.array_max("p"))
    confirmed = ~F.col("denied") & (F.col("p") >= model.threshold) & (F.element_at("m", F.col("best")) >= CONFIRM) & (F.element_at("m", F.col("best")) >= F.array_max("m"))
    name = F.element_at(F.array(*[F.lit(f) for f in FAMILIES]), F.col("best"))
    by_row = scored.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_paragraphs"),
        F.array_sort(F.collect_set(F.when(confirmed, name))).alias("families"),
        F.min(F.when(confirmed, F.struct((-F.col("p")).alias("minus"), name.alias("family")))).alias("top"),
    )
    return kept.join(by_row.withColumnRenamed("row", "__row"), F.col("row") == F.col("__row"), "left").select(
        "id", F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("top.family", F.lit(UNKNOWN)).alias("family"), F.coalesce(-F.col("top.minus"), F.lit(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_columns

    docs = read_columns(spark, sf_dir, "documents", "doc_id", "text")
    return scan(docs, train(docs)).withColumnRenamed("id", "doc_id")
