"""License scans: a trained paragraph classifier, confirmed against templates.

A paragraph (a line of a text) is turned into its word n-grams, of two and three words. A
sparse (L1) multinomial logistic regression over them names a licence family or `unknown`.
The probability from which a family counts is calibrated on ordinary paragraphs kept out of
training: at most `false_rate` of them may pass it. A prediction then stands only if the
paragraph shares enough n-grams with a template of that family. DataFrame functions and
pyspark.ml transformers, which run in the JVM on the row; no Python in tasks.

Scale: a document is read once, its paragraphs are scored where they are read and only
predicted ones are written. Features are n-grams of the templates, a fixed list. A paragraph
without any n-gram that speaks for a family more than for `unknown` is unknown; so only
paragraphs with a word of such an n-gram are cut into n-grams. Training reads the templates
and at most `sample_rows` paragraphs of `sample_docs` labelled documents; calibration counts
the scores of all the other labelled documents in a histogram.

Defined cases: null or empty texts have one paragraph without n-grams, which is unknown, and
so is a paragraph of a single word. Very long texts and paragraphs are scored whole; n-grams
that no template has do not change a score. Of families with equal probability the one that
comes first by name is taken. Repeated rows of an id are one document; rows with a null id
together are one, too. Without ordinary paragraphs to calibrate on, a family needs a
probability of `floor`. Other columns of the input are left behind.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from worktide.llm.frames import ascii_lower, materialise, named

# Names of licences, of which notices are made by rule.
NAMES = {
    "agpl": ["GNU Affero General Public License, version 3", "GNU AGPL v3"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license"],
    "boost": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "bsd": ["BSD License", "BSD-style license", "2-Clause BSD License", "3-Clause BSD License", "New BSD License"],
    "cc": ["CC BY 4.0", "CC BY-SA 4.0", "CC BY-NC 4.0", "CC BY-ND 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0",
           "CC BY 3.0", "CC BY-SA 3.0", "Creative Commons Attribution 4.0 International License",
           "Creative Commons Attribution-ShareAlike 4.0 International License",
           "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["CC0 1.0 Universal Public Domain Dedication", "Creative Commons Zero license"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License, version 1.0"],
    "gpl": ["GNU General Public License, version 2", "GNU General Public License, version 3", "GNU GPL v2",
            "GNU GPL v3", "GNU General Public License"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License, version 3",
             "GNU LGPL"],
    "mit": ["MIT License", "Expat License"],
    "mpl": ["Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License Version 2.0"],
    "unlicense": ["Unlicense"],
}
LEADS = [
    "{}",
    "Licensed under the {}.",
    "Released under the {}.",
    "Distributed under the {}.",
    "This work is licensed under the {}.",
    "This project is licensed under the terms of the {}.",
    "The source code is available under the {}; see the LICENSE file.",
]
# SPDX identifiers.
SPDX = {
    "agpl": ["AGPL-3.0-only", "AGPL-3.0-or-later"],
    "apache": ["Apache-2.0"],
    "boost": ["BSL-1.0"],
    "bsd": ["BSD-2-Clause", "BSD-3-Clause", "0BSD"],
    "cc": ["CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0"],
    "cc0": ["CC0-1.0"],
    "epl": ["EPL-1.0", "EPL-2.0"],
    "gpl": ["GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"],
    "isc": ["ISC"],
    "lgpl": ["LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"],
    "mit": ["MIT"],
    "mpl": ["MPL-2.0"],
    "unlicense": ["Unlicense"],
}
_FREE_SOFTWARE = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as "
    "published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_NO_WARRANTY = (
    "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
    "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {} for more details."
)
_COPY = "You should have received a copy of the GNU {} along with this program. If not, see https://www.gnu.org/licenses/."
# Paragraphs of notices and of short licences.
BODIES = {
    "agpl": [t.format("Affero General Public License", 3) for t in (_FREE_SOFTWARE, _NO_WARRANTY, _COPY)],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "See the License for the specific language governing permissions and limitations under the License.",
    ],
    "boost": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software "
        "and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, "
        "distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED "
        "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
        "this work.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License "
        "2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    ],
    "gpl": [t.format("General Public License", 3) for t in (_FREE_SOFTWARE, _NO_WARRANTY, _COPY)] + [
        _FREE_SOFTWARE.format("General Public License", 2),
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE "
        "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "lgpl": [t.format("Lesser General Public License", 3) for t in (_FREE_SOFTWARE, _NO_WARRANTY, _COPY)],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code "
        "form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
}
# Paragraphs that use the words of licences without being one.
ORDINARY = [
    "", "a licence plate under a car", "The driver had no license.", "You may obtain a copy of the book at the library.",
    "The public may use the software free of charge.", "The software is provided by the school.",
    "He works in the general public interest.", "The apache helicopter was licensed under the old rules.",
    "The license is under the table.", "The terms of the agreement are the following.",
    "Students of MIT released the new version.", "The creative commons of the town is open to any person.",
    "The foundation published a copy of the report.", "see the file", "for any purpose", "in the public domain",
    "The boost in sales came from a new license.", "An eclipse is a public event.", "This work is done under pressure.",
    "This project is distributed over three years.", "The source of the river is available on the map.",
]
UNKNOWN = "unknown"
FAMILIES = [UNKNOWN, *sorted(NAMES)]


def texts_of(family: str) -> list[str]:
    """Every notice of a family: its names in all leads, its SPDX lines, its paragraphs."""
    named_so = [lead.format(name) for name in NAMES[family] for lead in LEADS]
    return [*named_so, *[f"SPDX-License-Identifier: {name}" for name in SPDX[family]], *BODIES.get(family, [])]


def words(text: Column) -> Column:
    cut = F.split(ascii_lower(text), "[^a-z0-9\\x{80}-\\x{10FFFF}]+")
    return F.array_remove(cut, "")


def with_grams(df: DataFrame) -> DataFrame:
    """The rows with `grams`, all n-grams of two and three of their `words`."""
    two = NGram(n=2, inputCol="words", outputCol="two").transform(df)
    three = NGram(n=3, inputCol="words", outputCol="three").transform(two)
    return three.withColumn("grams", F.concat("two", "three")).drop("two", "three")


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, at, line) of every text."""
    rows = named(docs, row=id_col, text=text_col)
    return rows.select("row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("at", "line"))


def mentions(line: Column) -> Column:
    """A paragraph that speaks of a licence is no ordinary one."""
    return F.lower(line).contains("licen")


def templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family in NAMES for text in texts_of(family)]
    return with_grams(spark.createDataFrame(rows, "family string, text string").withColumn("words", words(F.col("text"))))


@dataclass(frozen=True)
class Model:
    """The fitted transformers, the words one of which a licence must have, and the calibrated bound."""

    vocabulary: CountVectorizerModel
    regression: LogisticRegressionModel
    pivots: tuple[str, ...]
    bound: float

    def lifting(self) -> set[str]:
        """N-grams that speak for some family more than for unknown."""
        weights = self.regression.coefficientMatrix.toArray()
        up = (weights[1:] > weights[0]).any(axis=0)
        return {gram for gram, lifts in zip(self.vocabulary.vocabulary, up, strict=True) if lifts}


def _sampled_ids(labelled: DataFrame, id_col: str, sample_docs: int) -> DataFrame:
    ids = named(labelled, row=id_col).filter(F.col("row").isNotNull()).distinct()
    return ids.orderBy(F.xxhash64(F.col("row").cast("string")), "row").limit(sample_docs)


def fit(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    labelled: DataFrame,
    sample_docs: int = 2_000,
    sample_rows: int = 4_000,
    floor: float = 0.5,
) -> Model:
    """Fit on the templates and on ordinary paragraphs of labelled documents.

    `labelled` has the ids (under `id_col`) of the documents to sample from. Of the
    `sample_docs` of them with the smallest hashes, at most `sample_rows` paragraphs are
    used, again those with the smallest hashes.
    """
    spark = docs.sparkSession
    ids = _sampled_ids(labelled, id_col, sample_docs)  # at most sample_docs rows are sent
    some = named(docs, row=id_col, text=text_col).join(F.broadcast(ids), "row", "left_semi")
    lines = lines_of(some, "row", "text").filter(~mentions(F.col("line")))
    lines = lines.select(F.xxhash64("line").alias("hash"), "line").orderBy("hash", "line").limit(sample_rows)
    plain = lines.select("line", F.lit(1.0).alias("weight")).unionByName(
        spark.createDataFrame([(t, 5.0) for t in ORDINARY], "line string, weight double"))
    plain = materialise(with_grams(plain.withColumn("words", words(F.col("line")))))
    known = templates(spark)
    # A notice, and its halves if it is long: notices are often quoted in part.
    n = F.size("words")
    long = n >= 12
    parts = known.select("family", F.explode(F.when(long, F.array(
        "words", F.slice("words", 1, F.ceil(n / 2).cast("int")),
        F.slice("words", F.floor(n / 2).cast("int") + 1, n))).otherwise(F.array("words"))).alias("words"))
    number = F.array_position(F.lit(FAMILIES), F.col("family")) - 1
    good = with_grams(parts).select(number.cast("double").alias("label"), F.lit(20.0).alias("weight"), "grams")
    bad = plain.select(F.lit(0.0).alias("label"), "weight", "grams")
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=1 << 16, binary=True).fit(good)
    rows = vocabulary.transform(good.unionByName(bad)).select("label", "weight", "features").coalesce(2).cache()
    regression = LogisticRegression(family="multinomial", weightCol="weight", regParam=0.0005, elasticNetParam=1.0,
                                    maxIter=100).fit(rows)
    rows.unpersist()
    model = Model(vocabulary, regression, (), floor)
    # The rarest word of each n-gram that counts, by how many ordinary paragraphs have it.
    lifting = model.lifting()
    wanted = sorted({w for gram in lifting for w in gram.split(" ")})
    seen = plain.select(F.explode(F.array_intersect("words", F.lit(wanted))).alias("w")).groupBy("w").count().collect()
    seen = {r.w: r["count"] for r in seen}  # at most the words of the templates
    pivots = {min(gram.split(" "), key=lambda w: (seen.get(w, 0), -len(w), w)) for gram in lifting}
    return replace(model, pivots=tuple(sorted(pivots)))


def candidates(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, at, family, p, plain, grams) of every paragraph that is some family rather than unknown.

    `plain` tells paragraphs that do not mention licences. The table is written.
    """
    lines = lines_of(docs, id_col, text_col).select("row", "at", "line", words(F.col("line")).alias("words"))
    lines = lines.filter(F.arrays_overlap("words", F.lit(list(model.pivots))))
    scored = model.regression.transform(model.vocabulary.transform(with_grams(lines)))
    best = F.col("prediction").cast("int") + 1
    return materialise(scored.filter("prediction > 0").select(
        "row", "at", F.element_at(F.lit(FAMILIES), best).alias("family"),
        F.element_at(vector_to_array("probability"), best).alias("p"), (~mentions(F.col("line"))).alias("plain"),
        F.array_distinct("grams").alias("grams")))


def compared(found: DataFrame) -> DataFrame:
    """Candidates with `rate`, the best share of n-grams that one has in common with a template of its family.

    It is the share of the template's n-grams or, for paragraphs of four words or more, that
    of the paragraph's, if it is more.
    """
    known = templates(found.sparkSession).select(
        F.col("family").alias("of"), F.array_distinct("grams").alias("template")).filter(F.size("template") > 0)
    met = found.join(F.broadcast(known), F.col("family") == F.col("of"))  # the fixed list
    shared = F.size(F.array_intersect("grams", "template"))
    less = F.when(F.size("grams") >= 5, F.least(F.size("grams"), F.size("template"))).otherwise(F.size("template"))
    best = met.groupBy("row", "at", "family", "p", "plain").agg(F.max(shared / less).alias("rate"))
    return best


def calibrate(
    model: Model, found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
    labelled: DataFrame, sample_docs: int = 2_000, false_rate: float = 0.001, floor: float = 0.5, verbatim: float = 0.9,
) -> Model:
    """The model with the bound that at most `false_rate` of the held-out ordinary paragraphs pass.

    Held out are all labelled documents that `fit` has not sampled. Paragraphs that mention a
    licence, or repeat `verbatim` of a template, are not ordinary.
    """
    ids = named(labelled, row=id_col).filter(F.col("row").isNotNull()).distinct()
    held = ids.join(F.broadcast(_sampled_ids(labelled, id_col, sample_docs)), "row", "left_anti")
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    count = named(docs, row=id_col, text=text_col).select("row", F.size(F.filter(lines, lambda x: ~mentions(x))).alias("n"))
    ordinary = count.join(held, "row", "left_semi").agg(F.sum("n")).first()[0] or 0
    wrong = compared(found.filter("plain")).filter(F.col("rate") < verbatim).join(held, "row", "left_semi")
    bins = wrong.groupBy(F.floor(F.col("p") * 1000).alias("bin")).count().collect()  # at most 1,001 rows
    allowed, bound = false_rate * ordinary, floor
    for row in sorted(bins, key=lambda r: -r.bin):
        allowed -= row["count"]
        if allowed < 0:
            bound = max(floor, (row.bin + 1) / 1000)
            break
    return replace(model, bound=min(bound, 0.999))


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, labelled: DataFrame, **settings: float,
) -> Model:
    """`fit` and `calibrate` in one, for callers that do not score the same documents afterwards."""
    fitting = {k: v for k, v in settings.items() if k in ("sample_docs", "sample_rows", "floor")}
    bounding = {k: v for k, v in settings.items() if k in ("sample_docs", "false_rate", "floor", "verbatim")}
    model = fit(docs, id_col, text_col, labelled=labelled, **fitting)
    found = candidates(docs, model, id_col, text_col)
    return calibrate(model, found, docs, id_col, text_col, labelled=labelled, **bounding)


def find_licences(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, overlap: float = 0.6,
    found: DataFrame | None = None,
) -> DataFrame:
    """(id, paragraph, family, p, template_overlap) of every confirmed paragraph.

    A prediction needs the model's bound and a template overlap (see `compared`) of `overlap`.
    `found` are the documents' candidates, if the caller has them already.
    """
    found = candidates(docs, model, id_col, text_col) if found is None else found
    best = compared(found.filter(F.col("p") >= model.bound)).filter(F.col("rate") >= overlap)
    return best.select(F.col("row").alias(id_col), F.col("at").alias("paragraph"), "family", "p",
                       F.col("rate").alias("template_overlap"))


def document_licences(
    docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", *, overlap: float = 0.6,
    found: DataFrame | None = None,
) -> DataFrame:
    """(id, n_paragraphs, families) of every document; families in order, `unknown` if none."""
    sure = find_licences(docs, model, id_col, text_col, overlap=overlap, found=found).select(
        F.col(id_col).alias("r"), F.col("paragraph"), F.col("family"))
    of = sure.groupBy("r").agg(F.count_distinct("paragraph").alias("n"),
                               F.array_sort(F.collect_set("family")).alias("families"))
    ids = named(docs, row=id_col).distinct()
    out = ids.join(of, F.col("row").eqNullSafe(F.col("r")), "left")
    return out.select(F.col("row").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"),
                      F.coalesce("families", F.array(F.lit(UNKNOWN))).alias("families"))
