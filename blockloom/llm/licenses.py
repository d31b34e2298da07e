"""Operator 8: licence scans, with DataFrame functions only.

A paragraph is what stands between blank lines, and each of its lines: a notice may be
wrapped over the lines of a paragraph, or be one line of it. They are classified by
their word n-grams (one and two words):

1. Training rows are made by Spark from the notices below (each notice, each notice
   without each of its words, and its halves), and, for the class unknown, from the
   fixed sentences of OTHER and from at most NEGATIVES distinct lines of the corpus
   (chosen by a bound on their hash, which their number sets) that share less than
   OVERLAP of their pairs of words with any notice.
2. A multinomial logistic regression over sparse counts (pyspark.ml, in the JVM) gives
   weights for each n-gram and family. Its n-grams are those that the notices have, so a
   paragraph without any of the notices' rare words (CUES) can only be unknown, and isn't
   looked at any further. A temperature set on held-back rows calibrates its probabilities.
3. Scoring is a broadcast join of the paragraphs' n-grams with the weights (as many rows as
   the notices have n-grams). A family is predicted where its calibrated probability is
   LEVEL or more; unknown is a class like the others.
4. Template comparison confirms a prediction: CONFIRM of the paragraph's pairs of words
   must stand in one template of the predicted family (or CONFIRM of the template's in the
   paragraph). Templates are whole licence texts and headers, not the training notices.

Lines of a paragraph that is found as a whole aren't reported by themselves; if one of them
fits a template better by CLEARLY, it is reported and the paragraph isn't.

Defined results: null and empty texts have no paragraphs; paragraphs of any length
are taken whole; equal paragraphs are all reported, each with its first line; rows equal
in all columns are reported once for each, as are rows with a null id; an empty table
gives no rows; other columns don't matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise

VOCABULARY, NEGATIVES, OVERLAP, CONFIRM, LEVEL, CLEARLY = 8192, 4000, 0.3, 0.5, 0.5, 0.1
#: Temperatures tried.
HEATS = [round(0.25 * 1.25**i, 4) for i in range(16)]

#: Short notices of each family, by which it is learned.
NOTICES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the Apache License",
        "This project is under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
        "distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind, see the License for the specific language governing permissions and limitations",
    ],
    "MIT": [
        "Released under the MIT License",
        "This project is licensed under the terms of the MIT license",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The software is provided as is, without warranty of any kind, express or implied, including the warranties of merchantability, fitness for a particular purpose and noninfringement",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License, either version 3 of the License, or any later version",
    ],
    "GPL-2.0": [
        "This program is licensed under the GNU General Public License, version 2",
        "Distributed under the terms of the GNU General Public License v2",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License",
        "Distributed under the terms of the GNU Lesser General Public License, version 2.1 or version 3",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "BSD": [
        "Licensed under the BSD License",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "public-domain": ["This is free and unencumbered software released into the public domain", "Released into the public domain under CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "all-rights-reserved": ["All rights reserved", "Copyright by the authors, all rights reserved, no part may be reproduced without permission"],
}
FAMILIES = ["unknown", *NOTICES]

#: Texts and headers of each family, against which a prediction is held.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "SPDX-License-Identifier: Apache-2.0 Apache License Version 2.0, January 2004 released under the Apache 2.0 license",
    ],
    "MIT": [
        "The MIT License (MIT). This software is released under the MIT License. It is licensed under the terms of the MIT license. Released under the MIT License. SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. SPDX-License-Identifier: GPL-3.0-or-later",
        "This work is licensed under the GNU General Public License, version 3. GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007. Released under the GNU GPL v3.",
    ],
    "GPL-2.0": [
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. SPDX-License-Identifier: GPL-2.0-only",
        "This program is licensed under the GNU General Public License, version 2. GNU GENERAL PUBLIC LICENSE Version 2, June 1991. Distributed under the terms of the GNU General Public License v2.",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. SPDX-License-Identifier: LGPL-2.1-or-later",
        "This library is distributed under the terms of the GNU Lesser General Public License, version 3. This library is licensed under the GNU Lesser General Public License. This library is distributed under the GNU Lesser General Public License.",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "This software is licensed under the BSD License. SPDX-License-Identifier: BSD-3-Clause",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/. Licensed under the Mozilla Public License 2.0. SPDX-License-Identifier: MPL-2.0"],
    "CC-BY": ["This work is licensed under CC BY 4.0, a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["This work is licensed under CC BY-SA 4.0, a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["This work is licensed under CC BY-NC 4.0, a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software. Released into the public domain under CC0 1.0 Universal. SPDX-License-Identifier: CC0-1.0"],
    "all-rights-reserved": ["Copyright (c) by the authors. All rights reserved. No part may be reproduced without permission."],
}

#: Sentences that speak of such things and grant nothing.
OTHER = [
    "The driver's license was checked by the police", "He got a fishing licence last year", "Permission was granted to build a bridge", "All seats are reserved for guests", "The general public was invited to the version of the play",
    "The software was sold to a large company", "The library is open to the public", "She has the right to vote", "Human rights are not negotiable", "The warranty of the car ended", "The terms of the contract were changed",
    "The Apache were a people of the plains", "The university released its report under pressure", "Notice of the meeting was given", "A copy of the letter was found", "Only members may use the name above any other without further conditions", "The work was distributed among the farmers",
]


def words(text: str) -> str:
    return f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), x -> x <> '')"


def grams(w: str) -> str:
    """Words and pairs of neighbouring words of an array, which is bound once."""
    return f"transform(array({w}), v -> concat(v, transform(slice(v, 2, greatest(size(v) - 1, 0)), (x, i) -> concat(v[i], ' ', x))))[0]"


def pairs(w: str) -> str:
    return f"transform(array({w}), v -> array_distinct(if(size(v) < 2, v, transform(slice(v, 2, greatest(size(v) - 1, 0)), (x, i) -> concat(v[i], ' ', x)))))[0]"


def table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table from a literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")


def listed(spark: SparkSession, texts: dict[str, list[str]]) -> DataFrame:
    return table(spark, [{"family": f, "notice": n} for f, own in texts.items() for n in own], "family:string,notice:string")


def strings(values) -> Column:
    return F.array([F.lit(v) for v in values])


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0) and text of each line."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "paragraph"))


def training_rows(docs: DataFrame) -> DataFrame:
    """family, grams and back: whether the row is held back for calibration."""
    spark = docs.sparkSession
    known = listed(spark, NOTICES).selectExpr("family", f"{words('notice')} as w")
    made = known.selectExpr(
        "family",
        """explode(concat(array(w, w, w),
             if(size(w) < 4, cast(array() as array<array<string>>), transform(w, (x, i) -> filter(w, (y, j) -> i <> j))),
             if(size(w) < 8, cast(array() as array<array<string>>), array(slice(w, 1, size(w) div 2), slice(w, size(w) div 2 + 1, size(w))))
           )) as w""",
    )
    fixed = listed(spark, {"unknown": OTHER}).selectExpr("family", f"{words('notice')} as w")
    templates = [r.p for r in listed(spark, NOTICES).selectExpr(f"{pairs(words('notice'))} as p").collect()]  # the fixed notices
    every = lines_of(docs).where(F.col("paragraph").rlike(r"[\p{L}\p{N}]")).select("paragraph", F.xxhash64("paragraph").alias("h"))
    # a bound on the hash first, so that no task sends more than its part of the pool
    many = every.agg(F.approx_count_distinct("h")).first()[0]
    share = min(1.0, (1.5 * NEGATIVES + 100) / max(many, 1))
    low = every.where(F.pmod("h", F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    pool = low.groupBy("h").agg(F.min("paragraph").alias("paragraph")).orderBy("h").limit(NEGATIVES).selectExpr(f"{words('paragraph')} as w", "h").selectExpr("w", "h", f"{pairs('w')} as p")
    near = F.greatest(*[F.size(F.array_intersect("p", strings(t))) / F.greatest(F.size("p"), F.lit(1)) for t in templates])
    other = pool.where(near < OVERLAP).select(F.lit("unknown").alias("family"), "w").unionByName(fixed)
    back = F.pmod(F.xxhash64("w", F.lit(5)), F.lit(5)) == 0
    return made.unionByName(other).withColumn("back", back).selectExpr("family", "back", f"{grams('w')} as grams")


def fit(docs: DataFrame) -> tuple[DataFrame, list[float], float]:
    """Weights (gram, w by family), the intercepts, and the temperature."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import CountVectorizerModel
    from pyspark.ml.functions import vector_to_array

    spark = docs.sparkSession
    rows = training_rows(docs).withColumn("label", F.array_position(strings(FAMILIES), F.col("family")).cast("double") - 1)
    rows = rows.coalesce(2).persist()
    known = listed(spark, NOTICES).selectExpr(f"explode({grams(words('notice'))}) as g").distinct().orderBy("g").collect()  # of the fixed notices
    counter = CountVectorizerModel.from_vocabulary([r.g for r in known][:VOCABULARY], "grams", "x").setBinary(True)
    x = counter.transform(rows)
    model = LogisticRegression(featuresCol="x", labelCol="label", family="multinomial", regParam=1e-3, maxIter=60, aggregationDepth=2).fit(x.where(~F.col("back")))
    weights, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    kept = [{"gram": g, "w": [round(float(v), 6) for v in weights[:, i]]} for i, g in enumerate(counter.vocabulary) if abs(weights[:, i]).max() > 1e-4]
    held = model.transform(x.where("back")).select(vector_to_array("rawPrediction").alias("z"), F.col("label").cast("int").alias("y"))
    loss = [F.avg(F.expr(f"ln(aggregate(z, 0D, (a, v) -> a + exp((v - array_max(z)) / {t}))) - (z[y] - array_max(z)) / {t}")).alias(f"t{i}") for i, t in enumerate(HEATS)]
    found = held.agg(*loss).first()
    heat = min((v, t) for v, t in zip(found, HEATS))[1] if found[0] is not None else 1.0
    rows.unpersist()
    return table(spark, kept, "gram:string,w:array<double>"), [float(b) for b in intercepts], heat


def cue_words(spark: SparkSession) -> list[str]:
    """Words that notices have and that OTHER sentences and anchors of prose don't: every notice must hold one."""
    from .spotsigs import ANCHORS

    plain = {w for r in listed(spark, {"x": OTHER}).selectExpr(f"explode({words('notice')}) as w").collect() for w in [r.w]} - {"license", "licence", "rights", "reserved", "public", "software", "apache"}
    own = {r.w for r in listed(spark, NOTICES).selectExpr(f"explode({words('notice')}) as w").collect()}  # of the fixed notices
    return sorted(w for w in own | {"licence", "licenced"} if w not in plain and w not in ANCHORS and len(w) > 2)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, line, family, probability, overlap and paragraph of each licence notice found."""
    spark = docs.sparkSession
    weights, intercepts, heat = fit(docs)
    n = len(FAMILIES)
    cues = strings(cue_words(spark))
    piece = F.expr(
        f"""
        transform(array(transform(split(coalesce(text, ''), '\\n'), x -> {words('x')})), w ->
          transform(sequence(0, size(w) - 1), i -> w[i]))[0]
        """
    )
    # a text's lines as words; lines without words end a paragraph
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.split(F.coalesce("text", F.lit("")), "\n").alias("t"), piece.alias("w")).where(F.exists("w", lambda x: F.arrays_overlap(x, cues)))
    step = """aggregate(sequence(0, size(w) - 1), cast(array() as array<struct<a: int, b: int>>), (acc, i) ->
        if(size(w[i]) = 0, acc, if(size(acc) > 0 and element_at(acc, -1).b = i - 1, concat(slice(acc, 1, size(acc) - 1), array(struct(element_at(acc, -1).a as a, i as b))), concat(acc, array(struct(i as a, i as b))))))"""
    one = cut.withColumn("row", F.monotonically_increasing_id()).withColumn("hit", F.transform("w", lambda x: F.arrays_overlap(x, cues)))
    spans = one.withColumn("wholes", F.expr(f"filter({step}, s -> s.b > s.a and exists(slice(hit, s.a + 1, s.b - s.a + 1), h -> h))"))
    spans = spans.withColumn("lone", F.expr("transform(filter(sequence(0, size(w) - 1), i -> hit[i]), i -> struct(i as a, i as b))"))
    unit = materialise(
        spans.select("doc_id", "row", "t", F.explode(F.expr("concat(wholes, lone)")).alias("s")).select(
            "doc_id", "row", F.col("s.a").alias("line"), F.col("s.b").alias("last"), F.expr("array_join(slice(t, s.a + 1, s.b - s.a + 1), '\\n')").alias("paragraph")
        ).withColumn("id", F.monotonically_increasing_id())
    )
    # n-grams count once each in a paragraph; those that the model doesn't know fall out in the join, and only sums are shuffled
    hits = unit.selectExpr("id", f"explode(array_distinct({grams(words('paragraph'))})) as gram").join(F.broadcast(weights), "gram")
    sums = hits.groupBy("id").agg(*[F.sum(F.col("w")[i]).alias(f"z{i}") for i in range(n)])
    z = F.array([(F.col(f"z{i}") + F.lit(intercepts[i])) / F.lit(heat) for i in range(n)])
    said = (
        sums.withColumn("z", z).withColumn("top", F.array_max("z")).withColumn("total", F.expr("aggregate(z, 0D, (a, x) -> a + exp(x - top))"))
        .withColumn("best", F.array_max(F.slice("z", 2, n))).withColumn("probability", F.expr("exp(best - top) / total")).where(F.col("probability") >= LEVEL)
        .withColumn("family", strings(FAMILIES)[F.expr("array_position(z, best)").cast("int") - 1])
    )
    # a prediction stands if a template of its family is like it
    templates: dict[str, list[list[str]]] = {}
    for r in listed(spark, TEMPLATES).selectExpr("family", f"{pairs(words('notice'))} as p").collect():  # the fixed templates
        templates.setdefault(r.family, []).append(r.p)
    shared = lambda t: F.size(F.array_intersect("p", strings(t)))
    like = F.coalesce(*[F.when(F.col("family") == f, F.greatest(*[F.greatest(shared(t) / F.size("p"), shared(t) / F.lit(len(t))) for t in own], F.lit(0.0))) for f, own in templates.items()], F.lit(0.0))
    found = said.select("id", "family", "probability").join(unit, "id")
    sure = found.withColumn("p", F.expr(pairs(words("paragraph")))).withColumn("overlap", like).where(F.col("overlap") >= CONFIRM)
    # lines inside a paragraph that is found as a whole are part of it, unless one of them fits a template clearly better
    each = sure.groupBy("row", "doc_id").agg(F.collect_list(F.struct("line", "last", "family", "probability", "overlap", "paragraph")).alias("x"))
    each = each.withColumn("wholes", F.expr(f"filter(x, o -> o.last > o.line and not exists(x, s -> s.last = s.line and o.line <= s.line and s.line <= o.last and s.overlap > o.overlap + {CLEARLY}))"))
    own = F.expr("concat(wholes, filter(x, s -> s.last = s.line and not exists(wholes, o -> o.line <= s.line and s.line <= o.last)))")
    return each.select("doc_id", F.explode(own).alias("s")).select(
        "doc_id", F.col("s.line").alias("line"), F.col("s.family").alias("family"), F.round("s.probability", 6).alias("probability"), F.round("s.overlap", 6).alias("overlap"), F.col("s.paragraph").alias("paragraph")
    )
