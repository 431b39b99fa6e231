"""License scan: trained paragraph classifiers, confirmed by templates, in DataFrame functions.

Texts are cut at blank lines (lines without letters and digits, such as a bare comment mark, too) and into
sentences, which may be wrapped over lines; each line of a sentence is a paragraph, and so is the sentence.
Every paragraph of every text is classified, in two steps that are both logistic regressions on sparse n-grams
of its words. The first has two classes, ordinary prose against anything about a licence. Its weights are one
array, looked up by the hash of each word and word pair, so that it costs no join or shuffle; a paragraph whose
score is below the limit is prose. The limit is the least score of the training samples of licences.
What remains, the candidates, goes to the second, multinomial one over licence families, ``unknown`` (a licence of
no family here) and ``none``: a candidate's words and word pairs are hashed to ``DIMENSIONS`` features, and the
weights, a table of DIMENSIONS rows, are joined to the exploded features; equal paragraphs are scored once. A
prediction stands if its probability reaches the calibrated limit and some template of the family, or sentence of
one that names a license, shares ``MIN_SHARED`` of its word pairs with the paragraph; else the paragraph is
``unknown``. A wrapped sentence that is confirmed counts in place of its lines, but for lines confirmed by
themselves that are no part of its family's templates; else its lines count.

Both are trained on the driver, on seeded variations of the templates below and of sentences of the other
classes; the second limit is the probability that 98 in 100 held-back family samples reach, between 0.2 and 0.6:
below, a family would be named that is hardly likelier than others; above, a varied notice would be unknown
for a few odd words, although the templates still have to confirm it.

Defined cases: a null or empty text has no paragraphs; rows that share a doc_id count as one document;
null doc_ids are one document too; paragraphs of any length are scored whole; an empty table gives no
rows. Output: doc_id, n_candidates, families (sorted names joined by commas, empty if none), n_confirmed,
n_unknown, best_family (of the most probable confirmed paragraph), best_probability.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedgeway.llm.common import let
from sedgeway.runtime import cut, table

DIMENSIONS = 4096
MIN_SHARED = 0.5
SAMPLES = 120
SEED = 7
#: Weights of the first step.
SCREEN = 1 << 14

#: Where a sentence ends, within lines and, with the next line's comment mark, at their ends; and a gap of blank lines.
SENTENCE = r"(?<=[.!?;])[ \t]+"
LINE_END = r"(?<=[.!?;])[\n\r]+[^\p{L}\p{N}\n\r]*"
GAP = r"(?:\n|\r(?!\n))[^\p{L}\p{N}]*[\n\r]"

#: Short notices of the licence families. Fixed values.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "agpl": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "bsd": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the 2-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "public-domain": ["This work is dedicated to the public domain under CC0 1.0 Universal.", "This is free and unencumbered software released into the public domain."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this work may be reproduced without prior written permission of the copyright holder. All rights reserved."],
}
#: Sentences of the two other classes; {x} stands for invented names. Fixed values.
UNKNOWN = [
    "Licensed under the {x} License.", "Released under the {x} Community License, version {n}.", "This work is licensed under the {x} Public Licence, version {n}.",
    "Use of this software is governed by the {x} licence agreement.", "SPDX-License-Identifier: LicenseRef-{x}", "Distributed under the terms of the {x} source license.",
    "You may redistribute this under the {x} terms.", "The {x} software license applies to all copies.",
]
NONE = [
    "He lost his driving licence after the {x} race.", "The copyright debate in {x} went on for years.", "Every {x} comes with a two year warranty.",
    "She applied for a fishing license in {x}.", "The {x} office grants a license to sell food.", "There is no warranty that {x} will rain.",
    "A book on copyright by {x} sold well.", "The public domain of {x} has many parks.", "They licensed the song to {x} for a film.", "Permission is hereby granted to {x} to hold the fair.", "The plate on the {x} car shows its license number.",
]

#: Common words of four languages, of which sentences of ordinary prose are made. Fixed values.
PROSE = """
the of and to in is was for on with as it that by from at this be are or an not have were which their one all has but they you can had
when will more if no out so what up said about into them only other time new some could these two may then do first any like my now over
such our man me even most made after also did many off before must well back through years where much your way down should because long
der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um
la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec son elle mais nous cette
el los y las del por con para una su al lo como más pero sus este ya cuando muy sin sobre también hasta hay donde quien desde
""".split()

FAMILIES = tuple(TEMPLATES)
CLASSES = (*FAMILIES, "unknown", "none")


def _words(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9+]+", " ", text.lower()).split()


def _pairs(w: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(w, w[1:])]


def template_pairs() -> list[tuple[str, list[str]]]:
    """(family, word pairs) of the templates, and of their sentences that name a license: texts are cut the same way."""
    out = []
    for family, texts in TEMPLATES.items():
        for t in texts:
            named = [x for x in re.split(SENTENCE, t) if "license" in _words(x)]
            out += [(family, sorted(set(_pairs(_words(x))))) for x in dict.fromkeys([t, *named])]
    return out


def _features(text: str) -> dict[int, float]:
    """Feature: value; the same as ``features`` makes of a column."""
    w = _words(text)
    grams = sorted({*w, *_pairs(w)})
    out: dict[int, float] = {}
    for g in grams:
        k = zlib.crc32(g.encode()) % DIMENSIONS
        out[k] = out.get(k, 0.0) + 1 / len(grams) ** 0.5
    return out


@dataclass(frozen=True)
class Classifier:
    weights: np.ndarray  # DIMENSIONS x classes
    bias: np.ndarray
    limit: float

    def probabilities(self, text: str) -> np.ndarray:
        z = self.bias + sum((v * self.weights[k] for k, v in _features(text).items()), np.zeros(len(self.bias)))
        e = np.exp(z - z.max())
        return e / e.sum()


def labelled_samples(each: int = SAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """``each`` seeded variations for every class."""
    rng = random.Random(seed)
    name = lambda: "".join(rng.choices(["tor", "mel", "ka", "rin", "dos", "vex", "al", "qui", "sor", "nem"], k=rng.randint(2, 3))).title()

    def vary(t: str) -> str:
        w = t.split()
        w = [x for x in w if rng.random() > 0.06] or w
        if rng.random() < 0.5:
            w = [rng.choice(["#", "//", "*", name(), name().lower(), "Note:", "(c)", str(rng.randint(1990, 2030))]), *w]
        if rng.random() < 0.3:
            w += [name() for _ in range(rng.randint(1, 4))]
        out = " ".join(w)
        return out.upper() if rng.random() < 0.15 else out

    out = []
    for k, c in enumerate(CLASSES):
        for _ in range(each):
            t = rng.choice(TEMPLATES.get(c) or (UNKNOWN if c == "unknown" else NONE))
            out.append((vary(t.replace("{x}", name()).replace("{n}", str(rng.randint(1, 9)))), k))
    return out


@lru_cache(maxsize=1)
def train(rounds: int = 400, rate: float = 4.0, ridge: float = 2e-4) -> Classifier:
    """Multinomial logistic regression by accelerated gradient steps; a fifth of the samples is held back for the limit."""
    data = labelled_samples()
    x = np.zeros((len(data), DIMENSIONS))
    for i, (t, _) in enumerate(data):
        for k, v in _features(t).items():
            x[i, k] = v
    y = np.array([k for _, k in data])
    held = np.arange(len(data)) % 5 == 0
    used = np.flatnonzero(x.any(axis=0))  # sparse: other features keep weight 0
    xs, target = x[~held][:, used], np.eye(len(CLASSES))[y[~held]]
    w, b = np.zeros((len(used), len(CLASSES))), np.zeros(len(CLASSES))
    mw, mb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(rounds):
        z = xs @ w + b
        e = np.exp(z - z.max(axis=1, keepdims=True))
        g = (e / e.sum(axis=1, keepdims=True) - target) / len(xs)
        mw, mb = 0.9 * mw + xs.T @ g + ridge * w, 0.9 * mb + g.sum(axis=0)
        w, b = w - rate * mw, b - rate * mb
    full = np.zeros((DIMENSIONS, len(CLASSES)))
    full[used] = w
    z = x[held] @ full + b
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    known = y[held] < len(FAMILIES)
    limit = float(np.quantile(p[known, y[held][known]], 0.02))
    return Classifier(full, b, min(0.6, max(0.2, limit)))


def _places(words: list[str]) -> list[int]:
    """Places of a paragraph's words and word pairs among the weights of the first step; as ``screen_score`` hashes them."""
    single = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    pairs = [xxhash.xxh64_intdigest(w.encode(), h) for h, w in zip(single, words[1:])]
    return [h % SCREEN for h in single + pairs]


@dataclass(frozen=True)
class Screen:
    """The first step: weights, constant and the least score of a candidate."""

    weights: np.ndarray
    bias: float
    limit: float

    def score(self, words: list[str]) -> float:
        at = _places(words)
        return self.bias + float(self.weights[at].sum()) / len(at) ** 0.5 if at else self.bias


def screen_samples(each: int = SAMPLES, seed: int = SEED) -> list[tuple[str, int]]:
    """Variations of all that is about licences (1), and of sentences that aren't (0), most of them of common and invented words."""
    rng = random.Random(seed + 1)
    invented = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9)))
    plain = lambda k: [rng.choice(PROSE) if rng.random() < 0.7 else invented() for _ in range(k)]
    rows = []
    for t, k in labelled_samples(each, seed):
        if CLASSES[k] != "none" and rng.random() < 0.4:
            t = " ".join([*plain(rng.randint(0, 6)), t, *plain(rng.randint(0, 6))])
        rows.append((t, int(CLASSES[k] != "none")))
    whole = [t for ts in TEMPLATES.values() for t in ts]
    rows += [(t, 1) for t in whole] + [(x, 1) for t in whole for x in re.split(SENTENCE, t) if "license" in _words(x)]
    for _ in range(50 * each):  # of every length, the shortest ones most
        share = rng.choice([0.4, 0.7, 1.0])
        rows.append((" ".join(rng.choice(PROSE) if rng.random() < share else invented() for _ in range(rng.choice([1, 1, 2, 3, 4, 6, 8, 10, 12, 15, 20, 30, 40]))), 0))
    return rows


@lru_cache(maxsize=1)
def train_screen(rounds: int = 500, rate: float = 8.0, ridge: float = 1e-6) -> Screen:
    """Logistic regression on sparse counts by accelerated gradient steps."""
    data = [(_places(_words(t)), y) for t, y in screen_samples()]
    used = sorted({k for at, y in data if y for k in at})  # what no licence has weighs nothing
    column = {k: i for i, k in enumerate(used)}
    cells = [(i, column[k], len(at) ** -0.5) for i, (at, _) in enumerate(data) for k in at if k in column]
    rows, cols, values = (np.array(c) for c in zip(*cells))
    y = np.array([v for _, v in data], float)
    score = lambda: np.bincount(rows, values * w[cols], len(data)) + b
    w, b, mw, mb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(score(), -30, 30))) - y) / len(data)
        mw, mb = 0.9 * mw + np.bincount(cols, values * g[rows], len(used)) + ridge * w, 0.9 * mb + g.sum()
        w, b = w - rate * mw, b - rate * mb
    w, b = np.round(w, 4), round(float(b), 4)
    full = np.zeros(SCREEN)
    full[used] = w
    return Screen(full, b, float(score()[y == 1].min()) - 1e-6)


def screen_score(words: Column, screen: Screen) -> Column:
    """The score of an array of words by the first step."""
    weights = F.from_json(F.lit("[" + ",".join(f"{v:g}" for v in screen.weights) + "]"), "array<double>")  # folded to a constant
    at = lambda h: F.get(weights, h.bitwiseAND(F.lit(SCREEN - 1)).cast("int"))
    n = F.size(words)

    def both(w: Column, i: Column) -> Column:
        return at(F.xxhash64(w)) + F.when(i + 1 < n, at(F.xxhash64(w, F.get(words, i + 1)))).otherwise(0.0)

    total = F.aggregate(F.transform(words, both), F.lit(0.0), lambda acc, v: acc + v)
    return F.lit(screen.bias) + total / F.sqrt((2 * n - 1).cast("double"))


def paragraphs(text: Column, screen: Screen | None = None) -> Column:
    """(whole, lines) of the sentences of a text that hold candidates: all of it and its candidate lines, as normalised words with one space between."""
    screen = screen or train_screen()
    words = lambda p: F.trim(F.regexp_replace(F.lower(p), r"[^a-z0-9+]+", " "))
    named = lambda w: (w != "") & let(F.split(w, " "), lambda a: screen_score(a, screen) >= screen.limit)
    blocks = F.split(F.coalesce(text, F.lit("")), GAP, -1)
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(b, LINE_END + "|" + SENTENCE, -1)))
    joined = lambda lines: F.struct(F.array_join(F.filter(lines, lambda w: w != ""), " ").alias("whole"), lines.alias("lines"))
    parts = F.transform(sentences, lambda p: let(F.transform(F.split(p, r"[\n\r]+", -1), words), joined))
    several = lambda p: F.when(F.size(p["lines"]) > 1, named(p["whole"])).otherwise(False)  # noqa: E731  # one line is the whole sentence
    judged = F.transform(parts, lambda p: F.struct(p["whole"].alias("whole"), F.filter(p["lines"], named).alias("lines"), several(p).alias("named")))
    found = F.filter(judged, lambda p: p["named"] | (F.size(p["lines"]) > 0))
    return F.transform(found, lambda p: F.struct(p["whole"].alias("whole"), p["lines"].alias("lines")))


def word_pairs(w: Column) -> Column:
    """The different pairs of neighbours in an array of words."""
    pairs = lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: F.concat_ws(" ", x, F.get(a, i + 1)))
    return F.array_distinct(let(w, pairs))


def classify(units: DataFrame, classifier: Classifier, unit: str = "unit") -> DataFrame:
    """(unit, family, probability, shared) for every different paragraph of ``units``."""
    spark = units.sparkSession
    names = [f"w{k}" for k in range(len(CLASSES))]
    rows = [(i, *map(float, r)) for i, r in enumerate(classifier.weights) if r.any()]
    weights = spark.createDataFrame(rows, "feature int, " + ", ".join(f"{n} double" for n in names))
    templates = spark.createDataFrame(template_pairs(), "t_family string, t_pairs array<string>")
    one = units.select(unit).distinct().withColumn("w", F.split(unit, " ")).withColumn("pairs", word_pairs(F.col("w")))
    grams = one.withColumn("grams", F.array_distinct(F.concat("w", "pairs"))).select(unit, F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    keyed = grams.withColumn("feature", (F.crc32(F.col("gram").cast("binary")) % DIMENSIONS).cast("int"))
    sums = keyed.join(F.broadcast(weights), "feature", "left").groupBy(unit).agg(*[(F.coalesce(F.sum(n), F.lit(0.0)) / F.sqrt(F.max("n"))).alias(n) for n in names])  # DIMENSIONS rows
    z = F.array(*[F.struct((F.col(n) + float(b)).alias("z"), F.lit(c).alias("c")) for n, b, c in zip(names, classifier.bias, CLASSES)])
    scored = sums.select(unit, z.alias("z")).withColumn("top", F.array_max("z"))
    p = 1 / F.aggregate("z", F.lit(0.0), lambda acc, x: acc + F.exp(x["z"] - F.col("top")["z"]))
    best = scored.select(unit, F.col("top")["c"].alias("guess"), p.alias("probability"))
    near = (
        best.join(one.select(unit, "pairs"), unit)
        .join(F.broadcast(templates), F.col("guess") == F.col("t_family"), "left")
        .groupBy(unit, "guess", "probability")
        .agg(F.max(F.size(F.array_intersect("pairs", "t_pairs")) / F.greatest(F.lit(1), F.size("t_pairs"))).alias("shared"))
    )
    sure = (F.col("probability") >= classifier.limit) & (F.coalesce("shared", F.lit(0.0)) >= MIN_SHARED)
    family = F.when(F.col("guess").isin("none", "unknown"), F.col("guess")).when(sure, F.col("guess")).otherwise("unknown")
    return near.select(unit, family.alias("family"), "probability", "shared")


def scan_licenses(df: DataFrame, text: str = "text", doc_id: str = "doc_id", classifier: Classifier | None = None) -> DataFrame:
    """A row for each different doc_id of ``df``."""
    # Outer, as Spark would put a filter that computes the paragraphs a second time below a plain inline.
    sentences = df.select(F.col(doc_id).alias("u_id"), F.inline_outer(paragraphs(F.col(text)))).filter("whole is not null").withColumn("p", F.monotonically_increasing_id())
    unit = lambda u, w: F.struct(u.alias("unit"), F.lit(w).alias("wrapped"))
    lines = F.transform("lines", lambda x: unit(x, False))
    wrapped = F.when(F.col("lines") != F.array("whole"), F.array(unit(F.col("whole"), True))).otherwise(F.array().cast("array<struct<unit: string, wrapped: boolean>>"))
    units = cut(sentences.select("u_id", "p", F.inline(F.concat(lines, wrapped))).filter("unit != ''"))
    # Materialised, so that both sides of the join are exchanged and Spark can split a line that very many texts share.
    named = units.join(cut(classify(units, classifier or train())), "unit", "left")
    known = ~F.col("family").isin("none", "unknown")
    line, whole = known & ~F.col("wrapped"), known & F.col("wrapped")
    each = named.groupBy("u_id", "p").agg(
        F.count_if(~F.col("wrapped")).alias("n_lines"), F.count_if(F.col("family") == "unknown").alias("n_all_unknown"), F.count_if((F.col("family") == "unknown") & ~F.col("wrapped")).alias("n_line_unknown"),
        F.collect_list(F.when(line, F.struct("probability", "family", "unit"))).alias("found"), F.max(F.when(whole, F.struct("probability", "family", "unit"))).alias("whole"),
    )
    by_family: dict[str, set[str]] = {}
    for f, pairs in template_pairs():
        by_family.setdefault(f, set()).update(pairs)
    of_family = df.sparkSession.createDataFrame([(f, sorted(x)) for f, x in by_family.items()], "w_family string, w_pairs array<string>")
    each = each.join(F.broadcast(of_family), F.col("whole.family") == F.col("w_family"), "left")
    own = lambda x: (x["family"] == F.col("w_family")) | (F.size(F.array_except(word_pairs(F.split(x["unit"], " ")), F.col("w_pairs"))) > 0)
    each = each.withColumn("found", F.when(F.col("whole").isNull(), F.col("found")).otherwise(F.filter("found", own)))
    more = F.col("whole").isNotNull() & ~F.exists("found", lambda x: x["family"] == F.col("w_family"))
    each = each.withColumn("found", F.when(more, F.array_append("found", F.col("whole"))).otherwise(F.col("found")))
    confirmed, sure, alone = F.size("found"), F.col("whole").isNotNull(), F.col("n_lines") == 0  # alone: what it names is itself wrapped
    sentence = each.select(
        "u_id", confirmed.alias("confirmed"), F.when(sure, confirmed).otherwise(F.greatest("n_lines", F.lit(1))).alias("candidates"),
        F.when(sure, 0).when(alone, F.col("n_all_unknown")).otherwise(F.col("n_line_unknown")).alias("unknown"),
        F.transform("found", lambda x: x["family"]).alias("families"), F.array_max(F.transform("found", lambda x: F.struct(x["probability"].alias("probability"), x["family"].alias("family")))).alias("best"),
    )
    each = sentence.groupBy("u_id").agg(
        F.sum("candidates").alias("n_candidates"), F.sum("confirmed").alias("n_confirmed"), F.sum("unknown").alias("n_unknown"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.flatten(F.collect_set("families"))))).alias("families"), F.max("best").alias("best"),
    )
    ids = df.select(doc_id).distinct()
    joined = ids.join(each, ids[doc_id].eqNullSafe(each["u_id"]), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        doc_id, zero("n_candidates"), F.coalesce("families", F.lit("")).alias("families"), zero("n_confirmed"), zero("n_unknown"),
        F.col("best.family").alias("best_family"), F.col("best.probability").alias("best_probability"),
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
