"""Licence scan of paragraphs.

A trained classifier names the licence family of a paragraph: multinomial logistic regression with an
L1 penalty over indicators of word n-grams (one to three words). Only n-grams that hold a cue word are
features, so the model is sparse and a paragraph without any cue word has no feature: it belongs to no
family whatever the rest of it says, and is passed over exactly, not approximately. Probabilities are
tempered, and the bound under which a statement counts as ``unknown`` is calibrated, on families and
statements that the fit had not seen. A prediction stands only if the paragraph shares enough word
pairs with a template of that family; else it is ``unknown``.

The model is fitted by the driver from the templates below alone, never from the corpus. Scanning is
DataFrame functions only: equal paragraphs are classified once, their n-grams meet the weights, a table
of the model's fixed size, by broadcast.

Words are runs of letters and digits in lower case; acronyms lose a version that is written to them
(GPLv3 is gpl). The one word whose case counts is MIT, which is a common word in lower case.

Defined cases: a paragraph is a line, with the lines after it where it is broken in the middle of a
sentence (a letter, digit, comma or semicolon before the break, a small letter after it); a null text has no
paragraph, an empty text neither; a very long line is one paragraph; rows that share an id are one
document with the paragraphs of all their texts; a null id is such an id; of equally sure families the
one with the greater similarity, then the later name counts; other columns are ignored, whatever their
names; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import column, dropped, hot_join, written

NONE, UNKNOWN = "none", "unknown"

# Names and statements of public licences.
NAMES: dict[str, list[str]] = {
    "apache": ["Apache License, Version 2.0", "Apache 2.0 License", "Apache License 2.0", "Apache-2.0 license", "Apache Software License"],
    "mit": ["MIT License", "MIT licence", "terms of the MIT License", "MIT/X11 License", "MIT"],
    "bsd": ["BSD License", "3-clause BSD License", "2-clause BSD License", "New BSD License", "BSD-style license", "BSD-3-Clause", "BSD-2-Clause", "BSD"],
    "gpl": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL license v3", "GPLv3 license", "GNU GPL", "GPL", "GPL-3.0-only"],
    "lgpl": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "LGPL license", "GNU LGPL", "LGPL", "LGPL-2.1-or-later"],
    "agpl": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "AGPL license", "GNU AGPL", "AGPL", "AGPL-3.0-only"],
    "mpl": ["Mozilla Public License", "Mozilla Public License, v. 2.0", "MPL 2.0 license", "MPL", "MPL-2.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC-SA 4.0 license", "Creative Commons BY-NC license"],
    "cc-by-sa": ["CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 3.0 license"],
    "cc-by": ["CC BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 3.0 license"],
    "public-domain": ["CC0 1.0 Universal public domain dedication", "Creative Commons CC0 license", "Unlicense"],
    "proprietary": ["proprietary license", "commercial license agreement", "end user license agreement"],
}
STATEMENTS: dict[str, list[str]] = {
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Licensed to the Software Foundation under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This program is distributed in the hope that it will be useful; see the GNU General Public License for more details.",
    ],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "agpl": ["you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
    "cc-by-nc": ["You may not use the material for commercial purposes under the Creative Commons Attribution NonCommercial license"],
    "cc-by-sa": ["If you remix, transform, or build upon the material, you must distribute your contributions under the same Creative Commons ShareAlike license as the original"],
    "cc-by": ["You must give appropriate credit, provide a link to the Creative Commons license, and indicate if changes were made"],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "has waived all copyright and related rights and dedicated the work to the public domain"],
    "proprietary": ["Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission of the copyright holder", "Unauthorized copying of this file, via any medium is strictly prohibited. Proprietary and confidential. All rights reserved"],
}
FRAMES = ["{}", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}, see the file.", "The code is available under the {}.", "License: {}", "distributed under {}", "SPDX-License-Identifier: {}"]
#: Sentences with cue words that grant nothing.
OTHER = [
    "She passed the test and got her driving licence in spring.", "The city issued a license to the taxi driver.", "The fishing license costs ten euros a year.", "A licensed electrician must check the wiring.",
    "The album was released under a new label.", "They asked for permission to leave the room.", "Permission was denied by the court.", "The warranty covers repairs for two years.", "The copyright dispute went to trial.",
    "Public debate about the domain name went on.", "The general public may visit the garden.", "Apache helicopters flew over the valley.", "MIT researchers published a study of the sea.", "Mozilla opened an office in Berlin.",
    "The software was redistributed to schools.", "His creative work was common in those days.", "The gnu is a large antelope.", "The bar lost its liquor license.", "The pilot holds a commercial license.", "License plates were changed in the state.",
    "Attribution of the painting is not certain.", "Terms of the agreement were not disclosed.", "All members reserved their seats.", "The unauthorized biography sold well.", "Version 2.0 of the engine is faster.",
    "Please answer with a cc to the whole team.", "The permit of the public library was renewed.", "All rights of way were restored in the valley.", "The common creative process took years.", "Copyright law is taught in the third year.",
    "The MIT campus lies on the river.", "Public rights and duties are set out in the constitution.", "Permission to land was given at noon.", "The proprietary recipe stayed in the family.", "The BSD marathon was cancelled.",
]
FILLER = ["the river ran past the old mill", "prices rose again in the second quarter", "no one had seen the letter before", "we walked home in the rain"]
#: Word beginnings that a licence statement cannot do without, and acronyms, which may carry a version.
CUES = ("licen", "copyright", "permi", "redistribut", "public", "rights", "unlicense", "creative", "apache", "mozilla", "commons", "proprietary", "unauthorized")
VERSIONED = "agpl|lgpl|gpl|mpl|bsd|gnu|spdx"
PLAIN = "cc0|cc"

GRAMS = 3
PENALTY = 5e-5
ROUNDS = 250
#: Statements of known families, left out of the fit, that the bound keeps.
KEPT = 0.99
#: Probability of no licence under which a paragraph with cue words is unknown.
NONE_LEAST = 0.4
#: Word pairs that a paragraph must share with a template, of those of the smaller.
SIMILAR = 0.6
WORD = r"[\p{L}\p{N}]+"


#: A cue among prepared words; and in a line as it stands.
CUE_WORD = rf"^(?:MIT|{VERSIONED}|{PLAIN}|(?:{'|'.join(CUES)}).*)$"
CUE_LINE = rf"(?<![\p{{L}}\p{{N}}])(?:MIT(?![\p{{L}}\p{{N}}])|(?i:(?:(?:{VERSIONED})(?:v?[0-9]+)?|{PLAIN})(?![\p{{L}}\p{{N}}])|{'|'.join(CUES)}))"
VERSION = rf"^({VERSIONED})v?[0-9]+$"
#: A line break in the middle of a sentence.
WRAP = r"\n(?<=[\p{L}\p{N},;]\n)[ \t]*(?=\p{Ll})"
_CUE, _VERSION = re.compile(CUE_WORD), re.compile(VERSION)


def _is_cue(word: str) -> bool:
    return _CUE.match(word) is not None


def _words(text: str) -> list[str]:
    return ["MIT" if w == "MIT" else _VERSION.sub(r"\1", w.lower()) for w in re.findall(r"[^\W_]+", text)]


def _grams(words: list[str]) -> set[str]:
    spans = [words[i : i + n] for n in range(1, GRAMS + 1) for i in range(len(words) - n + 1)]
    return {" ".join(s).lower() for s in spans if any(map(_is_cue, s))}


def _samples() -> list[tuple[str, int, str]]:
    """(class, group that is left out together, text) of the training statements."""
    out = []
    for family in NAMES:
        for i, name in enumerate(NAMES[family]):
            out += [(family, k, frame.format(name)) for k, frame in enumerate(FRAMES)]
            out += [(family, i, f"{FILLER[i % 4]}. Licensed under the {name}"), (family, i + 1, name.lower()), (family, i + 2, f"under the {name.lower()}")]
        for i, text in enumerate(STATEMENTS[family]):
            words = text.split()
            out += [(family, i, text), (family, i + 1, f"{FILLER[i % 4]} {text}")]
            out += [(family, i + k, " ".join(words[a : a + n])) for k, n in ((2, 10), (1, 18)) for a in range(0, max(1, len(words) - n + 5), n // 2)]
    out += [(NONE, i, text) for i, text in enumerate(OTHER)]
    out += [(NONE, i, f"{a} {b}") for i, (a, b) in enumerate(zip(OTHER, OTHER[3:] + OTHER[:3], strict=True))]
    return out


@dataclass
class Model:
    classes: list[str]
    grams: dict[str, int]
    weights: np.ndarray  # n-grams x classes
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.5  # probability under which a family is unknown
    passed: float = 0.0  # statements of unseen families that pass for a known one

    def probabilities(self, text: str) -> np.ndarray:
        at = [self.grams[g] for g in _grams(_words(text)) if g in self.grams]
        z = (self.weights[at].sum(axis=0) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()


def _fit(samples: list[tuple[str, int, str]]) -> Model:
    """Proximal gradient descent with momentum on the mean log loss and an L1 penalty."""
    classes = sorted({s[0] for s in samples})
    rows = [_grams(_words(s[2])) for s in samples]
    grams = {g: i for i, g in enumerate(sorted(set().union(*rows)))}
    x = np.zeros((len(rows), len(grams) + 1))
    for i, r in enumerate(rows):
        x[i, [grams[g] for g in r]] = 1
    x[:, -1] = 1
    y = np.zeros((len(rows), len(classes)))
    y[np.arange(len(rows)), [classes.index(s[0]) for s in samples]] = 1
    share = (1 / y.sum(axis=0))[y.argmax(axis=1)]
    share /= share.sum()  # every class weighs the same
    step = 1 / (0.5 * np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2)
    w = np.zeros((x.shape[1], len(classes)))
    ahead, t = w, 1.0
    for _ in range(ROUNDS):
        z = x @ ahead
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = ahead - step * (x.T @ ((p - y) * share[:, None]))
        new[:-1] = np.sign(new[:-1]) * np.maximum(0, np.abs(new[:-1]) - step * PENALTY)
        t, last = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        ahead, w = new + (last - 1) / t * (new - w), new
    used = np.nonzero(np.abs(w[:-1]).max(axis=1) > 0)[0]
    names = list(grams)
    return Model(classes, {names[g]: i for i, g in enumerate(used)}, w[used], w[-1])


@lru_cache(1)
def trained() -> Model:
    """The calibrated model. Its temperature and bound come from statements and families left out of the fit."""
    samples = _samples()
    model = _fit(samples)
    seen, strange, families = [], [], list(NAMES)  # (model that has not seen it, text, family)
    for fold in range(3):
        away = set(families[fold::3])
        part = _fit([s for s in samples if s[0] not in away and s[1] % 3 != fold])
        for family, group, text in samples:
            if family in away:
                strange.append((part, text))
            elif group % 3 == fold:
                seen.append((part, text, family))

    def loss(temperature: float) -> float:
        total = 0.0
        for part, text, family in seen:
            part.temperature = temperature
            total -= np.log(max(1e-9, part.probabilities(text)[part.classes.index(family)]))
        return total

    model.temperature = min((0.25, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0), key=loss)

    def top(part: Model, text: str) -> tuple[str, float]:
        part.temperature = model.temperature
        p = part.probabilities(text)
        return part.classes[int(p.argmax())], float(p.max())

    right = [p for part, text, family in seen if family != NONE for name, p in [top(part, text)] if name == family and resembles(text, name) >= SIMILAR]
    wrong = [p for part, text in strange for name, p in [top(part, text)] if name != NONE and resembles(text, name) >= SIMILAR]
    # The bound keeps KEPT of the statements of known families; passed: what it lets through of unseen ones.
    model.least = float(np.clip(np.quantile(right, 1 - KEPT), 0.4, 0.8))
    model.passed = float(np.sum(np.array(wrong) >= model.least) / max(1, len(strange)))
    return model


def _templates() -> list[tuple[str, int, str]]:
    """(family, number, text) that predictions are compared with."""
    out = []
    for family in NAMES:
        texts = [*STATEMENTS[family], *NAMES[family], *(f.format(n) for n in NAMES[family] if len(_words(n)) < 4 for f in ("under the {}", "under {}", "License: {}", "{} license", "SPDX-License-Identifier: {}"))]
        out += [(family, i, t) for i, t in enumerate(texts) if len(_words(t)) > 1]
    return out


def _pairs(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + 2]).lower() for i in range(len(words) - 1)}


@lru_cache(1)
def _template_pairs() -> list[tuple[str, int, frozenset[str]]]:
    return [(family, i, frozenset(_pairs(_words(t)))) for family, i, t in _templates()]


def resembles(text: str, family: str) -> float:
    """The largest part of word pairs, of the smaller side's, that a text shares with a template of the family."""
    own = _pairs(_words(text))
    return max((len(own & other) / min(len(own), len(other)) for name, _, other in _template_pairs() if name == family and own), default=0.0)


def judge(text: str, model: Model) -> tuple[str, float, float]:
    """Verdict, probability and similarity of one paragraph, in Python."""
    p = model.probabilities(text)
    top = max(range(len(p)), key=lambda i: (p[i], model.classes[i]))
    name, sure = model.classes[top], float(p[top])
    close = resembles(text, name) if name != NONE else 0.0
    if name == NONE:
        return (NONE if sure >= NONE_LEAST else UNKNOWN), sure, close
    return (name if sure >= model.least and close >= SIMILAR else UNKNOWN), sure, close


def _cued_grams(words: str) -> Column:
    """The distinct n-grams of an array of words that hold a cue word: those around its cue words."""
    at = F.filter(F.transform(words, lambda w, i: F.when(w.rlike(CUE_WORD), i)), lambda i: i.isNotNull())

    def around(p: Column) -> Column:
        spans = [(start, n) for n in range(1, GRAMS + 1) for start in range(-n + 1, 1)]
        gram = lambda start, n: F.when((p + start >= 0) & (p + start + n <= F.size(words)), F.lower(F.array_join(F.array(*[F.get(words, p + start + k) for k in range(n)]), " ")))
        return F.filter(F.array(*[gram(*x) for x in spans]), lambda g: g.isNotNull())

    return F.array_distinct(F.flatten(F.transform(at, around)))


def _word_pairs(words: str) -> Column:
    """The distinct pairs of neighbouring words."""
    return F.array_distinct(F.filter(F.transform(words, lambda w, i: F.lower(F.concat(w, F.lit(" "), F.get(words, i + 1)))), lambda g: g.isNotNull()))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row per document: id, n_paragraphs (with a word), n_cued, families, family, confidence, similarity, n_unknown.

    family is the surest confirmed one, ``unknown`` if there are only statements that nothing confirms,
    else ``none``; families lists all confirmed ones.
    """
    model = model or trained()
    spark = df.sparkSession
    cue = CUE_LINE
    text = F.regexp_replace(F.coalesce(column(text_col), F.lit("")), WRAP, " ")
    unwrapped = df.select(column(id_col).alias("_id"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD))
    cued = F.when(F.col("_text").rlike(cue), F.filter("_lines", lambda x: x.rlike(cue))).otherwise(F.array().cast("array<string>"))
    docs = unwrapped.select("_id", "_text", lines.alias("_lines")).select("_id", F.size("_lines").alias("n_paragraphs"), cued.alias("_cued"))
    docs = written(docs, "cued-paragraphs")
    plain = F.transform(F.regexp_extract_all("line", F.lit(f"({WORD})"), 1), lambda w: F.when(w == "MIT", w).otherwise(F.regexp_replace(F.lower(w), VERSION, "$1")))
    norm = F.array_join(plain, " ")
    lines_of = docs.filter(F.size("_cued") > 0).select("_id", F.explode("_cued").alias("line")).select("_id", norm.alias("norm"))
    lines_of = written(lines_of, "cued-lines")
    # Written with its words, or Spark would split the line anew for every word that a lambda looks at.
    distinct = written(lines_of.groupBy("norm").agg(F.count(F.lit(1)).alias("lines")).withColumn("words", F.split("norm", " ")), "distinct-lines")

    weights = spark.createDataFrame([(g, [float(x) for x in model.weights[i]]) for g, i in model.grams.items()], "gram string, w array<double>")
    grams = distinct.select("norm", F.explode(_cued_grams("words")).alias("gram")).join(F.broadcast(weights), "gram")
    sums = grams.groupBy("norm").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"z{i}") for i in range(len(model.classes))])
    scores = distinct.select("norm").join(sums, "norm", "left")
    z = [(F.coalesce(f"z{i}", F.lit(0.0)) + float(b)) / model.temperature for i, b in enumerate(model.bias)]
    scores = scores.select("norm", F.array(*z).alias("z")).withColumn("e", F.transform("z", lambda x: F.exp(x - F.array_max("z"))))
    best = F.array_max(F.transform("e", lambda e, i: F.struct(e.alias("e"), F.get(F.lit(model.classes), i).alias("name"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, b: a + b)
    named = scores.select("norm", best["name"].alias("name"), (best["e"] / total).alias("p"))

    pairs = sorted((family, i, pair) for family, i, found in _template_pairs() for pair in found)
    sizes = {}
    for family, i, _ in pairs:
        sizes[family, i] = sizes.get((family, i), 0) + 1
    shapes = spark.createDataFrame([(f, i, g, sizes[f, i]) for f, i, g in pairs], "name string, template int, gram string, size int")
    claims = written(named, "licence-claims")
    own = claims.filter(F.col("name") != NONE).join(distinct, "norm").select("norm", _word_pairs("words").alias("pairs")).select("norm", F.size("pairs").alias("n"), F.explode("pairs").alias("gram"))
    shared = own.join(F.broadcast(shapes), "gram").groupBy("norm", "name", "template", "n", "size").agg(F.count(F.lit(1)).alias("both"))
    close = shared.groupBy("norm", "name").agg(F.max(F.col("both") / F.least("n", "size")).alias("similarity"))
    judged = claims.join(close, ["norm", "name"], "left").withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))
    verdict = F.when((F.col("name") == NONE) & (F.col("p") >= NONE_LEAST), F.lit(NONE)).when((F.col("name") != NONE) & (F.col("p") >= model.least) & (F.col("similarity") >= SIMILAR), F.col("name")).otherwise(F.lit(UNKNOWN))
    judged = judged.join(distinct.select("norm", "lines"), "norm").select("norm", "lines", verdict.alias("family"), F.round("p", 6).alias("confidence"), F.round("similarity", 6).alias("similarity"))
    judged = written(judged, "licence-verdicts")
    dropped(claims, distinct)

    sure = F.when(~F.col("family").isin(NONE, UNKNOWN), F.struct("confidence", "similarity", "family"))
    per_doc = hot_join(lines_of, judged, "norm", "lines", F.col("_id"), lines_of.count()).groupBy("_id").agg(F.max(sure).alias("top"), F.sort_array(F.collect_set(F.when(~F.col("family").isin(NONE, UNKNOWN), F.col("family")))).alias("families"), F.count_if(F.col("family") == UNKNOWN).alias("n_unknown"))
    counts = docs.groupBy("_id").agg(F.sum("n_paragraphs").alias("n_paragraphs"), F.sum(F.size("_cued")).cast("long").alias("n_cued"))
    out = counts.join(per_doc, counts["_id"].eqNullSafe(per_doc["_id"]), "left").select(counts["_id"].alias(id_col), "n_paragraphs", "n_cued", "top", "families", "n_unknown")
    return out.select(
        id_col, F.col("n_paragraphs").cast("long").alias("n_paragraphs"), "n_cued",
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("top.family", F.when(F.col("n_unknown") > 0, F.lit(UNKNOWN)).otherwise(F.lit(NONE))).alias("family"),
        "top.confidence", "top.similarity", F.coalesce("n_unknown", F.lit(0)).cast("long").alias("n_unknown"),
    )

