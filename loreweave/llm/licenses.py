"""Licence scans: paragraphs, classified by a sparse word n-gram logistic regression and confirmed against templates.

A paragraph is a run of lines of which each but the last breaks off inside a sentence (it does not end with . ! ? : or ;), so a
wrapped statement is one paragraph; a blank line always ends one. Paragraphs of more than `window` words are scored in windows
that overlap by half. The weights of a window's distinct 1- to 3-grams are summed per family and turned into probabilities.
Training holds statements made from names and frames, statements that name no licence, and, for the class unknown, prose with
licence words and statements with names of no known licence; the temperature is fitted on names, frames and prose that training
does not hold. Whatever stays under `least` probability is unknown. A prediction is confirmed if the window holds `overlap` of
the words of one of its family's templates. The weights are a small broadcast table.

Which paragraphs are scored follows from the weights: `triggers` is a set of words without which no paragraph can score a family
over unknown, whatever else it holds (the sum of all other positive differences of weights is less than the bias of unknown).

Only DataFrame functions run on the executors. Defined results: a null or empty text has no paragraphs; very long texts are read
whole; of windows with equal probability the first counts, of families with equal scores the first by name; rows repeated are
separate rows; null ids are kept; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.llm.common import literal_table, materialize, text_of

UNKNOWN = "unknown"
#: Families, and the ways their licences are named. Every fourth name is left out of training and serves calibration.
NAMES = {
    "apache-2.0": ("the Apache License, Version 2.0", "Apache License 2.0", "the Apache 2.0 license", "the Apache License Version 2.0, January 2004", "Apache-2.0", "Apache 2", "the Apache Software License 2.0", "the Apache License v2.0"),
    "mit": ("the MIT License", "an MIT license", "the MIT License (MIT)", "the terms of the MIT License", "MIT", "the Expat MIT License", "the MIT licence", "an MIT-style license"),
    "gpl-3.0": ("the GNU General Public License, version 3", "the GNU GPL v3", "GPL-3.0-or-later", "version 3 of the GNU General Public License", "GPLv3", "the GNU General Public License v3.0", "the GNU General Public License", "the GNU GPL version 3", "the GPL, version 3", "GPL-3.0-only", "GNU GPL 3"),
    "gpl-2.0": ("the GNU General Public License, version 2", "the GNU GPL v2", "GPL-2.0-only", "version 2 of the GNU General Public License", "GPLv2", "the GNU General Public License v2.0", "GPL-2.0-or-later", "the GNU GPL version 2", "the GPL, version 2"),
    "agpl-3.0": ("the GNU Affero General Public License, version 3", "the GNU AGPL v3", "AGPL-3.0-or-later", "the GNU Affero General Public License", "AGPLv3", "the Affero GPL", "AGPL-3.0-only", "the AGPL, version 3"),
    "lgpl": ("the GNU Lesser General Public License", "LGPL-3.0", "the LGPL version 2.1", "the GNU Lesser General Public License, version 3", "LGPLv3", "LGPL-2.1-or-later", "the GNU LGPL", "the LGPL"),
    "bsd": ("the BSD 3-Clause License", "the BSD 2-Clause License", "a BSD-style license", "BSD-3-Clause", "the New BSD License", "the BSD license", "the Simplified BSD License", "BSD-2-Clause"),
    "mpl-2.0": ("the Mozilla Public License, v. 2.0", "the Mozilla Public License Version 2.0", "MPL-2.0", "the MPL 2.0", "MPLv2", "the Mozilla Public License", "MPL 2.0", "the MPL, version 2.0"),
    "epl-2.0": ("the Eclipse Public License 2.0", "EPL-2.0", "the Eclipse Public License v2.0", "the Eclipse Public License, version 2.0", "EPLv2", "the EPL 2.0", "the Eclipse Public License", "the Eclipse Public License - v 2.0"),
    "isc": ("the ISC License", "ISC", "the ISC licence", "the ISC license (ISC)"),
    "boost-1.0": ("the Boost Software License, Version 1.0", "BSL-1.0", "the Boost License", "the Boost Software License 1.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "CC-BY-NC-SA-4.0", "CC BY-NC 3.0", "CC BY-NC-SA 4.0", "the Creative Commons Attribution NonCommercial license", "CC BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "cc-by-sa": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "CC-BY-SA-3.0", "CC BY-SA 3.0", "the Creative Commons Attribution ShareAlike license", "CC BY-SA", "Creative Commons Attribution-ShareAlike 3.0"),
    "cc-by": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "CC BY", "CC-BY-4.0", "the Creative Commons Attribution License", "CC BY 3.0", "Creative Commons Attribution 4.0"),
    "public-domain": ("CC0 1.0 Universal", "the Unlicense", "the CC0 public domain dedication", "CC0-1.0", "CC0", "the CC0 1.0 license"),
    UNKNOWN: (
        "the Zorp License", "the Acme Public License, version 1.0", "FOO-1.0", "our own license", "the Example Source License", "the terms of the contract", "version 4 of the Widget License", "a commercial license", "XYZ 2.0", "the Harbor License 3.0",
        "the Acme International License", "a special agreement", "the Northern Lights Community License", "QPR-2.1", "the treaty", "a license of the city", "a General License", "the Software License of the firm", "the Public Source License 2.0", "the 4.0 plan",
    ),
}
#: Sentences around a name; every fifth is left out of training.
FRAMES = (
    "Licensed under {}.", "Released under {}.", "This work is licensed under {}.", "This program is distributed under the terms of {}.", "This file is covered by {}.",
    "Distributed under {}, see the file LICENSE.", "SPDX-License-Identifier: {}", "The source code is available under {}.", "You may use this file only in compliance with {}.", "It may be used under the terms of {}.",
    "License: {}", "This software is free under {}.", "The text is made available under {}.",
)
#: Whole statements that name no licence, by family.
STATEMENTS = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    ),
    "gpl-3.0": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.",),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or any later version.",),
    "apache-2.0": ("you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "public-domain": ("This is free and unencumbered software released into the public domain.", "This work has been dedicated to the public domain."),
    "proprietary": (
        "All rights reserved.", "Copyright 2020 Example Inc. All rights reserved.", "No part of this publication may be reproduced without prior written permission; all rights reserved.",
        "(c) 2019 the authors, all rights reserved worldwide.", "Unauthorized copying is strictly prohibited, all rights reserved.",
    ),
}
#: Prose with words of licences; every fourth sentence is left out of training.
PROSE = (
    "He lost his driving license last year.", "A license to fish costs ten dollars.", "The software was slow and the license fee too high.", "They discussed the rights of workers and the public domain of ideas.",
    "The version of the story told in 2004 was released under pressure.", "See the general public at the license office.", "An apache helicopter flew over the commons.", "She studied at MIT and wrote software.",
    "The creative work of the commons committee was reserved for later.", "Copyright law has changed many times.", "Mozilla released a new version of the browser.", "The license plate was stolen under the bridge.",
    "The permission was granted by the general.", "Attribution of the work is open to question.", "Section 3 of the report covers licenses for taxis.", "A commercial license is sold by the city.",
    "Rights and duties are listed in version 2.0 of the plan.", "The BSD group met on Monday.", "We use software under license from a vendor.", "No warranty was offered with the car.",
    "Under the terms of the treaty, rights were reserved for the crown.", "The copyright office opens at nine.", "All seats were reserved, and all rights of way were closed.", "A copy of the file was found in the notice of the court.",
    "This program was on the air for the first time in 1997.", "The moon hid the sun; it was an eclipse seen by the public.", "You may use the room with the permission of the owner.", "The source of the river is free to any person who walks there.",
    "Any later version of the text is lost.", "The above conditions were met by the team.", "He wrote that this work is made for the public.", "The list of copies is in the documentation of the museum.",
    "GNU is an animal of the plains.", "The foundation published the terms of the sale.", "Boost the signal and use the second version.", "It is available in the shop at the corner, and the price is 4.0 or 3.0.",
    "The word was in the file, and in the end it was of no use.", "With or without fee, the purpose of the copy was clear.", "Der Vertrag gilt mit der Lizenz der Stadt.", "La licence de pêche est dans le bureau du maire.",
    "La licencia de pesca es de la ciudad.", "Er kam mit dem Hund und mit der Karte.", "Das ist mit Absicht so, mit oder ohne Geld.", "Wir gehen mit.", "Ein Haus mit Garten.", "Sie sprach mit ihm.", "This is the part of the work that is to be done.", "The city at the mouth of the river is covered by snow.", "International trade is a creative business.",
    "The distribution of grain was restricted, provided that the harvest failed.", "She may obtain a copy at the office.", "In compliance with the law, the binary star was named.", "The universal joint and the simplified form were new.",
)
TOKEN = r"[a-z0-9]+(?:[.][0-9]+)*"


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)}


def tokens(text: str) -> list[str]:
    return re.findall(TOKEN, text.lower())


#: Function words; a gram of nothing else tells no licence.
STOP = frozenset("a an and any as at be by for from in is it may of on only or out see that the this to under was with without you your all not no has have are been".split())


def training_table() -> list[tuple[str, str, bool]]:
    """(family, statement, held out for calibration), each statement once. A held-out one has a name or frame that no other has."""
    out: dict[tuple[str, str], bool] = {}
    for family, names in NAMES.items():
        for i, name in enumerate(names):
            out |= {(family, frame.format(name)): i % 4 == 3 or j % 5 == 4 for j, frame in enumerate(FRAMES)}
    for family, own in STATEMENTS.items():
        out |= {(family, s): False for s in own}
    out |= {(UNKNOWN, s): k % 4 == 3 for k, s in enumerate(PROSE)}
    return [(f, s, h) for (f, s), h in out.items()]


def templates() -> list[tuple[str, list[str]]]:
    """(family, distinct words of a template)."""
    out = [(f, sorted(set(tokens(name)) - {"the", "a", "an", "of", "terms"})) for f, names in NAMES.items() if f != UNKNOWN for name in names]
    out = [(f, t) for f, t in out if len(t) > 1 or len(t[0]) > 3]
    return [*out, *((f, ["all", "reserved", "rights"] if f == "proprietary" else sorted(set(tokens(s)))) for f, own in STATEMENTS.items() for s in own)]


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    weights: dict  # gram -> a weight for each family
    bias: tuple[float, ...]
    temperature: float

    def probabilities(self, words: list[str]) -> np.ndarray:
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in grams(words) if g in self.weights), np.zeros(len(self.bias)))
        p = np.exp((z - z.max()) / self.temperature)
        return p / p.sum()


def train(table: list[tuple[str, str, bool]], rounds: int = 200, rate: float = 2.0, lasso: float = 2e-4) -> tuple[Model, float]:
    """Proximal gradient on the cross entropy, the temperature by a grid on the held-out statements; and the accuracy there."""
    families = tuple(sorted({f for f, *_ in table}))
    sets = [grams(tokens(s)) for _, s, _ in table]
    y, held = np.array([families.index(f) for f, *_ in table]), np.array([h for *_, h in table])
    count: dict[str, int] = defaultdict(int)
    for s, h in zip(sets, held, strict=True):
        for g in () if h else s:
            count[g] += 1
    vocabulary = {g: k for k, g in enumerate(sorted(g for g, n in count.items() if (n >= 2 or " " not in g) and not STOP.issuperset(g.split())))}
    x = np.zeros((len(table), len(vocabulary)))
    for k, s in enumerate(sets):
        x[k, [vocabulary[g] for g in s if g in vocabulary]] = 1
    share = 1 / np.maximum(np.bincount(y[~held], minlength=len(families)), 1)
    share[families.index(UNKNOWN)] *= 3
    whole = {s for own in STATEMENTS.values() for s in own}
    mass = share[y] * np.array([12 if s in whole else 1 for _, s, _ in table])  # a whole statement is one among many that name its licence
    mass /= mass[~held].sum()
    w, b = np.zeros((len(vocabulary), len(families))), np.zeros(len(families))
    for _ in range(rounds):
        z = x[~held] @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(p)), y[~held]] -= 1
        p *= mass[~held, None]
        w -= rate * x[~held].T @ p
        w = np.sign(w) * np.maximum(np.abs(w) - rate * lasso, 0)
        b -= rate * p.sum(0)
    z = x[held] @ w + b
    loss = {}
    for t in np.geomspace(0.1, 4, 31):
        q = z / t
        loss[float(t)] = float(np.mean(np.logaddexp.reduce(q, axis=1) - q[np.arange(len(q)), y[held]]))
    kept = {g: tuple(float(v) for v in w[k]) for g, k in vocabulary.items() if np.abs(w[k]).sum() > 0}
    return Model(families, kept, tuple(float(v) for v in b), min(loss, key=loss.get)), float((z.argmax(1) == y[held]).mean())


@cache
def default_model() -> Model:
    return train(training_table())[0]


def triggers(model: Model) -> list[str] | None:
    """Words of which a paragraph must hold one to score any family over unknown; None if the weights allow no such set.

    Words (none of them a function word) are added, the most telling first, until for every family the bias and all differences of weights that remain, taken
    where they favour the family, are less than nothing.
    """
    u = model.families.index(UNKNOWN)
    left = {g: np.maximum(np.array(w) - w[u], 0) for g, w in model.weights.items()}
    base = np.array(model.bias) - model.bias[u]
    base[u] = -np.inf
    out: list[str] = []
    while ((base + sum(left.values())) >= 0).any():
        open_ = (base + sum(left.values())) >= 0
        gain: dict[str, float] = defaultdict(float)
        for g, d in left.items():
            for word in set(g.split()) - STOP:
                gain[word] += float(d[open_].sum())
        best = max(sorted(gain), key=gain.get, default=None)
        if best is None:
            return None
        out.append(best)
        left = {g: d for g, d in left.items() if best not in g.split()}
    return sorted(out)


def gate(model: Model) -> Column:
    """May a lower-case text hold a trigger?"""
    words = triggers(model)
    if words is None:
        return F.lit(True)
    return F.col("text").rlike(rf"(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in words)})(?![a-z0-9])")


#: A line end inside a sentence: no end mark before it, and text on the next line.
WRAP = r"([^.!?:;\x20\x09-\x0D])[\x20\x09\x0B-\x0D]*\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"


def paragraphs(docs: DataFrame, model: Model, id_col: str, text_col: str) -> DataFrame:
    """row, id, found: (place, text in lower case) of the paragraphs that hold a trigger; place counts a text's paragraphs. Written out."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.lower(text_of(text_col)).alias("text"))
    may = gate(model)
    parts = F.split(F.regexp_replace("text", WRAP, "$1 "), "\n")
    rows = rows.select("row", "id", F.when(may, parts).alias("parts"))
    words = triggers(model)
    hit = F.transform("parts", lambda x, i: F.struct(i.alias("place"), x.alias("text")))
    if words is not None:
        pattern = rf"(?<![a-z0-9])(?:{'|'.join(re.escape(w) for w in words)})(?![a-z0-9])"
        hit = F.filter(hit, lambda s: s["text"].rlike(pattern))
    return materialize(rows.select("row", "id", hit.alias("found")), "paragraphs")


def windows(found: DataFrame, window: int) -> DataFrame:
    """row, place, at, words: the words of each paragraph (row, place, text), or of its windows, which overlap by half."""
    split = found.select("row", "place", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)).alias("all"))
    step = window // 2
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - step - 1), F.lit(step))
    cut = split.select("row", "place", "all", F.explode(starts).alias("at"))
    return cut.select("row", "place", "at", F.slice("all", F.col("at") + 1, F.lit(window)).alias("words"))


def classify(found: DataFrame, model: Model, least: float = 0.5, overlap: float = 0.8, window: int = 120) -> DataFrame:
    """row, place, family, probability, confirmed of every paragraph in found (row, place, text) that is not unknown."""
    spark, k = found.sparkSession, range(len(model.families))
    weights = literal_table(spark, [{"gram": g} | {f"w{i}": v[i] for i in k} for g, v in model.weights.items()], ",".join(["gram:string", *(f"w{i}:double" for i in k)]))
    split = windows(found, window)
    pairs = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1)))
    triples = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 2, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get("words", i + 1), F.get("words", i + 2)))
    exploded = split.select("row", "place", "at", F.explode(F.array_distinct(F.concat("words", pairs, triples))).alias("gram"))
    sums = exploded.join(F.broadcast(weights), "gram").groupBy("row", "place", "at").agg(*(F.sum(f"w{i}").alias(f"s{i}") for i in k))  # weights: the training vocabulary
    logit = [(F.col(f"s{i}") + model.bias[i]) / model.temperature for i in k]
    scored = sums.select("row", "place", "at", F.array(*logit).alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("top")))
    names = F.array(*(F.lit(f) for f in model.families))
    scored = scored.select("row", "place", "at", F.get(names, F.array_position("z", F.col("top")).cast("int") - 1).alias("family"), (1 / total).alias("probability"))
    scored = scored.where((F.col("family") != UNKNOWN) & (F.col("probability") >= least))
    shapes = literal_table(spark, [{"family": f, "template": t} for f, t in templates()], "family:string,template:array<string>")
    both = scored.join(split, ["row", "place", "at"]).join(F.broadcast(shapes), "family")  # a few templates a family
    share = F.size(F.array_intersect("template", "words")) / F.size("template")
    sure = both.groupBy("row", "place", "at", "family", "probability").agg((F.max(share) >= overlap).alias("confirmed"))
    best = F.max_by(F.struct("family", "probability", "confirmed"), F.struct("confirmed", "probability", -F.col("at")))
    return sure.groupBy("row", "place").agg(best.alias("b")).select("row", "place", "b.*")


def scan(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, licences (array of place, family, probability, confirmed, by place)."""
    model = model or default_model()
    rows = paragraphs(docs, model, id_col, text_col)
    found = rows.where("size(found) > 0").select("row", F.inline("found"))
    own = classify(found, model).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "family", "probability", "confirmed"))).alias("licences"))
    none = F.array().cast("array<struct<place:int,family:string,probability:double,confirmed:boolean>>")
    return rows.select("row", "id").join(own, "row", "left").select(F.col("id").alias(id_col), F.coalesce("licences", none).alias("licences"))
