"""License scans (7): licence families of paragraphs, by a trained classifier that templates confirm.

A paragraph is a line, or lines joined: a text is cut at blank lines, after lines that end a sentence and at
COLD or more lines without licence words, and what is left between in several lines is one paragraph too, so a
notice counts however it is wrapped.  Paragraphs are classed by multinomial logistic regression over their
distinct words and word pairs.  The model is trained on the driver from the template list below: variants with
words left out and with words around them teach the families; lines of the corpus (a bounded sample) and
sentences that only mention licences teach "other", and grants under made-up names teach "unknown".  An L1
penalty keeps few weights.  Half of all variants are kept back: on them a temperature calibrates the
probabilities, and "unknown" also takes a paragraph for which no class reaches THRESHOLD.  A family counts as
confirmed if a template of it shares at least CONFIRM of its words and pairs with the paragraph, and CONFIRM of those that
no other family's templates have; if all words of the template with digits, or from FOREIGN, are there, so that a version is never
taken for another; if no further word of FOREIGN is, which tells of a neighbouring licence; and if the model gives it more than "other".
A paragraph that names several licences so has several families.  Of a licence and a neighbour whose FOREIGN words stand in
one paragraph, as CC BY and CC BY-SA, the neighbour alone counts.

Scoring uses DataFrame functions only.  A bound from the model's own weights drops texts, then paragraphs, that
score "other" whatever else they hold, and only those (see Bound).  The rest are classed once each, through a
join of their features with the weights, and the result is joined back, so a line that stands in a third of all
documents is classed once.  Joined lines add their family only where no line of theirs is confirmed for it, and
then settle what their lines leave unsettled.

Cases: null and empty texts hold no licence; rows that share a doc_id are judged each by its text; a null
doc_id stays; further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uploadwatch.llm.common import row_key
from uploadwatch.scratch import materialize

#: Notices by which texts name their licence.
TEMPLATES = {
    "apache-2.0": ["Apache License 2.0", "License: Apache-2.0", "Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License 2.0.", "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "mit": ["MIT License", "License: MIT", "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software, under the MIT License.", "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "gpl-3.0": ["GNU General Public License v3.0", "Released under GPLv3", "This work is licensed under the GNU General Public License, version 3.", "This program is free software under the terms of the GNU General Public License, either version 3 or any later version.", "SPDX-License-Identifier: GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "GNU General Public License v2.0", "Released under GPLv2", "SPDX-License-Identifier: GPL-2.0",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "Released under AGPLv3", "SPDX-License-Identifier: AGPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "lgpl-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "Released under LGPLv3", "SPDX-License-Identifier: LGPL-3.0"],
    "lgpl-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "bsd": ["BSD License", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License.", "Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "unlicense": ["This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"],
    "mpl-2.0": ["Mozilla Public License 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0-1.0": ["Released into the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"],
    "reserved": ["All rights reserved.", "Copyright. All rights reserved.", "All rights reserved. No part of this work may be reproduced without permission."],
}
#: Words of neighbouring licences that share a family's templates.
FOREIGN = {
    "gpl-3.0": ("affero", "agpl", "lesser", "lgpl"), "gpl-2.0": ("affero", "agpl", "lesser", "lgpl"), "lgpl-3.0": ("affero", "agpl"), "lgpl-2.1": ("affero", "agpl"),
    "cc-by-4.0": ("sa", "nc", "nd", "sharealike", "noncommercial", "noderivatives"), "cc-by-sa-4.0": ("nc", "nd", "noncommercial", "noderivatives"), "cc-by-nc-4.0": ("sa", "nd", "sharealike", "noderivatives"),
}
#: Sentences that speak of licences and grant none.
OTHER = [
    "The driver showed his licence and the officer let him pass.", "Her fishing license expired in the spring.", "They applied for a licence to sell food at the public market.",
    "The permission to enter was granted by the guard at version two of the gate.", "A general of the public army released the prisoners under terms.", "The Apache people lived in the southwest.",
    "He studied at MIT before he moved.", "The Mozilla browser has a new version.", "The source of the river is free of charge to visit.", "The work is subject to change without notice.",
]
#: Grants that name no known family; # is a name.
UNKNOWN = ["Licensed under the # License.", "Released under the # License.", "This work is licensed under the # License, version 2.", "Distributed under the terms of the # Public License.", "SPDX-License-Identifier: LicenseRef-#", "Use is subject to the # Licence Agreement."]
CLASSES = ("other", "unknown", *TEMPLATES)
THRESHOLD, CONFIRM, SAMPLE = 0.7, 0.6, 4_000
PIECE = 600  # characters of a sampled line, from a place its hash chooses
COMMON = 0.01  # a word in more of the lines that teach "other" is no feature, nor is a pair of such words
COLD = 12  # lines without licence words that end joined lines
_LINES = r"[\r\n]+"
_LETTER = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = _LETTER + "+"
#: A line's end after the end of a sentence, or a line without words.
_BREAK = r"(?<=[.!?:;])[\x20\t]*[\r\n]+|(?>\r\n?|\n)[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[\r\n]"


def paragraph_features(paragraph: str) -> list[str]:
    words = re.findall(_WORD, paragraph.lower())
    return sorted({*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))})


def train(negatives: list[str], seed: int = 11, rounds: int = 300) -> tuple[list[tuple[str, list[float]]], list[float]]:
    """(feature, weight per class) where any weight is not zero, and the biases; both divided by the temperature."""
    rng = random.Random(seed)
    filler = [w for p in negatives for w in p.split()[:30]] or ["and", "so", "on"]
    rows: list[tuple[str, int]] = []
    for c, family in enumerate(CLASSES):
        for template in TEMPLATES.get(family, []):
            words = template.split()
            for k in range(24):
                kept = [w for w in words if k < 6 or rng.random() > 0.1]
                around = [[rng.choice(filler) for _ in range(rng.choice((0, 0, 2, 5)))] for _ in range(2)]
                rows.append((" ".join([*around[0], *kept, *around[1]]), c))
    for form in UNKNOWN:
        for _ in range(24):
            rows.append((form.replace("#", " ".join(rng.choice(filler).capitalize() for _ in range(rng.choice((1, 1, 2))))), 1))
    rows += [(p, 0) for p in negatives] + [(p, 0) for p in OTHER for _ in range(12)]
    # Where the corpus has few lines, made-up words among short ones teach that what is not known is "other".
    short = sorted({w for t in (*OTHER, *(t for ts in TEMPLATES.values() for t in ts)) for w in re.findall(r"\b[a-z]{1,3}\b", t)})
    made = lambda: rng.choice(short) if rng.random() < 0.4 else "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    rows += [(" ".join(made() for _ in range(rng.randrange(1, 30))), 0) for _ in range(SAMPLE - len(negatives))]
    rng.shuffle(rows)
    half = len(rows) // 2
    sets = [paragraph_features(p) for p, _ in rows]
    # Names and words of the corpus have no weights of their own, as they tell nothing about other texts, nor have common words.
    rare = lambda f: any(common[w] <= COMMON * max(SAMPLE, len(negatives)) for w in f.split(" "))
    common = Counter(w for p, c in rows if c == 0 for w in set(re.findall(_WORD, p.lower())))
    known = [*(t for ts in TEMPLATES.values() for t in ts), *OTHER, *(part for form in UNKNOWN for part in form.split("#"))]
    vocabulary = {f: k for k, f in enumerate(sorted({f for t in known for f in paragraph_features(t) if rare(f)}))}
    x = np.zeros((len(rows), len(vocabulary)), np.float32)
    for k, s in enumerate(sets):
        x[k, [vocabulary[f] for f in s if f in vocabulary]] = 1
    y = np.eye(len(CLASSES), dtype=np.float32)[[c for _, c in rows]]
    w, b = np.zeros((len(vocabulary), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    share = y[:half].sum(axis=0)
    of_row = (y[:half] @ (1 / np.maximum(share, 1)) * np.where(y[:half, 0] > 0, 0.5, 0.5 / (len(CLASSES) - 1)))[:, None]  # "other" weighs as much as all else
    rate, penalty = 4.0, 2e-5
    before = w, b
    for k in range(rounds):  # proximal gradient with momentum
        pace = k / (k + 3)
        at, at_b = w + pace * (w - before[0]), b + pace * (b - before[1])
        before = w, b
        gap = (_softmax(x[:half] @ at + at_b) - y[:half]) * of_row
        w = at - rate * (x[:half].T @ gap)
        w = (np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)).astype(np.float32)
        b = (at_b - rate * gap.sum(axis=0)).astype(np.float32)
    raw = x[half:] @ w + b
    loss = {t: -np.log(_softmax(raw / t)[y[half:] > 0] + 1e-12).mean() for t in np.linspace(0.1, 3, 59)}
    temperature = min(loss, key=loss.get)
    return [(f, (w[k] / temperature).astype(float).tolist()) for f, k in vocabulary.items() if np.abs(w[k]).max() > 1e-3], (b / temperature).astype(float).tolist()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _features(paragraph: Column) -> Column:
    words = F.regexp_extract_all(F.lower(paragraph), F.lit(_WORD), F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(F.concat(words, F.when(F.size(words) > 1, F.slice(pairs, 1, F.size(words) - 1)).otherwise(F.array().cast("array<string>"))))


def _alternatives(words: list[str]) -> str:
    """A pattern of exactly these words; common beginnings are shared, so few branches are tried at a place."""
    by_first: dict[str, list[str]] = {}
    for w in sorted(words):
        by_first.setdefault(w[:1], []).append(w[1:])
    parts = [re.escape(c) + (_alternatives(rest) if any(rest) else "") for c, rest in by_first.items() if c]
    inner = parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"
    return (f"(?:{inner})?" if "" in by_first else inner) if parts else ""


class Bound:
    """What a paragraph's distinct words can add, at most, to any class's lead over "other".

    With z the scores, "other" has probability 1 / (1 + sum exp(z[c] - z[0])).  No lead exceeds its bias and the
    sum over features of max(w[c] - w[0]), so a sum up to a limit leaves "other" at THRESHOLD or above.  A word
    answers for its own gain and for those of the pairs assigned to it, as a pair is there only if both its words
    are.  Words with the least gains are left out as long as their sum is below a quarter of the limit, which is
    taken off the limit.
    """

    def __init__(self, model: tuple[list[tuple[str, list[float]]], list[float]]):
        weights, bias = model
        limit = float(np.log((1 / THRESHOLD - 1) / np.exp(np.array(bias[1:]) - bias[0]).sum())) - 1e-6
        features = {f for f, _ in weights}
        lead = {f: max(x - w[0] for x in w[1:]) for f, w in weights}
        self.gains = {f: x for f, x in lead.items() if x > 0 and " " not in f}
        for pair, x in lead.items():
            if x > 0 and " " in pair:  # common words have no weight, so the rarer one answers for both
                word = max(pair.split(" "), key=lambda w: (w in features, lead.get(w, 0.0), len(w), w))
                self.gains[word] = self.gains.get(word, 0.0) + x
        spare = max(limit, 0.0) / 4
        for word in sorted(self.gains, key=lambda w: (self.gains[w], w)):
            if self.gains[word] > spare:
                break
            spare -= self.gains[word]
            limit -= self.gains.pop(word)
        self.limit = limit
        self.pattern = rf"(?<!{_LETTER})" + (_alternatives(list(self.gains)) if self.gains else "(?!)") + rf"(?!{_LETTER})"

    def exceeded(self, hits: Column) -> Column:
        """Whether a paragraph with these words of the pattern may score something else than "other"."""
        known = F.create_map(*(F.lit(x) for pair in self.gains.items() for x in pair)) if self.gains else F.create_map(F.lit(""), F.lit(0.0))
        return F.aggregate(F.array_distinct(hits), F.lit(0.0), lambda acc, w: acc + F.coalesce(F.try_element_at(known, w), F.lit(0.0))) > F.lit(self.limit)

    def hits(self, text: Column) -> Column:
        return F.regexp_extract_all(F.lower(text), F.lit(self.pattern), F.lit(0))


def paragraphs(docs: DataFrame, model: tuple[list[tuple[str, list[float]]], list[float]]) -> DataFrame:
    """doc_id, _key, block, run, joined, paragraph: lines (joined is false) and joined lines of a run, without what is bound to score "other"."""
    bound = Bound(model)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).withColumn("_key", row_key())
    texts = texts.filter(bound.exceeded(bound.hits(F.col("text"))))
    cold = rf"(?i)(?:[\r\n]++(?![^\r\n]*{bound.pattern})[^\r\n]*+){{{COLD}}}"
    several = lambda c: F.col(c).rlike(r"[\r\n]")
    blocks = texts.select("doc_id", "_key", F.posexplode(F.split("text", _BREAK, -1)).alias("block", "_block"))
    blocks = blocks.filter(bound.exceeded(bound.hits(F.col("_block"))))
    runs = blocks.select("doc_id", "_key", "block", F.posexplode(F.when(several("_block"), F.split("_block", cold, -1)).otherwise(F.array("_block"))).alias("run", "_run"))
    whole = F.when(several("_run"), F.array("_run")).otherwise(F.array().cast("array<string>"))
    pieces = runs.select("doc_id", "_key", "block", "run", several("_run").alias("_several"), F.posexplode(F.concat(whole, F.split("_run", _LINES, -1))).alias("_n", "paragraph"))
    pieces = pieces.filter(bound.exceeded(bound.hits(F.col("paragraph"))))
    return pieces.select("doc_id", "_key", "block", "run", (F.col("_several") & (F.col("_n") == 0)).alias("joined"), F.trim("paragraph").alias("paragraph"))


def template_features() -> list[tuple[int, int, str, int, int, int]]:
    """class, template, feature, kind (0: of the template, 1: a word of FOREIGN), whether no other family has it, whether a paragraph must have it: a word with a digit, or one that tells neighbours apart."""
    held = {(c, k): paragraph_features(t) for c, family in enumerate(CLASSES) for k, t in enumerate(TEMPLATES.get(family, []))}
    families: dict[str, set[int]] = {}
    for (c, _), found in held.items():
        for f in found:
            families.setdefault(f, set()).add(c)
    apart = {w for words in FOREIGN.values() for w in words}
    rows = [(c, k, f, 0, int(len(families[f]) == 1), int(f in apart or (" " not in f and any(x.isdigit() for x in f)))) for (c, k), found in held.items() for f in found]
    return rows + [(c, k, f, 1, 0, 0) for c, k in held for f in FOREIGN.get(CLASSES[c], ())]


def spread_features(distinct: DataFrame, weights: list[tuple[str, list[float]]]) -> DataFrame:
    """paragraph, feature: those that the model or a template has, as others tell nothing; a paragraph of other words alone keeps one row without a feature."""
    known = F.lit(sorted({f for f, _ in weights} | {f for _, _, f, *_ in template_features()}))
    worded = distinct.select("paragraph", _features(F.col("paragraph")).alias("_all")).filter(F.size("_all") > 0)
    return worded.select("paragraph", F.explode_outer(F.array_intersect("_all", known)).alias("feature"))


def classify(found: DataFrame, model: tuple[list[tuple[str, list[float]]], list[float]]) -> DataFrame:
    """paragraph, family ("other", "unknown" or a licence), probability, families (confirmed ones), confirmed (whether there are any) of distinct paragraphs."""
    spark = found.sparkSession
    weights, bias = model
    side = F.broadcast(spark.createDataFrame(weights, "feature string, w array<double>"))  # bounded by the templates and SAMPLE
    forms = spark.createDataFrame(template_features(), "class int, template int, feature string, foreign int, own int, number int")
    totals = forms.groupBy("class", "template").agg(F.count_if(F.col("foreign") == 0).alias("total"), F.sum("own").alias("n_own"), F.sum("number").alias("n_number"))
    forms = F.broadcast(forms.join(F.broadcast(totals), ["class", "template"]))  # bounded by the templates
    distinct = found.select("paragraph").distinct()
    spread = spread_features(distinct, weights)
    sums = spread.join(side, "feature", "left").groupBy("paragraph").agg(*(F.coalesce(F.sum(F.get("w", F.lit(c))), F.lit(0.0)).alias(f"z{c}") for c in range(len(CLASSES))))
    logits = F.array(*(F.col(f"z{c}") + F.lit(bias[c]) for c in range(len(CLASSES))))
    top = F.array_max("logits")
    scored = sums.select("paragraph", logits.alias("logits")).select(
        "paragraph", "logits", (F.array_position("logits", top) - 1).cast("int").alias("best"), (1 / F.aggregate("logits", F.lit(0.0), lambda acc, z: acc + F.exp(z - top))).alias("probability")
    )
    shared = spread.join(forms, "feature").groupBy("paragraph", "class", "template").agg(
        F.count_if(F.col("foreign") == 0).alias("n"), F.sum("own").alias("own"), F.sum("number").alias("number"), F.sum("foreign").alias("foreign"), *(F.max(c).alias(c) for c in ("total", "n_own", "n_number"))
    )
    held = (F.col("n") >= CONFIRM * F.col("total")) & (F.col("own") >= CONFIRM * F.col("n_own")) & (F.col("number") == F.col("n_number")) & (F.col("foreign") == 0)
    close = shared.filter(held).groupBy("paragraph").agg(F.array_sort(F.collect_set("class")).alias("close"))  # families at most
    joined = scored.join(close, "paragraph", "left")
    names = F.array(*map(F.lit, CLASSES))
    family = F.when(F.col("probability") < THRESHOLD, "unknown").otherwise(F.element_at(names, F.col("best") + 1))
    likely = F.filter(F.coalesce("close", F.array().cast("array<int>")), lambda c: F.get("logits", c) > F.get("logits", F.lit(0)))
    families = F.transform(likely, lambda c: F.element_at(names, c + 1))
    return joined.select("paragraph", family.alias("family"), "probability", families.alias("families"), (F.size(families) > 0).alias("confirmed"))


def _grants(line: str) -> bool:
    """Whether a line holds a template or the form of a grant, so that it does not teach "other"."""
    held = set(paragraph_features(line))
    forms = [paragraph_features(t) for t in (*(t for ts in TEMPLATES.values() for t in ts), *UNKNOWN)]
    return any(len(held.intersection(f)) >= CONFIRM * len(f) for f in forms)


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[list[tuple[str, list[float]]], list[float]]:
    """The model, with at most ``sample`` distinct lines of the corpus (those that hash lowest, PIECE characters of each) as negatives."""
    lines = docs.select(F.explode(F.split(F.col("text").cast("string"), _LINES, -1)).alias("line")).filter(F.length("line") > 20).select("line", F.xxhash64("line").alias("h"))
    least = [r["h"] for r in lines.select("h").distinct().orderBy("h").limit(sample).collect()]
    start = F.pmod("h", F.greatest(F.length("line") - PIECE, F.lit(0)) + 1).cast("int") + 1
    chosen = lines.filter(F.col("h").isin(least)).select("h", F.substring("line", start, F.lit(PIECE)).alias("piece")).distinct()
    return train([r["piece"] for r in sorted(chosen.collect()) if not _grants(r["piece"])])


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, families (confirmed, sorted, comma-joined), n_confirmed, n_unknown (paragraphs of unsettled licence language), best (highest probability of a confirmed family) for every row."""
    model = fit(docs)
    found = materialize(paragraphs(docs, model), "paragraphs")
    judged = materialize(classify(found, model).filter("family <> 'other'"), "classes")
    place = ["doc_id", "_key", "block", "run"]
    near = found.join(judged, "paragraph").groupBy(*place).agg(
        F.flatten(F.collect_list(F.when(~F.col("joined"), F.col("families")))).alias("lines"),
        F.count_if(~F.col("joined") & ~F.col("confirmed")).alias("open"),
        F.flatten(F.collect_list(F.when(F.col("joined"), F.col("families")))).alias("whole"),
        F.max(F.col("joined") & ~F.col("confirmed")).alias("whole_open"),
        F.max(F.when(F.col("confirmed") & ~F.col("joined"), F.col("probability"))).alias("best_line"),
        F.max(F.when(F.col("confirmed") & F.col("joined"), F.col("probability"))).alias("best_whole"),
    )
    added = F.array_except("whole", "lines")
    adds = F.size(added) > 0
    unsettled = F.when(adds, 0).when(F.col("open") > 0, F.col("open")).otherwise(F.when(F.col("whole_open") & (F.size("lines") == 0), 1).otherwise(0))
    near = near.select(*place, F.concat("lines", added).alias("families"), unsettled.alias("open"), F.when(adds, F.greatest("best_line", "best_whole")).otherwise(F.col("best_line")).alias("best"))
    per = near.groupBy(F.col("doc_id").alias("_d"), F.col("_key").alias("_k")).agg(
        F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("families")))), ",").alias("families"), F.sum(F.size("families")).alias("n_confirmed"), F.sum("open").alias("n_unknown"), F.max("best").alias("best")
    )
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).select("doc_id", row_key().alias("_key"))
    joined = rows.join(per, rows["doc_id"].eqNullSafe(per["_d"]) & (rows["_key"] == per["_k"]), "left")
    return joined.select("doc_id", F.coalesce("families", F.lit("")).alias("families"), *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_confirmed", "n_unknown")), F.round("best", 6).alias("best"))
