"""Licence scan: paragraphs are classified by sparse word n-gram logistic regression.

A paragraph is a line with a word, or the passage of a block of lines (between empty lines)
that comes closest to a template, so that a notice wrapped over several lines is seen whole.
Its features are its word 1- to 3-grams that occur in the training paragraphs. The classes are
the licence families of TEMPLATES and an unknown class, learned from the templates in varied
wording and, for unknown, from a bounded sample of the corpus's own lines, from sentences that
only mention licences and from denied notices. The probability from which a family is believed
is calibrated on a fifth of the training paragraphs held out, and a predicted family must also
share enough of its word pairs with one of the family's templates; otherwise the paragraph
stays unknown.

That share gives a lossless filter: of any set of more than half of a template's pairs a
confirmed paragraph holds one, so texts without a word of the rarest such pairs are done.

The model is small and of fixed bound (templates, SAMPLE_LINES lines of at most SAMPLE_CHARS),
so it is fitted on the driver and sent to the tasks; the scan is one map over the whole texts.

Defined results: a null or empty text has no paragraphs and no families; n_paragraphs counts
lines; a paragraph of any length is scored whole; rows that repeat are scanned alike; an empty
table has an empty result; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.llm.common import column

#: Lines of the corpus, by smallest hash, from which the unknown class is learned, and their length at most.
SAMPLE_LINES, SAMPLE_CHARS = 1500, 2000
VARIANTS, NGRAM, EPOCHS, SHARED_PAIRS = 12, 3, 150, 0.5
#: Share of the believed held-out paragraphs that must be right.
PRECISION = 0.98
UNKNOWN = "unknown"

#: Notices by which licence families are recognised.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "This project is released under the Apache 2.0 license.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Licensed under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "Licensed under the GPL, version 2 or later.",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Released under the AGPL 3.0.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
        "Licensed under the MPL 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "cc0": (
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work and dedicated it to the public domain.",
    ),
    "all-rights-reserved": (
        "All rights reserved.",
        "Copyright 2020 Example Company. All rights reserved.",
        "No part of this publication may be reproduced in any form without the prior written permission of the publisher.",
    ),
}
#: Sentences that mention licences without granting one.
MENTIONS = (
    "He lost his driving license on the way to work.", "The company applied for a license to operate trains.",
    "You need a fishing license in this state.", "The rights of workers were reserved for later talks.",
    "Version 2.0 of the game was released in May.", "MIT is a university in the United States.",
    "The general public was not admitted.", "An apache helicopter landed near the village.",
    "The work was released under pressure.", "Public domain is a legal term.",
)

#: Identifiers that stand for a family in a tag line.
TAGS: dict[str, tuple[str, ...]] = {
    "apache-2.0": ("Apache-2.0",), "mit": ("MIT",), "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "gpl": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later"),
    "lgpl": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later"),
    "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"), "mpl-2.0": ("MPL-2.0",), "cc-by": ("CC-BY-4.0", "CC-BY-3.0"),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC-BY-SA-3.0"), "cc-by-nc": ("CC-BY-NC-4.0",), "cc0": ("CC0-1.0",),
}
#: Every template with its family: the notices and the tag lines.
NOTICES = [(f, t) for f, own in TEMPLATES.items() for t in own] + [(f, f"SPDX-License-Identifier: {x}") for f, own in TAGS.items() for x in own]
#: Words before which a "not" denies the notice.
GRANTS = ("licensed", "released", "available", "granted", "permitted", "subject")

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


def words_of(line: str) -> list[str]:
    return _WORD.findall(line.lower())


def ngrams(words: list[str]) -> set[tuple[str, ...]]:
    return {tuple(words[i:i + k]) for k in range(1, NGRAM + 1) for i in range(len(words) - k + 1)}


def varied(words: list[str], chance: random.Random) -> list[str]:
    """A template as it may be met: words dropped at its ends, something before or after."""
    low = chance.randrange(0, max(1, len(words) // 6 + 1))
    high = len(words) - chance.randrange(0, max(1, len(words) // 4 + 1))
    filler = lambda: [f"w{chance.randrange(10**6)}" for _ in range(chance.choice((0, 0, 1, 3, 6)))]
    return [*filler(), *words[low:high], *filler()]


def denied(words: list[str]) -> list[str] | None:
    """The notice with a "not" before the word that grants, if it has one."""
    at = next((i for i, w in enumerate(words) if w in GRANTS), None)
    return None if at is None else [*words[:at], "not", *words[at:]]


def cues_of(pairs: set[tuple[str, str]]) -> set[str]:
    """A word of each of so many pairs that a paragraph with enough shared pairs has one; the longest are the rarest."""
    rare = sorted(pairs, key=lambda p: (-max(map(len, p)), p))
    return {max(p, key=lambda w: (len(w), w)) for p in rare[:len(pairs) - math.ceil(SHARED_PAIRS * len(pairs)) + 1]}


def closest(words: list[str], pairs: set[tuple[str, str]], size: int) -> tuple[int, int] | None:
    """The stretch of at most ``size`` words with the most different pairs of a template, from its first to its last."""
    at = [i for i, p in enumerate(zip(words, words[1:])) if p in pairs]
    inside, best, first = Counter(), (0, 0, 0), 0
    for k, i in enumerate(at):
        inside[words[i], words[i + 1]] += 1
        while i + 2 - at[first] > size:
            old = words[at[first]], words[at[first] + 1]
            inside[old] -= 1
            if not inside[old]:
                del inside[old]
            first += 1
        best = max(best, (len(inside), -(i + 2 - at[first]), -at[first]))
    return (-best[2], -best[2] - best[1]) if best[0] else None


@dataclass
class Model:
    """Weights by n-gram, families in order (unknown last), and the calibrated probability."""

    families: list[str]
    index: dict[tuple[str, ...], int]
    weights: np.ndarray
    least: float = 0.5
    pairs: dict[str, list[set]] = field(default_factory=dict)

    def probabilities(self, words: list[str]) -> np.ndarray:
        own = [self.index[g] for g in ngrams(words) if g in self.index]
        z = self.weights[-1] + self.weights[own].sum(axis=0) / max(1, len(own)) ** 0.5
        e = np.exp(z - z.max())
        return e / e.sum()

    def shared(self, family: str, words: list[str]) -> float:
        """Largest share of a template's word pairs that the paragraph has."""
        have = set(zip(words, words[1:]))
        return max(len(p & have) / len(p) for p in self.pairs[family])

    def classify(self, words: list[str]) -> tuple[str, float]:
        p = self.probabilities(words)
        best = int(p.argmax())
        family = self.families[best]
        if family == UNKNOWN or p[best] < self.least or self.shared(family, words) < SHARED_PAIRS:
            return UNKNOWN, float(p[-1])
        return family, float(p[best])


def fit(lines: list[str]) -> Model:
    """Train on the templates and, for the unknown class, on the given lines."""
    chance = random.Random(7)
    families = [*TEMPLATES, UNKNOWN]
    pairs = {f: [set(zip(w, w[1:])) for w in (words_of(t) for g, t in NOTICES if g == f)] for f in TEMPLATES}
    every = [p for own in pairs.values() for p in own]
    plain = [w for w in map(words_of, [*lines, *MENTIONS * 10])
             if w and not any(len(p & set(zip(w, w[1:]))) >= SHARED_PAIRS * len(p) for p in every)]
    rows = [(varied(words_of(t), chance), families.index(f)) for f, t in NOTICES for _ in range(VARIANTS)]
    rows += [(w, len(families) - 1) for w in plain]
    turned = [varied(w, chance) for w in (denied(words_of(t)) for _, t in NOTICES) if w for _ in range(VARIANTS)]
    rows += [(w, len(families) - 1) for w in turned if "not" in w]
    chance.shuffle(rows)
    held, train = rows[::5], [r for i, r in enumerate(rows) if i % 5]
    seen = Counter(g for w, y in train if y < len(families) - 1 for g in ngrams(w))
    seen.update(g for w in turned for g in ngrams(w) if "not" in g)
    names = sorted(g for g, n in seen.items() if n >= 2)  # n-grams of a single variant are its filler
    model = Model(families, {g: i for i, g in enumerate(names)}, np.zeros((len(names) + 1, len(families))), pairs=pairs)
    x = np.zeros((len(train), len(names) + 1), np.float32)
    x[:, -1] = 1
    for i, (w, _) in enumerate(train):
        own = [model.index[g] for g in ngrams(w) if g in model.index]
        x[i, own] = max(1, len(own)) ** -0.5
    y = np.eye(len(families))[[c for _, c in train]]
    momentum = np.zeros_like(model.weights)
    for _ in range(EPOCHS):
        z = x @ model.weights
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        momentum = 0.9 * momentum + x.T @ (p - y) / len(train) + 1e-5 * model.weights
        model.weights = model.weights - 2.0 * momentum
    # held-out paragraphs that the template comparison would confirm: how sure, and rightly so?
    said = []
    for w, c in held:
        p = model.probabilities(w)
        if families[p.argmax()] != UNKNOWN and model.shared(families[p.argmax()], w) >= SHARED_PAIRS:
            said.append((float(p.max()), p.argmax() == c))
    said.sort(reverse=True)
    right = [sum(r for _, r in said[:k]) >= PRECISION * k for k in range(1, len(said) + 1)]
    model.least = max(0.5, min([q for (q, _), good in zip(said, right) if good], default=0.95))
    return model


def corpus_lines(docs: DataFrame, limit: int = SAMPLE_LINES) -> list[str]:
    """The bounded sample: the lines with the smallest hash, of at most SAMPLE_CHARS characters.

    Lines are counted first, so that only about as many as are wanted are ordered and fetched.
    """
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).filter(
        (F.col("line") != "") & (F.char_length("line") <= SAMPLE_CHARS)).withColumn("h", F.xxhash64("line"))
    n = lines.count()
    share = 2 * limit / max(1, n)
    while True:
        some = lines if share >= 0.5 else lines.filter(F.col("h") < F.lit(int(-2**63 + share * 2**64)))
        rows = some.orderBy("h", "line").limit(limit).collect()
        if len(rows) == limit or share >= 0.5:
            return [r.line for r in rows]
        share *= 4


def _blocks(lines: list[str]) -> Iterator[tuple[list[int], list[str]]]:
    """Runs of two lines or more between empty lines: the number of each word's line among those with a word, and the words."""
    n, where, words, many = 0, [], [], set()
    for line in [*lines, ""]:
        if line.strip():
            n += 1
            own = words_of(line)
            where += [n] * len(own)
            words += own
            many.add(n)
        else:
            if len(many) > 1:
                yield where, words
            where, words, many = [], [], set()


def found_in(text: str, model: Model, cues: set[str]) -> tuple[int, list[dict]]:
    """The number of lines with a word, and the paragraphs of a family."""
    lines = [x for x in text.split("\n")]
    n = sum(1 for x in lines if x.strip())
    if cues.isdisjoint(words_of(text)):
        return n, []
    found, number = [], 0
    for line in lines:
        if not line.strip():
            continue
        number += 1
        words = words_of(line)
        if not cues.isdisjoint(words):
            family, p = model.classify(words)
            if family != UNKNOWN:
                found.append({"paragraph": number, "family": family, "probability": p})
    for where, words in _blocks(lines):
        if cues.isdisjoint(words):
            continue
        have = set(zip(words, words[1:]))
        for family, own in model.pairs.items():
            if any(f["family"] == family and where[0] <= f["paragraph"] <= where[-1] for f in found):
                continue
            for pairs in own:
                if len(pairs & have) < SHARED_PAIRS * len(pairs):
                    continue
                first, past = closest(words, pairs, 2 * len(pairs) + 4)
                said, p = model.classify(words[max(0, first - 3):past + 3])
                if said == family and where[first] != where[past - 1]:
                    found.append({"paragraph": where[first], "family": family, "probability": p})
                    break
    return n, sorted(found, key=lambda f: (f["paragraph"], f["family"]))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of docs: doc_id, n_paragraphs, families (sorted), best (family, paragraph number, probability)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cues = set().union(*(cues_of(ps) for every in own.pairs.values() for ps in every))
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text in column(batch, "text"):
                n, found = found_in(text.as_py() or "", own, cues)
                best = max(found, key=lambda f: (f["probability"], -f["paragraph"]), default=None)
                for values, v in zip(out, (n, sorted({f["family"] for f in found}), best and best["family"], found)):
                    values.append(v)
            hit = pa.list_(pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(out[0], pa.int64()), pa.array(out[1], pa.list_(pa.string())),
                 pa.array(out[2], pa.string()), pa.array(out[3], hit)],
                names=["doc_id", "n_paragraphs", "families", "family", "found"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id bigint, n_paragraphs bigint, families array<string>, family string, "
             "found array<struct<paragraph: bigint, family: string, probability: double>>")
