"""Licence scans with a trained paragraph classifier.

Paragraphs are the lines of a text that aren't blank, wrapped lines joined: a line of at most ``WRAPPED``
bytes that ends in a letter, digit, comma, hyphen or other sign within a sentence goes on in the next
line unless that is blank. A multinomial logistic regression over sparse word
1- to 3-grams tells licence families from one another and from everything else. It is trained here,
on notices made of fixed templates and on paragraphs that aren't licences: sentences that use the
same words and names otherwise, notices of other and of made-up licences, and at most ``sample`` lines of
the corpus without such words.

For calibration it is fitted without every third name of each family (and every third sentence that
is no notice) and judged on these: a temperature that minimises the log loss, and the least
probability at which at least 99 % of the decisions for a family are right. Then it is fitted on all.
Below that probability, or where "unknown" is the likeliest class, a paragraph is unknown.
A prediction is confirmed if a template of its family is found in the paragraph: at least 60 % of
the template's word pairs.

Every paragraph of every text is scored where it is read; those without any known n-gram have the
score of the constant term, which is unknown. The model, a few thousand n-grams, is broadcast.

Defined cases: null or empty text: no paragraph. Null or repeated doc_ids give rows like others.
Ties between families go to the first in alphabetical order. Empty table: no rows. Extra columns,
whatever their names, are not looked at. Lines and paragraphs of any length are whole.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm import _text as tx

U64, I64 = np.uint64, np.int64

# Names of licence families as their notices give them.
NAMES = {
    "AGPL": ["GNU Affero General Public License", "GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPL-3.0", "AGPLv3", "AGPL-3.0-or-later"],
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache Software License", "Apache License"],
    "BSD": ["BSD License", "3-Clause BSD License", "BSD 2-Clause License", "New BSD License", "Simplified BSD License", "BSD-3-Clause", "BSD-2-Clause"],
    "CC-BY": ["Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "CC BY 4.0", "CC BY 3.0", "CC-BY-4.0", "CC BY"],
    "CC-BY-NC": ["Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial-ShareAlike License", "CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "CC-BY-NC-4.0", "CC BY-NC"],
    "CC-BY-ND": ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND-4.0", "CC BY-ND"],
    "CC-BY-SA": ["Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA-4.0", "CC BY-SA"],
    "CC0": ["Creative Commons Zero", "CC0 1.0 Universal", "CC0 1.0", "CC0-1.0", "CC0 public domain dedication", "CC0"],
    "GPL": ["GNU General Public License", "GNU General Public License, version 3", "GNU General Public License, version 2", "GNU GPL v3", "GNU GPL", "GPL-3.0", "GPLv2", "GPLv3", "GPL-2.0-only"],
    "ISC": ["ISC License", "ISC license terms", "Internet Systems Consortium License", "ISC"],
    "LGPL": ["GNU Lesser General Public License", "GNU Lesser General Public License, version 2.1", "GNU Library General Public License", "GNU LGPL", "LGPL-3.0", "LGPLv2.1"],
    "MIT": ["MIT License", "MIT license terms", "MIT", "The MIT License", "Expat License"],
    "MPL": ["Mozilla Public License", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "Unlicense": ["Unlicense", "The Unlicense", "Unlicense terms"],
}
# Sentences of the licences' own notices.
GRANTS = {
    "Apache": ["You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"],
    "AGPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
NOTICES = [
    "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
    "This project is licensed under the terms of the {}.", "Distributed under the {}.", "Distributed under the terms of the {}; see LICENSE for details.", "Available under {}.",
    "The content of this page is available under the {} unless otherwise noted.", "SPDX-License-Identifier: {}", "License: {}", "This software is published under the {}.", "Code is under {}.",
]
OTHERWISE = [
    "His driver's license was revoked after the accident.", "The restaurant lost its liquor license last year.", "She is a licensed professional engineer.", "All rights reserved.",
    "A fishing license is required by law.", "The license plate was stolen.", "Copyright infringement is a serious matter.", "They licensed the technology to a competitor.",
    "The general public was invited to the library.", "The Apache helicopter was distributed to the army.", "MIT is a university in Massachusetts.", "Students at MIT released a new study.",
    "Mozilla released a new version of its browser.", "The foundation published software for students.", "Permission to enter is granted by the office.", "The creative commons room is open to the public.",
    "Attribution of the painting is uncertain.", "The terms of the agreement were published.", "This work is under review.", "The version 2.0 of the software was released.", "The source is available under the bridge.",
]
MADE_UP = ["{} Public License", "{} License, version 1.0", "{} Community License", "{}-1.0", "Acme {} terms", "{} Public License 2.0", "{} Public License, version 2.0", "{} License 2.0", "{}-2.0", "{} v3"]
# Names of licences outside the families.
OTHER_LICENCES = ["Eclipse Public License 2.0", "Eclipse Public License - v 1.0", "Artistic License 2.0", "Boost Software License 1.0", "zlib License", "PostgreSQL License", "European Union Public Licence 1.2", "Common Development and Distribution License", "Microsoft Public License", "SIL Open Font License 1.1", "Python Software Foundation License", "Open Software License 3.0", "Academic Free License v. 3.0", "Do What The F*ck You Want To Public License", "EPL-2.0", "BSL-1.0", "Business Source License 1.1", "Server Side Public License"]
ABOUT_NAMES = ["The {} meeting was held on Monday.", "{} was held in the city.", "{} released a new report.", "He works at {}.", "A talk about {} and others.", "{} is a member of the council.", "The head of {} said that it was late.", "We went to the {} office."]
SHORT_NAMES = ["MIT", "ISC", "BSD", "GPL", "MPL", "GNU", "Apache", "Mozilla", "CC", "Expat", "Creative Commons"]
WRAPPED = 120
_GOES_ON = np.zeros(256, bool)
_GOES_ON[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b",-()'\"/&"]] = True
UNKNOWN = "unknown"
_ABOUT = re.compile(r"licen[cs]|copyright|redistribut|permission|public domain|\bcc\b|creative commons|gnu|apache|mozilla", re.I)


def _features(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph, hash) of all word 1- to 3-grams; paragraphs are given by offsets."""
    start, end, doc = tx.words(raw, off, plain=True)
    word = tx.word_hashes(raw, start, end)
    rows, keys = [doc], [tx.mix(word)]
    for n in (2, 3):
        if len(word) >= n:
            acc = sum((word[k : len(word) - n + 1 + k] * tx.powers(8)[k + 1] for k in range(n)), np.zeros(len(word) - n + 1, U64))
            same = doc[: len(acc)] == doc[n - 1 :]
            rows.append(doc[: len(acc)][same])
            keys.append(tx.mix(acc + U64(n))[same])
    return np.concatenate(rows), np.concatenate(keys)


def _paragraphs(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of the lines that aren't blank, wrapped ones joined."""
    cut = np.flatnonzero(raw == 0x0A)
    doc_cut = np.searchsorted(off, cut, "right") - 1
    start = np.concatenate([off[:-1], cut + 1])
    doc = np.concatenate([np.arange(len(off) - 1), doc_cut])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = off[doc + 1].copy()
    same = doc[1:] == doc[:-1]
    end[:-1][same] = start[1:][same] - 1
    solid = np.concatenate([[0], np.cumsum(~tx._SPACE[raw])])
    full = solid[end] > solid[start]
    if not full.any():
        return start[:0], end[:0], doc[:0]
    number = np.flatnonzero(full)
    start, end, doc = start[full], end[full], doc[full]
    place = np.flatnonzero(~tx._SPACE[raw])
    last = place[solid[end] - 1]  # the last byte that isn't white space
    joined = np.zeros(len(start), bool)
    joined[1:] = (number[1:] == number[:-1] + 1) & (doc[1:] == doc[:-1]) & _GOES_ON[raw[last[:-1]]] & (end[:-1] - start[:-1] <= WRAPPED)
    begins = np.flatnonzero(~joined)
    return start[begins], end[np.append(begins[1:], len(start)) - 1], doc[begins]


@dataclass
class Classifier:
    families: list[str]
    key: np.ndarray  # sorted n-gram hashes
    weight: np.ndarray  # n-grams x families
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5
    pairs: dict = field(default_factory=dict)  # family -> word-pair hashes of its templates

    def logits(self, rows: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        hit = np.flatnonzero(self.key[at] == keys)
        rows, at = rows[hit], at[hit]
        if len(rows):  # an n-gram counts once in a paragraph
            both = np.unique(rows * len(self.key) + at)
            rows, at = both // len(self.key), both % len(self.key)
        out = np.stack([np.bincount(rows, self.weight[at, k], n) for k in range(len(self.families))], 1) if len(rows) else np.zeros((n, len(self.families)))
        return out + self.bias

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = np.exp((logits - logits.max(1, keepdims=True)) / self.temperature)
        return z / z.sum(1, keepdims=True)


def _pairs(text: str) -> np.ndarray:
    raw, off = tx.utf8(pa.array([text]))
    start, end, _ = tx.words(raw, off, plain=True)
    word = tx.word_hashes(raw, start, end)
    return np.unique(word[:-1] * tx.powers(8)[1] + word[1:] * tx.powers(8)[2]) if len(word) > 1 else np.unique(word)


class Grams:
    """A sparse 0/1 matrix of paragraphs x n-grams."""

    def __init__(self, row: np.ndarray, column: np.ndarray, n: int, m: int):
        own = np.unique(row * m + column) if len(row) else np.zeros(0, I64)
        self.n, self.m, self.row, self.column = n, m, own // m, own % m
        self.by_column = np.argsort(self.column, kind="stable")

    @staticmethod
    def _sums(values: np.ndarray, key: np.ndarray, n: int) -> np.ndarray:
        """Sums of rows by sorted key."""
        out = np.zeros((n, values.shape[1]))
        if len(key):
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            out[key[start]] = np.add.reduceat(values, start, axis=0)
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        return self._sums(w[self.column], self.row, self.n)

    def transposed_times(self, d: np.ndarray) -> np.ndarray:
        return self._sums(d[self.row[self.by_column]], self.column[self.by_column], self.m)


def loss_and_gradient(x: Grams, w: np.ndarray, b: np.ndarray, y: np.ndarray, weight: np.ndarray, decay: float = 1e-5):
    """Weighted log loss with a penalty of decay / 2 times the squared weights; its gradients by w and b."""
    z = x.times(w) + b
    z -= z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    rows = np.arange(len(y))
    loss = -(weight * np.log(p[rows, y])).sum() + decay / 2 * (w * w).sum()
    p[rows, y] -= 1
    p *= weight[:, None]
    return loss, x.transposed_times(p) + decay * w, p.sum(0)


def _fit(texts: list[str], y: np.ndarray, families: list[str], rounds: int) -> Classifier:
    """Adam on the whole loss; n-grams are those that occur twice in notices."""
    rows, keys = _features(*tx.utf8(pa.array(texts)))
    key, count = np.unique(keys[y[rows] > 0], return_counts=True)
    key = key[count > 1]
    at = np.minimum(np.searchsorted(key, keys), len(key) - 1)
    hit = key[at] == keys
    x = Grams(rows[hit], at[hit], len(texts), len(key))
    weight = (1 / np.maximum(1, np.bincount(y, minlength=len(families))))[y]
    weight[y == 0] *= len(families)
    weight /= weight.sum()
    values = [np.zeros((len(key), len(families))), np.zeros(len(families))]
    m1, m2 = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for t in range(1, rounds + 1):
        for k, g in enumerate(loss_and_gradient(x, *values, y, weight)[1:]):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.999 * m2[k] + 0.001 * g * g
            values[k] -= 0.1 * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    return Classifier(families, key, *values)


def _calibrate(model: Classifier, texts: list[str], y: np.ndarray) -> None:
    rows, keys = _features(*tx.utf8(pa.array(texts)))
    logits = model.logits(rows, keys, len(texts))
    loss = []
    for t in np.geomspace(0.25, 8, 21):
        model.temperature = float(t)
        loss.append((-np.log(model.probabilities(logits)[np.arange(len(y)), y] + 1e-12).mean(), float(t)))
    model.temperature = min(loss)[1]
    p = model.probabilities(logits)
    guess, top = p.argmax(1), p.max(1)
    order = np.argsort(-top, kind="stable")
    order = order[guess[order] > 0]
    right = np.cumsum(guess[order] == y[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= 0.99)
    model.threshold = float(top[order][good[-1]]) if len(good) else 0.99


def _stretches(grant: str, size: int = 12) -> list[str]:
    """Overlapping stretches of a sentence: notices are often cited in part."""
    words = grant.split()
    return [" ".join(words[i : i + size]) for i in range(0, len(words) - size // 2, size // 2)]


def train(corpus_lines: list[str], seed: int = 3, rounds: int = 150) -> Classifier:
    """Fit without the held-out part, calibrate on it, fit on all and add the templates."""
    rng = np.random.default_rng(seed)
    texts: list[str] = []
    label: list[str] = []
    held: list[bool] = []
    words = [w for x in corpus_lines[:500] for w in x.split()[:20]] or ["lorem", "ipsum"]
    templates: dict[str, list[str]] = {}
    for family, names in NAMES.items():
        own = [(p.format(n), k % 3 == 2) for k, n in enumerate(names) for p in NOTICES] + [(x, False) for g in GRANTS.get(family, []) for x in (g, *_stretches(g))]
        templates[family] = [x for x, _ in own]
        for x, out in own:
            for copy in range(2):  # as it is, and between other words
                around = [" ".join(rng.choice(words, rng.integers(0, 12))) for _ in range(2)] if copy else ["", ""]
                texts.append(f"{around[0]} {x} {around[1]}")
                label.append(family)
                held.append(out)
    made_up = [m.format(w.strip(".,").title()) for m in MADE_UP for w in rng.choice(words, 4)]
    other = [*OTHERWISE, *(p.format(x) for p in NOTICES for x in [*made_up, *OTHER_LICENCES]), *(p.format(n) for p in ABOUT_NAMES for n in SHORT_NAMES), *corpus_lines, ""]
    texts += other
    label += [UNKNOWN] * len(other)
    held += [k % 3 == 2 for k in range(len(other))]
    families = [UNKNOWN, *sorted(NAMES)]
    y, out = np.array([families.index(f) for f in label]), np.array(held)
    some = lambda keep: [t for t, k in zip(texts, keep) if k]
    trial = _fit(some(~out), y[~out], families, rounds)
    _calibrate(trial, some(out), y[out])
    model = _fit(texts, y, families, rounds)
    model.temperature, model.threshold = trial.temperature, trial.threshold
    model.pairs = {f: [_pairs(t) for t in own] for f, own in templates.items()}
    return model


def _sampled_lines(docs: DataFrame, sample: int) -> list[str]:
    """At most ``sample`` lines that say nothing of licences, ten of a text."""
    total = docs.count()
    space = 1 << 62
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(space)) < F.lit(min(space, space * (sample // 10) // max(1, total)))).select(F.slice(F.split("text", "\n"), 1, 10).alias("x"))
    return [x for r in some.orderBy("x").limit(sample // 10).collect() for x in (r["x"] or []) if x and not _ABOUT.search(x)]


def scan(docs: DataFrame, sample: int = 3000, confirm: float = 0.6, model: Classifier | None = None) -> DataFrame:
    """(doc_id, paragraph, start, end, family, probability, template_share, confirmed) of every paragraph with a family; start and end are byte offsets, paragraph counts from 0."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(model or train(_sampled_lines(docs, sample)))

    def run(batches):
        model = sent.value
        seen = np.zeros(1 << 20, bool)
        seen[model.key >> U64(44)] = True
        for rows, raw, off in tx.pieces(batches):
            start, end, doc = _paragraphs(raw, off)
            if not len(start):
                continue
            own, keys = _features(raw, np.append(start, len(raw)))  # what lies between two paragraphs is white space
            maybe = seen[keys >> U64(44)]
            logits = model.logits(own[maybe], keys[maybe], len(start))
            p = model.probabilities(logits)
            guess = p.argmax(1)
            found = np.flatnonzero((guess > 0) & (p.max(1) >= model.threshold))
            if not len(found):
                continue
            first = np.searchsorted(doc, doc[found])
            ids = rows.column(0).take(pa.array(doc[found]))
            family, share = [], []
            for k in found.tolist():
                f = model.families[guess[k]]
                pairs = _pairs(raw[start[k] : end[k]].tobytes().decode("utf-8", "replace"))
                family.append(f)
                share.append(max(float(np.isin(t, pairs).mean()) for t in model.pairs[f]))
            share = np.array(share)
            base = off[doc[found]]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array((found - first).astype(np.int32)), pa.array((start[found] - base).astype(I64)), pa.array((end[found] - base).astype(I64)), pa.array(family), pa.array(p[found, guess[found]]), pa.array(share), pa.array(share >= confirm)],
                ["doc_id", "paragraph", "start", "end", "family", "probability", "template_share", "confirmed"],
            )

    return docs.mapInArrow(run, "doc_id long, paragraph int, start long, end long, family string, probability double, template_share double, confirmed boolean")


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Every paragraph of documents with a licence family."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
