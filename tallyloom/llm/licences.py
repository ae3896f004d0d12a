"""License scans: a trained paragraph classifier finds licence notices and names their families.

A paragraph is a line. Its features are the runs of one to three words that occur in the licence templates below (words: letters,
digits and bytes over 127; A-Z as a-z). A multinomial logistic regression with an L1 penalty, which leaves most weights zero, is fitted on the driver to
cut and disturbed templates, one class for each family, and to lines of a bounded sample of documents as the class unknown. Its scores are
calibrated on examples held out from fitting: a temperature that maximises their likelihood, and the least probability that keeps the
share of unknown lines taken for licences under FALSE. A prediction is confirmed by comparison with its family's templates: the share
of word pairs, from the first to the last matching one, that the templates have, of which at least two.

Every line of every text is scored. Null and empty texts have no paragraphs. Rows are scanned one by one, repeated or not.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as T
from .common import map_blocks, text_bytes

# fixed values: words of public licence notices, by family
TEMPLATES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Distributed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause"],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "This work is released into the public domain under CC0 1.0 Universal.", "Released under CC0 1.0."],
    "gpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Released under the ISC License.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "Released under the MIT License.", "Licensed under the MIT license.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher."],
}
CLASSES = [*sorted(TEMPLATES), "unknown"]
#: Documents, and lines of them, that the class unknown is learned from at most.
SAMPLE, LINES = 400, 6000
#: Share of unknown lines that may be taken for licences; share of a notice's word pairs that templates must have.
FALSE, COVER = 0.001, 0.6
EXAMPLES, ROUNDS, L1 = 120, 300, 2e-4

_GAP = np.ones(256, bool)
_GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_U64 = np.uint64


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of the runs of one, two and three words that start at each word (0 where the text ends), words' texts and starts."""
    starts, ends, first = T.spans(data, offsets, _GAP)
    words = T.hash_spans(data, starts, ends)
    owner = T.owners(first)
    grams = [words]
    for n in (2, 3):
        g = np.zeros(len(words), _U64)
        if len(words) >= n:
            inside = owner[: len(words) - n + 1] == owner[n - 1 :]
            g[: len(words) - n + 1] = np.where(inside, T.mix(grams[-1][: len(words) - n + 1] * _U64(0x9FB21C651E98DF25) + words[n - 1 :]), _U64(0))
        grams.append(g)
    return grams, owner, starts


def _of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return text_bytes(pa.array(texts, pa.string()))


@dataclass
class Model:
    known: np.ndarray  # hashes of features, sorted
    weight: np.ndarray  # (features, classes)
    bias: np.ndarray
    temperature: float
    least: float
    pairs: list[np.ndarray]  # hashes of each family's word pairs

    def __post_init__(self):
        self.slot = np.full(1 << 18, -1, np.int32)
        self.slot[(self.known >> _U64(46)).astype(np.int64)[::-1]] = np.arange(len(self.known))[::-1]

    def hits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text and feature of each feature that occurs, as often as it does."""
        grams, owner, _ = _grams(data, offsets)
        texts, features = [], []
        for g in grams:
            at = np.flatnonzero(self.slot[(g >> _U64(46)).astype(np.int64)] >= 0)
            f = np.minimum(np.searchsorted(self.known, g[at]), len(self.known) - 1)
            same = self.known[f] == g[at]
            texts.append(owner[at[same]])
            features.append(f[same])
        return np.concatenate(texts), np.concatenate(features)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts that have a feature, and their scores by class."""
        text, feature = self.hits(data, offsets)
        cell = np.unique(text * np.int64(len(self.known)) + feature)
        text, feature = cell // len(self.known), cell % len(self.known)
        which, at = np.unique(text, return_inverse=True)
        out = np.stack([np.bincount(at, self.weight[feature, c], len(which)) for c in range(len(CLASSES))], axis=1) if len(which) else np.zeros((0, len(CLASSES)))
        return which, out + self.bias

    def cover(self, text: str, family: int) -> float:
        """Share of the text's word pairs, from the first to the last that the family's templates have, that they have."""
        pairs = _grams(*_of([text]))[0][1][:-1]
        has = np.flatnonzero(np.isin(pairs, self.pairs[family]))
        return len(has) / (has[-1] - has[0] + 1) if len(has) > 1 else 0.0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def examples(count: int = EXAMPLES, seed: int = 11) -> tuple[list[str], list[int]]:
    """Cut and disturbed templates with their classes."""
    r = np.random.default_rng(seed)
    texts, classes = [], []
    for c, family in enumerate(CLASSES[:-1]):
        for k in range(count):
            words = TEMPLATES[family][k % len(TEMPLATES[family])].split()
            if k >= len(TEMPLATES[family]):
                if len(words) > 12:
                    size = int(r.integers(10, len(words) + 1))
                    start = int(r.integers(0, len(words) - size + 1))
                    words = words[start : start + size]
                words = [w for w in words if r.random() > 0.04] if len(words) > 8 else words
                if r.random() < 0.3:
                    words = ["Copyright", "(c)", str(r.integers(1990, 2030)), *words]
            texts.append(" ".join(words))
            classes.append(c)
    return texts, classes


def fit(lines: list[str]) -> Model:
    """The classifier, from the examples and from lines as the class unknown, but for those that templates cover."""
    every = [t for c in CLASSES[:-1] for t in TEMPLATES[c]]
    known = np.unique(np.concatenate(_grams(*_of(every))[0]))
    known = known[known > 0]
    pairs = [np.unique(_grams(*_of(TEMPLATES[c]))[0][1]) for c in CLASSES[:-1]]
    pairs = [p[p > 0] for p in pairs]
    none = np.zeros((len(known), len(CLASSES)))
    model = Model(known, none, np.zeros(len(CLASSES)), 1.0, 0.5, pairs)
    every_pair = Model(known, none, model.bias, 1.0, 0.5, [np.unique(np.concatenate(pairs))])
    lines = [t for t in lines if t.strip() and every_pair.cover(t, 0) < COVER]
    # single words of templates are no licence
    lines += ["license", "licensed under", "version 2.0", "the software", "released", "copyright", "all rights", "reserved", "permission"] * 3
    texts, classes = examples()
    y = np.array(classes + [len(CLASSES) - 1] * len(lines))
    texts += lines
    text, feature = model.hits(*_of(texts))
    x = np.zeros((len(texts), len(known)), np.float32)
    x[text, feature] = 1
    share = np.array([1 / max(1, (y == c).sum()) for c in range(len(CLASSES))])[y]
    share = share / share.sum()
    hold = np.arange(len(y)) % 5 == 4
    w, b = np.zeros((len(known), len(CLASSES)), np.float32), np.zeros(len(CLASSES), np.float32)
    goal = np.eye(len(CLASSES), dtype=np.float32)[y]
    xs, ys, ss = x[~hold], goal[~hold], (share[~hold] / share[~hold].sum()).astype(np.float32)[:, None]
    step = 4.0 / max(1.0, float((xs.sum(axis=1) * ss[:, 0]).sum()))
    for _ in range(ROUNDS):  # proximal gradient descent
        gap = (softmax(xs @ w + b) - ys) * ss
        w -= step * 10 * (xs.T @ gap)
        b -= step * 10 * gap.sum(axis=0)
        w = np.sign(w) * np.maximum(np.abs(w) - step * 10 * L1, 0)
    z, yh = x[hold] @ w + b, y[hold]

    def loss(t: float) -> float:
        return -np.log(softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean()

    temperature = min(np.geomspace(0.05, 5, 60), key=loss)
    p = softmax(z / temperature)
    wrong = np.sort(np.where(p.argmax(axis=1) < len(CLASSES) - 1, p.max(axis=1), 0)[yh == len(CLASSES) - 1])
    least = max(0.5, float(wrong[int(np.ceil((1 - FALSE) * len(wrong))) - 1]) if len(wrong) else 0.5)
    used = np.abs(w).sum(axis=1) > 0
    return Model(known[used], w[used].astype(float), b.astype(float), float(temperature), least, pairs)


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the classifier with whole lines of at most sample documents, picked by a hash of doc_id, as unknown ones: all their lines, or LINES of them by hash."""
    ids = docs.where("text is not null and doc_id is not null").select("doc_id")
    share = min(1.0, sample / max(1, ids.count()))
    ids = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).distinct().limit(sample)
    # at most sample ids; a repeated id may have more rows than one
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").limit(sample).select(F.split(F.col("text").cast("string"), "\n").alias("lines"))
    rows = picked.select(F.explode("lines").alias("line")).where("trim(line) <> ''").orderBy(F.xxhash64("line")).limit(LINES).collect()
    return fit(sorted(r["line"] for r in rows))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_paragraphs, n_licences (confirmed), families (sorted, joined by a comma), family, probability (of the surest), found
    (line from 0, family, probability, cover, confirmed) for each row of docs(doc_id, text)."""

    def run(block: pa.RecordBatch) -> pa.RecordBatch:
        data, offsets = text_bytes(block.column("text"))
        edges = np.union1d(np.flatnonzero(data == 0x0A) + 1, offsets)
        first = np.searchsorted(edges, offsets)
        words, _, _ = T.spans(data, edges, _GAP)
        has = np.diff(np.searchsorted(words, edges)) > 0
        paragraphs = [int(has[a:b].sum()) for a, b in zip(first[:-1], first[1:], strict=True)]
        which, z = model.logits(data, edges)
        p = softmax(z / model.temperature) if len(z) else np.zeros((0, len(CLASSES)))
        best = p.argmax(axis=1) if len(p) else np.zeros(0, int)
        found = [[] for _ in range(block.num_rows)]
        sure = np.flatnonzero((best < len(CLASSES) - 1) & (p.max(axis=1, initial=0) >= model.least)) if len(p) else []
        for i in sure:
            line = int(which[i])
            doc = int(np.searchsorted(first, line, "right")) - 1
            cover = model.cover(data[edges[line] : edges[line + 1]].tobytes().decode(), int(best[i]))
            found[doc].append({"line": line - int(first[doc]), "family": CLASSES[best[i]], "probability": float(p[i, best[i]]), "cover": cover, "confirmed": cover >= COVER})
        firm = [[x for x in f if x["confirmed"]] for f in found]
        top = [max(f, key=lambda x: (x["probability"], -x["line"])) if f else None for f in firm]
        return pa.record_batch({
            "doc_id": block.column("doc_id"), "n_paragraphs": pa.array(paragraphs, pa.int64()), "n_licences": pa.array([len(f) for f in firm], pa.int64()),
            "families": pa.array([",".join(sorted({x["family"] for x in f})) for f in firm], pa.string()),
            "family": pa.array([t and t["family"] for t in top], pa.string()), "probability": pa.array([t and t["probability"] for t in top], pa.float64()),
            "found": pa.array(found, pa.list_(pa.struct([("line", pa.int32()), ("family", pa.string()), ("probability", pa.float64()), ("cover", pa.float64()), ("confirmed", pa.bool_())]))),
        })

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_blocks(slim, run, "doc_id long, n_paragraphs long, n_licences long, families string, family string, probability double, found array<struct<line: int, family: string, probability: double, cover: double, confirmed: boolean>>")
