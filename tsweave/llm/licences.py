"""Licence scan: a paragraph classifier trained on licence notices, confirmed by their templates.

Paragraphs are lines; longer ones are read in overlapping windows. A sparse
logistic regression over hashed words and word pairs tells the licence families
and everything else apart. It is fitted on the templates below, whole and in
parts and amid other words, and on paragraphs of a bounded sample of documents.
A third of these is held out: its likelihood sets the temperature of the
probabilities, and its unknown paragraphs set how probable a licence must be.
Stretches of windows that pass are then compared with the templates of every
family, word triple by word triple: each place that agrees with one is a notice.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, functions as F

from tsweave.llm import text as T

BUCKETS = 1 << 13
#: Words of a window, and from one window to the next.
WINDOW, STEP = 60, 30
#: Documents whose paragraphs stand for text without a licence, and paragraphs taken from them, at most.
MOST_DOCUMENTS, MOST_PARAGRAPHS = 400, 4_000
#: Share of held-out unknown paragraphs that may pass as a licence.
FALSE_SHARE = 0.001
#: Share of word triples that must agree with a template.
SIMILAR = 0.6
UNKNOWN = "unknown"

#: Fixed wording of public licence notices.
TEMPLATES = {
    "agpl": [
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
        "This work is licensed under CC BY-SA 4.0.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction.",
        "Licensed under the MIT License. See the LICENSE file for details.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
}


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    begin, end, first = T.spans(raw, at, T.NOT_ALNUM)
    return T.hashes(T.LOWER[raw], begin, end), first


def _windows(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Paragraph and first word of every window, for paragraphs of so many words."""
    number = np.where(count > WINDOW, -(-(count - WINDOW) // STEP) + 1, (count > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(count)), number)
    return owner, (np.arange(len(owner)) - np.repeat(np.cumsum(number) - number, number)) * STEP


def _features(text: str) -> dict[int, float]:
    raw, at = T.laid_out(pa.array([text]))
    word, first = _words(raw, at)
    pair, _ = T.grams(word, first, 2)
    keys, n = np.unique(np.concatenate([word, pair]) % np.uint64(BUCKETS), return_counts=True)
    return dict(zip(keys.astype(int).tolist(), (n / np.sqrt(max(1, len(word) + len(pair)))).tolist()))


def _triples(text: str) -> frozenset[int]:
    word, first = _words(*T.laid_out(pa.array([text])))
    return frozenset(T.grams(word, first, min(3, max(1, len(word))))[0].tolist())


def _examples(templates: dict[str, list[str]], others: list[str], seed: int = 7) -> list[tuple[str, str]]:
    """Templates whole, in parts of five words or more, and amid words of other paragraphs; and those paragraphs."""
    draw, out = random.Random(seed), [(UNKNOWN, x) for x in others]
    pool = [w for x in others for w in x.split()][:20_000] or ["text"]
    for family, texts in templates.items():
        for whole in texts:
            words = whole.split()
            for _ in range(40):
                size = draw.randint(min(5, len(words)), len(words))
                start = draw.randint(0, len(words) - size)
                part = words[start : start + size] if draw.random() < 0.3 else words
                before, after = (draw.choices(pool, k=draw.choice([0, 0, 3, 10, 20])) for _ in range(2))
                out.append((family, " ".join([*before, *part, *after])))
            out += [(family, whole)] * 5
    return out


@dataclass(frozen=True)
class LicenceScanner:
    """Weights of each class, how probable a licence must be, and the templates."""

    classes: list[str]
    weights: np.ndarray = field(repr=False)
    intercepts: np.ndarray
    temperature: float
    threshold: float
    templates: dict[str, list[str]] = field(repr=False)

    @staticmethod
    def fit(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> LicenceScanner:
        """Fitted on ``templates`` and on the paragraphs of at most ``MOST_DOCUMENTS`` documents, those of lowest hash; repeated rows are one."""
        spark, templates = docs.sparkSession, templates or TEMPLATES
        key = F.xxhash64("doc_id", "text")
        named = docs.select("text", key.alias("k")).where("text IS NOT NULL")
        # The keys alone are sorted; texts are picked by the greatest of them where they lie.
        least = [r["k"] for r in named.select("k").distinct().orderBy("k").limit(MOST_DOCUMENTS).collect()]
        sample = named.where(F.col("k") <= F.lit(max(least, default=-(1 << 63))))
        lines = sample.select(F.explode(F.split("text", "\n")).alias("line")).where("length(trim(line)) > 0").distinct()
        rows = lines.orderBy(F.xxhash64("line"), "line").limit(MOST_PARAGRAPHS).collect()
        known = [_triples(t) for texts in templates.values() for t in texts]
        others = [" ".join(r["line"].split()[:WINDOW]) for r in rows]
        others = [x for x, own in ((x, _triples(x)) for x in others) if all(_alike(own, t) < SIMILAR / 2 for t in known)]
        examples = _examples(templates, others)
        random.Random(11).shuffle(examples)
        classes = [*sorted(templates), UNKNOWN]
        held, used = examples[: len(examples) // 3], examples[len(examples) // 3 :]
        vector = lambda x: Vectors.sparse(BUCKETS, sorted(_features(x).items()))
        train = spark.createDataFrame([(float(classes.index(c)), vector(x)) for c, x in used], ["label", "features"]).coalesce(2).cache()
        model = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.3, maxIter=50, standardization=False).fit(train)
        train.unpersist()
        weights = np.zeros((len(classes), BUCKETS))
        weights[: model.coefficientMatrix.numRows] = model.coefficientMatrix.toArray()
        intercepts = np.zeros(len(classes))
        intercepts[: len(model.interceptVector)] = model.interceptVector.toArray()
        logits = np.array([weights[:, list(f)] @ np.array(list(f.values())) + intercepts if (f := _features(x)) else intercepts for _, x in held])
        truth = np.array([classes.index(c) for c, _ in held])
        loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
        temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
        licensed = 1 - _softmax(logits[truth == len(classes) - 1] / temperature)[:, -1]
        threshold = max(0.5, float(np.quantile(licensed, 1 - FALSE_SHARE))) if len(licensed) else 0.5
        return LicenceScanner(classes, weights, intercepts, temperature, threshold, templates)

    def scan(self, docs: DataFrame) -> DataFrame:
        """``doc_id, paragraph, first_word, n_words, family, probability, similarity, confirmed``.

        One row for each notice in each row of ``docs``: each place, in windows that the classifier takes for a
        licence, that agrees with a template of any family, with the family's highest probability there. Windows
        whose most probable family has no such place are merged where they overlap and are one row, not confirmed,
        at the most probable window, the first among equals. ``paragraph`` counts the lines of the text from 0.
        Null and empty texts have none. Repeated rows are scanned alike, null ids kept, other columns not read.
        """
        weights = np.ascontiguousarray(self.weights.T.astype(np.float32))
        intercepts, temperature, threshold, classes = self.intercepts, self.temperature, self.threshold, self.classes
        templates = {k: [_triples(t) for t in texts] for k, texts in self.templates.items()}
        places = _Places({classes.index(k): texts for k, texts in self.templates.items()})
        names = ["doc_id", "paragraph", "first_word", "n_words", "family", "probability", "similarity", "confirmed"]

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in T.slices(batches):
                raw, at = T.laid_out(batch.column(1))
                begin, end, line_first = T.lines_of(raw, at)
                # Lines as texts of their own; the break that ends one is no part of a word.
                word, first = _words(raw, np.append(begin, len(raw)))
                owner, start = _windows(np.diff(first))
                low = first[owner] + start
                high = np.minimum(low + WINDOW, first[owner + 1])
                uni = (word % np.uint64(BUCKETS)).astype(np.int64)
                pair = np.zeros(len(word), np.int64)
                if len(word) > 1:
                    pair[:-1] = (T.mix(T.mix(word[:-1] + T.ODD) * T.ODD + word[1:]) % np.uint64(BUCKETS)).astype(np.int64)
                scale = 1 / np.sqrt(np.maximum(2 * (high - low) - 1, 1))
                logits = np.empty((len(low), len(classes)))
                for k in range(len(classes)):
                    ones = np.concatenate([[0.0], np.cumsum(weights[uni, k], dtype=np.float64)])
                    twos = np.concatenate([[0.0], np.cumsum(weights[pair, k], dtype=np.float64)])
                    logits[:, k] = (ones[high] - ones[low] + twos[np.maximum(high - 1, low)] - twos[low]) * scale + intercepts[k]
                chance = _softmax(logits / temperature)
                best = chance[:, :-1].argmax(1)
                hit = np.flatnonzero((1 - chance[:, -1] >= threshold) & (chance.argmax(1) < len(classes) - 1))
                rows = []
                for some in _stretches(hit.tolist(), owner, low, high):
                    line, base = int(owner[some[0]]), int(low[some[0]])
                    doc = int(np.searchsorted(line_first, line, "right")) - 1
                    at_line = (doc, line - int(line_first[doc]))
                    notices = places.notices(word[base : high[some[-1]]])
                    for family, begins, ends, alike in notices:
                        p = max(float(chance[i, family]) for i in some if low[i] < base + ends and base + begins < high[i])
                        rows.append((*at_line, int(start[some[0]]) + begins, ends - begins, classes[family], p, alike, True))
                    for family in sorted(set(best[some].tolist())):
                        known = [(base + x, base + y) for f, x, y, _ in notices if f == family]
                        rest = [i for i in some if best[i] == family and not any(x < high[i] and low[i] < y for x, y in known)]
                        for near in _stretches(rest, owner, low, high):
                            checked = []
                            for i in near:
                                own = word[low[i] : high[i]]
                                triples = frozenset(T.grams(own, np.array([0, len(own)]), min(3, len(own)))[0].tolist())
                                alike = max(_alike(triples, t) for t in templates[classes[family]])
                                checked.append((alike >= SIMILAR, float(chance[i, family]), -i, alike))
                            sure, p, i, alike = max(checked)
                            rows.append((*at_line, int(start[-i]), int(high[-i] - low[-i]), classes[family], p, alike, sure))
                rows.sort(key=lambda r: r[:5])
                columns = list(zip(*rows)) if rows else [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, t) for c, t in zip(columns[1:], kinds))], names
                )

        schema = (
            "doc_id long, paragraph long, first_word long, n_words long, family string, probability double, similarity double, confirmed boolean"
        )
        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, schema)


def _stretches(windows: list[int], owner: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[list[int]]:
    """Runs of windows of one paragraph that overlap."""
    out: list[list[int]] = []
    for i in windows:
        if out and owner[out[-1][-1]] == owner[i] and low[i] < high[out[-1][-1]]:
            out[-1].append(i)
        else:
            out.append([i])
    return out


class _Places:
    """Where words agree with templates, each given by its family's number."""

    def __init__(self, templates: dict[int, list[str]]):
        self.family, self.times = [], []
        self.by_triple: dict[int, list[int]] = {}
        for family, texts in templates.items():
            for text in texts:
                word, first = _words(*T.laid_out(pa.array([text])))
                if len(word) < 3:
                    continue
                self.times.append(Counter(T.grams(word, first, 3)[0].tolist()))
                self.family.append(family)
                for triple in self.times[-1]:
                    self.by_triple.setdefault(triple, []).append(len(self.times) - 1)

    def notices(self, word: np.ndarray) -> list[tuple[int, int, int, float]]:
        """Family, first word, end and similarity of each notice; where templates compete for words, the most similar has them."""
        if len(word) < 3:
            return []
        triples = T.grams(word, np.array([0, len(word)]), 3)[0].tolist()
        least = len(set(triples))
        held: dict[int, list[tuple[int, int]]] = {}
        found: list[tuple[float, int, int, list[int]]] = []

        def share(t: int) -> float:
            return len({x for _, x in held[t]}) / min(least, len(self.times[t]))

        def close(t: int) -> None:
            if held[t] and share(t) >= SIMILAR:
                found.append((min(1.0, share(t)), len(held[t]), t, [k for k, _ in held[t]]))
                held[t] = []

        for k, x in enumerate(triples):
            for t in self.by_triple.get(x, ()):
                own, times = held.setdefault(t, []), self.times[t]
                spread = 2 * times.total()
                if own and (k - own[0][0] > spread or sum(y == x for _, y in own) == times[x]):
                    close(t)
                    own = held[t]
                    # What does not suffice so far may yet be the beginning of a notice.
                    while own and (k - own[0][0] > spread or sum(y == x for _, y in own) == times[x]):
                        own.pop(0)
                own.append((k, x))
        for t in held:
            close(t)
        taken: set[int] = set()
        out = []
        for alike, n, t, places in sorted(found, key=lambda f: (-f[0], -f[1], f[2])):
            if 2 * len(taken.intersection(places)) < n:
                taken.update(range(places[0], places[-1] + 1))
                out.append((self.family[t], places[0], places[-1] + 3, alike))
        return sorted(out)


def _alike(a: frozenset, b: frozenset) -> float:
    """Share of the smaller set that the sets have in common."""
    return len(a & b) / min(len(a), len(b)) if a and b else 0.0


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)
