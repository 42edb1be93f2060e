"""Licence notices in documents: a trained paragraph classifier, confirmed against templates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import ALNUM, WordHasher, mix, slices, text_buffer, without, word_spans

UNKNOWN = "unknown"
#: Words of the n-grams that paragraphs are judged by.
WIDTHS = (1, 2, 3)
#: Documents of the corpus whose paragraphs serve as examples of no licence, about.
SAMPLE = 1500
#: Variants of each template to learn from.
VARIANTS = 48
#: Part of a template's n-grams that a confirmed paragraph has.
CONFIRM = 0.5
RESULT = ("n_paragraphs", "families", "licenses")
FOUND = "array<struct<paragraph:int,family:string,probability:double,similarity:double>>"

#: Notices as authors write them, by family; these are what is learned.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
        "This project is distributed under the terms of the Apache License 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This software is available under the terms of the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "Distributed under the GNU GPL, version 2 or later.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "Distributed under the GNU LGPL, version 3 or later.",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Use of this source code is governed by a BSD-style license.",
        "Licensed under the 3-Clause BSD License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This text is available under the Creative Commons Attribution License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
    ),
}

_SLICE = 1 << 21
_HASHER = WordHasher(2)


def paragraph_grams(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams of texts, and the text each is in."""
    mapped, begin, end, counts = word_spans(data, starts, ALNUM)
    words = _HASHER.words(mapped, begin, end)
    owner = np.repeat(np.arange(len(counts)), counts)
    grams, owners = [], []
    for width in WIDTHS:
        run = _HASHER.runs(words, width)
        own = owner[: len(run)]
        whole = own == owner[width - 1 : width - 1 + len(run)]
        grams.append(mix(run[whole] + np.uint64(width)))
        owners.append(own[whole])
    return np.concatenate(grams), np.concatenate(owners)


def _sets(texts: list[str]) -> list[np.ndarray]:
    data, starts = text_buffer(pa.array(texts, pa.string()))
    grams, owner = paragraph_grams(data, starts)
    order = np.argsort(owner, kind="stable")
    cuts = np.searchsorted(owner[order], np.arange(len(texts) + 1))
    grams = grams[order]
    return [np.unique(grams[a:z]) for a, z in zip(cuts, cuts[1:])]


@dataclass(frozen=True)
class LicenseModel:
    """Sparse weights over known n-grams; its size follows from the templates alone."""

    families: tuple[str, ...]
    grams: np.ndarray
    weights: np.ndarray
    intercepts: np.ndarray
    temperature: float
    templates: tuple[tuple[np.ndarray, ...], ...]

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        """Calibrated probability of each class."""
        scaled = logits / self.temperature
        scaled -= scaled.max(axis=1, keepdims=True)
        out = np.exp(scaled)
        return out / out.sum(axis=1, keepdims=True)

    def logits(self, grams: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        hit = self.grams[place] == grams
        # An n-gram counts once per paragraph.
        pair = np.unique(owner[hit] * len(self.grams) + place[hit])
        text, gram = pair // len(self.grams), pair % len(self.grams)
        out = np.tile(self.intercepts, (n, 1))
        for k in range(len(self.families)):
            out[:, k] += np.bincount(text, weights=self.weights[k, gram], minlength=n)
        return out

    def similarity(self, family: int, grams: np.ndarray) -> float:
        """Largest part of a template of the family that the paragraph has."""
        return max(float(np.isin(t, grams).mean()) for t in self.templates[family])

    @cached_property
    def listed(self) -> list[tuple[int, np.ndarray, int]]:
        """Family of each template, which of the known n-grams it has, and the words of a window for it."""
        out = []
        for k, name in enumerate(self.families[:-1]):
            for own, text in zip(self.templates[k], TEMPLATES[name]):
                data, starts = text_buffer(pa.array([text], pa.string()))
                words = len(word_spans(data, starts, ALNUM)[1])
                out.append((k, np.isin(self.grams, own), words + words // 2))
        return out


def _variants(text: str, count: int, filler: list[str], rng: np.random.Generator) -> list[str]:
    """The text with words lost, other numbers and other words around."""
    out = [text]
    words = text.split()
    while len(out) < count:
        kept = [w for w in words if rng.random() > 0.08] or words
        kept = [
            "".join(str(rng.integers(1, 6)) if c.isdigit() else c for c in w) if rng.random() < 0.5 else w
            for w in kept
        ]
        around = [filler[i] for i in rng.integers(0, len(filler), rng.integers(0, 12))] if filler else []
        cut = int(rng.integers(0, len(around) + 1))
        out.append(" ".join([*around[:cut], *kept, *around[cut:]]))
    return out


def learn(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, seed: int = 7) -> LicenseModel:
    """A model of the templates against paragraphs of about ``sample`` documents.

    The sample, chosen by hash of the text, is a documented bound; sampled paragraphs
    that have most of a template are not taken as examples of no licence. A quarter
    of the examples only sets the temperature of the probabilities.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = max(texts.count(), 1)
    drawn = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, sample / total)))
    # At most a few lines of each, so that long documents do not crowd out the others.
    rows = texts.where(drawn).select(F.slice(F.split("text", "\n"), 1, 8).alias("lines")).limit(2 * sample).collect()
    plain = sorted({line[:2000] for row in rows for line in row["lines"] if line.strip()})
    rng = np.random.default_rng(seed)
    filler = [w for line in plain[:500] for w in line.split()[:20]]

    names = tuple(sorted(TEMPLATES))
    templates = tuple(tuple(_sets(list(TEMPLATES[x]))) for x in names)
    grams = np.unique(np.concatenate([t for family in templates for t in family]))
    examples: list[tuple[int, np.ndarray]] = []
    for k, name in enumerate(names):
        for text in TEMPLATES[name]:
            examples += [(k, x) for x in _sets(_variants(text, VARIANTS, filler, rng))]
    every = [t for family in templates for t in family]
    for own in _sets(plain):
        if len(own) and max(float(np.isin(t, own).mean()) for t in every) < CONFIRM:
            examples.append((len(names), own))
    # Words of notices without a notice, for the class of unknown paragraphs.
    words = sorted({w for name in names for text in TEMPLATES[name] for w in text.split()})
    for _ in range(400):
        mixed = [words[i] for i in rng.integers(0, len(words), rng.integers(1, 4))]
        mixed += [filler[i] for i in rng.integers(0, len(filler), rng.integers(3, 20))] if filler else []
        examples.append((len(names), _sets([" ".join(rng.permutation(mixed))])[0]))

    def row(label: int, own: np.ndarray):
        place = np.flatnonzero(np.isin(grams, own))
        return float(label), Vectors.sparse(len(grams), place.tolist(), [1.0] * len(place))

    held = [i % 4 == 3 for i in range(len(examples))]
    frame = spark.createDataFrame([row(*x) for x, h in zip(examples, held) if not h], ["label", "features"])
    fitted = LogisticRegression(
        family="multinomial", maxIter=60, regParam=2e-4, elasticNetParam=0.5, standardization=False
    ).fit(frame.coalesce(1))
    weights = fitted.coefficientMatrix.toArray()
    model = LicenseModel((*names, UNKNOWN), grams, weights, np.asarray(fitted.interceptVector), 1.0, templates)
    rest = [x for x, h in zip(examples, held) if h]
    logits = np.stack([model.logits(own, np.zeros(len(own), np.int64), 1)[0] for _, own in rest])
    labels = np.array([label for label, _ in rest])

    def loss(temperature: float) -> float:
        scaled = logits / temperature
        scaled = scaled - scaled.max(axis=1, keepdims=True)
        return float((np.log(np.exp(scaled).sum(axis=1)) - scaled[np.arange(len(labels)), labels]).mean())

    best = min((0.25 * 1.15**k for k in range(24)), key=loss)
    return LicenseModel(model.families, grams, weights, model.intercepts, best, templates)


def _lines(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where lines begin (and the end), and the document of each line."""
    breaks = np.flatnonzero(data == 0x0A) + 1
    every = np.unique(np.concatenate((starts, breaks)))
    begin = every[:-1]
    return every, np.searchsorted(starts, begin, side="right") - 1


def _notices(
    known: LicenseModel, gram: np.ndarray, at: np.ndarray, width: np.ndarray
) -> Iterator[tuple[int, int, int, float, float]]:
    """First and last word, family, probability and similarity of each notice in one paragraph.

    ``gram``, ``at`` and ``width`` tell of its known n-grams by place. Windows somewhat
    longer than a template are held against it. The one with most n-grams comes first,
    and a word counts for one notice only, so that a name within another name is not a
    second notice.
    """
    taken = np.zeros(int((at + width).max()), bool)
    order = np.argsort(at, kind="stable")
    gram, at, width = gram[order], at[order], width[order]

    def inside(t: int, start: int) -> np.ndarray:
        _, has, size = known.listed[t]
        a, z = np.searchsorted(at, [start, start + size])
        own = np.arange(a, z)
        own = own[has[gram[a:z]] & (at[a:z] + width[a:z] <= start + size)]
        free = [not taken[at[i] : at[i] + width[i]].any() for i in own.tolist()]
        return own[np.array(free, bool)]

    windows = []
    for t, (_, has, size) in enumerate(known.listed):
        need = CONFIRM * has.sum()
        hit = has[gram]
        if len(np.unique(gram[hit])) < need:
            continue
        spots = at[hit]
        starts = np.unique(spots)
        starts = starts[np.searchsorted(spots, starts + size) - np.searchsorted(spots, starts) >= need]
        for start in starts.tolist():
            n = len(np.unique(gram[inside(t, start)]))
            if n >= need:
                windows.append((-n, -n / has.sum(), -start, t))
    for _, _, start, t in sorted(windows):
        family, has, _ = known.listed[t]
        own = inside(t, -start)
        own = own[np.argsort(at[own] + width[own], kind="stable")]
        same, once = np.unique(gram[own], return_index=True)
        # The window ends with the last n-gram that is new in it.
        own, same = own[: once.max(initial=-1) + 1], len(same) / has.sum()
        runs = own[width[own] > 1]
        if same < CONFIRM or not len(runs):
            continue
        first, last = int(at[runs].min()), int((at[runs] + width[runs]).max())
        near = gram[(at >= first) & (at + width <= last)]
        chance = known.probabilities(known.logits(known.grams[near], np.zeros(len(near), np.int64), 1))[0]
        if chance.argmax() == family and chance[family] > 0.5:
            for i in runs.tolist():
                taken[at[i] : at[i] + width[i]] = True
            yield first, last - 1, family, float(chance[family]), float(same)


def scan(docs: DataFrame, model: LicenseModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_paragraphs``, ``families`` and ``licenses``.

    All lines with a word are judged, and all windows as long as a template and half
    of it in a run of such lines, so that wrapped and commented notices and several in
    one line are found. One is reported if the calibrated probability of a family is
    over one half and at least half of the n-grams of one of its templates are there.
    ``n_paragraphs`` counts the lines with a word, ``paragraph`` is the one of them,
    from 0, in which the notice begins; ``families`` are sorted names.

    Null, empty and blank texts have no paragraphs. Repeated rows are judged alike,
    empty tables give empty results, and input columns named like a result column
    are replaced.
    """
    docs = without(docs, RESULT)
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    schema = docs.selectExpr(
        "*", "0 AS n_paragraphs", "array('') AS families", f"cast(array() AS {FOUND}) AS licenses"
    ).schema
    kinds = [
        pa.int32(), pa.list_(pa.string()),
        pa.list_(pa.struct([("paragraph", pa.int32()), ("family", pa.string()),
                            ("probability", pa.float64()), ("similarity", pa.float64())])),
    ]

    def judge(known: LicenseModel, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[int, list]]:
        docs_here = len(starts) - 1
        cuts, doc = _lines(data, starts)
        mapped, begin, end, in_line = word_spans(data, cuts, ALNUM)
        words = _HASHER.words(mapped, begin, end)
        line = np.repeat(np.arange(len(doc)), in_line)
        filled = in_line > 0
        # Numbers of the filled lines within their documents.
        rank = np.cumsum(filled) - 1
        count = np.bincount(doc[filled], minlength=docs_here)
        first = np.cumsum(count) - count
        # Runs of filled lines; a line of comment signs alone has no word.
        full = np.flatnonzero(filled)
        fresh = np.ones(len(full), bool)
        fresh[1:] = (np.diff(full) > 1) | (doc[full[1:]] != doc[full[:-1]])
        block = np.repeat(np.cumsum(fresh) - 1, in_line[full])
        ids, places, widths = [], [], []
        for width in WIDTHS:
            run = mix(_HASHER.runs(words, width) + np.uint64(width))
            at = np.minimum(np.searchsorted(known.grams, run), len(known.grams) - 1)
            n = len(run)
            hit = np.flatnonzero((known.grams[at] == run) & (block[:n] == block[width - 1 : width - 1 + n]))
            ids.append(at[hit])
            places.append(hit)
            widths.append(np.full(len(hit), width))
        gram, at, wide = np.concatenate(ids), np.concatenate(places), np.concatenate(widths)
        within = line[at] == line[at + wide - 1]
        grams, owner = known.grams[gram[within]], line[at[within]]
        chance = known.probabilities(known.logits(grams, owner, len(doc)))
        best = chance.argmax(axis=1)
        unknown = len(known.families) - 1
        picked = np.flatnonzero((best != unknown) & filled & (chance.max(axis=1) > 0.5))
        rows: dict[tuple[int, int], tuple[float, float]] = {}
        for x in picked.tolist():
            family = int(best[x])
            same = known.similarity(family, grams[owner == x])
            if same >= CONFIRM:
                rows[x, family] = float(chance[x, family]), same
        # Only paragraphs that have half of a template somewhere can have a notice.
        size = len(known.grams)
        pair = np.unique(block[at] * size + gram)
        of, have = pair // size, pair % size
        hopeful = np.zeros(int(fresh.sum()), bool)
        for _, has, _ in known.listed:
            hopeful |= np.bincount(of[has[have]], minlength=len(hopeful)) >= CONFIRM * has.sum()
        wanted = np.flatnonzero(hopeful[block[at]])
        wanted = wanted[np.argsort(block[at[wanted]], kind="stable")]
        edges = np.flatnonzero(np.diff(block[at[wanted]])) + 1
        for own in np.split(wanted, edges) if len(wanted) else []:
            offset = int(at[own].min())
            for a, z, family, p, same in _notices(known, gram[own], at[own] - offset, wide[own]):
                a, z = int(line[a + offset]), int(line[z + offset])
                for x in range(a + 1, z + 1):  # a line of a wrapped notice that was found by itself
                    rows.pop((x, family), None)
                rows.setdefault((a, family), (p, same))
        found: dict[int, list] = {}
        for (x, family), (p, same) in sorted(rows.items()):
            found.setdefault(int(doc[x]), []).append(
                {
                    "paragraph": int(rank[x] - first[doc[x]]),
                    "family": known.families[family],
                    "probability": p,
                    "similarity": same,
                }
            )
        return count, found

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            data, starts = text_buffer(batch.column(at))
            counts = np.zeros(batch.num_rows, np.int32)
            licenses: list[list] = [[] for _ in range(batch.num_rows)]
            for a, z in slices(starts, _SLICE):
                cut = starts[a : z + 1]
                if cut[-1] == cut[0]:
                    continue
                count, found = judge(known, data[cut[0] : cut[-1]], cut - cut[0])
                counts[a:z] = count
                for doc, rows in found.items():
                    licenses[a + doc] = rows
            families = [sorted({r["family"] for r in rows}) for rows in licenses]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(counts, kinds[0]), pa.array(families, kinds[1]), pa.array(licenses, kinds[2])],
                [*batch.schema.names, *RESULT],
            )

    return docs.mapInArrow(task, schema)
