"""Licence scans: a trained paragraph classifier, confirmed by comparison with templates.

1. Paragraphs for training are derived from public licence notices, with words
   dropped and ordinary words around them, and from a bounded sample of the
   corpus's own paragraphs as the background class.
2. Sparse word n-grams (one to three words) feed a multinomial logistic
   regression. Its terms are those of the notices, a fixed number.
3. On held-out paragraphs the least probability that keeps the wanted precision
   is found. A paragraph that is more likely a licence than not, but of no
   family that sure or without a template's shingles, is ``unknown``.
4. A template confirms if it shares 0.8 or more of its five-word shingles, or of
   the paragraph's if that is the shorter. One of under five words, such as a
   title, confirms if its whole word sequence stands in the paragraph.

A paragraph is a line. Results in special cases: a null or empty text has no
paragraphs. Repeated rows are scanned each for itself. With no corpus
paragraphs for the background, the notices alone are trained on. An empty table
gives no rows. All columns beside id and text are left aside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobsluice.llm.common import bounded_sample, store

# The usual notices of public licences, and their titles.
NOTICES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
        "file except in compliance with the License.",
        "SPDX-License-Identifier: Apache-2.0",
        "Apache License", "Apache License, Version 2.0", "Apache License 2.0",
        "License: Apache-2.0", "License: Apache 2.0"],
    "mit": [
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction",
        "SPDX-License-Identifier: MIT",
        "MIT License", "The MIT License (MIT)", "License: MIT"],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU General Public License", "License: GPL-3.0", "License: GPL"],
    "lgpl": [
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms "
        "of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU Lesser General Public License", "License: LGPL-2.1", "License: LGPL"],
    "bsd": [
        "Released under the 3-Clause BSD License.",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "License: BSD"],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
        "Mozilla Public License", "Mozilla Public License Version 2.0", "License: MPL-2.0"],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
        "Creative Commons Attribution 4.0 International", "License: CC BY 4.0"],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
        "License.",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Creative Commons Attribution-ShareAlike 4.0 International", "License: CC BY-SA 4.0"],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Creative Commons Attribution-NonCommercial 4.0 International", "License: CC BY-NC 4.0"],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related rights "
        "to this work under CC0 1.0.",
        "SPDX-License-Identifier: CC0-1.0",
        "CC0 1.0 Universal", "License: CC0"],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: Unlicense",
        "The Unlicense", "License: Unlicense"],
}
FAMILIES = list(NOTICES)
BACKGROUND = len(FAMILIES)
_TERM = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")


@dataclass(frozen=True)
class LicenceSettings:
    copies: int = 60            # training paragraphs made of each notice
    drop_words: float = 0.1     # share of words dropped in them
    # Background paragraphs taken from the corpus, at most.
    max_background: int = 4_000
    max_terms: int = 4_096
    precision: float = 0.99
    shingle_words: int = 5
    similarity: float = 0.8


def terms(text: str) -> list[str]:
    """Lower-case words; signs inside a name such as ``by-nc`` or ``2.0`` stay."""
    return _TERM.findall(text.lower())


def ngrams(words: list[str]) -> list[str]:
    return words + [" ".join(words[k:k + n]) for n in (2, 3) for k in range(len(words) - n + 1)]


def _noisy(cfg: LicenceSettings):
    """Copies of a notice with words dropped and words of the corpus around them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for label, text, near, copy in zip(*(c.to_pylist() for c in batch.columns)):
                rng = np.random.default_rng([label, copy, len(text)])
                words = terms(text)
                # A title with a word dropped is no title.
                if copy >= 6 and len(words) >= cfg.shingle_words:
                    words = [w for w in words if rng.random() >= cfg.drop_words]
                around = terms(near or "")
                left = int(rng.integers(0, 4)) if copy >= 3 else 0
                right = int(rng.integers(0, 4)) if copy >= 3 else 0
                out.append(around[:left] + words + around[left:left + right])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.float64()), pa.array([ngrams(w) for w in out],
                                                              pa.list_(pa.string())),
                 pa.array([c % 4 == 3 for c in batch.column(3).to_pylist()])],
                names=["label", "grams", "held"])
    return run


def _plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = batch.column(0).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([float(BACKGROUND)] * len(lines)),
             pa.array([ngrams(terms(x)) for x in lines], pa.list_(pa.string())),
             pa.array([h % 4 == 3 for h in batch.column(1).to_pylist()])],
            names=["label", "grams", "held"])


@dataclass(frozen=True)
class LicenceModel:
    terms: dict[str, int]
    weights: np.ndarray         # class by term
    bias: np.ndarray
    sure: float
    shingles: dict[int, list[frozenset]]


def shingles(words: list[str], size: int) -> frozenset:
    return frozenset(tuple(words[k:k + size]) for k in range(max(1, len(words) - size + 1))) \
        if words else frozenset()


def background(texts: DataFrame, cfg: LicenceSettings) -> DataFrame:
    """``(line, h)``: lines of a sample of the documents, chosen over all of it by a hash."""
    found = bounded_sample(texts.where("t is not null"), cfg.max_background, "i", "t") \
        .select("i", F.posexplode(F.split("t", "\n")).alias("at", "line")) \
        .where(~F.col("line").rlike(r"(?i)licen[cs]e|copyright|public domain|permission|spdx"))
    sample = store(found.where("trim(line) <> ''"), "licence-sample")
    return store(bounded_sample(sample, cfg.max_background, "i", "at", "line").select(
        "line", F.xxhash64("i", "at", "line", F.lit("held")).alias("h")), "licence-lines")


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          cfg: LicenceSettings = LicenceSettings()) -> LicenceModel:
    spark = docs.sparkSession
    # Lines of a bounded sample; notices that stand in it are left out as background.
    lines = background(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), cfg)
    near = [r[0] for r in lines.orderBy("h", "line").limit(200).select("line").collect()] or [""]
    rows = [(k, text, near[(k * 31 + at * 7 + copy) % len(near)], copy)
            for k, family in enumerate(FAMILIES) for at, text in enumerate(NOTICES[family])
            for copy in range(cfg.copies)]
    kinds = "label double, grams array<string>, held boolean"
    made = spark.createDataFrame(rows, "label int, text string, near string, copy int") \
        .mapInArrow(_noisy(cfg), kinds)
    data = store(made.unionByName(lines.mapInArrow(_plain, kinds)), "licence-training")
    fitted = data.where("not held")
    words = spark.createDataFrame(
        [(ngrams(terms(t)),) for texts in NOTICES.values() for t in texts], "grams array<string>")
    vector = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=cfg.max_terms,
                             binary=True).fit(words)
    model = LogisticRegression(family="multinomial", regParam=1e-3, maxIter=40).fit(
        vector.transform(fitted).select("label", "features"))
    probability = vector_to_array("probability")
    held = model.transform(vector.transform(data.where("held"))).select(
        "label", F.array_max(probability).alias("p"), "prediction") \
        .where(F.col("prediction") != BACKGROUND)
    # One row for each thousandth of probability: right and wrong ones above it.
    bins = held.groupBy(F.floor(F.col("p") * 1000).alias("bin")).agg(
        F.count("*").alias("n"), F.count_if(F.col("label") == F.col("prediction")).alias("right"))
    sure, n, right = 0.5, 0, 0
    for at, seen, hits in sorted(map(tuple, bins.collect()), reverse=True):
        n, right = n + seen, right + hits
        if right >= cfg.precision * n:
            sure = max(0.5, at / 1000)
    weights = model.coefficientMatrix.toArray()
    bias = np.asarray(model.interceptVector.toArray())
    if len(bias) <= BACKGROUND:     # no background was seen
        weights = np.vstack([weights, np.zeros((1, weights.shape[1]))])
        bias = np.append(bias, 0.0)
    return LicenceModel(
        {t: k for k, t in enumerate(vector.vocabulary)}, weights, bias, sure,
        {k: [shingles(terms(t), cfg.shingle_words) for t in NOTICES[f]]
         for k, f in enumerate(FAMILIES)})


def confirms(model: LicenceModel, family: int, words: list[str], cfg: LicenceSettings) -> bool:
    own = shingles(words, cfg.shingle_words)
    for known in model.shingles[family]:
        size = min(len(known), len(own))
        if size and len(known & own) >= cfg.similarity * size:
            return True
        # Templates of fewer words are one shingle, which must stand in the line as it is.
        if any(len(t) < cfg.shingle_words and any(
                tuple(words[k:k + len(t)]) == t for k in range(len(words) - len(t) + 1))
               for t in known):
            return True
    return False


def classify(model: LicenceModel, line: str, cfg: LicenceSettings) -> tuple[str, float] | None:
    """Family, or ``unknown``, and probability; None for the background."""
    words = terms(line)
    found = {model.terms[g] for g in ngrams(words) if g in model.terms} \
        if sum(w in model.terms for w in words) >= 2 else ()
    if not found:
        return None
    score = model.bias + model.weights[:, sorted(found)].sum(axis=1)
    share = np.exp(score - score.max())
    share /= share.sum()
    if share[BACKGROUND] >= 0.5:
        return None
    best = int(np.argmax(share[:BACKGROUND]))
    sure = share[best] >= model.sure and confirms(model, best, words, cfg)
    return (FAMILIES[best] if sure else "unknown", float(share[best]))


def _scan(model: LicenceModel, cfg: LicenceSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare = {w for w in model.terms if " " not in w and len(w) > 2}
        for batch in batches:
            counts, spans = [], []
            for text in batch.column(1):
                text, at, found, lines = text.as_py() or "", 0, [], 0
                for line in text.split("\n"):
                    if line and not line.isspace():
                        lines += 1
                        low = line.lower()
                        if not rare.isdisjoint(_TERM.findall(low)):
                            verdict = classify(model, line, cfg)
                            if verdict:
                                found.append((verdict[0], at, at + len(line), verdict[1]))
                    at += len(line) + 1
                counts.append(lines)
                spans.append([{"family": f, "start": a, "end": b, "probability": p}
                              for f, a, b, p in found])
            kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()),
                                       ("end", pa.int64()), ("probability", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spans, kind)],
                names=["id", "n_paragraphs", "found"])
    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         cfg: LicenceSettings = LicenceSettings()) -> DataFrame:
    """``(id, n_paragraphs, found)``; ``found`` has family, start, end and probability."""
    model = train(docs, id_col, text_col, cfg)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(
        _scan(model, cfg), f"id {kind}, n_paragraphs long, found array<struct<family:string,"
                           "start:long,end:long,probability:double>>")
