"""License statements in texts.

Templates are fingerprinted by winnowing: of each window of hashed word grams the least is kept. The fingerprints
make an inverted index of fixed size. A text's grams that are in the index name templates and places;
a banded alignment of the template's words with those around a place then tells how much of the template is
there, and where.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import let_workers_import, text_hash

#: (least words of a template, words of a gram, grams of a window). Of a template of m words a fifth may be missing, changed or
#: have a word put in between; what is left has a run of equal words that holds a whole window, so it shares a fingerprint.
GRAMS = ((1, 1, 1), (2, 2, 1), (8, 3, 1), (16, 3, 2))
BAND = 8
LEAST_COVERAGE = 0.8

#: Statements of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts, ends of all words of some texts, and the edges of each text among them. ASCII counts as lower case."""
    from tidewell.llm.grams import WORD_BYTE, _runs, hash_runs
    from tidewell.llm.hmm import LOWER

    keep = WORD_BYTE[data]
    starts, lengths = _runs(data, offsets, keep) if len(data) else (np.zeros(0, np.int64),) * 2
    edges = np.searchsorted(starts, offsets)
    edges[-1] = len(starts)
    return hash_runs(LOWER[data], starts, lengths, keep), starts, starts + lengths, edges


def gram_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` words."""
    from tidewell.llm.grams import mix, powers

    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    factor = powers(size, 0xD6E8FEB86659FD93)
    return mix(sum((words[j : n + j] * factor[j] for j in range(size)), np.full(n, size, np.uint64)))


def winnowed(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the grams that are the least of some window; fewer grams than that are one window."""
    if len(grams) <= window:
        return np.array([int(grams.argmin())] if len(grams) else [], np.int64)
    return np.unique([at + int(grams[at : at + window].argmin()) for at in range(len(grams) - window + 1)])


class Index:
    """The templates' fingerprints: for each length of gram the sorted hashes, and where they lie."""

    def __init__(self, templates: list[tuple[str, str]]):
        raw = [t.encode() for _, t in templates]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        data = np.frombuffer(b"".join(raw), np.uint8)
        words, _, _, edges = word_spans(data, offsets)
        self.words = [words[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        found: dict[int, list[tuple[int, int, int]]] = {}
        for i, w in enumerate(self.words):
            size, window = next((g, k) for least, g, k in reversed(GRAMS) if len(w) >= least or least == 1)
            grams = gram_hashes(w, size)
            found.setdefault(size, []).extend((int(grams[at]), i, int(at)) for at in winnowed(grams, window))
        self.tables = {size: (np.array([r[0] for r in sorted(rows)], np.uint64), [r[1:] for r in sorted(rows)]) for size, rows in found.items()}

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in ``words``, template, place in it)."""
        for size, (grams, places) in self.tables.items():
            own = gram_hashes(words, size)
            lo, hi = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
            for i in np.flatnonzero(hi > lo).tolist():
                for k in range(lo[i], hi[i]):
                    yield (i, *places[k])


def align(template: np.ndarray, words: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int]:
    """(matched, first, last): most words of ``template`` in order in ``words`` within ``band`` of the diagonal.

    Word j of the template may meet words[j + diagonal - band .. j + diagonal + band].
    """
    width = 2 * band + 1
    none = -1
    score = np.zeros((len(template) + 1, width + 2), np.int64)
    begin = np.full((len(template) + 1, width + 2), none)
    end = np.full((len(template) + 1, width + 2), none)
    for j, t in enumerate(template):
        for b in range(width):
            at = j + diagonal - band + b
            # From the row above: the same word of the text lies one cell further right.
            best = (score[j, b + 2], begin[j, b + 2], end[j, b + 2])
            left = (score[j + 1, b], begin[j + 1, b], end[j + 1, b])
            if left[0] > best[0]:
                best = left
            if 0 <= at < len(words) and words[at] == t:
                s, f = score[j, b + 1] + 1, begin[j, b + 1]
                if s >= best[0]:
                    best = (s, at if f == none else f, at)
            score[j + 1, b + 1], begin[j + 1, b + 1], end[j + 1, b + 1] = best
    most = np.flatnonzero(score[-1] == score[-1].max())
    k = int(most[np.abs(most - band - 1).argmin()])  # nearest to the diagonal
    return int(score[-1, k]), int(begin[-1, k]), int(end[-1, k])


def license_spans(
    docs: DataFrame, templates: list[tuple[str, str]] | None = None, coverage: float = LEAST_COVERAGE, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """The places where a text has at least the share ``coverage`` of a template's words, in order.

    Returns key, license, template (its number), matched (words), words (of the template), coverage, first_char and
    end_char (code points). Places of one template that overlap count once: in their order, the one with more coverage
    stays, and of equals the first. A null or empty text has none. Repeated rows with equal number and text report once; null numbers are
    kept. An empty table gives an empty result. Other columns are ignored.
    """
    let_workers_import(docs.sparkSession)
    templates = TEMPLATES if templates is None else templates
    kind = dict(docs.dtypes)[key]

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidewell.llm.grams import text_bytes

        index = Index(templates)
        names = ["doc", "text_hash", "template", "diagonal", "words", "chars", "ends"]
        for batch in batches:
            data, offsets = text_bytes(batch.column(2), lower=False)
            i, n = 0, batch.num_rows
            while i < n:
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 19), "right")) - 1)
                part, bounds = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words, starts, ends, edges = word_spans(part, bounds)
                chars = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80)))
                rows: list[list] = [[] for _ in names]
                seen: set[tuple[int, int, int]] = set()
                for at, template, place in index.hits(words):
                    d = int(np.searchsorted(edges, at, "right")) - 1
                    diagonal = at - int(edges[d]) - place
                    if (d, template, diagonal) in seen:
                        continue
                    seen.add((d, template, diagonal))
                    m = len(index.words[template])
                    lo, hi = max(edges[d], edges[d] + diagonal - BAND), min(edges[d + 1], edges[d] + diagonal + m + BAND)
                    if np.isin(index.words[template], words[lo:hi]).sum() < coverage * m - 1e-9:
                        continue  # too few of its words are there, in any order
                    base = chars[bounds[d]]
                    for c, x in zip(rows, (i + d, i + d, template, diagonal + edges[d] - lo, words[lo:hi].view(np.int64), chars[starts[lo:hi]] - base, chars[ends[lo:hi]] - base), strict=True):
                        c.append(x)
                if rows[0]:
                    take = pa.array(rows[0], pa.int64())
                    kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), *[pa.array(c, t) for c, t in zip(rows[2:], kinds, strict=True)]], names)
                i = j

    cols = docs.select(F.col(key).alias("doc"), text_hash(text).alias("text_hash"), F.col(text).alias("text"))
    found = cols.mapInArrow(candidates, f"doc {kind}, text_hash long, template int, diagonal int, words array<long>, chars array<long>, ends array<long>")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        known: dict[tuple, tuple[int, int, int]] = {}
        for batch in batches:
            rows = []
            for template, diagonal, words, chars, ends in zip(*(batch.column(k).to_pylist() for k in range(2, 7)), strict=True):
                at = (template, diagonal, tuple(words))
                if at not in known:
                    if len(known) > 50_000:
                        known.clear()
                    known[at] = align(index.words[template], np.array(words, np.int64).view(np.uint64), diagonal)
                matched, a, b = known[at]
                rows.append((matched, len(index.words[template]), chars[a] if matched else None, ends[b] if matched else None))
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *cols], ["doc", "text_hash", "template", "matched", "words", "first_char", "end_char"])

    # Long runs of statements in a few texts are dealt out anew.
    spread = found.repartition(F.xxhash64("doc", "text_hash", "template", "diagonal", "chars"))
    made = spread.mapInArrow(aligned, f"doc {kind}, text_hash long, template int, matched long, words long, first_char long, end_char long")
    made = made.withColumn("coverage", F.col("matched") / F.col("words")).where(F.col("coverage") >= coverage)
    # By their first characters; of two that overlap the one with more coverage stays, and of equals the first.
    places = made.distinct().groupBy("doc", "text_hash", "template").agg(F.sort_array(F.collect_list(F.struct("first_char", "end_char", "coverage", "matched", "words"))).alias("p"))
    last = lambda kept: F.element_at(kept, -1)
    none = F.array().cast(places.schema["p"].dataType)
    kept = F.aggregate(
        "p", none,
        lambda kept, x: F.when(F.size(kept) == 0, F.array(x))
        .when(x["first_char"] >= last(kept)["end_char"], F.concat(kept, F.array(x)))
        .when(x["coverage"] > last(kept)["coverage"], F.concat(F.slice(kept, F.lit(1), F.size(kept) - 1), F.array(x)))
        .otherwise(kept),
    )
    best = places.select("doc", "text_hash", "template", F.explode(kept).alias("b"))
    names = F.element_at(F.array(*[F.lit(n) for n, _ in templates]), F.col("template") + 1)
    return best.select(
        F.col("doc").alias(key), "text_hash", names.alias("license"), "template", "b.matched", "b.words", "b.coverage", "b.first_char", "b.end_char",
    )
