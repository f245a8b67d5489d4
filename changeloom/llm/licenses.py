"""License notices in texts: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

Templates are grouped by length: a class of size S holds templates of more than S / 2 and up to S
words (from 4 on). Windows of 2 S words with a stride of S words contain any S consecutive words whole,
so the window around an unchanged notice has at least about a quarter of its shingles in common with
the template. With BANDS bands of one MinHash each, such a window meets its template in at least one
band with probability 1 - 0.75 ** BANDS, over 0.999998. A retrieved template is reported if at least
`least` of its distinct shingles are in the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import bound_batches
from .textbytes import LOWER, NON_ALNUM, arrow_texts, chunks, mix, shingle_hashes, span_hashes, word_spans

BANDS = 48
WIDTH = 2  #: words of a shingle
LEAST = 0.95
#: License notices.
TEMPLATES = (
    ("All-rights-reserved", "All rights reserved."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "This work has been dedicated to the public domain under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


def _shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and each text's first (n + 1 offsets); a single word is one shingle."""
    low = LOWER[data]
    starts, ends, first = word_spans(low, offs, NON_ALNUM)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offs), np.int64)
    words = span_hashes(low, starts, ends)
    grams = shingle_hashes(words, WIDTH)
    n = np.diff(first)
    keep = np.ones(len(grams), bool)
    over = first[1:-1] - 1  # shingles that reach into the next text
    keep[over[(over >= 0) & (over < len(grams))]] = False
    cut = np.concatenate([[0], np.cumsum(np.maximum(0, n - WIDTH + 1))])
    return grams[keep], cut


class Scanner:
    def __init__(self, templates=TEMPLATES, least: float = LEAST, bands: int = BANDS):
        self.names = [n for n, _ in templates]
        self.least = least
        self.factors = mix(np.arange(1, bands + 1, dtype=np.uint64)) | np.uint64(1)
        texts = pa.array([t for _, t in templates], pa.string())
        grams, cut = _shingles(*arrow_texts(texts))
        self.sets = [np.unique(grams[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
        self.classes: dict[int, list[int]] = {}
        for k, s in enumerate(self.sets):
            words = int(cut[k + 1] - cut[k]) + WIDTH - 1
            if len(s):
                self.classes.setdefault(max(4, 1 << (words - 1).bit_length()), []).append(k)
        self.minima = {k: (s[None, :] * self.factors[:, None]).min(1) for k, s in enumerate(self.sets) if len(s)}

    def scan(self, data: np.ndarray, offs: np.ndarray) -> Iterator[list[tuple[int, float]]]:
        """(template, containment) of verified templates for each text."""
        for _, part, po in chunks(data, offs, 1 << 20):
            grams, cut = _shingles(part, po)
            found: list[dict[int, float]] = [{} for _ in range(len(po) - 1)]
            if len(grams):
                for size, members in self.classes.items():
                    for text, template, share in self._class(grams, cut, size, members):
                        found[text][template] = max(share, found[text].get(template, 0.0))
            yield from (sorted(f.items()) for f in found)

    def _class(self, grams: np.ndarray, cut: np.ndarray, size: int, members: list[int]):
        blocks = -(-np.diff(cut) // size)
        first = np.concatenate([[0], np.cumsum(blocks)])
        text = np.repeat(np.arange(len(blocks)), blocks)
        start = cut[:-1][text] + size * (np.arange(first[-1]) - first[:-1][text])
        last = np.zeros(len(text), bool)
        last[first[1:][blocks > 0] - 1] = True
        hits: set[tuple[int, int]] = set()
        for band, factor in enumerate(self.factors):
            low = np.minimum.reduceat(grams * factor, start)
            window = low.copy()
            window[:-1][~last[:-1]] = np.minimum(low[:-1], low[1:])[~last[:-1]]
            for k in members:
                hits.update((k, w) for w in np.flatnonzero(window == self.minima[k][band]).tolist())
        for k, w in sorted(hits):
            end = min(start[w] + 2 * size, cut[text[w] + 1])
            share = np.isin(self.sets[k], grams[start[w] : end]).mean()
            if share >= self.least:
                yield int(text[w]), k, float(share)


def scan_licenses(docs: DataFrame, templates=TEMPLATES, least: float = LEAST) -> DataFrame:
    """docs (doc_id, text, ...) -> (doc_id, matches array<struct<license, template, containment>>), a row for each row of docs.

    Whole texts are scanned; null and empty texts have no matches. Other columns are ignored.
    """
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("matches", T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("template", T.IntegerType()), T.StructField("containment", T.DoubleType())])))])
    arrow = pa.list_(pa.struct([("license", pa.string()), ("template", pa.int32()), ("containment", pa.float64())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, least)
        for batch in it:
            rows = [[{"license": scanner.names[k], "template": k, "containment": s} for k, s in found] for found in scanner.scan(*arrow_texts(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, arrow)], ["doc_id", "matches"])

    return bound_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)
