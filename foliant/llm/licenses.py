"""License scans: MinHash bands over overlapping word windows, then exact shingle containment.

Every template is cut into all its windows of one of the sizes SIZES (in five-word shingles), and
so is every text, so a window of a copied notice has its counterpart in the library. A window's
signature is 16 minima, in 8 bands of 2: a window pair of Jaccard similarity 0.8 collides in some
band with probability 0.9997, one of 0.67 with 0.99, and a notice has many windows. A collision
fixes an alignment; the text's stretch there is compared with the whole template by exact
containment of its distinct shingles, and CONTAINMENT of them must be there.

Defined results: null and empty texts match nothing. Of overlapping matches
of one license the fullest counts, then the longest, then the first; one of another license gives
way to a fuller one. Templates under five words are one shingle of all their words and match
where a text has exactly these words in a row; such a match gives way to any longer template of
its license. Without templates given, the library is library_texts(): short notices, paragraphs and
full texts; an empty one matches nothing. Repeated rows give repeated matches. Extra columns are ignored.
"""

from __future__ import annotations

from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .shared import batch, lean

WORDS = 5
CONTAINMENT = 0.8
SIZES = (1, 4, 16)
BANDS, ROWS = 8, 2
STRIDE = {1: 1, 4: 1, 16: 4}

#: Short notices and characteristic paragraphs of well-known public licenses.
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software', "MIT License", "SPDX-License-Identifier: MIT"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("either version 2 of the License, or (at your option) any later version.", "licensed under the GNU General Public License, version 2."),
    "LGPL": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",),
    "BSD": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "ISC License", "SPDX-License-Identifier: ISC"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0": ("dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication.",),
    "All rights reserved": ("All rights reserved. No part of this work may be reproduced", "All rights reserved."),
}

#: Full public texts that stand beside this module, by license.
FULL = {"Apache-2.0": ("Apache-2.0",), "CC0-1.0": ("CC0-1.0",), "GPL-2.0": ("GPL-2",), "GPL-3.0": ("GPL-3",), "LGPL": ("LGPL-2.1", "LGPL-3"), "MPL-2.0": ("MPL-2.0",)}


def library_texts() -> dict[str, tuple[str, ...]]:
    """The default templates: short notices, characteristic paragraphs and full texts."""
    texts = files("foliant.llm") / "texts"
    return {name: (*own, *((texts / f"{x}.txt").read_text("utf-8") for x in FULL.get(name, ()))) for name, own in TEMPLATES.items()}


#: Letters and digits in lower case; all other ASCII separates words.
PLAIN = K.LOWER.copy()
PLAIN[[c for c in range(128) if not chr(c).isalnum()]] = 0x20


def word_sums(data: np.ndarray, offsets: np.ndarray) -> tuple[K.Prefix, np.ndarray]:
    """Prefix sums of word hashes, whose grams may reach over rows, and the rows' word offsets."""
    low = PLAIN[data]
    starts, ends, at = K.words(low, offsets)
    return K.Prefix(K.word_hashes(low, starts, ends)), at


class Library:
    """Band keys of all template windows; and, by number of words, the hashes of templates under five words."""

    def __init__(self, templates: dict[str, tuple[str, ...]]):
        self.names, self.grams = [], []
        self.short: dict[int, dict[int, list[int]]] = {}
        keys: dict[int, list[np.ndarray]] = {w: [] for w in SIZES}
        for name, texts in sorted(templates.items()):
            for text in texts:
                data = np.frombuffer(text.encode(), np.uint8)
                sums, at = word_sums(data, np.array([0, len(data)]))
                n = int(at[-1])
                if not n:
                    raise ValueError(f"a template of {name} has no words")
                g = sums.grams(min(n, WORDS))
                if n < WORDS:
                    self.short.setdefault(n, {}).setdefault(int(g[0]), []).append(len(self.names))
                    self.names.append(name)
                    self.grams.append(g)
                    continue
                w = max(x for x in SIZES if x == 1 or len(g) >= x + STRIDE[x] - 1)
                for size, band, key in band_keys(g, {w: 1}):
                    keys[size].append(np.stack([key, *(np.broadcast_to(x, len(key)).astype(np.uint64) for x in (band, len(self.names), np.arange(len(key))))], 1))
                self.names.append(name)
                self.grams.append(g)
        self.tables = {}
        for w, rows in keys.items():
            if rows:
                t = np.concatenate(rows)
                t = t[np.argsort(t[:, 0], kind="stable")]
                bits = np.zeros(1 << 16, bool)
                bits[(t[:, 0] >> K.U(48)).astype(np.int64)] = True
                self.tables[w] = (t[:, 0].copy(), t[:, 2].astype(np.int64), t[:, 3].astype(np.int64), bits)


def band_keys(g: np.ndarray, strides: dict[int, int]):
    """(size, band, key of each window of that size at its stride); rows of the text are not told apart."""
    for band in range(BANDS):
        acc = {w: K.U(band * 0x9E37 + w) for w in strides}
        for r in range(ROWS):
            x = K.mix(g ^ K.U((band * ROWS + r + 1) * 0xD1B54A32D192ED03 & (1 << 64) - 1))
            for w, s in strides.items():
                m = K.sliding_min(x, w)[::s]
                acc[w] = K.mix(m ^ acc[w]) if r == 0 else K.mix(m + acc[w])
        for w in strides:
            yield w, band, acc[w]
        if set(strides) == {1}:
            return


def find(data: np.ndarray, offsets: np.ndarray, lib: Library) -> list[tuple[int, int, int, int, float]]:
    """(row, template, first word, words, containment) of verified matches."""
    sums, at = word_sums(data, offsets)
    g = sums.grams(WORDS)
    spots: list[np.ndarray] = []
    strides = {w: STRIDE[w] for w in lib.tables}
    parts = [band_keys(g, {1: 1})] if 1 in strides else []
    parts.append(band_keys(g, {w: s for w, s in strides.items() if w > 1}))
    for part in parts:
        for w, _, key in part:
            keys, template, offset, bits = lib.tables[w]
            may = np.flatnonzero(bits[(key >> K.U(48)).astype(np.int64)])
            lo, hi = np.searchsorted(keys, key[may], "left"), np.searchsorted(keys, key[may], "right")
            n = hi - lo
            which = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            spots.append(np.stack([template[which], np.repeat(may * strides[w], n) - offset[which]], 1))
    rows = np.unique(np.concatenate(spots), axis=0) if spots else np.zeros((0, 2), np.int64)
    found = []
    for t, start in rows.tolist():
        own = lib.grams[t]
        middle = min(max(start + len(own) // 2, 0), len(g) - 1)
        row = int(np.searchsorted(at, middle, "right")) - 1
        slack = len(own) // 4
        a, b = max(start - slack, int(at[row])), min(start + len(own) + slack, int(at[row + 1]) - WORDS + 1)
        if a >= b:
            continue
        distinct = np.unique(own)
        hit = np.isin(g[a:b], distinct)
        share = len(np.unique(g[a:b][hit])) / len(distinct)
        if share >= CONTAINMENT:
            where = np.flatnonzero(hit)
            found.append((row, t, a + int(where[0]), int(where[-1] - where[0]) + WORDS, share))
    for n, own in lib.short.items():
        h = sums.grams(n)
        where = np.flatnonzero(np.isin(h, np.fromiter(own, np.uint64, len(own))))
        row = np.searchsorted(at, where, "right") - 1
        inside = where + n <= at[row + 1]
        found += [(r, t, a, n, 1.0) for r, a in zip(row[inside].tolist(), where[inside].tolist(), strict=True) for t in own[int(h[a])]]
    best = []
    covered: dict[int, list] = {}
    for row, t, start, n, share in sorted(set(found), key=lambda f: (f[0], f[3] < WORDS, -f[4], -f[3], f[2], lib.names[f[1]])):
        own = covered.setdefault(row, [])
        if not any((lib.names[u] == lib.names[t] or x > share) and start < s + k and s < start + n for u, s, k, x in own):
            best.append((row, t, start, n, share))
            own.append((t, start, n, share))
    return [(row, t, start - int(at[row]), n, share) for row, t, start, n, share in best]


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per match: doc_id, license, start_word, n_words, containment."""
    own = library_texts() if templates is None else templates
    out = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])

    def scan(batches):
        lib = Library(own)
        for b in batches:
            rows = []
            ids = b.column("doc_id").to_pylist()
            for i, _, data, offsets in K.chunks(b.column("text")):
                rows += [(ids[i + r], lib.names[t], s, n, c) for r, t, s, n, c in find(data, offsets, lib)]
            if rows:
                yield batch(out, *zip(*rows, strict=True))

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(lean(scan), "doc_id long, license string, start_word long, n_words long, containment double")
