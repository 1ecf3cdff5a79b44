"""License scans: winnowed fingerprints find candidates, banded alignment measures them.

Texts become words (A-Z lower-cased, other ASCII than letters and digits dropped).  A template's 3-word
hashes are winnowed (the least of each 2 neighbours is kept) into an inverted index; a document is
winnowed alike, so any 4 words in a row shared with a template hit the index.  Hits name a template and a
diagonal; around it the template is aligned with the words of the document in a band, and counts as
found if at least ``COVERAGE`` of its words match (of the words it spans, if those are more) and all of its
telling words do: those that a sibling, a template of another license that shares ``SIBLING`` of its words in
order, does not have.  Of words with a digit one may be missing, but no other number may stand at the place.  So
another version or clause is never taken for this one.  Where found places overlap, the one with most matched
words stays, so a longer sibling wins where it stands; of equals the template that is listed first.

The templates are an argument, by default public statements of common licenses; their index is sent to
the tasks and is refused above ``MAX_WORDS`` words.  Null and empty texts hold no license.  A license found in
several places has a row for each; repeated rows give rows of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contrapunto.llm.common import slices, wanted

GRAM, WINDOW, COVERAGE, SIBLING, MAX_WORDS, CACHE = 3, 2, 0.85, 0.6, 1_000_000, 200_000
#: Public license statements (fixed texts).
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0",
                   'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "SPDX-License-Identifier: MIT",
            'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'],
    "BSD": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "ISC": ["Licensed under the ISC License.", "SPDX-License-Identifier: ISC",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0",
                "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0",
                 "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-2.1": ["This work is licensed under the GNU Lesser General Public License, version 2.1.", "SPDX-License-Identifier: LGPL-2.1",
                 "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0",
                 "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-ND-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-SA-4.0"],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-ND-4.0"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
}
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c > 127 else 32 for c in range(256))


class Words(dict):
    """Word to a 64-bit number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return h


def raw_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def words(text: str | None, known: Words) -> np.ndarray:
    return np.array([known[w] for w in raw_words(text)], dtype=np.uint64)


def winnowed(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the kept grams: the least of each window, the rightmost of equals."""
    if len(w) < GRAM:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = w[:len(w) - GRAM + 1].copy()
    for j in range(1, GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j:len(w) - GRAM + 1 + j]
    h ^= h >> np.uint64(31)
    if len(h) < WINDOW:
        return h, np.arange(len(h))
    views = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    at = np.unique(np.arange(len(views)) + WINDOW - 1 - views[:, ::-1].argmin(axis=1))
    return h[at], at


def aligned(a: np.ndarray, b: np.ndarray, shift: int, band: int, telling: frozenset[int] = frozenset()) -> tuple[int, int, int, frozenset[int]]:
    """Most words of ``a`` matched in order in ``b`` near the diagonal ``shift``, the span in ``b`` of those
    matches, and which of the ``telling`` places of ``a`` are among them (of equal alignments the one with most)."""
    best = {}  # place in b of the last match -> (matches, telling places matched, first place), for the rows so far
    top = (0, frozenset(), 0, 0)
    for i in range(len(a)):
        low, high = max(0, i + shift - band), min(len(b), i + shift + band + 1)
        fresh = {}
        for j in range(low, high):
            if a[i] == b[j]:
                n, told, first = max(((n, t, f) for q, (n, t, f) in best.items() if q < j), default=(0, frozenset(), j), key=lambda x: (x[0], len(x[1])))
                fresh[j] = (n + 1, told | {i} if i in telling else told, first)
                if (n + 1, len(fresh[j][1])) > (top[0], len(top[1])):
                    top = (n + 1, fresh[j][1], first, j + 1)
        for j, v in fresh.items():
            if j not in best or (v[0], len(v[1])) > (best[j][0], len(best[j][1])):
                best[j] = v
        best = {q: v for q, v in best.items() if q >= i + shift - 2 * band - 1}
    return top[0], top[2], top[3], top[1]


def _is_number(word: bytes) -> bool:
    return any(48 <= c <= 57 for c in word)


def telling_places(templates: list[tuple[str, np.ndarray]], numbers: set[int]) -> list[frozenset[int]]:
    """For each template the places of the words that are no numbers and are missing in a sibling."""
    out = []
    for name, t in templates:
        places = set()
        for other, s in templates:
            if other == name or not len(t):
                continue
            every = frozenset(range(len(t)))
            matched, _, _, kept = aligned(t, s, 0, max(len(t), len(s)), every)
            if matched >= SIBLING * len(t):
                places |= every - kept
        out.append(frozenset(i for i in places if int(t[i]) not in numbers))
    return out


class Index:
    def __init__(self, templates: dict[str, list[str]]):
        self.known = Words()
        self.templates = [(name, words(t, self.known)) for name, texts in templates.items() for t in texts]
        if sum(len(w) for _, w in self.templates) > MAX_WORDS:
            raise ValueError("more template words than one task should hold")
        self.raw = [raw_words(t) for texts in templates.values() for t in texts]
        numbers = {self.known[w] for own in self.raw for w in own if _is_number(w)}
        self.telling = telling_places(self.templates, numbers)
        self.numbers = [frozenset(i for i, w in enumerate(own) if _is_number(w)) for own in self.raw]
        self.posting: dict[int, list[tuple[int, int]]] = {}
        for n, (_, w) in enumerate(self.templates):
            for h, at in zip(*winnowed(w)):
                self.posting.setdefault(int(h), []).append((n, int(at)))
        self.hashes = np.sort(np.array(list(self.posting), dtype=np.uint64))

    def scan(self, text: str | None) -> list[tuple[str, float, int, int]]:
        """(license, coverage, first word, last word + 1) of each place; where places overlap, the one with most words matched."""
        w = words(text, self.known)
        h, at = winnowed(w)
        if not len(h) or not len(self.hashes):
            return []
        slot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        found, seen = [], set()
        for k in np.flatnonzero(self.hashes[slot] == h).tolist():
            for n, offset in self.posting[int(h[k])]:
                name, t = self.templates[n]
                band = max(2, len(t) // 8)
                shift = int(at[k]) - offset
                cell = (n, shift // (band + 1))
                if cell in seen:
                    continue
                seen.add(cell)
                low = max(0, shift - 2 * band)
                matched, first, last, told = aligned(t, w[low:shift + len(t) + 2 * band], shift - low, 2 * band, self.telling[n] | self.numbers[n])
                coverage = matched / max(len(t), last - first)  # words put between the template's count against it
                if coverage < COVERAGE or not told >= self.telling[n]:
                    continue
                lost, own = len(t) - matched, self.raw[n]
                if not told >= self.numbers[n] and any(_is_number(x) and x not in own for x in raw_words(text)[max(0, low + first - lost):low + last + lost]):
                    continue  # another number stands where one is missing
                found.append((-matched, -coverage, low + first, low + last, n, name))
        out: list[tuple[str, float, int, int]] = []
        for _, coverage, first, last, _, name in sorted(found):
            if all(last <= b or first >= e for _, _, b, e in out):
                out.append((name, -coverage, first, last))
        return sorted(out, key=lambda r: r[2])


_kept: dict[str, object] = {}


def scan(docs: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``doc_id``, ``license``, ``coverage`` and the span in words (``begin``, ``end``) of each license found."""
    source = wanted(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))

    def run(batches):
        if _kept.get("templates") != templates:
            _kept.update(templates=templates, index=Index(templates))
        index = _kept["index"]
        for b in slices(batches):
            rows = [(d, *r) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for r in index.scan(t)]
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "license", "coverage", "begin", "end"])

    return source.mapInArrow(run, "doc_id long, license string, coverage double, begin long, end long")
