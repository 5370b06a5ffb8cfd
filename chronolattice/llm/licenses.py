"""License scan by patience alignment.

Texts and templates are lower-cased words.  A window of the text is aligned
with a template by anchoring on the words that are unique in both, taking the
longest increasing subsequence of the anchors, and aligning the gaps between
them in the same way; coverage is the share of template words aligned.

Windows are found without loss: to cover a share c of n words at least one of
any n - ceil(c n) + 1 template words must be aligned, so each template has that
many trigger words (its longest), and all windows of the template's length and a
quarter of it to spare on both sides that hold one are aligned, unless fewer
words of theirs than needed are in the template at all.  Whole texts are scanned, in one narrow pass.

Coverage alone does not name a license: notices differ in one word ("BSD" for
"MIT", "Lesser" before "General").  Reports therefore keep a window only if the
passage holds, word next to word, every phrase of ``MARKS`` that its template
has ("3" stands for "3.0" too); a template under ``SHORT`` words without such a
phrase must be covered in full.  A passage of which all aligned words belong to
a hit with more of them (a BSD text in a longer BSD text) counts once.

Edge cases.  Null and empty texts have no hits.  Rows stand alone, so repeated
rows, empty tables and extra columns need no care.  Equal coverage: the longer
template wins, then the lesser name.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache
from itertools import accumulate
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame

COVERAGE = 0.8
SHORT = 15
_WORD = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")

_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
_CC = "This work is licensed under a Creative Commons Attribution-{} 4.0 International License."

#: (name, category, text): public notices, short and long.
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("MIT", "permissive", "Released under the MIT License."),
    ("Apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "noncommercial", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "copyleft", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT", "permissive", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software, and to permit persons to whom the software is furnished to do so."),
    ("Apache-2.0", "permissive", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied."),
    ("GPL-3.0", "copyleft", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "permissive", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("Proprietary", "restricted", "All rights reserved. No part of this publication may be reproduced, distributed or transmitted in any form or by any means without the prior written permission of the publisher."),
    ("BSD", "permissive", "Released under the BSD License."),
    ("BSD-2-Clause", "permissive", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "permissive", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "permissive", _BSD),
    ("BSD-3-Clause", "permissive", _BSD + " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "permissive", "Released under the ISC License."),
    ("ISC", "permissive", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "copyleft", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MPL-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("GPL", "copyleft", "Released under the GPL License."),
    ("GPL-2.0", "copyleft", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-2.1", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "copyleft", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "copyleft", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("GPL-2.0", "copyleft", _GNU.format("General", "2")),
    ("LGPL-2.1", "copyleft", _GNU.format("Lesser General", "2.1")),
    ("LGPL-3.0", "copyleft", _GNU.format("Lesser General", "3")),
    ("AGPL-3.0", "copyleft", _GNU.format("Affero General", "3")),
    ("CC-BY-4.0", "permissive", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "copyleft", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "restricted", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "noncommercial", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "noncommercial", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-NC-4.0", "noncommercial", _CC.format("NonCommercial")),
    ("CC-BY-ND-4.0", "restricted", _CC.format("NoDerivatives")),
    ("CC-BY-NC-SA-4.0", "noncommercial", _CC.format("NonCommercial-ShareAlike")),
    ("CC-BY-NC-ND-4.0", "noncommercial", _CC.format("NonCommercial-NoDerivatives")),
    ("CC0-1.0", "permissive", "Released under CC0 1.0."),
    ("CC0-1.0", "permissive", "Licensed under CC0 1.0 Universal."),
    ("CC0-1.0", "permissive", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "permissive", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "restricted", "Released under a proprietary license."),
)

#: Phrases that name a license; those that a template has must stand in a passage it covers.
MARKS: dict[str, tuple[str, ...]] = {
    "MIT": ("mit license",),
    "Apache-2.0": ("apache", "2.0"),
    "BSD": ("bsd",),
    "BSD-2-Clause": ("bsd 2 clause",),
    "BSD-3-Clause": ("bsd 3 clause",),
    "ISC": ("isc license",),
    "MPL-2.0": ("mozilla public license", "2.0"),
    "GPL": ("gpl",),
    "GPL-2.0": ("gnu general public license", "version 2"),
    "GPL-3.0": ("gnu general public license", "version 3"),
    "LGPL-2.1": ("gnu lesser general public license", "version 2.1"),
    "LGPL-3.0": ("gnu lesser general public license", "version 3"),
    "AGPL-3.0": ("gnu affero general public license", "version 3"),
    "CC-BY-4.0": ("cc by 4.0", "attribution 4.0"),
    "CC-BY-SA-4.0": ("cc by sa 4.0", "attribution sharealike 4.0"),
    "CC-BY-ND-4.0": ("cc by nd 4.0", "attribution noderivatives 4.0"),
    "CC-BY-NC-4.0": ("cc by nc 4.0", "attribution noncommercial 4.0"),
    "CC-BY-NC-SA-4.0": ("cc by nc sa 4.0", "attribution noncommercial sharealike 4.0"),
    "CC-BY-NC-ND-4.0": ("cc by nc nd 4.0", "attribution noncommercial noderivatives 4.0"),
    "CC0-1.0": ("cc0 1.0",),
    "Unlicense": ("unencumbered", "public domain"),
    "Proprietary": ("proprietary license",),
}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def patience(a: Sequence[str], b: Sequence[str]) -> list[tuple[int, int]]:
    """Aligned places of ``a`` and ``b``, increasing in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        in_a, in_b = Counter(a[i:j]), Counter(b[k:m])
        place = {b[y]: y for y in range(k, m) if in_b[b[y]] == 1}
        anchors = [(x, place[a[x]]) for x in range(i, j) if in_a[a[x]] == 1 and a[x] in place]
        if not anchors:
            continue
        ends, kept, back = [], [], []
        for n, (_, y) in enumerate(anchors):
            at = bisect_left(ends, y)
            if at == len(ends):
                ends.append(y)
                kept.append(n)
            else:
                ends[at], kept[at] = y, n
            back.append(kept[at - 1] if at else -1)
        chain, n = [], kept[-1]
        while n >= 0:
            chain.append(anchors[n])
            n = back[n]
        x0, y0 = i, k
        for x, y in reversed(chain):
            out.append((x, y))
            todo.append((x0, x, y0, y))
            x0, y0 = x + 1, y + 1
        todo.append((x0, j, y0, m))
    return sorted(out)


def holds(own: Sequence[str], phrase: list[str]) -> bool:
    """Whether the words of the phrase stand next to each other; a number stands for its .0 too."""
    m = len(phrase)
    return any(all(w in (p, p + ".0") for w, p in zip(own[k : k + m], phrase)) for k in range(len(own) - m + 1))


@dataclass
class Template:
    name: str
    category: str
    words: list[str]
    coverage: float
    triggers: set[str] = field(default_factory=set)
    marks: list[list[str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        n = len(self.words)
        self.marks = [m for m in map(str.split, MARKS.get(self.name, ())) if holds(self.words, m)]
        places = sorted(range(n), key=lambda k: (-len(self.words[k]), k))[: n - ceil(self.coverage * n) + 1]
        self.triggers = {self.words[k] for k in places}

    def names(self, window: list[str], pairs: list[tuple[int, int]]) -> bool:
        """Whether a covered window names this license: the passage, with the unaligned ends, has the marks."""
        n = len(self.words)
        if not self.marks:
            return n >= SHORT or len(pairs) == n
        passage = window[max(0, pairs[0][0] - pairs[0][1]) : pairs[-1][0] + n - pairs[-1][1]]
        return all(holds(passage, m) for m in self.marks)


@cache
def _templates(spec: tuple[tuple[str, str, str], ...], coverage: float) -> tuple[list[Template], re.Pattern]:
    found = [Template(name, kind, words(text), coverage) for name, kind, text in spec]
    return found, re.compile("|".join(sorted({re.escape(w) for t in found for w in t.triggers}, key=len, reverse=True)))


def _starts(at: list[int], size: int) -> Iterator[int]:
    """Starts of all windows of ``size`` words that have one of the places, increasing."""
    last = -1
    for k in at:
        yield from range(max(last + 1, k - size + 1), k + 1)
        last = k


def _covered(text: str | None, spec: tuple[tuple[str, str, str], ...], coverage: float, named: bool) -> list[tuple[dict, set[int]]]:
    """Hits of a whole text with the places of their aligned words; ``named``: only those that name the license."""
    templates, any_trigger = _templates(spec, coverage)
    lowered = (text or "").lower()
    if not any_trigger.search(lowered):
        return []
    own = _WORD.findall(lowered)
    wanted = {w for t in templates for w in t.triggers}
    seen: dict[str, list[int]] = {}
    for k, w in enumerate(own):
        if w in wanted:
            seen.setdefault(w, []).append(k)
    out = []
    for t in templates:
        n, at = len(t.words), sorted({k for w in t.triggers for k in seen.get(w, ())})
        if not at:
            continue
        slack, need, done, own_words = ceil(n / 4), ceil(coverage * n), 0, set(t.words)
        size = n + 2 * slack
        upto = [0, *accumulate(w in own_words for w in own)]
        for start in _starts(at, size):
            if start < done or upto[min(start + size, len(own))] - upto[start] < need:
                continue
            pairs = patience(own[start : start + size], t.words)
            if len(pairs) < coverage * n:
                continue
            # The first window that covers may end before the passage does; the one around the passage goes before it.
            around = max(done, start + pairs[0][0] - pairs[0][1] - slack)
            tried = [(start, pairs), (around, patience(own[around : around + size], t.words))]
            tried = [(s, p) for s, p in tried if len(p) >= coverage * n and (not named or t.names(own[s : s + size], p))]
            if tried:
                s, pairs = max(tried, key=lambda x: len(x[1]))
                a, b = s + pairs[0][0], s + pairs[-1][0] + 1
                out.append(({"license": t.name, "category": t.category, "coverage": round(len(pairs) / n, 6), "start_word": a, "end_word": b, "matched": len(pairs)}, {s + x for x, _ in pairs}))
                done = b
    return out


def hits(text: str | None, spec: tuple[tuple[str, str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> list[dict]:
    """All covered windows of a whole text: name, category, coverage, start and end (in words), matched."""
    return [h for h, _ in _covered(text, spec, coverage, False)]


def named_hits(text: str | None, spec: tuple[tuple[str, str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> list[dict]:
    """The hits that name their license, without those that lie in a hit with more words."""
    found = _covered(text, spec, coverage, True)
    return [h for h, at in found if not any(at < more for _, more in found)]


def license_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per hit: doc_id, license, category, coverage, start_word, end_word, matched."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([pa.field("doc_id", b.schema.field(0).type), ("license", pa.string()), ("category", pa.string()), ("coverage", pa.float64()), ("start_word", pa.int32()), ("end_word", pa.int32()), ("matched", pa.int32())])
            yield pa.RecordBatch.from_pylist([{"doc_id": i} | h for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for h in named_hits(t, templates, coverage)], schema)

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, license string, category string, coverage double, start_word int, end_word int, matched int")


def best(found: list[dict]) -> dict | None:
    return min(found, key=lambda h: (-h["coverage"], -h["matched"], h["license"], h["start_word"]), default=None)


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str, str], ...] = TEMPLATES, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, license and category of the best hit (null without one), coverage (0), start_word, hits."""
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [named_hits(t, templates, coverage) for t in b.column(1).to_pylist()]
            top = [best(f) or {} for f in found]
            columns = [pa.array([t.get("license") for t in top], pa.string()), pa.array([t.get("category") for t in top], pa.string()), pa.array([t.get("coverage", 0.0) for t in top], pa.float64()), pa.array([t.get("start_word") for t in top], pa.int32()), pa.array(map(len, found), pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "license", "category", "coverage", "start_word", "hits"])

    return slim.mapInArrow(run, f"doc_id {slim.schema[0].dataType.simpleString()}, license string, category string, coverage double, start_word int, hits int")
