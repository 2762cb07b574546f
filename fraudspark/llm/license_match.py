"""License scan: winnowed template fingerprints pick candidates, banded alignment reports coverage and spans.

Templates are cut into words; hashes of `GRAM` words are winnowed over windows of `WINDOW`, so any
`GRAM + WINDOW - 1` words that a text shares with a template hit at least one fingerprint. Hits of one
template on neighbouring diagonals are a candidate, whose words are aligned with the template within a
band around that diagonal: the best alignment, then the best of the words left, and so on, so copies close
to each other are all found. A match covers at least `least_coverage` of the template's words.

Nulls and empty texts match nothing. Repeated rows are scanned one by one. Empty tables give empty
tables. Columns other than the id and the text are not read. Of matches that overlap in a text, the
one with more matched words stays; on ties the one with the smaller template name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fraudspark.llm.common import as_bytes, hash_words, map_batches, word_grams

GRAM, WINDOW, BAND = 3, 3, 12
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() or chr(c) == "." else 32 for c in range(256))
_WORD = re.compile(rb"[^\x00-\x20]+")

#: Wording of licence notices (fixed values).
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
           "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
           "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
           "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
           "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                    "that the following conditions are met: Redistributions of source code must retain the above copyright "
                    "notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce "
                    "the above copyright notice, this list of conditions and the following disclaimer in the documentation "
                    "and/or other materials provided with the distribution. Neither the name of the copyright holder nor the "
                    "names of its contributors may be used to endorse or promote products derived from this software without "
                    "specific prior written permission.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
                  "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
               "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
               "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without "
               "even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
               "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def split(data: bytes) -> list[bytes]:
    return [w for w in (x.strip(b".") for x in data.lower().translate(_PLAIN).split()) if w]


def winnow(grams: np.ndarray) -> list[int]:
    """Positions of the smallest hash of every window, the last one on ties."""
    kept: list[int] = []
    for at in range(max(1, len(grams) - WINDOW + 1)):
        window = grams[at:at + WINDOW]
        if len(window):
            best = at + len(window) - 1 - int(np.argmin(window[::-1]))
            if not kept or kept[-1] != best:
                kept.append(best)
    return kept


def align(text: list, template: list, diagonal: int, band: int = BAND, taken: frozenset | set = frozenset()) -> tuple[int, int, int]:
    """(matched words, first, end) of the best local alignment with |text place - template place - diagonal| <= band.

    A match counts 2, a gap or a mismatch -1; the earliest best alignment is reported. None crosses a `taken` place.
    """
    best = (0, 0, 0, 0)
    row: dict[int, tuple[int, int, int]] = {}  # text place -> (score, matched, first)
    for i, word in enumerate(template):
        above, row = row, {}
        for j in range(max(0, i + diagonal - band), min(len(text), i + diagonal + band + 1)):
            if j in taken:
                continue
            score, matched, first = above.get(j - 1, (0, 0, j))
            if score <= 0:
                score, matched, first = 0, 0, j
            options = [(score + 2, matched + 1, first) if text[j] == word else (score - 1, matched, first)]
            for before in (above.get(j), row.get(j - 1)):
                if before is not None:
                    options.append((before[0] - 1, before[1], before[2]))
            cell = max(options, key=lambda c: (c[0], c[1], -c[2]))
            row[j] = cell
            if cell[0] > best[0]:
                best = (*cell, j + 1)
    return best[1], best[2], best[3]


def align_all(text: list, template: list, diagonal: int, least: float, band: int = BAND) -> Iterator[tuple[int, int, int]]:
    """Alignments of the band that match at least `least` words, none over words of another, while free runs are long enough."""
    taken: set[int] = set()
    low, high = max(0, diagonal - band), min(len(text), len(template) + diagonal + band)
    while True:
        cuts = [low - 1, *sorted(taken), high]
        if max(b - a - 1 for a, b in zip(cuts, cuts[1:])) < max(1, least):
            return
        matched, first, end = align(text, template, diagonal, band, taken)
        if not matched:
            return
        taken.update(range(first, end))
        if matched >= least:
            yield matched, first, end


class Templates:
    def __init__(self, templates: dict[str, str], least_coverage: float):
        self.least_coverage = least_coverage
        self.names = sorted(templates)
        self.words = [split(as_bytes(templates[n])) for n in self.names]
        index: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            grams = word_grams(hash_words(words), min(GRAM, max(1, len(words))))
            for at in winnow(grams):
                index.setdefault(int(grams[at]), []).append((t, at))
        self.index = index
        self.keys = np.array(sorted(index), np.uint64)

    def matches(self, text: str | None) -> list[dict]:
        data = as_bytes(text)
        words = split(data)
        grams = word_grams(hash_words(words), GRAM)
        if not len(grams) or not len(self.keys):
            return []
        near = np.minimum(np.searchsorted(self.keys, grams), len(self.keys) - 1)
        spots = np.flatnonzero(self.keys[near] == grams)
        if not len(spots):
            return []
        diagonals = sorted({(t, int(p) - at) for p in spots for t, at in self.index[int(grams[p])]})
        found, last = set(), None
        for t, diagonal in diagonals:
            if last is not None and last[0] == t and diagonal - last[1] <= BAND // 2:
                continue
            last = (t, diagonal)
            for matched, first, end in align_all(words, self.words[t], diagonal, self.least_coverage * len(self.words[t])):
                found.add((-matched, self.names[t], first, end, t))
        kept: list[tuple] = []
        for hit in sorted(found):
            if all(hit[3] <= k[2] or hit[2] >= k[3] for k in kept):
                kept.append(hit)
        if not kept:
            return []
        places = [m.span() for m in _WORD.finditer(data.translate(_PLAIN)) if m[0].strip(b".")]
        point = lambda at: len(data[:at].decode("utf-8", "surrogatepass"))
        return [{
            "license": name, "matched": -matched, "words": len(self.words[t]), "coverage": -matched / len(self.words[t]),
            "start": point(places[first][0]), "end": point(places[end - 1][1]),
        } for matched, name, first, end, t in sorted(kept, key=lambda h: h[2])]


MATCHES = "array<struct<license: string, matched: int, words: int, coverage: double, start: int, end: int>>"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, *, id_column: str = "doc_id", text_column: str = "text",
         least_coverage: float = 0.8) -> DataFrame:
    """(id, matches) of every row; offsets in code points, end exclusive. Templates are a fixed list given by the caller."""
    known = Templates(TEMPLATES if templates is None else templates, least_coverage)
    kind = docs.schema[id_column].dataType.simpleString()
    shape = pa.list_(pa.struct([("license", pa.string()), ("matched", pa.int32()), ("words", pa.int32()),
                                ("coverage", pa.float64()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            made = [known.matches(text) for text in part.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([part.column(0), pa.array(made, shape)], names=[id_column, "matches"])

        return work

    return map_batches(docs.select(id_column, text_column), make, f"`{id_column}` {kind}, matches {MATCHES}")
