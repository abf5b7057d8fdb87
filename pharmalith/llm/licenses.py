"""License notices in documents, by MinHash over overlapping text windows.

Texts and templates are sequences of word shingles.  Windows of 2**j shingles,
a quarter of that apart (every one, for up to four), slide over the text.  A
template of n shingles belongs to the level whose windows are just long enough
that every run of n shingles lies in one window whole; so it makes up at least
three eighths of that window.  Each of ``BANDS`` hash functions is a band of
one row: a window and a template meet if any least value agrees.  A window
with a whole template is missed with probability (1 - 3/8)**28 = 2e-6, one
with four fifths of its shingles with (1 - 0.279)**28 = 1e-4.  Windows that
meet a template are then compared exactly: the share of the template's
shingles that the window's part of the document has.  Templates of different
licenses may share most of their shingles; a match must also have some of the
shingles that tell it from each such rival (name and version), and yields to a
rival that matches the same words better, or of which it is a part.

A template of fewer words than a shingle is looked for word for word, ending
where a sentence, clause or line ends.

Windows run over all texts of a slice, so a window may touch two documents;
only the part in one document counts in the comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .bytewords import ALNUM, Words, row_slices, shingle_hashes, text_buffer, words_of

SHINGLE = 5
BANDS = 28
#: Share of a template's shingles that a match has at least.
CONTAINED = 0.8
#: Share of its shingles in a template of another license from which it is a part of that one.
PART = 0.95
#: Share of its shingles in a template of another license from which that one is a template's rival.
RIVAL = 0.5

_rng = np.random.default_rng(19991231)
_A = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)

#: Public license names and the texts by which they are applied.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("Proprietary", "All rights reserved. No part of this work may be reproduced without permission."),
    ("Proprietary", "All rights reserved."),
]


def _least(shingles: np.ndarray, band: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((shingles * _A[band] + _B[band]) >> np.uint64(32)).astype(np.uint32)


def level_of(n: int) -> tuple[int, int]:
    """Window length and step of the least level with which every run of ``n`` shingles lies in one window."""
    length = 1
    while n > length - max(1, length // 4) + 1:
        length *= 2
    return length, max(1, length // 4)


@dataclass
class Index:
    """Templates by level, their least values by band, and quick tables of those values' low bits."""

    names: list[str]
    shingles: list[np.ndarray]
    levels: dict[int, list[int]]
    #: word hashes of the templates of fewer words than a shingle
    short: list[tuple[str, np.ndarray]]

    @classmethod
    def build(cls, templates: list[tuple[str, str]], size: int = SHINGLE) -> Index:
        data, offsets = text_buffer(pa.array([t for _, t in templates], pa.string()))
        doc = words_of(data, offsets, ALNUM)
        words = doc.hashes()
        shingles, firsts = shingle_hashes(words, doc.rows, size)
        short = [(name, words[a:b]) for (name, _), a, b in zip(templates, doc.rows[:-1], doc.rows[1:]) if 0 < b - a < size]
        own = [np.unique(shingles[a:b]) for a, b in zip(firsts[:-1], firsts[1:])]
        levels: dict[int, list[int]] = {}
        for k, (a, b) in enumerate(zip(firsts[:-1], firsts[1:])):
            if b > a:
                levels.setdefault(level_of(int(b - a))[0], []).append(k)
        return cls([n for n, _ in templates], own, levels, short)

    def __post_init__(self) -> None:
        self.values: dict[int, list[np.ndarray]] = {}
        self.maybe: dict[int, list[np.ndarray]] = {}
        for length, members in self.levels.items():
            least = [np.array([_least(self.shingles[k], b).min() for k in members]) for b in range(BANDS)]
            self.values[length] = least
            self.maybe[length] = []
            for v in least:
                table = np.zeros(1 << 16, dtype=bool)
                table[v & 0xFFFF] = True
                self.maybe[length].append(table)
        #: template -> {rival: the template's shingles that the rival lacks}
        self.telling: list[dict[int, np.ndarray]] = []
        #: template -> templates of other licenses that it is a part of
        self.whole: list[set[int]] = []
        for k, mine in enumerate(self.shingles):
            shared = {r: np.isin(mine, other) for r, other in enumerate(self.shingles) if self.names[r] != self.names[k]}
            self.whole.append({r for r, x in shared.items() if len(mine) and x.mean() >= PART and len(self.shingles[r]) > len(mine)})
            self.telling.append({r: mine[~x] for r, x in shared.items() if len(mine) and RIVAL <= x.mean() < 1})

    def search(self, shingles: np.ndarray, firsts: np.ndarray, contained: float = CONTAINED) -> dict[tuple[int, str], list]:
        """(row, license) -> [greatest share, first and last shingle of matched windows' shared part]."""
        met: dict[int, dict[int, set[int]]] = {}  # level -> window start -> templates
        n = len(shingles)
        for band in range(BANDS):
            value, length, step = _least(shingles, band), 1, 1
            for goal in sorted(self.levels):
                if goal == 1 and band:
                    continue  # a window of one shingle is that shingle: one band decides
                while length < goal:
                    # windows twice as long; those past the end are as long as there is text
                    half = length // step
                    pad = np.concatenate([value[half:], np.full(min(half, len(value)), 0xFFFFFFFF, np.uint32)])
                    value, length = np.minimum(value, pad), length * 2
                    if (target := max(1, length // 4)) > step:
                        value, step = value[:: target // step], target
                hits = np.flatnonzero(self.maybe[goal][band][value & 0xFFFF])
                if not len(hits):
                    continue
                members, mins = self.levels[goal], self.values[goal][band]
                hits = hits[np.isin(value[hits], mins)]
                of_level = met.setdefault(goal, {})
                for at in hits.tolist():
                    of_level.setdefault(at * step, set()).update(members[k] for k in np.flatnonzero(mins == value[at]))
        matches: dict[int, list[tuple[int, float, int, int, dict[int, float]]]] = {}  # row -> template, share, first and last shingle, share of what tells it from each rival
        for length, windows in met.items():
            for at, templates in windows.items():
                stop = min(at + length, n)
                row = int(np.searchsorted(firsts, at, side="right")) - 1
                while row < len(firsts) - 1 and firsts[row] < stop:
                    low, high = max(at, int(firsts[row])), min(stop, int(firsts[row + 1]))
                    part = shingles[low:high]
                    for k in templates:
                        shared = np.isin(part, self.shingles[k])
                        if not shared.any():
                            continue
                        share = len(np.unique(part[shared])) / len(self.shingles[k])
                        if share < contained:
                            continue
                        told = {r: float(np.isin(x, part).mean()) for r, x in self.telling[k].items()}
                        if all(told.values()):
                            where = np.flatnonzero(shared)
                            matches.setdefault(row, []).append((k, share, low + int(where[0]) - int(firsts[row]), low + int(where[-1]) - int(firsts[row]), told))
                    row += 1
        out: dict[tuple[int, str], list] = {}
        for row, found in matches.items():
            for k, share, first, last, told in found:
                if any(r in told and told[r] < 0.5 and better > share and a <= last and first <= b for r, better, a, b, _ in found):
                    continue  # a rival has these words
                if any(r in self.whole[k] and a <= last and first <= b for r, _, a, b, _ in found):
                    continue  # the words are part of a longer license
                seen = out.setdefault((row, self.names[k]), [share, first, last])
                seen[0], seen[1], seen[2] = max(seen[0], share), min(seen[1], first), max(seen[2], last)
        return out

    def search_short(self, doc: Words, hashes: np.ndarray) -> dict[tuple[int, str], tuple[int, int]]:
        """(row, license) -> first and last word of the places where a short template stands and a sentence, clause or line ends."""
        out: dict[tuple[int, str], tuple[int, int]] = {}
        for name, words in self.short:
            n = len(words)
            at = np.flatnonzero(hashes[: len(hashes) - n + 1] == words[0]) if len(hashes) >= n else np.zeros(0, np.int64)
            for k in range(1, n):
                at = at[hashes[at + k] == words[k]]
            for first in at.tolist():
                row = int(np.searchsorted(doc.rows, first, side="right")) - 1
                past = first + n
                if past > doc.rows[row + 1]:
                    continue  # the words are of two rows
                if past < doc.rows[row + 1]:
                    gap = doc.data[doc.ends[past - 1] : doc.starts[past]].tobytes()
                    # blanks go on, and one sign between two words joins them
                    if not gap.strip(b" \t") or len(gap) == 1 and gap not in b"\r\n":
                        continue
                a, b = first - int(doc.rows[row]), past - 1 - int(doc.rows[row])
                low, high = out.get((row, name), (a, b))
                out[row, name] = min(low, a), max(high, b)
        return out


def templates_from(folder: str) -> list[tuple[str, str]]:
    """Templates out of a local folder of license texts, each named by its file without ``.txt``: whole texts beside the notices of ``TEMPLATES``."""
    return [(path.name.removesuffix(".txt"), path.read_text(encoding="utf-8")) for path in sorted(Path(folder).glob("*.txt"))]


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, contained: float = CONTAINED) -> DataFrame:
    """``id, license, containment, first_word, last_word``: a row per document and license found in it.

    The words span all places where the document has that license.  Documents
    without any give no row; null texts are empty; repeated rows are scanned
    each for itself, whole texts however long they are; other columns are left
    out, whatever their names; an empty table gives no rows.  Templates without
    words match nothing.
    """
    index = Index.build(TEMPLATES if templates is None else templates, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0).to_pylist()
            for first, last in row_slices(offsets):
                doc = words_of(data, offsets[first : last + 1], ALNUM)
                hashes = doc.hashes()
                shingles, firsts = shingle_hashes(hashes, doc.rows, size)
                words = np.diff(doc.rows)
                by_row = {key: [v[0], v[1], min(v[2] + size - 1, int(words[key[0]]) - 1)] for key, v in index.search(shingles, firsts, contained).items()} if len(shingles) else {}
                for key, (a, b) in index.search_short(doc, hashes).items():
                    seen = by_row.setdefault(key, [1.0, a, b])
                    seen[:] = 1.0, min(seen[1], a), max(seen[2], b)
                found = sorted(by_row.items())
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([ids[first + r] for (r, _), _ in found], pa.int64()), pa.array([x for (_, x), _ in found]), pa.array([v[0] for _, v in found], pa.float64()),
                            pa.array([v[1] for _, v in found], pa.int64()), pa.array([v[2] for _, v in found], pa.int64()),
                        ],
                        ["id", "license", "containment", "first_word", "last_word"],
                    )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, license string, containment double, first_word long, last_word long")


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``doc_id, license, containment, first_word, last_word``: licenses found in all documents."""
    return scan(docs).withColumnRenamed("id", "doc_id")
