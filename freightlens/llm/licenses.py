"""License notices in documents: winnowed fingerprints, then banded alignment.

Templates are cut into word shingles; of every window of shingle hashes the least is a
fingerprint, so any run of ``gram + window - 1`` equal words shares one.  An inverted
index from fingerprint to (template, place) picks, per text, the templates and
diagonals with hits; nearby diagonals make one candidate.  Around it, a local alignment
within a band of diagonals gives the matched words of the template, so small edits,
missing or added words don't end a match.  The index holds the templates only: its
size is theirs, whatever the corpus.  A line ``SPDX-License-Identifier: ...`` has too few
words to fingerprint and names its licenses itself, so they are read from it.
"""

from __future__ import annotations

import sys
from bisect import bisect_right
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .joins import bounded_batches
from .license_texts import WHOLE

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Customary notices of public licenses.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": "Released under the MIT License",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-text": "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-text": "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0-text": "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    **WHOLE,
}

#: Word characters of the alignment: letters, digits, and what joins them in names and versions.
SEPARATORS = np.array([i < 128 and not (chr(i).isalnum() or chr(i) in "-.") for i in range(256)])


#: The marker of a license line, and the words between its names.
SPDX_MARKER = "spdx-license-identifier"
SPDX_BETWEEN = ("and", "or", "with")


def templates_in(folder: str) -> dict[str, str]:
    """Every file of a folder as a template under its file name, read on the driver."""
    return {f.name: f.read_text(encoding="utf-8", errors="replace") for f in sorted(Path(folder).iterdir()) if f.is_file()}


@dataclass(frozen=True)
class Settings:
    """Words per shingle, shingles per window, half width of the band, least coverage of a template, least share of its fingerprints."""

    gram: int = 3
    window: int = 2
    band: int = 6
    coverage: float = 0.85
    hits: float = 0.25


def tokens(raw: np.ndarray, offsets: np.ndarray) -> W.Words:
    """Words without punctuation; a full stop or hyphen counts only between letters or digits."""
    solid = ~W.MARKS[raw]
    inside = np.zeros(len(raw), bool)
    inside[1:-1] = solid[:-2] & solid[2:]
    edges = offsets[(offsets > 0) & (offsets < len(raw))]
    inside[edges], inside[edges - 1] = False, False
    return W.Words(np.where(solid | (inside & ~SEPARATORS[raw]), raw, np.uint8(32)), offsets, 0, SEPARATORS)


def pairs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(max(len(hashes) - k + 1, 0), np.uint64)
    for j in range(k):
        out = out * W.STEP + hashes[j : j + len(out)]
    return W.mix(out)


def winnow(values: np.ndarray, w: int) -> np.ndarray:
    """Places of the least value of every window (the rightmost of equal ones); of a shorter sequence, of all."""
    if not len(values):
        return np.zeros(0, np.int64)
    w = min(w, len(values))
    windows = np.lib.stride_tricks.sliding_window_view(values, w)
    return np.unique(np.arange(len(windows)) + w - 1 - windows[:, ::-1].argmin(1))


def build_index(templates: dict[str, str], cfg: Settings):
    """(sorted fingerprints, their templates, their places, word hashes by template)."""
    names, prints, owner, place, hashes = list(templates), [], [], [], []
    for t, text in enumerate(templates.values()):
        h = word_hashes(text)
        values = pairs_of(h, cfg.gram)
        at = winnow(values, cfg.window)
        hashes.append(h)
        prints.append(values[at])
        owner.append(np.full(len(at), t))
        place.append(at)
    prints, owner, place = (np.concatenate(x) for x in (prints, owner, place))
    order = np.argsort(prints, kind="stable")
    return names, prints[order], owner[order], place[order], hashes


def align(text: np.ndarray, template: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """Local alignment within a band around text place = template place + shift.

    Match 2, mismatch or gap -1.  Returns (matched template words, start, stop in the
    text) of the best alignment, the leftmost of equal ones.
    """
    n, best, zero = len(text), (0, 0, 0, 0), (0, 0, 0)
    above: dict[int, tuple] = {}
    for i in range(len(template)):
        row: dict[int, tuple] = {}
        for j in range(max(0, i + shift - band), min(n, i + shift + band + 1)):
            s, m, start = above.get(j - 1, zero)
            same = text[j] == template[i]
            cell = (s + 2, m + 1, start if s > 0 else j) if same else (s - 1, m, start)
            for other in (above.get(j, zero), row.get(j - 1, zero)):
                if other[0] - 1 > cell[0]:
                    cell = (other[0] - 1, other[1], other[2])
            if cell[0] > 0:
                row[j] = cell
                if cell[0] > best[0] or (cell[0] == best[0] and cell[2] < best[2]):
                    best = (cell[0], cell[1], cell[2], j + 1)
        above = row
    return best[1], best[2], best[3]


def matches(h: np.ndarray, index, cfg: Settings) -> list[tuple[int, int, int, int]]:
    """(template, matched words, start, stop) of one text's words, for templates covered enough."""
    _, prints, owner, place, templates = index
    counts = np.bincount(owner, minlength=len(templates))
    values = pairs_of(h, cfg.gram)
    at = np.flatnonzero(np.isin(values, prints))
    if not len(at):
        return []
    lo, hi = np.searchsorted(prints, values[at], "left"), np.searchsorted(prints, values[at], "right")
    seen: dict[int, list[int]] = {}
    for p, a, b in zip(at.tolist(), lo.tolist(), hi.tolist()):
        for x in range(a, b):
            seen.setdefault(int(owner[x]), []).append(p - int(place[x]))
    out = []
    for t, shifts in seen.items():
        shifts.sort()
        last, need = None, cfg.hits * counts[t]
        for i, shift in enumerate(shifts):
            if last is not None and shift - last <= cfg.band:
                continue  # inside the band of the one before
            if bisect_right(shifts, shift + cfg.band) - i < need:
                continue
            last = shift
            m, start, stop = align(h, templates[t], shift, 2 * cfg.band)
            if m >= cfg.coverage * len(templates[t]):
                out.append((t, m, start, stop))
    # of overlapping matches the one of more words stays, then the earlier template
    out = sorted(set(out), key=lambda x: (-x[1], x[0], x[2]))
    kept: list[tuple[int, int, int, int]] = []
    for x in out:
        if all(x[3] <= y[2] or x[2] >= y[3] for y in kept):
            kept.append(x)
    return sorted(kept, key=lambda x: (x[2], x[0]))


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return tokens(raw, np.array([0, len(raw)])).hash


def named(found: W.Words, raw: np.ndarray, marker: np.uint64, between: np.ndarray) -> list[tuple[int, int, str, int]]:
    """(text, place of the marker, license, place of its name) for the licenses that marked lines name.

    Names follow the marker, on its line, with AND, OR or WITH between them.
    """
    out = []
    for at in np.flatnonzero(found.hash == marker).tolist():
        text = int(np.searchsorted(found.first, at, "right")) - 1
        for place in range(at + 1, int(found.first[text + 1])):
            if (raw[found.end[place - 1] : found.start[place]] == 10).any():
                break
            is_between = bool((between == found.hash[place]).any())
            if is_between != ((place - at) % 2 == 0):
                break
            if not is_between:
                out.append((text, at, raw[found.start[place] : found.end[place]].tobytes().decode(errors="replace"), place))
    return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, cfg: Settings = Settings()) -> DataFrame:
    """Per match: doc_id, license, n_matched, coverage, and the byte span of the match in the text.

    A license named on an SPDX line gives a row of its own, under its name as written, with
    the words from the marker to the name.

    Null and empty texts match nothing.  Rows are scanned one by one, so repeated rows
    give repeated matches and null ids come out as null.  Only doc_id and text are
    read.  An empty table gives an empty one.
    """
    bounded_batches(docs.sparkSession)
    index = build_index(templates or TEMPLATES, cfg)
    names, sizes = index[0], [len(h) for h in index[4]]
    marker, between = word_hashes(SPDX_MARKER)[0], word_hashes(" ".join(SPDX_BETWEEN))

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, raw, offsets in W.slices(batch.column("text")):
                found = tokens(raw, offsets)
                values = pairs_of(found.hash, cfg.gram)
                hit = np.flatnonzero(np.isin(values, index[1]))
                rows = []
                for i in np.unique(np.searchsorted(found.first, hit, "right") - 1).tolist():
                    a, b = found.first[i], found.first[i + 1]
                    for t, m, start, stop in matches(found.hash[a:b], index, cfg):
                        rows.append((lo + i, names[t], m, m / sizes[t], int(found.start[a + start] - offsets[i]), int(found.end[a + stop - 1] - offsets[i])))
                for i, at, name, place in named(found, raw, marker, between):
                    rows.append((lo + i, name, place - at + 1, 1.0, int(found.start[at] - offsets[i]), int(found.end[place] - offsets[i])))
                columns = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.float64()), pa.array(columns[4], pa.int64()), pa.array(columns[5], pa.int64())],
                    ["doc_id", "license", "n_matched", "coverage", "start", "stop"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, license string, n_matched int, coverage double, start long, stop long")


def op9(spark, sf_dir: str) -> DataFrame:
    """Every license notice in ``documents``."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
