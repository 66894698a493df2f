"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

1. Templates are grouped by length in words into classes (L/2, L] for L = 8, 16, 32, ...
   A class has windows of 2 L words at every L-th word of a text, so each passage of
   up to L words lies whole in some window.
2. A window and a template that it contains to the share ``CONTAINMENT`` have at least a
   known Jaccard similarity s over word shingles. Each of b bands holds one MinHash
   value (r = 1); b is the least number with 1 - (1 - s)^b >= ``CERTAINTY``.
   A window whose value equals a template's in any band is a candidate.
3. A candidate counts only if the window really holds the share ``CONTAINMENT`` of
   the template's shingles. Each tightest stretch that reaches the share is a hit. It is widened to
   the template's length where that adds more of its shingles. Of hits that overlap in a text,
   the one with the highest containment stays, then the longest template, the shortest
   span, the first by name and place; a loser whose tightest stretch is still free has that.

The job is map-only: templates are a parameter of a few texts, sent with the code.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

WIDTH, CONTAINMENT, CERTAINTY, LEAST_CLASS = 2, 0.8, 0.999, 8

#: (name, text): public notices and grants.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0-or-later", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
]


def bands_needed(similarity: float, certainty: float) -> int:
    """The least number of one-row bands of which one collides with the given certainty."""
    return max(1, math.ceil(math.log(1 - certainty) / math.log(1 - min(similarity, 0.999999))))


def least_similarity(shingles: int, span: int, containment: float, width: int) -> float:
    """Jaccard similarity of a template of so many shingles to a window of ``2 * span`` words that contains enough of it."""
    window = 2 * span - width + 1
    shared = math.ceil(containment * shingles)
    return shared / (shingles + window - shared)


@dataclass
class LengthClass:
    """Templates of one length class: their bands' values and shingle sets."""

    span: int
    seeds: np.ndarray
    values: np.ndarray  # one sorted row of band values per band
    owner: np.ndarray  # the template of each value
    names: list[str]
    number: list[int]
    sets: list[np.ndarray]
    full: list[dict[int, int]]  # how often a template has each of its shingles


def build_classes(templates: list[tuple[str, str]], width: int = WIDTH, containment: float = CONTAINMENT, certainty: float = CERTAINTY) -> list[LengthClass]:
    """Templates without ``width`` words are refused, as they have no shingle."""
    by: dict[int, list[tuple[int, str, np.ndarray]]] = {}
    full: dict[int, dict[int, int]] = {}
    for i, (name, text) in enumerate(templates):
        data, off = tv.buffers(pc.utf8_lower(pa.array([text])))
        words = int(tv.tokens(data, off).counts[0])
        if words < width:
            raise ValueError(f"template {name!r} has fewer than {width} words")
        h, _ = tv.shingles(pa.array([text]), width)
        span = LEAST_CLASS
        while span < words:
            span *= 2
        each, times = np.unique(h, return_counts=True)
        full[i] = dict(zip(each.tolist(), times.tolist(), strict=True))
        by.setdefault(span, []).append((i, name, each))
    out = []
    for span, own in sorted(by.items()):
        b = bands_needed(min(least_similarity(len(s), span, containment, width) for _, _, s in own), certainty)
        seeds = tv.mix64(np.arange(1, b + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        values = np.array([[permuted(s, seed).min() for _, _, s in own] for seed in seeds])
        owner = np.argsort(values, axis=1, kind="stable")
        out.append(LengthClass(span, seeds, np.take_along_axis(values, owner, 1), owner, [n for _, n, _ in own], [i for i, _, _ in own], [s for _, _, s in own], [full[i] for i, _, _ in own]))
    return out


def permuted(h: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A bijection of 64-bit values per seed: odd multiplier, then xor of the high half."""
    x = (h ^ seed) * (seed | np.uint64(1))
    return x ^ (x >> np.uint64(32))


def window_candidates(h: np.ndarray, first: np.ndarray, c: LengthClass) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, template) of the windows that share a band value with a template; begin and end index shingles.

    ``first``: offsets of each text's shingles. Windows are two blocks of ``span`` shingles, or what the text has.
    """
    counts = np.diff(first)
    blocks = -(-counts // c.span)
    block_first = np.concatenate([[0], np.cumsum(blocks)])
    if not len(h):
        none = np.zeros(0, np.int64)
        return none, none, none
    text = np.repeat(np.arange(len(counts)), blocks)
    at = first[text] + (np.arange(block_first[-1]) - block_first[text]) * c.span
    last = np.zeros(len(at), bool)
    last[block_first[1:][blocks > 0] - 1] = True
    end = np.minimum(at + 2 * c.span, first[text + 1])
    found = []
    for j, seed in enumerate(c.seeds):
        low = np.minimum.reduceat(permuted(h, seed), at)
        low = np.where(last, low, np.minimum(low, np.append(low[1:], low[-1])))
        k = np.searchsorted(c.values[j], low)
        same = c.values[j][np.minimum(k, len(c.names) - 1)] == low
        for t in range(len(c.names)):
            # Templates can share a value: look at every one with the same.
            hit = np.flatnonzero(same)[c.values[j][np.minimum(k[same] + t, len(c.names) - 1)] == low[same]] if same.any() else np.zeros(0, np.int64)
            hit = hit[k[hit] + t < len(c.names)]
            if not len(hit):
                break
            found.append(hit * len(c.names) + c.owner[j][k[hit] + t])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    window, template = np.divmod(pairs, len(c.names))
    return at[window], end[window], template


def tightest(own: np.ndarray, want: np.ndarray, need: int) -> list[tuple[int, int]]:
    """(first, last) of the stretches that hold ``need`` different shingles of sorted ``want``, none within another."""
    at = np.flatnonzero(np.isin(own, want))
    have: dict[int, int] = {}
    out, left = [], 0
    values = own[at].tolist()
    for right, v in enumerate(values):
        have[v] = have.get(v, 0) + 1
        if len(have) < need:
            continue
        while have[values[left]] > 1 or len(have) > need:
            have[values[left]] -= 1
            if not have[values[left]]:
                del have[values[left]]
            left += 1
        span = (int(at[left]), int(at[right]))
        if out and out[-1][0] == span[0]:
            continue  # the same start with a later end holds the one before
        out.append(span)
    return out


def widened(own: np.ndarray, core: tuple[int, int], full: dict[int, int]) -> tuple[int, int]:
    """The stretch around ``core``, no longer than the template (or the core), with most of its shingles; of those the shortest, then the first.

    ``full``: how often the template has each shingle; further copies of one count for nothing.
    """
    i, j = core
    size = max(sum(full.values()), j - i + 1)
    lo = max(0, j - size + 1)
    values = own[lo : min(len(own), i + size)].tolist()
    have: dict[int, int] = {}
    distinct = copies = 0
    best: tuple | None = None
    right = 0
    for left in range(i - lo + 1):
        while right < min(len(values), left + size):
            v = values[right]
            if v in full:
                have[v] = have.get(v, 0) + 1
                distinct += have[v] == 1
                copies += have[v] <= full[v]
            right += 1
        if best is None or (distinct, copies) >= best[:2]:
            spare, a, b = dict(have), left, right - 1
            # Shingles at the edges that add nothing, but never the core's.
            while a < i - lo and (values[a] not in full or spare[values[a]] > full[values[a]]):
                spare[values[a]] = spare.get(values[a], 0) - 1
                a += 1
            while b > j - lo and (values[b] not in full or spare[values[b]] > full[values[b]]):
                spare[values[b]] = spare.get(values[b], 0) - 1
                b -= 1
            if best is None or (distinct, copies, a - b) > best[:3]:
                best = (distinct, copies, a - b, a, b)
        v = values[left]
        if v in full:
            have[v] -= 1
            distinct -= have[v] == 0
            copies -= have[v] < full[v]
    return lo + best[3], lo + best[4]


def best_apart(hits: list[tuple]) -> list[tuple]:
    """Of (-share, -shingles, length, name, number, first, last, core) those that stay; ``core`` is a hit of the same form, or None."""
    kept: list[tuple] = []
    free = lambda x: all(x[6] < y[5] or x[5] > y[6] for y in kept)
    rest = []
    for x in sorted(hits, key=lambda x: x[:7]):
        if free(x):
            kept.append(x)
        elif x[7] is not None:
            rest.append(x[7])
    for x in sorted(rest, key=lambda x: x[:7]):
        if free(x):
            kept.append(x)
    return kept


def _scan(templates: list[tuple[str, str]], width: int, containment: float, certainty: float):
    names = ["doc_id", "license", "template", "start", "end", "containment"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = build_classes(templates, width, containment, certainty)
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                data, off = tv.buffers(pc.utf8_lower(tv.as_strings(part.column(1))))
                t = tv.tokens(data, off)
                h, first = tv.ngrams(tv.token_hashes(data, t), t.first, width)
                cores: dict[int, set[tuple]] = {}
                for n, c in enumerate(classes):
                    for a, b, k in zip(*(x.tolist() for x in window_candidates(h, first, c)), strict=True):
                        own, want = h[a:b], c.sets[k]
                        need = next(m for m in range(int(containment * len(want)), len(want) + 2) if m / len(want) >= containment)
                        if len(np.unique(own[np.isin(own, want)])) < need:
                            continue
                        d = int(np.searchsorted(first, a, "right") - 1)
                        cores.setdefault(d, set()).update((n, k, a - int(first[d]) + i, a - int(first[d]) + j) for i, j in tightest(own, want, max(need, 1)))
                rows = []
                for d, found in sorted(cores.items()):
                    own = h[first[d] : first[d + 1]]
                    hits = {}
                    for n, k, i, j in sorted(found):
                        c = classes[n]
                        hit = lambda x, y, core: (-len(np.intersect1d(own[x : y + 1], c.sets[k])) / len(c.sets[k]), -len(c.sets[k]), y - x + width - 1, c.names[k], c.number[k], x, y + width - 1, core)  # noqa: B023, E731
                        x, y = widened(own, (i, j), c.full[k])
                        tight = hit(i, j, None)
                        hits[n, k, x, y, i, j] = hit(x, y, tight if (x, y) != (i, j) else None)
                    # Lower-casing maps character by character, so offsets hold for the text as it was.
                    text = bytes(data[off[d] : off[d + 1]])
                    word = int(t.first[d])
                    for share, _, _, name, number, x, y, _ in sorted(best_apart(list(hits.values())), key=lambda x: x[5]):
                        begin, end = int(t.start[word + x]), int(t.end[min(word + y, t.first[d + 1] - 1)])
                        chars = [len(text[: p - int(off[d])].decode()) for p in (begin, end)]
                        rows.append((d, name, number, *chars, -share))
                if rows:
                    d, *rest = zip(*rows, strict=True)
                    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), *(pa.array(v, k) for v, k in zip(rest, kinds, strict=True))], names)

    return run


def license_matches(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", templates: list[tuple[str, str]] | None = None, width: int = WIDTH, containment: float = CONTAINMENT, certainty: float = CERTAINTY
) -> DataFrame:
    """One row per match: doc_id, license, template (its number), start and end in characters, containment.

    Null and empty texts, and texts without a license, have no row. Repeated rows give the same
    matches again; null ids stay null. An empty table, or no templates, gives no rows.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    return source.mapInArrow(_scan(TEMPLATES if templates is None else templates, width, containment, certainty), f"doc_id {kind}, license string, template int, start long, end long, containment double")
