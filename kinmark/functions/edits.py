"""Terms within a few edits: deletion keys and checks in numpy on Arrow batches, many terms at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType

_B, _M = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FAR = 9


def _codes(terms: list[str], width: int) -> np.ndarray:
    """Code points of terms of at most ``width`` characters, with zeros after their ends."""
    return np.array(terms, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(terms), max(width, 1))


def _hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """64-bit sums over characters and places of terms of one length: a row for each, with what is left after deleting up to k (0, 1 or 2) characters."""
    n, length = codes.shape
    c = (codes.astype(np.uint64) + np.uint64(1)) * _M
    c = (c ^ (c >> np.uint64(29))).T * _B
    powers = np.cumprod(np.full(length + 1, _B, np.uint64))
    # before[d][i]: what the first i characters add after d of those before them are gone.
    before = [np.zeros((length + 1, n), np.uint64) for _ in range(k + 1)]
    for d in range(k + 1):
        shifted = np.concatenate([np.zeros(min(d, length), np.uint64), powers[: max(length - d, 0)]])
        np.cumsum(c * shifted[:, None], axis=0, out=before[d][1:])
    total = [b[length] for b in before]
    out = [total[0] + powers[length]]
    if k >= 1:
        out += [before[0][i] + total[1] - before[1][i + 1] + powers[length - 1] for i in range(length)]
    if k >= 2:
        out += [before[0][i] + before[1][j] - before[1][i + 1] + total[2] - before[2][j + 1] + powers[length - 2] for i in range(length) for j in range(i + 1, length)]
    return np.stack(out, axis=1)


@F.arrow_udf(ArrayType(LongType()))
def deletion_keys(term: pa.Array, k: pa.Array) -> pa.Array:
    """Hashes of the term and of what is left after deleting up to k characters, each once; none for a negative k. Equal strings have equal keys, and the others seldom."""
    terms, level = term.to_pylist(), np.asarray(k.to_pylist(), np.int64)
    length = np.array([len(t) for t in terms], np.int64)
    counts, parts = np.zeros(len(terms), np.int64), []
    for kind in sorted({(a, b) for a, b in zip(length.tolist(), level.tolist()) if b >= 0}):
        rows = np.flatnonzero((length == kind[0]) & (level == kind[1]))
        codes = _codes([terms[i] for i in rows], kind[0])[:, : kind[0]]
        keys = np.sort(_hashes(codes, kind[1]), axis=1)
        new = np.ones(keys.shape, bool)
        new[:, 1:] = keys[:, 1:] != keys[:, :-1]
        counts[rows] = new.sum(axis=1)
        parts.append((rows, keys[new]))
    offsets = np.concatenate([[0], np.cumsum(counts)])
    values = np.empty(offsets[-1], np.int64)
    for rows, keys in parts:
        n = counts[rows]
        starts = np.repeat(offsets[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        values[starts + np.arange(len(keys))] = keys.view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values))


def edits(a: list[str], b: list[str]) -> np.ndarray:
    """Edits from a to b, where a swap of neighbours is one and may be edited further; exact up to 2, above that some number above 2."""
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    out = np.full(len(a), _FAR, np.int8)
    longest = np.maximum(la, lb)
    done = np.abs(la - lb) > 2
    width = 8
    while not done.all():
        rows = np.flatnonzero(~done & (longest <= width))
        if len(rows):
            out[rows] = _edits(_codes([a[i] for i in rows], width), _codes([b[i] for i in rows], width), la[rows], lb[rows])
            done[rows] = True
        width *= 2
    return out


def _edits(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> np.ndarray:
    n, width = a.shape
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    far = np.full(n, _FAR, np.int8)
    out, gap = far.copy(), lb - la
    # rows[r][o + 2]: edits between the first i - r characters of a and o more (or less) of b; further apart there are more than two.
    rows: list[list[np.ndarray]] = [[], [], [], []]
    for i in range(int(la.max()) + 1):
        rows = [[], *rows[:3]]
        for o in range(-2, 3):
            j, at = i + o, o + 2
            if j < 0 or j > width:
                rows[0].append(far)
                continue
            if i == 0 or j == 0:
                rows[0].append(np.full(n, i + j, np.int8))
                continue
            d = rows[1][at] + (a[i - 1] != b[j - 1])
            if o < 2:
                d = np.minimum(d, rows[1][at + 1] + 1)
            if o > -2:
                d = np.minimum(d, rows[0][at - 1] + 1)
            if i >= 2 and j >= 2:
                d = np.minimum(d, np.where((a[i - 1] == b[j - 2]) & (a[i - 2] == b[j - 1]), rows[2][at] + 1, _FAR))
            if i >= 2 and j >= 3 and o > -2:
                d = np.minimum(d, np.where((a[i - 1] == b[j - 3]) & (a[i - 2] == b[j - 1]), rows[2][at - 1] + 2, _FAR))
            if i >= 3 and j >= 2 and o < 2:
                d = np.minimum(d, np.where((a[i - 1] == b[j - 2]) & (a[i - 3] == b[j - 1]), rows[3][at + 1] + 2, _FAR))
            rows[0].append(np.minimum(d, _FAR).astype(np.int8))
        for o in range(-2, 3):
            ends = (la == i) & (gap == o)
            out[ends] = rows[0][o + 2][ends]
    return out


@F.arrow_udf(BooleanType())
def within_edits(a: pa.Array, b: pa.Array, k: pa.Array) -> pa.Array:
    """Whether a is within k (0, 1 or 2) edits of b, where a swap of neighbours is one edit."""
    return pa.array(edits(a.to_pylist(), b.to_pylist()) <= np.asarray(k.to_pylist(), np.int8))
