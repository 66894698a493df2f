"""Vectorised text features over Arrow string buffers.

Everything here works on the raw UTF-8 bytes of a whole batch at once: no
Python object is made per word. A *word* is a maximal run of ASCII letters,
digits, underscores and non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
CHUNK_BYTES = 2 << 20
_BASE = U64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = U64(pow(int(_BASE), -1, 1 << 64))
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))

SPACE, WORD, PUNCT = 0, 1, 2
#: Class of each byte when only words matter, and when punctuation runs are tokens too.
WORD_CLASS = np.zeros(256, np.uint8)
for _c in range(256):
    if chr(_c) in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_" or _c >= 128:
        WORD_CLASS[_c] = WORD
TOKEN_CLASS = WORD_CLASS.copy()
for _c in range(33, 127):
    if TOKEN_CLASS[_c] == SPACE:
        TOKEN_CLASS[_c] = PUNCT


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the hash base and of its inverse, modulo 2**64."""
    global _powers
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        up, down = np.full(size, _BASE), np.full(size, _BASE_INV)
        up[0] = down[0] = 1
        _powers = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _powers


def as_strings(column: pa.Array) -> pa.Array:
    """The column as 32-bit-offset strings, with null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and len+1 offsets into them."""
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batch: pa.RecordBatch, text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about ``most`` bytes of text, so that memory stays bounded.

    A single longer text makes a slice of its own and is never cut.
    """
    n = batch.num_rows
    if n == 0:
        return
    _, off = buffers(as_strings(batch.column(batch.schema.get_field_index(text))))
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Tokens:
    """Tokens of a batch: byte spans, class and, per text, the index of its first token."""

    start: np.ndarray
    end: np.ndarray
    kind: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def tokens(data: np.ndarray, off: np.ndarray, classes: np.ndarray = WORD_CLASS) -> Tokens:
    """Maximal runs of one non-space class; no run crosses from one text to the next."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Tokens(none, none, np.zeros(0, np.uint8), np.zeros(len(off), np.int64))
    c = classes[data]
    edge = np.empty(n, bool)
    edge[0] = True
    np.not_equal(c[1:], c[:-1], out=edge[1:])
    edge[off[:-1][off[:-1] < n]] = True
    at = np.flatnonzero(edge)
    to = np.append(at[1:], n)
    kind = c[at]
    keep = kind != SPACE
    at, to, kind = at[keep], to[keep], kind[keep]
    return Tokens(at, to, kind, np.searchsorted(at, off))


def token_hashes(data: np.ndarray, t: Tokens) -> np.ndarray:
    """64-bit hash of each token's bytes, from prefix sums of a polynomial."""
    n = len(data)
    if len(t.start) == 0:
        return np.zeros(0, U64)
    up, down = powers(n)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=total[1:])
    return mix64((total[t.end] - total[t.start]) * down[t.start])


def ngrams(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside each text, and offsets per text.

    A text of fewer words, but at least one, has a single n-gram of all its words.
    """
    counts = np.diff(first)
    if width == 1:
        return mix64(words + U64(width)), first
    step = mix64(np.arange(1, width + 1, dtype=U64))
    size = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    off = np.concatenate([[0], np.cumsum(size)])
    if len(words) == 0:
        return np.zeros(0, U64), off
    padded = np.concatenate([words, np.zeros(width - 1, U64)])
    full = np.zeros(len(words), U64)
    for k in range(width):
        full += padded[k : k + len(words)] * (step[k] | U64(1))
    position = np.repeat(first[:-1] - off[:-1], size) + np.arange(off[-1])
    out = full[position]
    for d in np.flatnonzero((counts > 0) & (counts < width)):
        own = words[first[d] : first[d + 1]]
        out[off[d]] = np.sum(own * (step[: len(own)] | U64(1)), dtype=U64)
    return mix64(out + U64(width)), off


def shingles(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed shingles of ``width`` lower-cased words, and offsets per text."""
    data, off = buffers(pc.utf8_lower(as_strings(column)))
    t = tokens(data, off)
    return ngrams(token_hashes(data, t), t.first, width)
