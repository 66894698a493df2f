"""Secret scan: a randomness test battery with length-aware false-discovery control.

A *candidate* is a run of at least ``MIN_CHARS`` characters of ``[A-Za-z0-9+/_-]`` whose
inferred encoding (the smallest alphabet that has all its characters) lets it hold
``MIN_BITS`` bits. Runs of letters in one case (or capitalised) are ordinary words and no
candidates. The *reference* shows how random ordinary text of a length looks: the ASCII
letters of every document in a row, cut into pieces of each length class in turn.

1. Three two-sided tests of each run against uniform draws from its alphabet:
   chi-squared of the letter counts, runs about the middle of the alphabet, and
   lag-1 serial correlation. Fisher's method combines them into one score in 0..1.
2. A candidate's p-value is the share of reference pieces of its length class that
   score as high, so a short run, which passes the tests easily, needs a
   higher score. A class with few reference pieces borrows from shorter
   ones (which look more random, so this errs to the safe side), then from
   simulated letters.
3. Benjamini-Hochberg over the candidates of all documents, with Storey's estimate
   of the share that is ordinary, turns p-values into q-values; those with
   q <= ``FDR`` are reported. A p-value above ``LAMBDA`` has the q-value 1: what
   looks less random than most text is never reported.

Both corpus-wide tables are histograms of a fixed number of cells (length class x score
bucket), whatever the input. Both passes are map-only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

MIN_CHARS, MIN_BITS, FDR, MASK = 16, 64, 0.1, "[SECRET]"
#: Shortest length of each length class, and the number of score buckets.
CLASSES = np.array([16, 18, 20, 24, 28, 32, 40, 48, 64, 96, 128, 256])
BUCKETS = 1000
MIN_REFERENCE = 1000
#: Candidates of a larger p-value count as ordinary in Storey's estimate.
LAMBDA = 0.5

_LOWER, _UPPER, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: From the smallest alphabet to the largest; the first two are ordinary words.
ALPHABETS = [
    ("word", _LOWER), ("upper", _UPPER), ("decimal", _DIGIT), ("hex", _DIGIT + "abcdef"), ("hex_upper", _DIGIT + "ABCDEF"), ("base32", _UPPER + "234567"),
    ("base36", _DIGIT + _LOWER), ("base36_upper", _DIGIT + _UPPER), ("base62", _DIGIT + _UPPER + _LOWER), ("base64", _UPPER + _LOWER + _DIGIT + "+/"), ("base64url", _UPPER + _LOWER + _DIGIT + "-_"), ("mixed", _UPPER + _LOWER + _DIGIT + "+/-_"),
]
_SIZES = np.array([len(a) for _, a in ALPHABETS])
_MEMBER = np.zeros(256, np.uint16)
_INDEX = np.zeros((len(ALPHABETS), 256), np.int64)
for _i, (_, _chars) in enumerate(ALPHABETS):
    for _j, _ch in enumerate(_chars):
        _MEMBER[ord(_ch)] |= 1 << _i
        _INDEX[_i, ord(_ch)] = _j
for _ch in _UPPER:
    _INDEX[0, ord(_ch)] = _INDEX[0, ord(_ch.lower())]
_RUN = np.where(_MEMBER > 0, tv.WORD, tv.SPACE).astype(np.uint8)
_GRID = np.linspace(-9, 9, 3601)
_CDF = np.array([0.5 * math.erfc(-z / math.sqrt(2)) for z in _GRID])


def normal_cdf(z: np.ndarray) -> np.ndarray:
    return np.interp(z, _GRID, _CDF)


def two_sided(z: np.ndarray) -> np.ndarray:
    return np.maximum(2 * normal_cdf(-np.abs(z)), 1e-15)


@dataclass
class Runs:
    """Long runs of a batch: byte spans, text index, encoding and test results."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    encoding: np.ndarray
    chi: np.ndarray
    runs: np.ndarray
    serial: np.ndarray
    score: np.ndarray

    @property
    def cell(self) -> np.ndarray:
        """Length class x score bucket."""
        size = np.searchsorted(CLASSES, self.end - self.start, "right") - 1
        return size * BUCKETS + np.minimum((self.score * BUCKETS).astype(np.int64), BUCKETS - 1)

    @property
    def ordinary(self) -> np.ndarray:
        return self.encoding < 2


def battery(x: np.ndarray, first: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The p-values of the three tests and Fisher's combination.

    ``x``: letter indexes of all runs in sequence; ``first``: offsets per run (n+1); ``k``: alphabet size per run.
    """
    n = np.diff(first)
    if len(n) == 0:
        none = np.zeros(0)
        return none, none, none, none
    own = np.repeat(np.arange(len(n)), n)
    at = first[:-1]
    counts = np.bincount(own * 80 + x, minlength=len(n) * 80).reshape(len(n), 80).astype(np.float64)
    stat = (counts**2).sum(1) * k / n - n
    # Matched to the exact mean and variance of the statistic, then Wilson and Hilferty's cube root.
    df = (k - 1) * n / np.maximum(n - 1, 1)
    z = (np.cbrt(np.maximum(stat * n / np.maximum(n - 1, 1), 0) / df) - (1 - 2 / (9 * df))) / np.sqrt(2 / (9 * df))
    p_chi = two_sided(z)
    high = (2 * x >= k[own]).astype(np.float64)
    n1 = np.add.reduceat(high, at)
    change = np.append(high[1:] != high[:-1], False)
    change[first[1:] - 1] = False
    r = 1 + np.add.reduceat(change.astype(np.float64), at)
    mean = 1 + 2 * n1 * (n - n1) / n
    var = (mean - 1) * (mean - 2) / np.maximum(n - 1, 1)
    flat = var <= 0
    z = np.sign(r - mean) * np.maximum(np.abs(r - mean) - 0.5, 0) / np.sqrt(np.where(flat, 1, var))
    p_runs = np.where(flat, np.maximum(2.0 ** (1 - np.minimum(n, 45)), 1e-15), two_sided(z))
    d = x - (np.add.reduceat(x.astype(np.float64), at) / n)[own]
    after = np.append(d[1:], 0.0)
    after[first[1:] - 1] = d[at]
    ss = np.add.reduceat(d * d, at)
    flat = ss <= 1e-9
    corr = np.add.reduceat(d * after, at) / np.where(flat, 1, ss)
    p_serial = np.where(flat, 1e-15, two_sided((corr + 1 / np.maximum(n - 1, 1)) * np.sqrt(n)))
    x2 = -2 * (np.log(p_chi) + np.log(p_runs) + np.log(p_serial))
    h = x2 / 2
    return p_chi, p_runs, p_serial, np.exp(-h) * (1 + h + h * h / 2)


def find_runs(data: np.ndarray, off: np.ndarray) -> Runs:
    """All long runs of the texts, ordinary words among them."""
    t = tv.tokens(data, off, _RUN)
    size = t.end - t.start
    long = np.flatnonzero(size >= MIN_CHARS)
    start, end = t.start[long], t.end[long]
    doc = np.searchsorted(off, start, "right") - 1
    n = end - start
    first = np.concatenate([[0], np.cumsum(n)])
    chars = data[np.repeat(start - first[:-1], n) + np.arange(first[-1])]
    bits = _MEMBER[chars]
    if len(n):
        head = chars[first[:-1]]
        bits[first[:-1]] |= ((head >= 65) & (head <= 90)).astype(np.uint16)  # a capital at the start of a word
        shared = np.bitwise_and.reduceat(bits, first[:-1])
        encoding = np.log2((shared & -shared.astype(np.int32)).astype(np.float64)).astype(np.int64)
    else:
        encoding = np.zeros(0, np.int64)
    keep = (encoding < 2) | (n * np.log2(_SIZES[encoding]) >= MIN_BITS)
    if not keep.all():
        chars = chars[np.repeat(keep, n)]
        start, end, doc, encoding, n = start[keep], end[keep], doc[keep], encoding[keep], n[keep]
        first = np.concatenate([[0], np.cumsum(n)])
    x = _INDEX[np.repeat(encoding, n), chars]
    return Runs(start, end, doc, encoding, *battery(x, first, _SIZES[encoding]))


def reference_cells(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Cells of the reference pieces of the texts; a piece lies within one text."""
    low = data | 0x20
    letter = (low >= 97) & (low <= 122)
    x = low[letter].astype(np.int64) - 97
    upto = np.concatenate([[0], np.cumsum(letter)])[off]
    m, cycle = np.diff(upto), np.concatenate([[0], np.cumsum(CLASSES)])
    n = m // cycle[-1] * len(CLASSES) + np.searchsorted(cycle[1:], m % cycle[-1], "right")
    first = np.concatenate([[0], np.cumsum(n)])
    j = np.arange(first[-1]) - np.repeat(first[:-1], n)
    start = np.repeat(upto[:-1], n) + j // len(CLASSES) * cycle[-1] + cycle[j % len(CLASSES)]
    size = CLASSES[j % len(CLASSES)]
    bounds = np.concatenate([[0], np.cumsum(size)])
    score = battery(x[np.repeat(start - bounds[:-1], size) + np.arange(bounds[-1])], bounds, np.full(len(size), 26))[3]
    return j % len(CLASSES) * BUCKETS + np.minimum((score * BUCKETS).astype(np.int64), BUCKETS - 1)


def simulated_reference(seed: int = 11, each: int = MIN_REFERENCE) -> np.ndarray:
    """Histogram of strings of independent letters at English frequencies, for classes without reference runs."""
    freq = np.array([82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1], np.float64)
    r, out = np.random.default_rng(seed), np.zeros(len(CLASSES) * BUCKETS)
    for i, n in enumerate(CLASSES):
        x = r.choice(26, size=each * n, p=freq / freq.sum())
        score = battery(x, np.arange(0, each * n + 1, n), np.full(each, 26))[3]
        np.add.at(out, i * BUCKETS + np.minimum((score * BUCKETS).astype(int), BUCKETS - 1), 1)
    return out


@dataclass
class Decision:
    """p- and q-value of every cell, from the two histograms of a corpus."""

    p: np.ndarray
    q: np.ndarray


def decide(reference: np.ndarray, candidates: np.ndarray) -> Decision:
    """Empirical p-values by length class, then adaptive Benjamini-Hochberg over all candidates."""
    ref, sim = reference.reshape(len(CLASSES), BUCKETS).astype(float), None
    p = np.ones((len(CLASSES), BUCKETS))
    for i in range(len(CLASSES)):
        pool = ref[i].copy()
        for j in range(i - 1, -1, -1):
            if pool.sum() >= MIN_REFERENCE:
                break
            pool += ref[j]
        if pool.sum() < MIN_REFERENCE:
            sim = simulated_reference().reshape(ref.shape) if sim is None else sim
            pool += sim[i] * (MIN_REFERENCE - pool.sum()) / sim[i].sum()
        p[i] = (1 + np.cumsum(pool[::-1])[::-1]) / (1 + pool.sum())
    flat, n = p.ravel(), candidates.astype(float)
    ordinary = min(1.0, (1 + n[flat > LAMBDA].sum()) / ((1 - LAMBDA) * max(n.sum(), 1)))
    order = np.argsort(flat, kind="stable")
    values, inverse = np.unique(flat[order], return_inverse=True)
    upto = np.cumsum(np.bincount(inverse, n[order]))
    raw = ordinary * values * n.sum() / np.maximum(upto, 1)
    q = np.minimum(np.minimum.accumulate(raw[::-1])[::-1], 1)
    out = np.ones(len(flat))
    out[order] = np.where(flat[order] > LAMBDA, 1.0, q[inverse])
    return Decision(flat, out)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, len(CLASSES) * BUCKETS), np.int64)
    for batch in batches:
        for part in tv.chunks(batch, "text"):
            data, off = tv.buffers(tv.as_strings(part.column(0)))
            r = find_runs(data, off)
            total[1] += np.bincount(r.cell[~r.ordinary], minlength=total.shape[1])
            total[0] += np.bincount(reference_cells(data, off), minlength=total.shape[1])
    kind, cell = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(cell, pa.int32()), pa.array(total[kind, cell])], ["kind", "cell", "n"])


def calibrate(docs: DataFrame, text_column: str = "text") -> Decision:
    """Pass 1 over all texts. At most 2 x 12,000 cells reach the driver, whatever the corpus."""
    cells = docs.select(F.col(text_column).cast("string").alias("text")).mapInArrow(_tally, "kind int, cell int, n long").groupBy("kind", "cell").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros((2, len(CLASSES) * BUCKETS))
    total[cells["kind"].to_numpy(), cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return decide(*total)


def _spans(made: Decision, fdr: float):
    names = pa.array([n for n, _ in ALPHABETS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                data, off = tv.buffers(tv.as_strings(part.column(1)))
                r = find_runs(data, off)
                hit = np.flatnonzero(~r.ordinary & (made.q[r.cell] <= fdr))
                if not len(hit):
                    continue
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                begin, cell, doc = r.start[hit], r.cell[hit], r.doc[hit]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(doc)), pa.array(chars[begin] - chars[off[doc]]), pa.array(r.end[hit] - begin), names.take(pa.array(r.encoding[hit])), *(pa.array(v[hit]) for v in (r.chi, r.runs, r.serial)), pa.array(made.p[cell]), pa.array(made.q[cell])],
                    ["doc_id", "start", "length", "encoding", "p_uniform", "p_runs", "p_serial", "p_value", "q_value"],
                )

    return run


def secret_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fdr: float = FDR) -> DataFrame:
    """One row per reported run: doc_id, start and length in characters, encoding, test results, p- and q-value.

    Null and empty texts have none. Repeated rows report the same spans
    again; a null id stays null. An empty table gives no rows. Other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    made = calibrate(docs, text_column)
    schema = f"doc_id {kind}, start long, length long, encoding string, p_uniform double, p_runs double, p_serial double, p_value double, q_value double"
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(_spans(made, fdr), schema)


def masked(text: Column, made: Decision, fdr: float = FDR, mask: str = MASK) -> Column:
    """The text with each reported run replaced by ``mask``; null stays null."""

    @F.arrow_udf("string")
    def mask_secrets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            whole = pa.RecordBatch.from_arrays([column.cast(pa.string())], ["text"])
            out = []
            for part in tv.chunks(whole, "text"):
                data, off = tv.buffers(tv.as_strings(part.column(0)))
                r = find_runs(data, off)
                hits: dict[int, list[tuple[int, int]]] = {}
                for i in np.flatnonzero(~r.ordinary & (made.q[r.cell] <= fdr)):
                    hits.setdefault(int(r.doc[i]), []).append((int(r.start[i]), int(r.end[i])))
                if not hits:
                    out.append(part.column(0))
                    continue
                raw, texts = data.tobytes(), part.column(0).to_pylist()
                for d, spans in hits.items():
                    pieces, at = [], int(off[d])
                    for a, b in spans:
                        pieces += [raw[at:a], mask.encode()]
                        at = b
                    texts[d] = b"".join([*pieces, raw[at : int(off[d + 1])]]).decode()
                out.append(pa.array(texts, pa.string()))
            yield pa.concat_arrays(out) if out else pa.array([], pa.string())

    return mask_secrets(text)


def mask_secrets(docs: DataFrame, text_column: str = "text", count_column: str | None = None, fdr: float = FDR, mask: str = MASK) -> DataFrame:
    """Every row, with secrets replaced in its text; a column of character counts is brought up to date if it is named.

    Null and empty texts stay as they are; repeated rows change alike and null ids don't matter. An empty table stays
    empty. Other columns are untouched, whatever their names.
    """
    made = calibrate(docs, text_column)
    out = docs.withColumn(text_column, masked(F.col(text_column), made, fdr, mask))
    if count_column and count_column in docs.columns:
        kind = docs.schema[count_column].dataType
        out = out.withColumn(count_column, F.when(F.col(count_column).isNotNull(), F.length(text_column)).cast(kind))
    return out.select(*docs.columns)
