"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Features of a text are relative frequencies of hashed one- and two-token
n-grams; tokens are runs of word or of punctuation characters, as written. Two-token
n-grams are also taken of token shapes (case, class, whether it repeats the
token before it or the one before that), which new words share with known ones.
A score is the sparse dot product of the frequencies and the weights.

The model is fitted on a bounded sample of labelled rows (at most ``max_labelled``, those of the smallest
hashes of ids); scores cover every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv

BITS, SCALE, MAX_LABELLED, EPOCHS, THRESHOLD = 18, 16.0, 6000, 3, 0.5
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.02, 0.1

_SHAPE = np.zeros(256, np.uint64)
for _c in range(256):
    _SHAPE[_c] = 1 if chr(_c).isdigit() and _c < 128 else 2 if chr(_c).isupper() and _c < 128 else 3 if chr(_c).islower() and _c < 128 else 4 if _c >= 128 else _c


def features(text: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each text, one after another, and offsets per text."""
    data, off = tv.buffers(tv.as_strings(text))
    t = tv.tokens(data, off, tv.TOKEN_CLASS)
    h = tv.token_hashes(data, t)
    two, first2 = tv.ngrams(h, t.first, 2)
    shape = (_SHAPE[data[t.start]] << tv.U64(9)) | (_SHAPE[data[np.minimum(t.start + 1, t.end - 1)]] << tv.U64(18)) | (_SHAPE[data[t.end - 1]] << tv.U64(27)) if len(h) else h
    doc = np.repeat(np.arange(len(t.counts)), t.counts)
    for back in (1, 2):
        if len(h) > back:
            shape[back:] |= ((h[back:] == h[:-back]) & (doc[back:] == doc[:-back])).astype(np.uint64) << tv.U64(back)
    forms, _ = tv.ngrams(tv.mix64(shape), t.first, 2)
    counts = t.counts + 2 * np.diff(first2)
    out_off = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(out_off[-1], np.int64)
    mask = tv.U64((1 << bits) - 1)
    for single, part, first, before in ((1, h, t.first, 0), (0, two, first2, t.counts), (0, forms, first2, t.counts + np.diff(first2))):
        n = np.diff(first)
        at = np.repeat(out_off[:-1] + before - first[:-1], n) + np.arange(len(part))
        out[at] = (tv.mix64(part + tv.U64(single)) & mask).astype(np.int64)
    return out, out_off


def sparse(text: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct buckets and their scaled relative frequencies."""
    b, off = features(text, bits)
    out = []
    for i in range(len(off) - 1):
        idx, n = np.unique(b[off[i] : off[i + 1]], return_counts=True)
        out.append((idx.astype(np.int32), (n * (SCALE / max(1, n.sum()))).astype(np.float32)))
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, text: pa.Array) -> np.ndarray:
        """Probability of good quality; 0 for a text without tokens (or null)."""
        out = np.zeros(len(text))
        at = 0
        for part in tv.chunks(pa.RecordBatch.from_arrays([tv.as_strings(text)], ["text"]), "text"):
            b, off = features(part.column(0), self.bits)
            n = np.diff(off)
            total = np.concatenate([[0.0], np.cumsum(self.weights[b], dtype=np.float64)])
            dot = (total[off[1:]] - total[off[:-1]]) * (SCALE / np.maximum(n, 1)) + self.bias
            out[at : at + len(n)] = np.where(n > 0, 1 / (1 + np.exp(-np.clip(dot, -30, 30))), 0.0)
            at += len(n)
        return out


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """FTRL-proximal over (buckets, values, label) rows; without rows every text scores 0.5."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            idx, val, y = rows[r]
            i, x = np.append(idx, size), np.append(val, 1.0)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y) * x
            root = np.sqrt(n[i])
            n[i] += g * g
            z[i] += g - (np.sqrt(n[i]) - root) / ALPHA * w
    w = weight(np.arange(size + 1))
    return Model(w[:size].astype(np.float32), float(w[size]), bits)


def labelled_rows(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, max_labelled: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("string").alias("id")).agg(F.min("quality").cast("int").alias("y"))
    source = docs.select(F.col(id_column).cast("string").alias("id"), F.col(text_column).cast("string").alias("text")).where("id is not null and text is not null").withColumn("th", F.xxhash64("text"))
    # The sample is chosen by ids and hashes of texts alone, of which repeated rows have one; only its texts are read in full.
    known = one.join(source.select("id", "th").distinct(), "id").orderBy(F.xxhash64("id"), "id", "th").limit(max_labelled)
    picked = source.join(F.broadcast(known), ["id", "th"]).groupBy("id", "th").agg(F.first("text").alias("text"), F.first("y").alias("y"))  # at most max_labelled rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in tv.chunks(batch, "text"):
                got = sparse(part["text"])
                yield pa.RecordBatch.from_arrays([part["id"], part["y"], pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.float32()))], ["id", "y", "idx", "val"])

    table = picked.select("id", "text", "y").mapInArrow(run, "id string, y int, idx array<int>, val array<float>").toArrow()
    rows = [(i, tuple(a.values.to_numpy()), a.values.to_numpy(), b.values.to_numpy(), y) for i, a, b, y in zip(table["id"].to_pylist(), table["idx"], table["val"], table["y"].to_pylist(), strict=True)]
    rows.sort(key=lambda r: (r[0], r[1]))
    return [(a, b, int(y > 0)) for _, _, a, b, y in rows]


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """The classifier for ``labels`` (doc_id, quality 0/1) over ``docs``.

    Rows with a null id, label or text are not learnt from; of contradicting labels of
    one id the lower counts, and repeated rows count once. Ids of any type are compared as strings.
    """
    return train(labelled_rows(docs, labels, id_column, text_column, max_labelled))


def score_column(model: Model, text: Column) -> Column:
    @F.arrow_udf("double")
    def quality_score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array(model.score(a))

    return quality_score(text)


def quality_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per document: doc_id, score in 0..1 and whether it is kept (score >= threshold).

    A null, empty or blank text scores 0 and is rejected. Repeated rows score
    alike. Without labels every other text scores 0.5 and is kept.
    """
    model = fit(docs, labels, id_column, text_column, max_labelled)
    scored = docs.select(F.col(id_column).alias("doc_id"), score_column(model, F.col(text_column)).alias("score"))
    return scored.withColumn("kept", F.col("score") >= threshold)


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that are not rejected, with their own columns, whatever their names.

    A null, empty or blank text is rejected. Repeated rows stay or go together, and a null id doesn't matter. Without
    labels only texts without a word go. An empty table stays empty.
    """
    model = fit(docs, labels, id_column, text_column, max_labelled)
    return docs.where(score_column(model, F.col(text_column)) >= threshold)
