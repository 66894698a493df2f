"""Token-id shards: concatenated ids with Elias-Fano encoded document boundaries.

A shard is one row: the ids of its documents one after another in the narrowest integer
type, and the n + 1 boundaries in Elias-Fano form. A boundary costs 2 + log2(ids / n)
bits, plus one 32-bit sample for every ``SAMPLE`` boundaries from which
select finds any boundary by a short scan: no 64-bit offset table exists.

The job is map-only: a task tokenises its rows in their order and closes a shard when it
has ``shard_tokens`` ids. A document is never cut between shards.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import textvec as tv

TOKENIZER, END, SHARD_TOKENS, SAMPLE = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50256, 1 << 20, 128
#: Runs of one kind (blank or not) above this length are cut before the tokenizer sees them, as its pattern and its merges can't hold them.
LONGEST_RUN = 4096
_LONG_RUN = re.compile(rf"\s{{{LONGEST_RUN},}}|\S{{{LONGEST_RUN},}}")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class EliasFano:
    """A non-decreasing sequence of integers: ``low_bits`` low bits each, and the high parts in unary."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // n).bit_length() - 1) if n else 0
        low = ((values[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel()
        at = (values >> width) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
        return cls(n, width, pack(low), pack(high), at[::SAMPLE].astype("<u4").tobytes())

    def select(self, i: int) -> int:
        """The i-th value: from the nearest sample on, count set bits byte by byte."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4", 1, i // SAMPLE * 4)[0])
        left = i % SAMPLE
        byte, skip = at >> 3, at & 7
        word = self.high[byte] >> skip << skip
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        position = byte * 8 + (word & -word).bit_length() - 1
        first = i * self.low_bits
        window = int.from_bytes(self.low[first >> 3 : (first + self.low_bits + 7) >> 3], "little") >> (first & 7)
        return (position - i) << self.low_bits | window & ((1 << self.low_bits) - 1)

    def decode(self) -> np.ndarray:
        """All values at once."""
        high = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))[: self.n] - np.arange(self.n)
        if not self.low_bits:
            return high
        bits = np.unpackbits(np.frombuffer(self.low, np.uint8), bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        return high << self.low_bits | (bits.astype(np.int64) << np.arange(self.low_bits)).sum(1)


@cache
def tokenizer(path: str):
    """The byte-level BPE in ``path`` (one base64 token and its rank per line)."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ids", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(path: str, text: str) -> list[int]:
    """Ids of a text of any shape; they decode to the text itself. Runs of ``LONGEST_RUN`` blanks or non-blanks and more are cut in pieces of that length."""
    own = tokenizer(path).encode_ordinary
    if len(text) < LONGEST_RUN or not (runs := list(_LONG_RUN.finditer(text))):
        return own(text)
    cuts = sorted({0, len(text), *(c for r in runs for c in (*range(r.start(), r.end(), LONGEST_RUN), r.end()))})
    return [i for a, b in zip(cuts, cuts[1:], strict=False) for i in own(text[a:b])]


def token_count(text: Column, tokenizer_path: str = TOKENIZER, end: int | None = END) -> Column:
    """Number of ids of each text, its closing id included; null for null, 0 for an empty text."""

    @F.arrow_udf("long")
    def count_tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        more = 0 if end is None else 1
        for column in batches:
            texts = column.cast(pa.string()).to_pylist()
            yield pa.array([None if t is None else len(encode(tokenizer_path, t)) + more if t else 0 for t in texts], pa.int64())

    return count_tokens(text)


def _shards(path: str, end: int | None, shard_tokens: int, id_type: pa.DataType):
    names = ["shard", "n_docs", "n_tokens", "doc_ids", "id_bytes", "ids", "low_bits", "low", "high", "samples"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = [] if end is None else [end]
        kind = np.dtype("<u2") if max(tokenizer(path).max_token_value, end or 0) < 1 << 16 else np.dtype("<u4")
        part, turn = TaskContext.get().partitionId(), 0
        docs: list = []
        ids: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal docs, ids, size, turn
            ef = EliasFano.encode(np.concatenate([[0], np.cumsum([len(x) for x in ids])]))
            row = [part << 32 | turn, len(docs), size, docs, kind.itemsize, np.concatenate(ids).tobytes(), ef.low_bits, ef.low, ef.high, ef.samples]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            docs, ids, size, turn = [], [], 0, turn + 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            for piece in tv.chunks(batch, "text"):
                for one, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    own = np.array(encode(path, text or "") + tail, kind)
                    docs.append(one)
                    ids.append(own)
                    size += len(own)
                    if size >= shard_tokens:
                        yield close()
        if docs:
            yield close()

    return run


def token_shards(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer_path: str = TOKENIZER, end: int | None = END, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per shard: shard, n_docs, n_tokens, doc_ids, id_bytes, ids, low_bits, low, high, samples.

    ``end`` is the id that closes each document (None: none). A null text is an empty document: its
    end id alone. Repeated rows are written each; ids keep their type and null ones stay null. Runs of
    blanks or non-blanks of any length are cut for the tokenizer (``encode``), and decode unchanged. An
    empty table gives no rows. Strings of special tokens in a text are ordinary text.
    Other columns are ignored. ``tokenizer_path`` must be readable on every executor.
    """
    source = docs.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"shard long, n_docs long, n_tokens long, doc_ids array<{kind}>, id_bytes int, ids binary, low_bits int, low binary, high binary, samples binary"
    return source.mapInArrow(_shards(tokenizer_path, end, shard_tokens, to_arrow_type(docs.schema[id_column].dataType)), schema)


def boundaries(row) -> EliasFano:
    """The n_docs + 1 boundaries of a shard's row."""
    return EliasFano(row["n_docs"] + 1, row["low_bits"], bytes(row["low"]), bytes(row["high"]), bytes(row["samples"]))


def document_ids(row, i: int) -> np.ndarray:
    """The ids of the i-th document of a shard's row, by two selects."""
    ef = boundaries(row)
    a, b = ef.select(i), ef.select(i + 1)
    return np.frombuffer(row["ids"], f"<u{row['id_bytes']}", b - a, a * row["id_bytes"])
