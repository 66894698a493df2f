import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from kinmark.llm import token_shards as ts

from .cases import awkward, awkward_rows, empty

pytestmark = pytest.mark.skipif(not os.path.exists(ts.TOKENIZER), reason="no tokenizer here")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=600))
def test_elias_fano(steps):
    values = np.cumsum(steps) if steps else np.zeros(0, np.int64)
    ef = ts.EliasFano.encode(values)
    assert ef.decode().tolist() == values.tolist()
    assert [ef.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        ef.select(len(values))


def test_space():
    values = np.cumsum(np.random.default_rng(0).integers(1, 2000, 100_000))
    ef = ts.EliasFano.encode(values)
    bits = 8 * (len(ef.low) + len(ef.high) + len(ef.samples)) / len(values)
    assert bits <= 2.3 + np.log2(values[-1] / len(values)) + 32 / ts.SAMPLE


def round_trip(rows):
    tok = ts.tokenizer(ts.TOKENIZER)
    out = []
    for r in rows:
        ef = ts.boundaries(r)
        assert ef.select(0) == 0 and ef.select(r.n_docs) == r.n_tokens and len(r.ids) == r.n_tokens * r.id_bytes
        for i, d in enumerate(r.doc_ids):
            ids = ts.document_ids(r, i)
            assert ids[-1] == ts.END
            out.append((d, tok.decode(ids[:-1].tolist())))
    return out


def test_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = ts.token_shards(docs, shard_tokens=20_000).collect()
    assert sorted(round_trip(rows)) == sorted(map(tuple, docs.collect()))
    assert len(rows) > 5 and rows[0].id_bytes == 2


def test_awkward_and_empty(spark):
    got = round_trip(ts.token_shards(awkward(spark)).collect())
    assert sorted(map(str, got)) == sorted(str((r[0], r[1] or "")) for r in awkward_rows())
    assert ts.token_shards(empty(spark)).count() == 0


def test_long_runs_and_string_ids(spark):
    texts = {"blank": " " * 1_500_000, "lines": "a" + "\n" * 300_000 + "b", "letters": "x" * 200_000, "signs": "word " + "-=" * 50_000 + " 漢" * 10 + "字" * 9000}
    got = round_trip(ts.token_shards(spark.createDataFrame(list(texts.items()), "doc_id string, text string")).collect())
    assert dict(got) == texts
    assert ts.encode(ts.TOKENIZER, "a plain text") == ts.tokenizer(ts.TOKENIZER).encode_ordinary("a plain text")
