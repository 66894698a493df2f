import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from kinmark.llm import audio as au
from pyspark.sql import functions as F

from .cases import awkward, empty


def brute_resample(x, rate_in, rate_out, taps=12, beta=8.0):
    """Zero stuffing, one convolution with the whole filter, then decimation."""
    g = np.gcd(rate_in, rate_out)
    p, q = rate_out // g, rate_in // g
    half = -(-taps * max(p, q) // (2 * p))
    n = np.arange(-half * p, half * p + 1)
    h = np.sinc(n / max(p, q)) * np.i0(beta * np.sqrt(np.maximum(0, 1 - (n / (half * p)) ** 2)))
    h[-1] = 0  # an even number of taps in each phase
    for r in range(p):
        h[r::p][: 2 * half] /= h[r::p][: 2 * half].sum()
    up = np.zeros(len(x) * p)
    up[::p] = x
    m = np.arange(-(-len(x) * p // q)) * q
    full = np.convolve(up, h)
    return full[m + half * p]


@pytest.mark.parametrize(("a", "b"), [(8000, 16000), (16000, 8000), (44100, 16000), (8000, 6000)])
def test_resampling(a, b):
    x = np.random.default_rng(0).normal(size=3000).astype(np.float32)
    y = au.resample(x, a, b)
    assert len(y) == -(-len(x) * b // a)
    if b > a and a == 8000:
        assert np.allclose(y, brute_resample(x, a, b), atol=2e-3)
    t = np.sin(2 * np.pi * 440 * np.arange(a) / a).astype(np.float32)
    z = au.resample(t, a, b)
    assert np.abs(z - np.sin(2 * np.pi * 440 * np.arange(len(z)) / b))[200:-200].max() < 1e-3


def brute_mel(y, c):
    n = au.frame_count(len(y), c)
    y = np.pad(y, (0, (n - 1) * c.hop + c.frame - len(y)))
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(c.frame) / c.frame)
    mel = au.mel_filters(c)
    out = []
    for i in range(n):
        part = np.pad(y[i * c.hop : i * c.hop + c.frame] * w, (0, c.fft - c.frame))
        k = np.arange(c.fft)
        dft = np.exp(-2j * np.pi * np.outer(np.arange(c.fft // 2 + 1), k) / c.fft) @ part
        out.append(np.log(np.abs(dft) ** 2 @ mel + c.floor))
    return np.array(out)


def test_patches_hold_the_log_mels():
    c = au.AudioConfig(on_db=-200, off_db=-200, gap=1, least=1)
    raw = np.random.default_rng(1).integers(0, 256, 3000).astype(np.uint8)
    rows = list(au.clip_patches([np.zeros(0, np.uint8), raw], c))
    want = brute_mel(au.resample(au.decode(raw, c.encoding), 8000, 16000), c)
    got = np.concatenate([t[: b - a] for _, _, _, a, b, t in rows])
    assert {r[0] for r in rows} == {1} and np.allclose(got, want, atol=1e-2)
    last = rows[-1]
    assert np.allclose(last[5][last[4] - last[3] :], np.log(c.floor))


def brute_segments(db, on, off, gap, least):
    out, start = [], None
    for i, v in enumerate([*db, -np.inf]):
        if v >= off and start is None:
            start = i
        if v < off and start is not None:
            if max(db[start:i]) >= on:
                out.append([start, i])
            start = None
    joined = []
    for s in out:
        if joined and s[0] - joined[-1][1] < gap:
            joined[-1][1] = s[1]
        else:
            joined.append(s)
    return [tuple(s) for s in joined if s[1] - s[0] >= least]


def test_segments_against_brute_force():
    r = np.random.default_rng(2)
    for _ in range(200):
        db = r.normal(-20, 10, 60).round(1)
        assert au.segments(db, -12, -24, 3, 4) == brute_segments(db.tolist(), -12, -24, 3, 4)


def test_silence_between_tones_splits_segments():
    tone = lambda n: (127 * np.sin(2 * np.pi * 500 * np.arange(n) / 8000) + 128).astype(np.uint8)
    clip = np.concatenate([np.full(4000, 128, np.uint8), tone(4000), np.full(4000, 128, np.uint8), tone(8000)])
    c = au.AudioConfig()
    rows = list(au.clip_patches([clip], c))
    assert {r[1] for r in rows} == {0, 1}
    starts = [min(r[3] for r in rows if r[1] == s) * c.hop / c.rate_out for s in (0, 1)]
    assert np.allclose(starts, [0.5, 1.5], atol=0.05)


def test_mulaw():
    assert au.decode(np.array([0xFF, 0x80, 0x00], np.uint8), "mulaw").tolist() == pytest.approx([0.0, 32124 / 32768, -32124 / 32768])
    with pytest.raises(ValueError):
        au.decode(np.zeros(1, np.uint8), "mp3")


def test_query_and_tensors(spark, tmp_path):
    docs = awkward(spark)
    out = au.audio_patches(docs, audio=F.encode("text", "UTF-8"))
    rows = out.toArrow()
    c = au.AudioConfig()
    tensors = au.as_tensors(rows["tensor"])
    assert tensors.type == pa.fixed_shape_tensor(pa.float32(), (c.frames, c.mels), dim_names=["frame", "mel"]) and tensors.to_numpy_ndarray().shape == (len(rows), c.frames, c.mels)
    ids = rows["doc_id"].to_pylist()
    assert 0 not in ids and 1 not in ids and 4 in ids and ids.count(6) % 3 == 0
    assert all(a < b for a, b in zip(rows["start_s"].to_pylist(), rows["end_s"].to_pylist(), strict=True))
    files = au.write_tensors(out, f"file://{tmp_path}/tensors").collect()
    back = pa.concat_tables(pq.read_table(f.file) for f in files)
    assert sum(f.rows for f in files) == len(rows) == back.num_rows and back.schema.field("tensor").type == tensors.type
    assert au.audio_patches(empty(spark), audio=F.encode("text", "UTF-8")).count() == 0
