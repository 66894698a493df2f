"""Audio features of a media column: polyphase resampling, log-mel filterbanks, energy segments.

A clip is a binary of 8-bit mu-law or linear PCM samples at ``rate_in``.

1. Rational resampling to ``rate_out``: up by p and down by q, with a Kaiser-windowed
   sinc filter split into its p phases, so only samples that are kept are computed.
2. Overlapped frames (Hann window, ``frame`` long, every ``hop``), power spectrum, triangular
   mel filters, natural log.
3. Hysteresis segmentation of frame energy: a segment starts where the energy, in dB
   below the clip's loudest frame, reaches ``on`` and lasts while it stays above ``off``;
   segments closer than ``gap`` are joined and those shorter than ``least`` dropped.
4. Each segment is cut into patches of ``frames`` frames, the last one padded with the log floor:
   a fixed-shape tensor [frames, mels] with its time span.

Spark has no tensor type, so the column is an array of frames x mels floats of one length; ``as_tensors``
shows it as Arrow's fixed_shape_tensor without copying, and ``write_tensors`` stores it so.
The job is map-only. Spectra are made slice by slice; a clip's wave and log-mel rows are held while it is worked, about
50 bytes for each byte of an 8 kHz clip.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_FRAMES = 4096
#: Samples of clips that are worked together.
BATCH_SAMPLES = 1 << 20


@dataclass(frozen=True)
class AudioConfig:
    rate_in: int = 8000
    rate_out: int = 16000
    encoding: str = "pcm_u8"  # or "mulaw"
    taps: int = 12  # of each phase of the filter, half of them on either side
    frame: int = 400
    hop: int = 160
    fft: int = 512
    mels: int = 40
    low_hz: float = 60.0
    high_hz: float = 7600.0
    floor: float = 1e-6
    on_db: float = -12.0
    off_db: float = -24.0
    gap: int = 5
    least: int = 5
    frames: int = 32


def decode(raw: np.ndarray, encoding: str) -> np.ndarray:
    """Samples in -1..1."""
    if encoding == "pcm_u8":
        return (raw.astype(np.float32) - 128) / 128
    if encoding == "mulaw":
        x = ~raw
        size = ((((x & 0x0F).astype(np.int32) << 3) + 0x84) << ((x >> 4) & 7)) - 0x84
        return (np.where(x & 0x80, -size, size) / 32768).astype(np.float32)
    raise ValueError(f"unknown encoding {encoding!r}")


def polyphase_filter(p: int, q: int, taps: int, beta: float = 8.0) -> np.ndarray:
    """(p, taps) phases of a low-pass filter at the lower of the two Nyquist rates; each phase sums to 1.

    Tap i of a phase weighs the input at i - taps / 2 + 1 from the output's place. When rates
    fall, the filter has more taps in proportion.
    """
    half = -(-taps * max(p, q) // (2 * p))
    n = np.arange(p)[:, None] + p * np.arange(half - 1, -half - 1, -1)
    h = np.sinc(n / max(p, q)) * np.i0(beta * np.sqrt(np.maximum(0, 1 - (n / (half * p)) ** 2)))
    return (h / h.sum(1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, rate_in: int, rate_out: int, taps: int = 12) -> np.ndarray:
    """Output m is phase (m q mod p) applied around input m q // p; ceil(len p / q) samples, zeros outside the clip."""
    g = gcd(rate_in, rate_out)
    p, q = rate_out // g, rate_in // g
    if p == q or not len(x):
        return x.astype(np.float32)
    phases = polyphase_filter(p, q, taps)
    width = phases.shape[1]
    n = -(-len(x) * p // q)
    padded = np.concatenate([np.zeros(width, np.float32), x.astype(np.float32), np.zeros(width + 1, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, width)
    out = np.empty(n, np.float32)
    for first in range(min(p, n)):
        # Outputs first, first + p, ... use one phase, at inputs q apart.
        begin = first * q // p + width - width // 2 + 1
        k = len(range(first, n, p))
        out[first::p] = view[begin : begin + (k - 1) * q + 1 : q] @ phases[first * q % p]
    return out


def mel_filters(c: AudioConfig) -> np.ndarray:
    """(fft / 2 + 1, mels) triangles, equally wide on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + np.asarray(f) / 700)
    edges = 700 * (10 ** (np.linspace(mel(c.low_hz), mel(min(c.high_hz, c.rate_out / 2)), c.mels + 2) / 2595) - 1)
    f = np.arange(c.fft // 2 + 1) * c.rate_out / c.fft
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def frame_count(samples: int, c: AudioConfig) -> int:
    """A clip shorter than a frame is padded to one."""
    return 0 if samples == 0 else 1 + max(0, -(-(samples - c.frame) // c.hop))


def features(y: np.ndarray, starts: np.ndarray, window: np.ndarray, filters: np.ndarray, c: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and mean energies of the frames at ``starts`` of ``y``, slice by slice."""
    mel, energy = np.empty((len(starts), c.mels), np.float32), np.empty(len(starts), np.float32)
    view = np.lib.stride_tricks.sliding_window_view(y, c.frame)
    for a in range(0, len(starts), SLICE_FRAMES):
        part = view[starts[a : a + SLICE_FRAMES]]
        energy[a : a + SLICE_FRAMES] = np.einsum("ij,ij->i", part, part) / c.frame
        spectrum = np.fft.rfft(part * window, c.fft, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        mel[a : a + SLICE_FRAMES] = np.log(power.astype(np.float32) @ filters + np.float32(c.floor))
    return mel, energy


def segments(db: np.ndarray, on: float, off: float, gap: int, least: int) -> list[tuple[int, int]]:
    """Spans [a, b) of frames, by hysteresis. An energy that is not a number counts as silence."""
    db = np.where(np.isnan(db), -np.inf, db)
    above = np.concatenate([[False], db >= off, [False]])
    edge = np.flatnonzero(above[1:] != above[:-1])
    out: list[list[int]] = []
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if db[a:b].max() < on:
            continue
        if out and a - out[-1][1] < gap:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= least]


def clip_patches(raw_clips: list[np.ndarray], c: AudioConfig) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """(clip, segment, patch, first frame, end frame, tensor) of each patch of each clip."""
    window, filters = np.hanning(c.frame + 1)[:-1].astype(np.float32), mel_filters(c)
    # All clips lie in one buffer, each padded to whole frames, so that the transforms run over many clips at once.
    waves = [resample(decode(r, c.encoding), c.rate_in, c.rate_out, c.taps) for r in raw_clips]
    n = np.array([frame_count(len(w), c) for w in waves], np.int64)
    size = np.where(n > 0, (n - 1) * c.hop + c.frame, 0)
    base = np.concatenate([[0], np.cumsum(size)])
    if not base[-1]:
        return
    y = np.zeros(base[-1], np.float32)
    for w, a in zip(waves, base[:-1].tolist(), strict=True):
        y[a : a + len(w)] = w
    first = np.concatenate([[0], np.cumsum(n)])
    starts = np.repeat(base[:-1] - first[:-1] * c.hop, n) + np.arange(first[-1]) * c.hop
    mel, energy = features(y, starts, window, filters, c)
    level = 10 * np.log10(energy + np.float32(1e-10))
    pad = np.float32(np.log(c.floor))
    for i in np.flatnonzero(n).tolist():
        own = level[first[i] : first[i + 1]]
        for s, (a, b) in enumerate(segments(own - own.max(), c.on_db, c.off_db, c.gap, c.least)):
            for k, at in enumerate(range(a, b, c.frames)):
                end = min(b, at + c.frames)
                tensor = np.full((c.frames, c.mels), pad, np.float32)
                tensor[: end - at] = mel[first[i] + at : first[i] + end]
                yield i, s, k, at, end, tensor


def _run(c: AudioConfig):
    names = ["doc_id", "segment", "patch", "start_s", "end_s", "n_frames", "tensor"]

    def batch_of(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        clip, seg, patch, a, b, tensors = zip(*rows, strict=True)
        flat = pa.array(np.concatenate([t.ravel() for t in tensors]))
        off = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * (c.frames * c.mels))
        a, b = np.array(a), np.array(b)
        return pa.RecordBatch.from_arrays(
            [ids.take(pa.array(clip)), pa.array(seg, pa.int32()), pa.array(patch, pa.int32()), pa.array(a * c.hop / c.rate_out), pa.array(((b - 1) * c.hop + c.frame) / c.rate_out), pa.array(b - a, pa.int32()), pa.ListArray.from_arrays(off, flat)], names
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clips = [np.frombuffer(x.as_buffer(), np.uint8) if x.is_valid else np.zeros(0, np.uint8) for x in batch.column(1)]
            at = 0
            while at < len(clips):
                to, total = at + 1, len(clips[at])
                while to < len(clips) and total + len(clips[to]) <= BATCH_SAMPLES:
                    total += len(clips[to])
                    to += 1
                rows = []
                for x in clip_patches(clips[at:to], c):
                    rows.append(x)
                    if len(rows) == 512:
                        yield batch_of(batch.column(0).slice(at, to - at), rows)
                        rows = []
                if rows:
                    yield batch_of(batch.column(0).slice(at, to - at), rows)
                at = to

    return run


def audio_patches(clips: DataFrame, id_column: str = "doc_id", audio: Column | None = None, config: AudioConfig = AudioConfig()) -> DataFrame:
    """One row per patch: doc_id, segment, patch, start_s, end_s, n_frames, tensor (frames x mels floats).

    ``audio``: binary column of samples; the column ``audio`` unless given. Null and empty clips have no
    row; a constant clip is one segment. Repeated rows give the same patches again; null ids
    stay null. An empty table gives no rows. Other columns are ignored.
    """
    kind = clips.schema[id_column].dataType.simpleString()
    source = clips.select(F.col(id_column).alias("id"), (F.col("audio") if audio is None else audio).cast("binary").alias("audio"))
    return source.mapInArrow(_run(config), f"doc_id {kind}, segment int, patch int, start_s double, end_s double, n_frames int, tensor array<float>")


def as_tensors(column: pa.Array | pa.ChunkedArray, config: AudioConfig = AudioConfig()) -> pa.Array:
    """The tensor column as an Arrow fixed_shape_tensor array over the same memory."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.fixed_shape_tensor(pa.float32(), (config.frames, config.mels), dim_names=["frame", "mel"])
    flat = column.flatten()
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, config.frames * config.mels))


def write_tensors(patches: DataFrame, folder: str, config: AudioConfig = AudioConfig()) -> DataFrame:
    """Write the patches as Parquet files with a fixed_shape_tensor column; returns (file, rows), one row per task with patches.

    Nulls, repeated rows and extra columns are stored as they come; an empty table gives no rows and no file.
    ``folder`` is one that all executors share. A file gets its name only when it is
    complete, so a task that is repeated leaves nothing half written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        at = TaskContext.get()
        name, temporary = f"{root}/part-{at.partitionId():06d}.parquet", f"{root}/.part-{at.partitionId():06d}-{at.taskAttemptId()}"
        writer, n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.schema.get_field_index("tensor")
            table = pa.Table.from_batches([batch]).set_column(k, "tensor", as_tensors(batch.column(k), config))
            writer = writer or pq.ParquetWriter(temporary, table.schema, filesystem=system)
            writer.write_table(table)
            n += batch.num_rows
        if writer:
            writer.close()
            system.move(temporary, name)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n])], ["file", "rows"])

    return patches.mapInArrow(run, "file string, rows long")
