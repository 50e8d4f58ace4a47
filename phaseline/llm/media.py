"""Audio columns: 8-bit PCM media, log-mel tensors and speech-like segments.

``media_table`` stores any bytes as the samples of a WAV file (mono, 8 bits,
16 kHz), losslessly, and keeps what was computed from the *stored* file: samples
resampled by a polyphase filter, overlapped log-mel frames in fixed-shape Arrow
tensors with their time spans, and segments of high energy with hysteresis (one
level to begin, a lower one to go on).  A tensor column is an Arrow stream of
its own whose first field has the ``arrow.fixed_shape_tensor`` type, so readers
get shaped arrays without knowing this module.

Every row is computed by itself, frames in slices, so a row's values depend on
its bytes only and long rows need memory for one slice of frames.

Defined cases: a null or empty text is one unit of 64 zero bytes;
a very long text is worked on in slices of frames; null keys and repeated rows
keep their rows, and equal texts get equal values; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNIT, RATE, UP, DOWN = 64, 16_000, 1, 2
FRAME, HOP, FFT, MELS = 200, 80, 256, 32
#: Frames of a tensor, and frames that are computed at a time.
TENSOR, SLICE = 16, 8192
#: Shares of the way from the quiet to the loud level that begin and end a segment.
BEGIN, GO_ON = 0.6, 0.4


# --------------------------------------------------------------------------
# media


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of the unit."""
    return data + bytes(UNIT - len(data) % UNIT if len(data) % UNIT or not data else 0)


def write_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A RIFF file of one channel of unsigned 8-bit samples."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def read_wav(media: bytes) -> tuple[int, bytes]:
    """(rate, samples) of such a file; other chunks are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not mono 8-bit PCM")
        elif kind == b"data":
            return rate, media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


# --------------------------------------------------------------------------
# features


@lru_cache
def low_pass(up: int, down: int, half: int = 8) -> np.ndarray:
    """Windowed-sinc filter for a rate of ``up / down``, ``half`` zero crossings a side."""
    wide = max(up, down)
    n = np.arange(-half * wide, half * wide + 1)
    h = np.sinc(n / wide) * np.hanning(len(n) + 2)[1:-1]
    return (h * up / h.sum()).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """``x`` at ``up / down`` times its rate by the branches of a polyphase filter.

    Output k is the filter at offset ``k * down`` of the signal with ``up - 1``
    zeros after each sample; each branch convolves only the samples it meets.
    """
    h = low_pass(up, down)
    mid, n_out = len(h) // 2, -(-len(x) * up // down)
    y = np.zeros(n_out, np.float32)
    for phase in range(up):  # outputs k = phase, phase + up, ...
        count = len(y[phase::up])
        first = phase * down + mid  # filter tap over zero-stuffed sample 0 for the first of them
        acc = np.zeros(count, np.float32)
        for r in range(down):  # input samples i = r, r + down, ...
            part = x[r::down]
            # output j of this branch and sample i = r + down * m meet at tap first + down * up * (j - m) - up * r
            taps = np.arange((first - up * r) % (down * up), len(h), down * up)
            if not len(part) or not len(taps) or not count:
                continue
            lag = (taps[0] - (first - up * r)) // (down * up)  # j - m of the first tap
            full = np.convolve(part, h[taps])
            lo, hi = max(0, lag), min(count, lag + len(full))
            if hi > lo:
                acc[lo:hi] += full[lo - lag : hi - lag]
        y[phase::up] = acc
    return y


@lru_cache
def mel_filters(rate: int) -> np.ndarray:
    """(bins, mels) triangular filters evenly spaced in mel."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, to_mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FFT, 1 / rate)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """((frames, mels) log10 power to 0.01, energy of each frame in dB)."""
    n = max(1, 1 + -(-(len(y) - FRAME) // HOP))
    padded = np.zeros((n - 1) * HOP + FRAME, np.float32)
    padded[: len(y)] = y[: len(padded)]
    frames = np.lib.stride_tricks.sliding_window_view(padded, FRAME)[::HOP]
    window, mel = np.hanning(FRAME).astype(np.float32), mel_filters(rate)
    out, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for a in range(0, n, SLICE):
        part = frames[a : a + SLICE] * window
        spectrum = np.fft.rfft(part, FFT, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[a : a + SLICE] = np.log10(np.maximum(power @ mel, 1e-8))
        energy[a : a + SLICE] = 10 * np.log10(np.maximum((part * part).mean(axis=1), 1e-10))
    return np.round(out, 2) + np.float32(0), np.round(energy, 2)


def segments(energy: np.ndarray) -> np.ndarray:
    """(n, 2) first and last-but-one frames of stretches of high energy."""
    quiet, loud = np.quantile(energy, [0.1, 0.95])
    begin, go_on = quiet + BEGIN * (loud - quiet), quiet + GO_ON * (loud - quiet)
    if loud - quiet < 1.0:  # no contrast: all or nothing
        return np.array([[0, len(energy)]]) if loud > -60 else np.zeros((0, 2), int)
    told = np.where(energy >= begin, 1, np.where(energy < go_on, 0, -1))
    last = np.maximum.accumulate(np.where(told >= 0, np.arange(len(told)), -1))
    on = np.where(last >= 0, told[last], 0)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on, [0]])))
    return edge.reshape(-1, 2)


def tensor_stream(mel: np.ndarray, rate: int) -> bytes:
    """An Arrow stream of (tensor fixed_shape_tensor<float>[16, 32], start_ms, end_ms)."""
    n = -(-len(mel) // TENSOR)
    full = np.zeros((n * TENSOR, MELS), np.float32)
    full[: len(mel)] = mel
    tensors = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, TENSOR, MELS))
    begin = np.arange(n, dtype=np.int64) * TENSOR
    ends = np.minimum(begin + TENSOR, len(mel)) - 1
    batch = pa.RecordBatch.from_arrays([tensors, pa.array(begin * HOP * 1000 // rate), pa.array((ends * HOP + FRAME) * 1000 // rate)], ["tensor", "start_ms", "end_ms"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """((n, 16, 32) tensors, (n, 2) spans in ms) of such a stream."""
    t = pa.ipc.open_stream(data).read_all().combine_chunks()
    return t.column("tensor").chunk(0).to_numpy_ndarray(), np.stack([t.column(c).to_numpy() for c in ("start_ms", "end_ms")], axis=1)


def features(media: bytes) -> tuple[int, bytes, np.ndarray]:
    """(frames, tensor stream, (n, 2) segments in ms) of a stored file."""
    rate, samples = read_wav(media)
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    y, rate = resample(x), rate * UP // DOWN
    mel, energy = log_mel(y, rate)
    return len(mel), tensor_stream(mel, rate), segments(energy) * (HOP * 1000) // rate


# --------------------------------------------------------------------------
# operators


def media_table(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media, frames, tensors, segments) for every row of ``df``."""
    spans = pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "n_bytes", "media", "frames", "tensors", "segments"]
        for b in batches:
            for a in range(0, len(b), 256):
                part = b.slice(a, 256)
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                media = [write_wav(pad(x)) for x in texts]
                made = [features(m) for m in media]
                rows = [[{"start_ms": int(s), "end_ms": int(e)} for s, e in m[2]] for m in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array(media, pa.binary()), pa.array([m[0] for m in made], pa.int64()), pa.array([m[1] for m in made], pa.binary()), pa.array(rows, spans)], names)

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("x"))
    out = src.mapInArrow(run, "key long, n_bytes long, media binary, frames long, tensors binary, segments array<struct<start_ms:bigint,end_ms:bigint>>")
    return out.withColumnRenamed("key", key)


def digest(table: DataFrame, key: str = "doc_id") -> DataFrame:
    """What was stored, read back from the columns of ``media_table``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for b in batches:
            rows = []
            for media, frames, tensors, spans in zip(*(b.column(i) for i in range(2, 6))):
                media = media.as_py()
                payload = read_wav(media)[1]
                values, _ = read_tensors(tensors.as_py())
                mel = values.reshape(-1, MELS)[: frames.as_py()]
                told = f"frames={len(mel)};segments={len(spans)};speech_ms={sum(s['end_ms'] - s['start_ms'] for s in spans.as_py())};mean={mel.mean(dtype=np.float64):.3f};tensors={hashlib.sha256(values.tobytes()).hexdigest()[:32]}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), told))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return table.select(key, "n_bytes", "media", "frames", "tensors", "segments").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
