"""Audio features of byte payloads stored as 8-bit PCM.

``encode`` pads a payload with spaces to a positive multiple of FRAME bytes
and stores it as a mono WAV file of unsigned 8-bit samples; ``decode`` reads the
samples back. From the samples: polyphase resampling by UP / DOWN with a
windowed-sinc filter, overlapped frames of WINDOW samples every HOP, log-mel
energies by a triangular filterbank, and segments by hysteresis on frame energy
(a segment begins at or above the high threshold and ends below the low one).
``features`` returns the log-mel frames as fixed-shape Arrow tensors with the
time span of each, and the segments. Samples are resampled and transformed in
runs of RUN frames; a payload's log-mel frames are held together, which takes
about as much memory as the payload itself.

Defined cases: null and empty texts are one frame of spaces; equal texts give
equal bytes and features; repeated rows are kept; other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import ship

FRAME, TAIL, PAD = 192, 16, b" "
RATE, UP, DOWN, TAPS = 8000, 3, 4, 8
WINDOW, HOP, MELS, RUN = 256, 128, 32, 2048
#: Frames of a tensor.
SPAN = 16
HIGH_DB, LOW_DB = 3.0, -3.0


def encode(payload: bytes) -> bytes:
    short = -len(payload) % FRAME if payload else FRAME
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload + PAD * short)
    return out.getvalue()


def decode(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


@cache
def _filter() -> np.ndarray:
    """phases x taps: a Hann-windowed sinc at the lower of both rates, one row for each output phase."""
    half = TAPS * UP // 2
    t = np.arange(-half, half)
    h = np.sinc(t / max(UP, DOWN)) * np.hanning(2 * half + 1)[: 2 * half]
    h *= UP / h.sum()
    return np.stack([h[p::UP] for p in range(UP)]).astype(np.float32)


def resample(x: np.ndarray, first: int, last: int) -> np.ndarray:
    """Output samples first to last - 1 of the signal x (unsigned bytes) at UP / DOWN of its rate; zero beyond its ends."""
    lo = first * DOWN // UP - TAPS // 2 + 1
    hi = (last - 1) * DOWN // UP + TAPS // 2 + 1
    part = np.zeros(hi - lo, np.float32)
    a, b = max(lo, 0), min(hi, len(x))
    if b > a:
        part[a - lo : b - lo] = (x[a:b].astype(np.float32) - 128) / 128
    view = np.lib.stride_tricks.sliding_window_view(part, TAPS)
    out = np.empty(last - first, np.float32)
    for p in range(UP):  # outputs of one phase of the filter lie DOWN inputs apart
        n0 = first + (p - first) % UP
        if n0 < last:
            start = n0 * DOWN // UP - TAPS // 2 + 1 - lo
            out[n0 - first :: UP] = view[start::DOWN][: -(-(last - n0) // UP)] @ _filter()[n0 * DOWN % UP][::-1]
    return out


@cache
def _mel_bank() -> np.ndarray:
    """rfft bins x MELS, triangles evenly spaced on the mel scale."""
    rate = RATE * UP / DOWN
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    hz = np.fft.rfftfreq(WINDOW, 1 / rate)
    up = (hz[:, None] - edge[None, :-2]) / (edge[1:-1] - edge[:-2])
    down = (edge[None, 2:] - hz[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(x: np.ndarray) -> Iterator[np.ndarray]:
    """Log-mel frames (dB) in runs of at most RUN."""
    total = len(x) * UP // DOWN
    frames = max(1, -(-(total - WINDOW) // HOP) + 1)
    window = np.hanning(WINDOW).astype(np.float32)
    for at in range(0, frames, RUN):
        k = min(RUN, frames - at)
        y = resample(x, at * HOP, (at + k - 1) * HOP + WINDOW)
        framed = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP] * window
        power = np.abs(np.fft.rfft(framed, axis=1)).astype(np.float32) ** 2
        yield 10 * np.log10(power @ _mel_bank() + 1e-6)


def segments(energy: np.ndarray) -> np.ndarray:
    """(begin, end) frames of the segments, by hysteresis around the mean energy."""
    level = energy - energy.mean()
    mark = np.where(level >= HIGH_DB, 1, np.where(level < LOW_DB, -1, 0))
    at = np.flatnonzero(mark)
    state = np.zeros(len(mark), np.int8)
    if len(at):
        state[at[0] :] = np.repeat(mark[at], np.diff(np.append(at, len(mark))))
    on = np.concatenate([[0], (state == 1).astype(np.int8), [0]])
    step = np.diff(on)
    return np.stack([np.flatnonzero(step == 1), np.flatnonzero(step == -1)], 1)


def analyse(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS, segments) of 8-bit samples."""
    mel = np.concatenate(list(log_mel(np.frombuffer(samples, np.uint8))))
    return mel, segments(mel.mean(axis=1))


def tensors(mel: np.ndarray, segs: np.ndarray) -> bytes:
    """An Arrow stream with one row for each SPAN frames: the tensor, its time span in ms and its frames that lie in segments."""
    n = -(-len(mel) // SPAN)
    full = np.zeros((n * SPAN, MELS), np.float32)
    full[: len(mel)] = mel
    inside = np.zeros(n * SPAN + 1, np.int32)
    np.add.at(inside, segs[:, 0], 1)
    np.add.at(inside, segs[:, 1], -1)
    active = np.cumsum(inside)[:-1].reshape(n, SPAN).sum(axis=1)
    ms = 1000 * HOP * DOWN / (RATE * UP)
    begin = np.arange(n) * SPAN * ms
    end = np.minimum((np.arange(n) + 1) * SPAN, len(mel)) * ms
    kind = pa.fixed_shape_tensor(pa.float32(), [SPAN, MELS])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(full.reshape(-1)), SPAN * MELS)
    batch = pa.RecordBatch.from_arrays([pa.ExtensionArray.from_storage(kind, flat), pa.array(begin), pa.array(end), pa.array(active.astype(np.int32))], names=["log_mel", "begin_ms", "end_ms", "active_frames"])
    out = io.BytesIO()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def _stored(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            raw = [b or b"" for b in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(b) for b in raw], pa.int64()), pa.array([encode(b) for b in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_media(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a WAV file) of each row of docs."""
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_stored, "doc_id long, n_bytes long, media binary")


def _features(with_tensors: bool):
    def run(batches):
        for batch in batches:
            ids, sizes, media = batch.column(0), batch.column(1), batch.column(2)
            out: list[tuple] = []
            for m in media:
                stored = m.as_buffer().to_pybytes()
                samples = decode(stored)
                mel, segs = analyse(samples)
                mean = " ".join(f"{v:.1f}" for v in mel.mean(axis=0))
                spans = hashlib.sha256(segs.astype("<i8").tobytes()).hexdigest()[:16]
                feature = f"frames={len(mel)} segments={len(segs)} active={int((segs[:, 1] - segs[:, 0]).sum())} spans={spans} mel={mean}"
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-TAIL:]), len(stored), hashlib.sha256(stored).hexdigest(), feature, tensors(mel, segs) if with_tensors else None))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
            columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)]
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tensors"]
            keep = len(names) if with_tensors else -1
            yield pa.RecordBatch.from_arrays([ids, sizes, *columns[:keep]], names=["doc_id", "n_bytes", *names[:keep]])

    return run


def features(spark: SparkSession, stored: DataFrame, with_tensors: bool = True) -> DataFrame:
    """Digests, a feature string and (if asked for) the tensors of each stored medium."""
    ship(spark)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored.mapInArrow(_features(with_tensors), schema + (", tensors binary" if with_tensors else ""))
