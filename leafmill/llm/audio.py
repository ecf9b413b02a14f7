"""Media columns: bytes kept losslessly as 8-bit mono audio, and audio features as tensors of fixed shape.

A payload becomes the samples of a WAV file (unsigned 8-bit PCM). Features come from the samples that are read back:
polyphase resampling by a ratio of small integers, overlapped frames under a Hann window, log energies of mel
filters, and segments of activity by two energy thresholds (on at the upper, off at the lower).
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
from pyspark.sql import DataFrame

from leafmill.llm.common import parts

RATE, UP, DOWN = 16_000, 5, 8
FRAME, HOP, BANDS, FRAMES = 256, 128, 24, 64
#: Seconds from frame to frame.
STEP = HOP * DOWN / UP / RATE
#: Above and below the median log energy; frames that an active stretch has at least.
ON, OFF, LEAST = 0.25, 0.05, 2
UNIT = 576
#: Samples that are resampled at a time, so that a long text takes little more memory than its samples.
BLOCK = 1 << 16


def padded(data: bytes, unit: int = UNIT) -> bytes:
    """The data with bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * ((unit - len(data) % unit) if len(data) % unit or not data else 0)


def wav(payload: bytes, rate: int = RATE) -> bytes:
    with wave.open(out := io.BytesIO(), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def samples(media: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono is what is read here")
        return w.readframes(w.getnframes()), w.getframerate()


@cache
def lowpass(up: int, down: int, taps: int = 16) -> np.ndarray:
    """Phases of a windowed-sinc filter: row p is what output samples of phase p take from `taps` input samples."""
    n, wide = taps * up, max(up, down)
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / wide) * np.hanning(n + 2)[1:-1]
    return (h / h.sum() * up).reshape(taps, up).T.astype(np.float32).copy()


def resampled(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling: of each output sample only its own phase of the filter is computed."""
    h = lowpass(up, down)
    taps = h.shape[1]
    n = -(-len(x) * up // down)
    x = np.concatenate([np.zeros(taps // 2, np.float32), x.astype(np.float32), np.zeros(taps, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(x, taps)
    out = np.empty(n, np.float32)
    for k in range(min(up, n)):  # outputs k, k + up, ... share a phase, and their inputs lie `down` apart
        for first in range(k, n, BLOCK * up):
            last = min(n, first + BLOCK * up)
            at = np.arange(first, last, up) * down // up
            out[first:last:up] = view[at] @ h[(k * down) % up, ::-1]
    return out


@cache
def mel(bands: int, frame: int, rate: float) -> np.ndarray:
    """Triangular filters, evenly spaced in mel, over the bins of a real FFT."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, bands + 2) / 2595) - 1) * frame / rate
    bins = np.arange(frame // 2 + 1)[:, None]
    low, mid, high = edges[:-2], np.maximum(edges[1:-1], edges[:-2] + 1e-3), np.maximum(edges[2:], edges[1:-1] + 1e-3)
    out = np.clip(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0, None)
    for band in np.flatnonzero(out.sum(0) == 0):  # narrower than a bin
        out[round(float(edges[band + 1])), band] = 1
    return out.astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> np.ndarray:
    """Frames x bands; the last frame is filled with silence."""
    frames = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    x = np.concatenate([x, np.zeros((frames - 1) * HOP + FRAME - len(x), np.float32)])
    cut = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = np.empty((frames, BANDS), np.float32)
    for i in range(0, frames, 2048):  # so that a long text stays within some MB
        power = np.abs(np.fft.rfft(cut[i : i + 2048] * np.hanning(FRAME).astype(np.float32), axis=1)) ** 2
        out[i : i + 2048] = np.log(power.astype(np.float32) @ mel(BANDS, FRAME, rate) + 1e-6)
    return out


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Stretches of frames that begin at ON and go on until below OFF, relative to the median."""
    level = energy - np.median(energy)
    out, start = [], None
    # Only frames that cross a threshold matter.
    state = np.where(level >= ON, 1, np.where(level < OFF, -1, 0))
    marks = np.flatnonzero(state)
    for i, s in zip(marks.tolist(), state[marks].tolist()):
        if s > 0 and start is None:
            start = i
        elif s < 0 and start is not None:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(energy)))
    return [(a, b) for a, b in out if b - a >= LEAST]


def features(media: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Log-mel frames and active stretches of a WAV file."""
    data, rate = samples(media)
    x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    frames = log_mel(resampled(x), rate * UP / DOWN)
    return frames, segments(frames.mean(1))


def blocks(media: bytes) -> tuple[int, np.ndarray, list[list[tuple[float, float]]]]:
    """Number of frames, tensors of FRAMES x BANDS, the last filled with the lowest value, and the active spans in each, in seconds."""
    frames, spans = features(media)
    fill = np.full((-len(frames) % FRAMES, BANDS), frames.min(), np.float32)
    tensors = np.concatenate([frames, fill]).reshape(-1, FRAMES, BANDS)
    inside: list[list[tuple[float, float]]] = [[] for _ in tensors]
    for s, e in spans:
        for k in range(s // FRAMES, -(-e // FRAMES)):
            inside[k].append((max(k * FRAMES, s) * STEP, min((k + 1) * FRAMES, e) * STEP))
    return len(frames), tensors, inside


def digest(n: int, tensors: np.ndarray, active: list[list[tuple[float, float]]]) -> str:
    """Equal for equal samples: shape, band means in thousandths, number of active spans and milliseconds in them, and a checksum of the frames in hundredths. n: frames of the tensors that are not filling."""
    frames = tensors.reshape(-1, BANDS)[:n]
    means = np.rint(frames.mean(0, dtype=np.float64) * 1000).astype(int)
    check = zlib.crc32(np.rint(frames * 100).astype("<i4").tobytes())
    spans = [x for block in active for x in block]
    return f"{n}x{BANDS};{','.join(map(str, means))};{len(spans)}:{round(sum(b - a for a, b in spans) * 1000)};{check:08x}"


def tensors(docs: DataFrame) -> DataFrame:
    """A row for each FRAMES frames: doc_id, chunk, start_s and end_s, tensor (FRAMES * BANDS floats, row by row), active spans in seconds.

    The last tensor of a document is filled with its lowest value; a span that two tensors share is cut. A null text counts as empty, whose payload is one
    unit of padding; repeated rows come out repeated. as_tensor() gives the column Arrow's type of fixed shape.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            out: list[tuple] = []
            for i, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                n, made, active = blocks(wav(padded((text or "").encode())))
                for k, (block, inside) in enumerate(zip(made, active)):
                    out.append((i, k, k * FRAMES * STEP, min((k + 1) * FRAMES, n) * STEP, block.ravel(), [{"start_s": a, "end_s": b} for a, b in inside]))
            names = ["doc_id", "chunk", "start_s", "end_s", "tensor", "active"]
            kinds = [part.schema.field("doc_id").type, pa.int32(), pa.float64(), pa.float64(), pa.list_(pa.float32()), pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))]
            for at in range(0, len(out), 512):
                columns = list(zip(*out[at : at + 512]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, chunk int, start_s double, end_s double, tensor array<float>, active array<struct<start_s:double,end_s:double>>")


def as_tensor(column: pa.Array) -> pa.FixedShapeTensorArray:
    """The tensor column as Arrow's fixed-shape tensors of FRAMES x BANDS."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (FRAMES, BANDS)), flat.cast(pa.list_(pa.float32(), FRAMES * BANDS)))


def media(docs: DataFrame) -> DataFrame:
    """A row for each document: sizes and digests of payload and stored form, both after reading back, and the features' digest.

    The features' digest is taken from the document's tensors, as Arrow holds them, and their time spans. Nulls and
    repeats as by tensors(); only doc_id and text are read.
    """
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for part in parts(batches):
            rows = []
            for text in part.column("text").to_pylist():  # one document's tensors at a time: a long text has many
                stored = wav(padded(data := (text or "").encode()))
                back, _ = samples(stored)
                n, made, active = blocks(stored)
                held = pa.FixedShapeTensorArray.from_numpy_ndarray(made)
                rows.append((len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), digest(n, held.to_numpy_ndarray(), active)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
