import hashlib
import zlib

import numpy as np
import pytest

from leafmill.llm import audio
from leafmill.llm.queries import op5_media_columns
from tests.conftest import SMALL
from tests.llm.cases import HARD, empty, hard


def test_documents_come_back(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = op5_media_columns(spark, SMALL).collect()
    assert len(got) == 200
    features = {}
    for r in got:
        data = texts[r["doc_id"]]
        payload = data + b"\xff" * (-len(data) % 576 if data else 576)
        stored = audio.wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest()) and audio.samples(stored)[0] == payload
        assert features.setdefault(data, r["feature"]) == r["feature"]
    assert len(set(features.values())) > len(features) * 0.9


@pytest.mark.parametrize("up, down", [(1, 2), (3, 2), (2, 3), (1, 1)])
def test_polyphase_is_filtering_at_the_high_rate(up, down):
    x = np.random.default_rng(1).normal(size=101).astype(np.float32)
    h = audio.lowpass(up, down)
    taps = h.shape[1]
    high = np.zeros(len(x) * up)
    high[::up] = x
    full = np.convolve(high, h.T.ravel().astype(float))  # the whole filter, phase by phase
    got = audio.resampled(x, up, down)
    delay = (taps - taps // 2 - 1) * up
    for k in range(len(got)):
        n = k * down + delay
        if n < len(full):
            assert got[k] == pytest.approx(full[n], abs=1e-4)


def test_long_inputs_are_resampled_in_blocks(monkeypatch):
    x = np.random.default_rng(2).normal(size=5000)
    whole = audio.resampled(x, 3, 2)
    monkeypatch.setattr(audio, "BLOCK", 64)
    assert np.array_equal(audio.resampled(x, 3, 2), whole)


def test_log_mel():
    rate, t = 8000, np.arange(4000)
    frames = audio.log_mel(np.sin(2 * np.pi * 1000 * t / rate).astype(np.float32), rate)
    assert frames.shape == (31, audio.BANDS)
    bank = audio.mel(audio.BANDS, audio.FRAME, rate)
    assert frames[5].argmax() in bank[round(1000 * audio.FRAME / rate)].nonzero()[0] and (bank.sum(0) > 0).all()
    one = np.abs(np.fft.rfft(np.sin(2 * np.pi * 1000 * t[:256] / rate) * np.hanning(256))) ** 2
    assert frames[0] == pytest.approx(np.log(one @ bank + 1e-6), abs=1e-3)
    assert audio.log_mel(np.zeros(0, np.float32), rate).shape == (1, audio.BANDS)


def slow_segments(e):
    level, out, start = e - np.median(e), [], None
    for i, v in enumerate(level):
        if start is None and v >= audio.ON:
            start = i
        elif start is not None and v < audio.OFF:
            out.append((start, i))
            start = None
    if start is not None:
        out.append((start, len(e)))
    return [(a, b) for a, b in out if b - a >= audio.LEAST]


def test_hysteresis():
    rng = np.random.default_rng(3)
    for _ in range(200):
        e = np.round(rng.normal(0, 0.2, rng.integers(1, 60)), 2)
        assert audio.segments(e) == slow_segments(e)


def test_tensors_and_hard_cases(spark):
    got = audio.tensors(hard(spark)).toArrow()
    shaped = audio.as_tensor(got.column("tensor"))
    assert shaped.to_numpy_ndarray().shape == (got.num_rows, audio.FRAMES, audio.BANDS)
    assert {r["doc_id"] for r in got.to_pylist()} == {i for i, *_ in HARD}
    for r in got.to_pylist():
        assert r["end_s"] > r["start_s"] and all(r["start_s"] <= a["start_s"] < a["end_s"] <= r["end_s"] for a in r["active"])
    rows = audio.media(hard(spark)).collect()
    assert len(rows) == len(HARD) and [r["n_bytes"] for r in rows if r["doc_id"] == 2] == [0]
    assert len({r["feature"] for r in rows if r["doc_id"] in (2, 3)}) == 1
    assert audio.media(empty(spark)).count() == audio.tensors(empty(spark)).count() == 0
