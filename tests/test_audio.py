from __future__ import annotations

import io
import wave

import numpy as np
import pytest

from fieldsonar import settings as S
from fieldsonar.operators import audio

RATE = 48_000


def wav(x: np.ndarray, width: int = 2, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(x.shape[1])
        f.setsampwidth(width)
        f.setframerate(rate)
        v = np.clip(x, -1, 1)
        if width == 1:
            f.writeframes((v * 127 + 128).astype(np.uint8).tobytes())
        elif width == 3:
            f.writeframes((v * (2**23 - 1)).astype("<i4").reshape(-1, 1).view(np.uint8)[:, :3].tobytes())
        else:
            f.writeframes((v * (2 ** (8 * width - 1) - 1)).astype(f"<i{width}").tobytes())
    return out.getvalue()


def call(lag: int, n: int = 3 * RATE, at: int = 60_000) -> np.ndarray:
    """A burst that has every frequency, late by a lag in the left channel, in silence: whitening raises whatever is in a
    bin, and noise at the edges of the cut would be the same in both channels."""
    s = np.random.default_rng(abs(lag)).normal(0, 0.2, int(0.4 * RATE)) * np.hanning(int(0.4 * RATE))
    x = np.zeros((n, 2))
    x[at : at + len(s), 1] += s
    x[at + lag : at + lag + len(s), 0] += s
    return x


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_decode(width):
    x = np.random.default_rng(0).uniform(-0.9, 0.9, (500, 2))
    got, rate = audio.decode_wav(wav(x, width))
    assert rate == RATE and np.abs(got - x).max() < {1: 2e-2, 2: 1e-4, 3: 1e-6, 4: 1e-6}[width]
    assert audio.decode_wav(wav(x[:, :1])) is None and audio.decode_wav(b"no wave") is None


def test_band_pass():
    sections = audio.band_pass(RATE)
    assert sections.shape == (4, 6)
    z = np.exp(-2j * np.pi * np.array([500.0, 1000.0, 2000.0, 50.0, 8000.0]) / RATE)
    gain = np.abs(np.prod([np.polyval(r[2::-1], z) / np.polyval(r[:2:-1], z) for r in sections], axis=0))
    assert gain[:3] == pytest.approx([2**-0.5, 1, 2**-0.5], abs=1e-3) and gain[3] < 1e-4 and gain[4] < 1e-2


def test_filter_in_blocks_is_the_recursion():
    sections = audio.band_pass(RATE)
    x = np.random.default_rng(1).normal(size=1000)
    y = x.copy()
    for b0, b1, b2, _, a1, a2 in sections:
        u = v = 0.0
        for i, w in enumerate(y.copy()):
            y[i] = b0 * w + u
            u, v = v + b1 * w - a1 * y[i], b2 * w - a2 * y[i]
    filtered = audio.Recursive(sections)
    assert np.abs(filtered.run(x) - y).max() < 1e-9
    both = filtered.both_ways(x)
    assert len(both) == 1000 and filtered.both_ways(x[:27]) is None
    assert np.abs(filtered.both_ways(np.full(500, 3.0))).max() < 1e-9  # a constant has no start
    # zero phase: a pulse in the middle stays there, symmetric
    pulse = np.zeros(4001)
    pulse[2000] = 1
    out = filtered.both_ways(pulse)
    assert np.argmax(np.abs(out)) == 2000 and np.abs(out - out[::-1]).max() < 1e-6


@pytest.mark.parametrize("lag", [-20, -7, 0, 1, 13, 20])
def test_delay(lag):
    kernel = audio.Recursive(audio.band_pass(RATE))
    peak, a, b, tau = audio.window_delay(call(lag), RATE, 0.0, 3.0, kernel)
    assert tau * RATE == pytest.approx(lag, abs=0.2)
    assert peak == pytest.approx(60_000 / RATE + 0.2, abs=0.1) and b - a == pytest.approx(0.5, abs=1e-3)
    assert audio.window_delay(call(lag), RATE, 2.9999, 3.0, kernel) is None


def test_limits():
    x = call(20)
    cut = audio.gcc_phat(x[55_000:90_000, 0], x[55_000:90_000, 1], RATE, 10 / RATE)
    assert abs(cut) <= 10 / RATE
    assert audio.gcc_phat(x[55_000:90_000, 0], x[55_000:90_000, 1], RATE, S.MIC_SPACING_M / S.SPEED_OF_SOUND_M_S, centred=True) * RATE == pytest.approx(20, abs=0.2)


def test_pass_over_recordings(spark):
    rows = [("Recorder 1", "a.wav", wav(call(5), 4)), ("Recorder 1", "mono.wav", wav(call(5)[:, :1])), ("Recorder 2", "bad.wav", b"x"), ("Recorder 2", "null.wav", None)]
    rec = spark.createDataFrame(rows, "recorder_folder string, wav_file string, content binary")

    def detector(channel, rate, allowed, confidence, overlap):
        loud = float(np.abs(channel).max()) > 0.1
        return [(0.0, 3.0, "bird", 0.9), (0.0, 3.0, "other", 0.9), (2.9999, 3.0, "bird", 0.3), (0.0, 3.0, "bird", 0.1)] if loud else []

    found = audio.detect(rec, detector, frozenset({"bird"}))
    assert {(r.channel, r.label, r.confidence) for r in found.collect()} == {("left", "bird", 0.9), ("right", "bird", 0.9), ("left", "bird", 0.3), ("right", "bird", 0.3)}
    windows = audio.agreed(found, ["recorder_folder", "wav_file"])
    got = sorted(audio.delays(rec, windows).collect(), key=lambda r: r.birdnet_start_s)
    assert [r.too_short for r in got] == [False, True] and got[0].detected_by == "left,right"
    assert got[0].lag_samples == pytest.approx(5, abs=0.2) and (got[0].bearing_1_deg + got[0].bearing_2_deg) % 360 == pytest.approx(180)
    assert audio.delays(rec, windows.limit(0)).collect() == []


def test_recordings_are_never_broadcast(spark):
    """The planner takes binary columns of unknown length for small: neither side of delays() goes through the driver."""
    rec = spark.range(40).selectExpr("CAST(id AS STRING) AS wav_file", "id").mapInArrow(lambda batches: batches, "wav_file string, id long").selectExpr("wav_file", "CAST(wav_file AS BINARY) AS content")
    windows = spark.range(40).selectExpr("CAST(id AS STRING) AS wav_file", "0D AS start_s", "3D AS end_s", "'left,right' AS detected_by")
    got = audio.delays(rec, windows, ("wav_file",))
    assert got.collect() == []
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_contents_made_in_the_pass(spark):
    """Recordings that a function gives for each row are measured as those of a column are; both hold one at a time."""
    rows = [(f"{lag}.wav", wav(call(lag), 4)) for lag in (-20, 3)] + [("bad.wav", b"x"), ("null.wav", None)]
    held = dict(rows)
    rec = spark.createDataFrame(rows, "wav_file string, content binary")
    contents = lambda batch: (held[n] for n in batch.column("wav_file").to_pylist())
    detector = lambda channel, rate, allowed, confidence, overlap: [(0.0, 3.0, "bird", 0.9)]
    want = sorted(audio.calls(rec, detector, keys=("wav_file",)).collect())
    assert len(want) == 2 and sorted(audio.calls(rec.select("wav_file"), detector, keys=("wav_file",), contents=contents).collect()) == want
    windows = spark.createDataFrame([(n, 0.0, 3.0, "left,right") for n, _ in rows], "wav_file string, start_s double, end_s double, detected_by string")
    named = rec.select("wav_file").join(audio.gathered(windows, ("wav_file",)), "wav_file")
    assert sorted(audio.window_delays(named, ("wav_file",), contents=contents).collect()) == want == sorted(audio.delays(rec, windows, ("wav_file",)).collect())


def test_signals_side_by_side():
    """Two signals at once are what each is alone, at lengths about a group of blocks."""
    kernel = audio.Recursive(audio.band_pass(RATE))
    whole = kernel.block * audio.GROUP
    for n in (28, kernel.block, whole - 1, whole, whole + 1, 3 * whole + 7):
        x = np.random.default_rng(n).normal(size=(2, n))
        assert np.abs(kernel.both_ways(x) - np.stack([kernel.both_ways(x[0]), kernel.both_ways(x[1])])).max() < 1e-12
