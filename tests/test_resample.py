"""Rate conversion: frequencies stay, cuts leave no seam, and recordings of other rates are measured."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookout.functions import resample as rs
from lookout.functions import signal as sg
from lookout.sources import files

RATE = 16_000


def tone(hz, seconds, rate, amplitude=0.5):
    return amplitude * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


@pytest.mark.parametrize("source", [8_000, 11_025, 22_050, 44_100, 48_000, 15_999])
def test_a_tone_keeps_its_course(source):
    """Away from the ends, the converted tone is the tone sampled at the new rate."""
    hz = 440.0
    n = int(1.5 * RATE)
    got = rs.converted(tone(hz, 1.5, source), 0, source, RATE, 0, n)
    want = tone(hz, 1.5, RATE)
    edge = 800
    assert np.abs(got - want[: len(got)])[edge:-edge].max() < 2e-4


def test_what_the_new_rate_cannot_hold_is_taken_out():
    high = rs.converted(tone(15_000, 1, 48_000), 0, 48_000, RATE, 0, RATE)
    assert np.abs(high[1000:-1000]).max() < 1e-3


@pytest.mark.parametrize("source", [8_000, 44_100, 48_000])
def test_parts_fit_together(source):
    """Any cut of the outputs, each part from no more than the samples it needs, gives the same outputs to the last bit of PCM16."""
    y = np.random.default_rng(1).uniform(-0.9, 0.9, source)
    count = int(np.ceil(len(y) * RATE / source))
    whole = rs.converted(y, 0, source, RATE, 0, count)
    reach = rs.reach_of(source, RATE)
    for cut in (1, 777, 5_000):
        parts = []
        for start in range(0, count, cut if cut > 1 else count - 1):
            n = min(cut if cut > 1 else count - 1, count - start)
            low = max(0, start * source // RATE - reach)
            high = min(len(y), (start + n - 1) * source // RATE + reach + 1)
            parts.append(rs.converted(y[low:high], low, source, RATE, start, n))
        assert np.abs(np.concatenate(parts) - whole).max() < 1e-12


def test_upsampling_keeps_the_samples():
    y = np.random.default_rng(2).uniform(-1, 1, 500)
    got = rs.converted(y, 0, 8_000, RATE, 0, 1000)
    assert np.abs(got[::2] - y).max() < 1e-12


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("rates")
    for rate in (8_000, 16_000, 44_100, 48_000):
        (root / f"r{rate}.wav").write_bytes(files.wav_content(tone(220, 11, rate), rate))
    both = np.stack([tone(220, 11, 44_100), tone(220, 11, 44_100)], axis=1)
    (root / "stereo.wav").write_bytes(files.wav_content(both, 44_100))
    (root / "odd.wav").write_bytes(files.wav_content(tone(20, 6, 500), 500))
    return str(root)


def named():
    return F.regexp_extract("path", r"([^/]+)\.wav$", 1).alias("name")


def test_recordings_of_other_rates_are_measured(spark, folder):
    out, rejects = sg.signal_features(files.read_recordings(spark, folder), resample=True)
    got = {(r["name"], r["chunk_id"]): r for r in out.select("*", named()).collect()}
    assert set(got) == {(n, c) for n in ("r8000", "r16000", "r44100", "r48000", "stereo") for c in (0, 1)}
    for (_, c), r in got.items():
        alike = got["r16000", c]
        assert r["pitch_mean"] == pytest.approx(220, rel=0.02)
        assert r["energy_mean"] == pytest.approx(alike["energy_mean"], rel=2e-3)
        assert r["zcr_mean"] == pytest.approx(alike["zcr_mean"], rel=0.02)
    assert [tuple(r) for r in rejects.select(named(), "error").collect()] == [("odd", "other sample rate")]
    _, strict = sg.signal_features(files.read_recordings(spark, folder))
    assert strict.count() == 5


def test_long_and_whole_recordings_of_other_rates(spark, folder):
    """Blocks of a whole recording, and parts of a recording that is dealt out, are converted alike."""
    recordings = files.read_recordings(spark, folder)
    out, _ = sg.file_features(recordings, block=50, resample=True)
    for r in out.select("*", named()).collect():
        assert r["pitch_mean"] == pytest.approx(220, rel=0.02) and r["pause_ratio"] == 0
    here = files.recording_parts(recordings, resample=True).select(named(), "chunk_id", F.md5("pcm").alias("pcm"))
    dealt = files.recording_parts(recordings, long_bytes=1, resample=True).select(named(), "chunk_id", F.md5("pcm").alias("pcm"))
    assert here.count() == 11 and here.exceptAll(dealt).count() == 0


def test_beginning_and_tail(spark, folder):
    recordings = files.read_recordings(spark, folder).filter("path LIKE '%r44100%'")
    tail = files.recording_parts(recordings, keep_tail=True, resample=True).selectExpr("chunk_id", "length(pcm) / 2 AS n").collect()
    assert sorted((r["chunk_id"], r["n"]) for r in tail) == [(0, 80_000), (1, 80_000), (2, 16_000)]
    begun = files.recording_parts(recordings, max_seconds=5.0, resample=True)
    assert begun.count() == 1
