from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lookout.functions import signal as sg
from lookout.operators import decide
from lookout.plans.jobs import corpus_features
from lookout.sources import files

RATE = 16_000


def tone(hz, seconds, amplitude=0.5, rate=RATE):
    t = np.arange(int(seconds * rate)) / rate
    return amplitude * np.sin(2 * np.pi * hz * t)


def speech(rng, low, high, amplitude, pause_low, pause_high, seconds):
    """Bursts of tones with pauses between, as (samples, share of silence)."""
    parts, silent = [], 0
    while sum(map(len, parts)) < seconds * RATE:
        parts.append(tone(rng.uniform(low, high), 0.4, amplitude))
        pause = np.zeros(int(rng.uniform(pause_low, pause_high) * RATE))
        parts.append(pause)
    y = np.concatenate(parts)[: seconds * RATE]
    silent = np.mean(np.convolve(np.abs(y) > 0, np.ones(64), "same") == 0)
    return y, silent


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = np.random.default_rng(11)
    root = tmp_path_factory.mktemp("corpus")
    clips = {
        "220": tone(220, 12),
        "330": tone(330, 5, 0.2),
        "silence": np.zeros(5 * RATE),
        "short": tone(200, 0.3),
        "noise": rng.normal(0, 0.1, 5 * RATE),
    }
    clips["slow"], slow = speech(rng, 95, 96, 0.08, 1.5, 3.0, 10)
    clips["varied"], _ = speech(rng, 140, 220, 0.35, 0.1, 0.4, 10)
    clips["fast"], _ = speech(rng, 200, 250, 0.5, 0.05, 0.2, 10)
    for name, y in clips.items():
        d = root / f"{name}_P"
        d.mkdir()
        (d / f"{name}_AUDIO.wav").write_bytes(files.wav_content(y))
    (root / "low_P").mkdir()
    (root / "low_P" / "low_AUDIO.wav").write_bytes(files.wav_content(tone(200, 6, rate=8000), 8000))
    (root / "cut_P").mkdir()
    (root / "cut_P" / "cut_AUDIO.wav").write_bytes(files.wav_content(tone(200, 6))[:30])
    (root / "textonly_P").mkdir()
    (root / "textonly_P" / "textonly_TRANSCRIPT.csv").write_text("speaker\tstart_time\tvalue\n")
    return str(root), slow


def subject():
    return F.regexp_extract("path", r"([^/]+)_AUDIO\.wav$", 1)


@pytest.fixture(scope="module")
def features(spark, folder):
    out, rejects = sg.signal_features(files.read_recordings(spark, folder[0]))
    return (
        {(r["s"], r["chunk_id"]): r for r in out.withColumn("s", subject()).collect()},
        {r["s"]: r["error"] for r in rejects.withColumn("s", subject()).collect()},
    )


def test_listing_and_subjects(spark, folder):
    listed = files.list_files(spark, folder[0], "*.wav")
    assert listed.count() == 10 and listed.columns == ["path", "length"]
    everything = files.list_files(spark, folder[0], "*")
    with_audio, without = files.subject_files(everything)
    assert [r["subject"] for r in without.collect()] == ["textonly"]
    assert with_audio.count() == 10


def test_chunks_and_rejects(features):
    got, rejects = features
    assert sorted(k for k in got if k[0] == "220") == [("220", 0), ("220", 1)]  # 12 s: tail dropped
    assert not [k for k in got if k[0] == "short"]
    assert rejects == {"low": "other sample rate", "cut": "no data part"}


def test_tones(features):
    got, _ = features
    for name, hz in (("220", 220), ("330", 330)):
        row = got[name, 0]
        assert row["pitch_mean"] == pytest.approx(hz, rel=0.02)
        assert row["pitch_std"] < 1
        assert row["spectral_centroid_mean"] == pytest.approx(hz, rel=0.2)
        assert row["zcr_mean"] == pytest.approx(2 * hz / RATE, rel=0.05)
        assert row["pause_ratio"] == 0
        assert row["hnr"] > 10
    assert got["220", 0]["energy_mean"] == pytest.approx(0.5 / np.sqrt(2), rel=0.01)


def test_silence_and_noise(features):
    got, _ = features
    silent = got["silence", 0]
    assert silent["pause_ratio"] == 1 and silent["pitch_mean"] == 0 and silent["energy_mean"] == 0
    assert silent["speech_rate"] == 0
    assert got["noise", 0]["hnr"] < got["220", 0]["hnr"]
    assert got["noise", 0]["spectral_centroid_mean"] > 3000


def test_speech_like(features, folder):
    got, _ = features
    energy = {n: np.mean([r["energy_mean"] for k, r in got.items() if k[0] == n]) for n in ("slow", "varied", "fast")}
    assert energy["slow"] < energy["varied"] < energy["fast"]
    pause = np.mean([r["pause_ratio"] for k, r in got.items() if k[0] == "slow"])
    assert pause == pytest.approx(folder[1], abs=0.12)
    for k, r in got.items():
        if k[0] == "slow" and r["pitch_mean"]:
            assert r["pitch_mean"] == pytest.approx(95.5, rel=0.02)


def test_long_recordings_are_dealt_out(spark, folder):
    rec = files.read_recordings(spark, folder[0])
    few, _ = files.recording_chunks(rec, long_bytes=100_000)
    all_, _ = files.recording_chunks(rec)
    a = {(r["path"], r["chunk_id"]): bytes(r["pcm"]) for r in few.collect()}
    b = {(r["path"], r["chunk_id"]): bytes(r["pcm"]) for r in all_.collect()}
    assert a == b and len(a) == 11


def test_tail_is_kept_on_request(spark, folder):
    kept, _ = files.recording_chunks(files.read_recordings(spark, folder[0]), keep_tail=True, min_seconds=0.5)
    sizes = {(r["s"], r["chunk_id"]): len(r["pcm"]) for r in kept.withColumn("s", subject()).collect()}
    assert sizes["220", 2] == 2 * RATE * 2
    assert ("short", 0) not in sizes  # 0.3 s


def test_only_the_beginning_on_request(spark, folder):
    first, _ = files.recording_chunks(files.read_recordings(spark, folder[0]), seconds=1, max_seconds=3.0)
    counts = first.groupBy("path").count().withColumn("s", subject())
    assert {r["s"]: r["count"] for r in counts.collect()}["220"] == 3


@pytest.mark.parametrize("block", [16, 160])
def test_whole_recordings(spark, folder, block):
    """Blocks of any size give what the whole recording gives at once."""
    out, rejects = sg.file_features(files.read_recordings(spark, folder[0]), block=block)
    got = {r["s"]: r for r in out.withColumn("s", subject()).collect()}
    assert {r["s"]: r["error"] for r in rejects.withColumn("s", subject()).collect()} == {
        "low": "other sample rate",
        "cut": "no data part",
        "short": "too short",
    }
    for name in ("220", "slow", "varied", "noise", "silence"):
        with open(f"{folder[0]}/{name}_P/{name}_AUDIO.wav", "rb") as f:
            f0 = sg.chunk_frames(f.read()[44:], RATE, sg.FRAME_LENGTH, sg.HOP, sg.TOP_DB)
        row, n = got[name], len(f0["frame"])
        assert row["energy_mean"] == pytest.approx(f0["energy"].mean(), abs=1e-9)
        assert row["energy_std"] == pytest.approx(f0["energy"].std(), abs=1e-6)
        assert row["pause_ratio"] == pytest.approx(1 - f0["loud"].mean())
        seconds = ((n - 1) * sg.HOP + sg.FRAME_LENGTH) / RATE
        assert row["speech_rate"] == pytest.approx(f0["onset"].sum() / seconds)
        voiced = f0["pitch"][~np.isnan(f0["pitch"])]
        assert row["pitch_mean"] == pytest.approx(voiced.mean() if len(voiced) else 0, rel=1e-6)
        assert row["spectral_centroid_mean"] == pytest.approx(f0["spectral_centroid"].mean(), rel=1e-4)


def test_head_with_another_part_first():
    wav = files.wav_content(tone(200, 1))
    extra = b"LIST" + struct.pack("<I", 5) + b"abcde\0"
    rate, channels, bits, start, size, error = files.parse_wav_head(wav[:36] + extra + wav[36:])
    assert (rate, channels, bits, error) == (RATE, 1, 16, None)
    assert (start, size) == (44 + len(extra), 2 * RATE)


def wav_of_parts(samples, before, code=1, channels=1):
    """A WAV file with other parts in front of the sound, in the plain or the extensible format."""
    plain = files.wav_content(samples)
    fmt = plain[12:36]
    if code != 1:
        body = struct.pack("<H", code) + fmt[10:] + struct.pack("<HHIH14s", 22, 16, 3, 1, b"\0" * 14)
        fmt = b"fmt " + struct.pack("<I", len(body)) + body
    data = fmt + before + plain[36:]
    return b"RIFF" + struct.pack("<I", 4 + len(data)) + b"WAVE" + data


def test_sound_behind_long_parts_two_channels_and_extensible(spark, tmp_path):
    """Parts of any length may come first; two channels are mixed; extensible PCM16 is PCM16."""
    left, right = tone(220, 5), np.zeros(5 * RATE)
    long_part = b"LIST" + struct.pack("<I", 70_000) + b"x" * 70_000
    clips = {
        "long": wav_of_parts(left, long_part),
        "longer": wav_of_parts(left, long_part * 3 + b"odd " + struct.pack("<I", 3) + b"abc\0"),
        "stereo": files.wav_content(np.column_stack([left, right])),
        "extensible": wav_of_parts(left, b"", files.EXTENSIBLE),
        "other": wav_of_parts(left, b"", 3),
    }
    for name, content in clips.items():
        (tmp_path / f"{name}_AUDIO.wav").write_bytes(content)
    out, rejects = sg.signal_features(files.read_recordings(spark, str(tmp_path)))
    got = {r["s"]: r for r in out.withColumn("s", subject()).collect()}
    assert {r["s"]: r["error"] for r in rejects.withColumn("s", subject()).collect()} == {"other": "not PCM16"}
    assert set(got) == {"long", "longer", "stereo", "extensible"}
    for name, r in got.items():
        assert r["energy_mean"] == pytest.approx(0.5 / np.sqrt(2) / (2 if name == "stereo" else 1), rel=0.01)
        assert r["pitch_mean"] == pytest.approx(220, rel=0.02)


def test_spread_of_a_loud_recording(spark, tmp_path):
    """The spread is not lost in large squares: it equals that of the frames however they are cut."""
    rng = np.random.default_rng(3)
    y = np.clip(0.9 + rng.normal(0, 1e-4, 20 * RATE), -1, 0.9999)
    (tmp_path / "loud_AUDIO.wav").write_bytes(files.wav_content(y))
    frames = sg.chunk_frames(files.wav_content(y)[44:], RATE, sg.FRAME_LENGTH, sg.HOP, sg.TOP_DB)
    out, _ = sg.file_features(files.read_recordings(spark, str(tmp_path)), block=16)
    assert out.first()["energy_std"] == pytest.approx(frames["energy"].std(), rel=1e-6)


def test_kernel_agrees_with_row_measures(spark):
    rng = np.random.default_rng(5)
    y = np.concatenate([rng.normal(0, a, 4000) for a in (0.2, 0.001, 0.3, 0.0005, 0.1)])
    pcm = files.wav_content(y)[44:]
    frames = sg.chunk_frames(pcm, RATE, 512, 256, 30.0)
    x = [(0, files.decode_pcm16(pcm).tolist())]
    cut = sg.frame_series(spark.createDataFrame(x, "c int, y array<double>"), ["c"], "y", 512, 256)
    s = F.col("samples")
    table = cut.select("c", F.col("frame").alias("pos"), sg.rms(s).alias("rms"), sg.zero_crossing_rate(s).alias("zcr"))
    rows = table.orderBy("pos").collect()
    assert np.allclose([r["rms"] for r in rows], frames["energy"], atol=1e-9)
    assert np.allclose([r["zcr"] for r in rows], frames["zcr"])
    quiet = sg.pause_ratio(table, ["c"], "rms", 30.0).first()["pause_ratio"]
    assert quiet == pytest.approx(1 - frames["loud"].mean())
    n = table.count()
    rate = sg.event_rate(table, ["c"], "pos", "rms", F.lit(1.0), sg.ONSET_WIDTH, sg.ONSET_DELTA_DB).first()["event_rate"]
    assert rate == frames["onset"].sum() and n == len(frames["onset"])


def test_fft_size():
    for n in (1, 2, 7, 64, 2248, 4097):
        size = sg.fft_size(n)
        rest = size
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        assert size >= n and rest == 1


def test_corpus_features(spark, folder):
    """Signal, text and class of every chunk; no transcript counts as no words."""
    said = spark.createDataFrame(
        [("220", 1.0, 1, "good and calm words"), ("220", 6.0, 2, "bad")],
        "subject string, start_time double, turn int, value string",
    )
    lexicon = spark.createDataFrame([("good", 0.7, 0.6), ("bad", -0.7, 0.6)], "word string, polarity double, subjectivity double")
    out, rejects = corpus_features(files.read_recordings(spark, folder[0]), subject(), said, lexicon)
    assert {r["error"] for r in rejects.collect()} == {"other sample rate", "no data part"}
    got = {(r["subject"], r["chunk_id"]): r for r in out.collect()}
    assert got["220", 0]["word_count"] == 4 and got["220", 0]["sentiment_polarity"] == pytest.approx(0.7)
    assert got["220", 1]["word_count"] == 1 and got["220", 1]["chunk_start"] == 5
    assert got["330", 0]["word_count"] == 0 and got["330", 0]["transcription"] == ""
    # Monotone, quiet, slow, dull, pausing and silent: every acoustic rule holds.
    assert got["silence", 0]["risk_label"] == 2
    score = out.select("subject", "chunk_id", decide.rule_score(decide.SPEECH_RULES).alias("s"))
    assert {r["s"] for r in score.filter("subject = 'silence'").collect()} == {2 + 2 + 1 + 1 + 1 + 1 + 1}


@pytest.mark.parametrize(("length", "hop"), [(2_048, 512), (512, 256)])
def test_peaks_of_overlapping_frames_are_those_of_each_frame(length, hop):
    """Products summed once per hop, against every frame on its own; also at silence and at a cut-off end."""
    rng = np.random.default_rng(3)
    y = rng.normal(0, 0.1, 20_000 + 77) + 0.3 * np.sin(np.arange(20_077) * 0.08)
    y[6_000:10_000] = 0
    y = y.astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(y, length)[::hop]
    lag, height = sg.autocorrelation_peak(frames, RATE, 80.0, 400.0)
    got_lag, got_height = sg.overlapping_peaks(y, length, hop, RATE, 80.0, 400.0)
    assert len(got_lag) == len(frames) and (got_lag == lag).all() and np.abs(got_height - height).max() < 1e-5
    assert (lag == 0).any() and sg.overlapping_peaks(y, length, hop + 1, RATE, 80.0, 400.0) is None


def test_one_row_per_chunk_leaves_the_task(spark):
    """Sums of a chunk against its frames; with blocks the frames around them are left out."""
    rng = np.random.default_rng(4)
    pcm = [files.wav_content(rng.normal(0, 0.1, n) + 0.2 * np.sin(np.arange(n) * 0.07))[44:] for n in (40_000, 100, 30_000)]
    rows = [(f"{i}.wav", i, 1, bytearray(p), None) for i, p in enumerate(pcm)] + [("bad.wav", None, None, None, "no WAV header")]
    chunks = spark.createDataFrame(rows, "path string, chunk_id long, channels int, pcm binary, error string")
    for block, halo in ((None, 0), (20, 3)):
        got = {r["path"]: r for r in sg.measured_chunks(chunks, RATE, sg.FRAME_LENGTH, sg.HOP, sg.TOP_DB, block, halo).collect()}
        assert set(got) == {"0.wav", "2.wav", "bad.wav"} and got["bad.wav"]["error"] == "no WAV header"
        for i in (0, 2):
            f = sg.chunk_frames(pcm[i], RATE, sg.FRAME_LENGTH, sg.HOP, sg.TOP_DB)
            mine = slice(min(halo, i * (block or 0)), None if block is None else min(halo, i * block) + block)
            row, energy, pitch = got[f"{i}.wav"], f["energy"][mine], f["pitch"][mine]
            assert (row["frames"], row["voiced"]) == (len(energy), int((~np.isnan(pitch)).sum()))
            assert row["energy"] == pytest.approx(energy.sum()) and row["energy_spread"] == pytest.approx(energy.var() * len(energy))
            assert row["pitch"] == pytest.approx(np.nansum(pitch)) and row["hnr"] == pytest.approx(f["hnr"][mine].sum(), rel=1e-5)
            assert row["levels"] == (None if block is None else pytest.approx(list(energy)))
