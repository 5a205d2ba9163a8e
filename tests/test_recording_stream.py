"""Recordings that arrive over several batches and runs, against the batch job."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lookout.functions.signal import signal_features
from lookout.sources import files
from lookout.streaming import jobs as st
from lookout.streaming import recordings as rec
from lookout.streaming import state

RATE = 16_000


def tone(hz, seconds, rate=RATE, amplitude=0.4):
    return amplitude * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate)


def subject():
    return F.regexp_extract("path", r"([a-z]+)[0-9]*\.wav$", 1)


def test_stream_equals_batch(spark, tmp_path):
    folder, path, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    folder.mkdir()

    def run():
        st.finish(rec.measure_recordings(rec.recording_stream(spark, str(folder), files_per_batch=2), subject(), path, check))

    clips = [("ann1", 200, 11, RATE), ("ben1", 150, 6, 8_000), ("ann2", 180, 5, 44_100), ("cut1", 0, 0, RATE), ("odd1", 30, 6, 500), ("ben2", 300, 5, RATE)]
    for n, (name, hz, seconds, rate) in enumerate(clips):
        content = files.wav_content(tone(hz, seconds, rate), rate) if hz else b"RIFF"
        (folder / f"{name}.wav").write_bytes(content)
        if n in (2, 3, 5):
            run()
    run()  # nothing new
    features, rejects = rec.measured(spark, path)
    want, refused = signal_features(files.read_recordings(spark, str(folder)), resample=True)

    def rounded(df):
        return sorted((r["path"], r["chunk_id"], round(r["pitch_mean"], 6), round(r["energy_mean"], 6)) for r in df.collect())

    assert rounded(features) == rounded(want) and features.count() == 5
    assert sorted((r["path"], r["error"]) for r in rejects.collect()) == sorted((r["path"], r["error"]) for r in refused.collect())
    assert {r["subject"] for r in rejects.collect()} == {"cut", "odd"}

    # The feature rows go on as a stream into the stateful pass.
    rows = rec.feature_stream(spark, path).withColumn("at", F.timestamp_seconds(F.col("chunk_id"))).select("subject", "path", "chunk_id", "energy_mean", "at")
    judged = state.with_baseline(rows, "subject", "at", "path", {"base": "energy_mean"}, min_rows=1)
    st.finish(st.append_to_table(judged, str(tmp_path / "judged"), str(tmp_path / "judged-check")))
    last = {}
    for r in spark.read.parquet(str(tmp_path / "judged")).collect():
        last[r["subject"]] = max(last.get(r["subject"], (0, 0.0)), (r["baseline_n"], r["base"]))
    for name, mean, n in features.groupBy("subject").agg(F.avg("energy_mean"), F.count("*")).collect():
        assert last[name][0] == n and abs(last[name][1] - mean) < 1e-9


def test_a_batch_of_short_recordings_takes_a_task_per_core(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    for i in range(30):
        (tmp_path / "in" / f"ann{i}.wav").write_bytes(files.wav_content(tone(200, 0.2), RATE))
    seen, features_of = [], rec.signal_features

    def counted(batch, *args, **options):
        seen.append(batch.rdd.getNumPartitions())
        return features_of(batch, *args, **options)

    monkeypatch.setattr(rec, "signal_features", counted)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")
    try:
        st.finish(rec.measure_recordings(rec.recording_stream(spark, str(tmp_path / "in")), subject(), str(tmp_path / "out"), str(tmp_path / "check")))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen == [spark.sparkContext.defaultParallelism]
