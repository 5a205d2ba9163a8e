"""Queries: frames, series and recordings."""

from __future__ import annotations

import threading
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from lookout.catalog.registry import query
from lookout.catalog.tables import r6
from lookout.functions import signal as sg
from lookout.operators.aggregates import frame_summary as summarize
from lookout.plans import views as v
from lookout.session import own_work_tables, scratch_path, table, work_tables
from lookout.sources import files
from lookout.streaming import jobs as st
from lookout.streaming import recordings as rec
from lookout.streaming import state

RATE, LOW, HIGH = 16_000.0, 500.0, 2_000.0  # lags 8 .. 32 of 64 samples

RMS = "sqrt(list_sum(list_transform(samples, lambda x: x * x)) / len(samples))"
ZCR = """len(list_filter(range(1, len(samples)), lambda i: (samples[i] >= 0) <> (samples[i + 1] >= 0)))
  / CAST(len(samples) AS DOUBLE)"""
LOUD = f"""lv AS (SELECT vec_id, chunk_id, pos, {RMS} AS rms FROM fr),
  ld AS (SELECT *, 20 * log10(rms / max(rms) OVER (PARTITION BY chunk_id)) > -10 AS loud FROM lv)"""


@query(
    "time_chunks",
    """SELECT event_id, CAST(floor(epoch_us(ts) / 5000000) AS BIGINT) AS chunk_id,
      CAST(floor(epoch_us(ts) / 5000000) AS BIGINT) * 5 AS chunk_start FROM events""",
)
def time_chunks(spark, d):
    chunk = files.chunk_number(F.col("ts"), 5)
    return table(spark, d, "events").select("event_id", chunk.alias("chunk_id"), (chunk * 5).alias("chunk_start"))


@query(
    "frame_series",
    f"""WITH {v.FR} SELECT vec_id, CAST(i AS INT) AS frame, 16 AS n, round(list_sum(samples[i * 8 + 1 : i * 8 + 16]), 6)
      AS total FROM fr, range(7) r(i)""",
)
def frame_series(spark, d):
    cut = sg.frame_series(v.frames(spark, d), ["vec_id"], "samples", 16, 8)
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return cut.select("vec_id", "frame", F.size("samples").alias("n"), r6(total).alias("total"))


@query("frame_rms", f"WITH {v.FR} SELECT vec_id, round({RMS}, 6) AS rms FROM fr")
def frame_rms(spark, d):
    return v.frames(spark, d).select("vec_id", r6(sg.rms(F.col("samples"))).alias("rms"))


@query("frame_zcr", f"WITH {v.FR} SELECT vec_id, round({ZCR}, 6) AS zcr FROM fr")
def frame_zcr(spark, d):
    return v.frames(spark, d).select("vec_id", r6(sg.zero_crossing_rate(F.col("samples"))).alias("zcr"))


def levels(spark, d):
    s = F.col("samples")
    return v.frames(spark, d).select(
        "vec_id", "chunk_id", "pos", sg.rms(s).alias("rms"), sg.zero_crossing_rate(s).alias("zcr")
    )


@query(
    "frame_mean_std",
    f"""WITH {v.FR}, m AS (SELECT chunk_id, pos, CASE WHEN pos % 5 = 0 THEN NULL ELSE {RMS} END AS rms, {ZCR} AS zcr FROM fr)
    SELECT chunk_id, round(avg(rms), 6) AS rms_mean, round(stddev_pop(rms), 6) AS rms_std, round(avg(zcr), 6) AS zcr_mean,
      round(stddev_pop(zcr), 6) AS zcr_std FROM m GROUP BY 1""",
)
def frame_mean_std(spark, d):
    """Every fifth level is NaN and must be skipped."""
    holes = levels(spark, d).withColumn("rms", F.when(F.col("pos") % 5 == 0, float("nan")).otherwise(F.col("rms")))
    out = summarize(holes, ["chunk_id"], ["rms", "zcr"])
    return out.select("chunk_id", *[r6(c).alias(c) for c in ("rms_mean", "rms_std", "zcr_mean", "zcr_std")])


@query(
    "pause_ratio",
    f"""WITH {v.FR}, {LOUD} SELECT chunk_id, round(1 - count(*) FILTER (loud) / count(*), 6) AS pause_ratio
      FROM ld GROUP BY 1""",
)
def pause_ratio(spark, d):
    return sg.pause_ratio(levels(spark, d), ["chunk_id"], "rms", 10.0).withColumn("pause_ratio", r6("pause_ratio"))


@query(
    "silence_islands",
    f"""WITH {v.FR}, {LOUD}, g AS (SELECT chunk_id, pos, pos - row_number() OVER (PARTITION BY chunk_id ORDER BY pos) AS run
      FROM ld WHERE loud), i AS (SELECT chunk_id, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS length
      FROM g GROUP BY chunk_id, run)
    SELECT *, CAST(sum(length) OVER (PARTITION BY chunk_id) AS BIGINT) AS loud_frames FROM i""",
)
def silence_islands(spark, d):
    """Runs of loud frames, with the loud frames of the chunk in all."""
    runs = sg.loud_intervals(levels(spark, d), ["chunk_id"], "pos", "rms", 10.0)
    return runs.withColumn("loud_frames", F.sum("length").over(Window.partitionBy("chunk_id")))


@query(
    "event_rate",
    f"""WITH {v.FR}, lv AS (SELECT chunk_id, pos, 20 * log10({RMS} + 1e-10) AS db FROM fr),
    p AS (SELECT chunk_id, coalesce(db > lag(db) OVER w AND db >= lead(db) OVER w AND db >= avg(db) OVER
      (PARTITION BY chunk_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) + 2, false) AS onset
      FROM lv WINDOW w AS (PARTITION BY chunk_id ORDER BY pos))
    SELECT chunk_id, round(count(*) FILTER (onset) / (count(*) * 0.2), 6) AS event_rate FROM p GROUP BY 1""",
)
def event_rate(spark, d):
    out = sg.event_rate(levels(spark, d), ["chunk_id"], "pos", "rms", F.count(F.lit(1)) * 0.2, 3, 2.0)
    return out.withColumn("event_rate", r6("event_rate"))


AC = f"""{v.FR}, ac AS (SELECT vec_id, lag, round(list_sum(list_transform(range(1, 65 - lag),
    lambda i: samples[i] * samples[i + lag])) / list_sum(list_transform(samples, lambda x: x * x)), 9) AS h
  FROM fr, range(8, 33) r(lag)),
best AS (SELECT vec_id, lag, h FROM ac QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY h DESC, lag) = 1)"""


def spectra(spark, d):
    return v.frames(spark, d).select("vec_id", sg.spectral_measures("samples", RATE, LOW, HIGH).alias("m"))


@query("frame_pitch", f"WITH {AC} SELECT vec_id, lag, round(16000.0 / lag, 6) AS pitch FROM best")
def frame_pitch(spark, d):
    return spectra(spark, d).select("vec_id", F.col("m.lag").alias("lag"), r6("m.pitch").alias("pitch"))


@query(
    "frame_hnr",
    f"""WITH {AC}, r AS (SELECT vec_id, greatest(least(h, CAST(0.999999 AS DOUBLE)), CAST(0.000001 AS DOUBLE)) AS r FROM best)
    SELECT vec_id, round(10 * log10(r / (1 - r)), 6) AS hnr FROM r""",
)
def frame_hnr(spark, d):
    return spectra(spark, d).select("vec_id", r6("m.hnr").alias("hnr"))


DFT = f"""{v.FR}, win AS (SELECT list_transform(range(0, 64), lambda i: 0.5 - 0.5 * cos(2 * pi() * i / 64)) AS hann),
sp AS (SELECT vec_id, k, sqrt(
    pow(list_sum(list_transform(range(0, 64), lambda i: hann[i + 1] * samples[i + 1] * cos(2 * pi() * k * i / 64))), 2) +
    pow(list_sum(list_transform(range(0, 64), lambda i: hann[i + 1] * samples[i + 1] * sin(2 * pi() * k * i / 64))), 2)) AS mag
  FROM fr, win, range(0, 33) r(k))"""


@query(
    "frame_centroid",
    f"WITH {DFT} SELECT vec_id, round(sum(k * 250.0 * mag) / sum(mag), 5) AS centroid FROM sp GROUP BY 1",
)
def frame_centroid(spark, d):
    return spectra(spark, d).select("vec_id", F.round("m.centroid", 5).alias("centroid"))


@query(
    "frame_rolloff",
    f"""WITH {DFT}, c AS (SELECT vec_id, k, sum(mag) OVER (PARTITION BY vec_id ORDER BY k) / sum(mag) OVER
      (PARTITION BY vec_id) AS share FROM sp)
    SELECT vec_id, CAST(min(k) FILTER (round(share, 12) >= 0.85) * 250 AS DOUBLE) AS rolloff FROM c GROUP BY 1""",
)
def frame_rolloff(spark, d):
    return spectra(spark, d).select("vec_id", F.col("m.rolloff").alias("rolloff"))


# Mel edges in Hz for a rate of 16 kHz: 130 of them, even on a scale that is linear up to 15 mel.
MEL = f"""{DFT}, top AS (SELECT 15 + 27 * ln(8) / ln(6.4) AS mel),
ed AS (SELECT j, CASE WHEN mel * j / 129 < 15 THEN mel * j / 129 * 200 / 3
    ELSE 1000 * exp(ln(6.4) / 27 * (mel * j / 129 - 15)) END AS hz FROM top, range(130) r(j)),
wt AS (SELECT a.j AS m, k, greatest(0, least((k * 250 - a.hz) / (b.hz - a.hz), (c.hz - k * 250) / (c.hz - b.hz)))
    * 2 / (c.hz - a.hz) AS w
  FROM ed a JOIN ed b ON b.j = a.j + 1 JOIN ed c ON c.j = a.j + 2, range(33) r(k)),
db AS (SELECT vec_id, m, 10 * log10(greatest(sum(mag * mag * w), 1e-10)) AS db FROM sp JOIN wt USING (k) GROUP BY 1, 2),
cl AS (SELECT vec_id, m, greatest(db, max(db) OVER (PARTITION BY vec_id) - 80) AS db FROM db)"""


@query(
    "frame_mfcc",
    f"WITH {MEL} SELECT vec_id, "
    + ", ".join(
        f"round(sum(db * cos(pi() * {c} * (2 * m + 1) / 256)) * sqrt(2 / 128{' / 2' if c == 0 else ''}), 4) AS mfcc_{c + 1}"
        for c in range(13)
    )
    + " FROM cl GROUP BY 1",
)
def frame_mfcc(spark, d):
    c = [F.round(F.get("m.mfcc", F.lit(i)), 4).alias(f"mfcc_{i + 1}") for i in range(sg.N_MFCC)]
    return spectra(spark, d).select("vec_id", *c)


# --- recordings made from the embeddings -----------------------------------------------


PART_BYTES = 1 << 29  #: of recordings that lie in the shared folder at a time, for a stream
BATCHES_PER_PART = 4  #: a batch job has no stream to start for each part and takes a fourth of it at a time
AT_ONCE = 2  #: parts that a batch job works on at a time, so that one is written and planned while another is measured
REPEATS = "(1250 * (1 + vec_id % 2) + 10)"


def dealt(rows, number, parts):
    """``rows`` written once, in as many folders as there are parts, by a hash of ``number``; returns a reader of one part."""
    spark, path = rows.sparkSession, scratch_path(rows.sparkSession, "dealt")
    mixed = F.xxhash64(number.cast("bigint"))
    placed = rows.withColumn("part", F.pmod(mixed, F.lit(parts)).cast("int"))
    placed.repartitionByRange("part", mixed).write.partitionBy("part").parquet(path)
    # A part that got no rows has no folder. The folders are listed once, not once for each part.
    written = spark.read.schema(placed.schema).parquet(path)
    return lambda one: written.filter(F.col("part") == one).drop("part")


def count_of_parts(spark, d, share=1):
    """Parts of the vectors whose recordings take about ``PART_BYTES / share``."""
    size = F.sum(F.expr(f"coalesce(size(embedding), 0) * {REPEATS} * {files.BYTES_PER_SAMPLE}"))
    return 1 + (table(spark, d, "embeddings").agg(size).first()[0] or 0) * share // PART_BYTES


def dealt_vectors(spark, d, share=1):
    """(reader of the vectors of one part, count of parts)"""
    parts = count_of_parts(spark, d, share)
    return dealt(table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("vec_id"), parts), parts


def recording_folders(spark, d, home=None):
    """One part of the recordings after the other, in a folder below ``home``: a WAV file per vector, its 64 values over and over, for 5 or 10
    seconds and a rest, every twentieth with another sample rate in its head.

    The recordings are a thousand times larger than the vectors, so a part goes, with all that was made of it on the way, before the next
    one is written.
    """
    vectors, parts = dealt_vectors(spark, d)
    for number in range(parts):
        with work_tables(spark):
            folder = scratch_path(spark, "corpus", home)
            write_recordings(vectors(number), folder)
            yield folder


def write_recordings(vectors, folder):
    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for i, e in zip(batch["vec_id"], batch["embedding"]):
                x = np.asarray(e, dtype=np.float64) * (1 + i % 7) / 8.0
                content = files.wav_content(np.tile(x, 1250 * (1 + i % 2) + 10), 8_000 if i % 20 == 0 else 16_000)
                with store.open_output_stream(f"{root}/{i}.wav") as out:  # a task run again writes the same file
                    out.write(content)
            yield batch[["vec_id"]]

    spark = vectors.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)  # also for no vectors
    # The vectors are few bytes and make long recordings, so they are dealt out first.
    e = vectors.repartition(spark.sparkContext.defaultParallelism, "vec_id")
    e.mapInPandas(write, "vec_id long").count()


def of_all_parts(spark, d, work):
    """The rows that ``work`` makes of each part of the recordings, from its number and folder; ``AT_ONCE`` parts lie there at a time."""
    path = scratch_path(spark, "from-recordings")
    vectors, parts = dealt_vectors(spark, d, BATCHES_PER_PART)
    changing = threading.Lock()  # one part is written or removed at a time

    def of_part(number):
        with work_tables(spark, changing):
            folder = scratch_path(spark, "corpus")
            with changing:
                write_recordings(vectors(number), folder)
            rows = work(number, folder)
            rows.write.parquet(f"{path}/part={number}")
            return rows.schema

    with ThreadPoolExecutor(AT_ONCE, initializer=own_work_tables) as pool:
        try:
            schemas = list(pool.map(of_part, range(parts)))
        finally:
            pool.shutdown(cancel_futures=True)
    return spark.read.schema(schemas[0]).parquet(path).drop("part")


def recordings_in(spark, folder):
    """The recordings of a part, which are short and many, read by one task per core."""
    return files.read_recordings(spark, folder).coalesce(spark.sparkContext.defaultParallelism)


def of_all_recordings(spark, d, work):
    """The rows that ``work`` makes of the recordings, read back part by part."""
    return of_all_parts(spark, d, lambda number, folder: work(recordings_in(spark, folder)))


def vec_id():
    return F.regexp_extract("path", r"([^/]+)\.wav$", 1).cast("long").alias("vec_id")


@query(
    "list_files",
    "SELECT vec_id, CAST(((vec_id % 2 + 1) * 1250 + 10) * 64 * 2 + 44 AS BIGINT) AS length FROM embeddings",
)
def list_files(spark, d):
    """The recordings made from the vectors, as they lie in their folder."""
    return of_all_parts(spark, d, lambda number, folder: files.list_files(spark, folder, "*.wav").select(vec_id(), "length"))


PCM_SQL = """e AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]),
  lambda x: CAST(round_even(x * (1 + vec_id % 7) / 8.0 * 32768, 0) AS BIGINT)) AS s FROM embeddings)"""
# A frame of 2,048 samples holds the 64 values 32 times, so all frames of a recording are alike.
ALIKE_SQL = f"""{PCM_SQL}, f AS (SELECT vec_id, sqrt(list_sum(list_transform(s, lambda x: CAST(x AS DOUBLE) * x)) / 64) / 32768 AS energy,
  (32 * len(list_filter(range(1, 64), lambda i: (s[i] >= 0) <> (s[i + 1] >= 0))) + 31 * CAST((s[64] >= 0) <> (s[1] >= 0) AS INT))
    / CAST(2048 AS DOUBLE) AS zcr FROM e),
mg AS (SELECT vec_id, m, sqrt(pow(list_sum(list_transform(range(0, 64), lambda i: s[i + 1] * cos(2 * pi() * m * i / 64))), 2)
    + pow(list_sum(list_transform(range(0, 64), lambda i: s[i + 1] * sin(2 * pi() * m * i / 64))), 2)) AS mag FROM e, range(33) r(m)),
bins AS (SELECT vec_id, 32 * m + o AS k, mag / (1 + abs(o)) AS mag FROM mg, (VALUES (-1), (0), (1)) v(o) WHERE 32 * m + o BETWEEN 0 AND 1024),
sums AS (SELECT vec_id, k, sum(mag) OVER (PARTITION BY vec_id ORDER BY k) / sum(mag) OVER (PARTITION BY vec_id) AS share FROM bins),
ro AS (SELECT vec_id, min(k) FILTER (round(share, 9) >= 0.85) * 7.8125 AS rolloff FROM sums GROUP BY 1),
fs AS (SELECT * FROM f JOIN ro USING (vec_id))"""
# A period of 64 samples is 250 Hz; at that lag a frame has 1,984 of its 2,048 products. Under a Hann window a harmonic fills its bin
# and half as much of the two beside it.
STATED = ("energy_mean", "energy_std", "zcr_mean", "speech_rate", "pause_ratio", "pitch_mean", "pitch_std", "hnr", "spectral_rolloff_mean")
STATED_SQL = """round(energy, 6) AS energy_mean, 0.0 AS energy_std, round(zcr, 6) AS zcr_mean, 0.0 AS speech_rate, 0.0 AS pause_ratio,
  250.0 AS pitch_mean, 0.0 AS pitch_std, round(10 * log10(1984.0 / 64), 2) AS hnr, CAST(rolloff AS DOUBLE) AS spectral_rolloff_mean"""
NOT_STATED_SQL = ", ".join("NULL" for _ in STATED)


@query(
    "wav_chunks",
    f"""WITH {PCM_SQL} SELECT vec_id, c AS chunk_id, c * 5 AS chunk_start, 80000 AS n,
      CAST(1250 * list_sum(s) AS BIGINT) AS total, list_min(s) AS low, list_max(s) AS high
      FROM e, range(1 + vec_id % 2) r(c) WHERE vec_id % 20 <> 0""",
)
def wav_chunks(spark, d):
    def summed(recordings):
        chunks, _ = files.recording_chunks(recordings)
        return chunks.withColumn("s", files.pcm_summary("pcm")).select(vec_id(), "chunk_id", "chunk_start", "s.*")

    return of_all_recordings(spark, d, summed)


def stated(features, rejects, *ids):
    """The measures that SQL can state, of complete feature rows, and the rejected recordings."""
    whole = features.filter("pitch_mean IS NOT NULL AND spectral_centroid_mean > 0 AND mfcc_13 IS NOT NULL AND hnr IS NOT NULL")
    rows = whole.select(vec_id(), *ids, *[F.abs(F.round(c, 2) if c == "hnr" else r6(c)).alias(c) for c in STATED], F.lit(None).cast("string").alias("error"))
    return rows.unionByName(rejects.select(vec_id(), "error"), allowMissingColumns=True)


@query(
    "signal_features",
    f"""WITH {ALIKE_SQL} SELECT vec_id, c AS chunk_id, {STATED_SQL}, NULL AS error FROM fs, range(1 + vec_id % 2) r(c) WHERE vec_id % 20 <> 0
      UNION ALL SELECT vec_id, NULL, {NOT_STATED_SQL}, 'other sample rate' FROM embeddings WHERE vec_id % 20 = 0""",
)
def signal_features(spark, d):
    return of_all_recordings(spark, d, lambda recordings: stated(*sg.signal_features(recordings), "chunk_id"))


@query(
    "file_features",
    f"""WITH {ALIKE_SQL} SELECT vec_id, {STATED_SQL}, NULL AS error FROM fs WHERE vec_id % 20 <> 0
      UNION ALL SELECT vec_id, {NOT_STATED_SQL}, 'other sample rate' FROM embeddings WHERE vec_id % 20 = 0""",
)
def file_features(spark, d):
    """Whole recordings, without chunks."""
    return of_all_recordings(spark, d, lambda recordings: stated(*sg.file_features(recordings)))


@query(
    "stream_recordings",
    f"""WITH {ALIKE_SQL} SELECT vec_id, c AS chunk_id, {STATED_SQL}, NULL AS error FROM fs, range(1 + vec_id % 2) r(c) WHERE vec_id % 20 <> 0
      UNION ALL SELECT vec_id, NULL, {NOT_STATED_SQL}, 'other sample rate' FROM embeddings WHERE vec_id % 20 = 0""",
)
def stream_recordings(spark, d):
    """The measures of arriving recordings and the reasons of rejected ones, as the batch has them."""
    path = measured_stream(spark, d)
    return stated(*rec.measured(spark, path), "chunk_id")


def measured_stream(spark, d):
    """The parts of the recordings arrive one after the other; the stream goes on from its checkpoint with each."""
    path, seen, home = (scratch_path(spark, name) for name in ("measured", "measured-state", "arriving"))
    for _ in recording_folders(spark, d, home):
        stream = rec.recording_stream(spark, home)
        st.finish(rec.measure_recordings(stream, vec_id() % 25, path, seen, resample=False))
    return path


@query(
    "stream_recording_alerts",
    f"""WITH {ALIKE_SQL}, c AS (SELECT vec_id, vec_id % 25 AS subject, c AS chunk_id, energy FROM f, range(1 + vec_id % 2) r(c) WHERE vec_id % 20 <> 0),
    b AS (SELECT *, count(*) OVER w AS n, avg(energy) OVER w AS base FROM c WINDOW w AS (PARTITION BY subject ORDER BY vec_id, chunk_id ROWS UNBOUNDED PRECEDING))
    SELECT vec_id, chunk_id, n AS baseline_n, CASE WHEN n >= 5 THEN round(base, 6) END AS base_energy,
      CASE WHEN n >= 5 AND energy < base * 0.9 THEN 'Unhealthy' ELSE 'Healthy' END AS status FROM b""",
)
def stream_recording_alerts(spark, d):
    """Arriving recordings through measures, the baseline of the moment, flag and decision."""
    rows = rec.feature_stream(spark, measured_stream(spark, d))
    # Recordings follow each other by their number, chunks by theirs.
    rows = rows.select("subject", vec_id(), "chunk_id", "energy_mean").withColumn("at", F.timestamp_seconds(F.col("vec_id") * 100 + F.col("chunk_id")))
    risk = F.when(F.col("pitch_drop"), F.lit("High")).otherwise(F.lit("Low"))
    judged = state.alerts_as_of(rows, "subject", "at", "vec_id", {"pitch_drop": ("energy_mean", "base_energy")}, lambda df: df.withColumn("model_risk", risk))
    out = judged.select("vec_id", "chunk_id", "baseline_n", "base_energy", F.col("mental_health_status").alias("status"))
    path = scratch_path(spark, "recording-alerts")
    st.finish(st.append_to_table(out, path, scratch_path(spark, "recording-alerts-state")))
    return spark.read.schema(out.schema).parquet(path).withColumn("base_energy", r6("base_energy"))


# The recordings with 8,000 Hz in their head, brought to 16,000: outputs at even places are source samples, those between them are
# sums under a windowed sinc. One period in the middle of a chunk is summed up; the signal repeats every 128 outputs.
SINC_SQL = f"""{PCM_SQL}, k AS (SELECT t, sin(pi() * (t - 0.5)) / (pi() * (t - 0.5)) * (0.5 + 0.5 * cos(pi() * (t - 0.5) / 32)) AS w FROM range(-31, 33) r(t)),
kn AS (SELECT t, w / (SELECT sum(w) FROM k) AS w FROM k),
odd AS (SELECT vec_id, i, sum(s[(i + t + 128) % 64 + 1] * w) AS x FROM e, range(64) r(i), kn GROUP BY vec_id, i),
one AS (SELECT vec_id, CAST(sum(greatest(-32768, least(32767, round_even(x, 0)))) AS BIGINT) AS between_total FROM odd GROUP BY 1)"""


@query(
    "wav_resampled",
    f"""WITH {SINC_SQL} SELECT vec_id, c AS chunk_id, 80000 AS n, CAST(list_sum(s) AS BIGINT) AS source_total, between_total
      FROM e JOIN one USING (vec_id), range(4) r(c) WHERE vec_id % 20 = 0 AND c < 2 * (1 + vec_id % 2)""",
)
def wav_resampled(spark, d):
    """Chunks of the recordings of another rate after conversion."""

    def sums(batches):
        for batch in batches:
            y = [np.frombuffer(b, "<i2").astype(np.int64) for b in batch["pcm"]]
            middle = [x[12_800 : 12_800 + 128] for x in y]
            batch = batch.assign(n=[len(x) for x in y], source_total=[int(x[::2].sum()) for x in middle], between_total=[int(x[1::2].sum()) for x in middle])
            yield batch.drop(columns="pcm")

    def converted(recordings):
        chunks, _ = files.recording_chunks(recordings.filter(F.regexp_extract("path", r"(\d+)\.wav$", 1).cast("long") % 20 == 0), resample=True)
        rows = chunks.select(vec_id(), "chunk_id", "pcm")
        return rows.mapInPandas(sums, "vec_id long, chunk_id long, n long, source_total long, between_total long")

    return of_all_recordings(spark, d, converted)


@query(
    "resampled_features",
    """SELECT vec_id, c AS chunk_id, true AS measured, NULL AS error FROM embeddings, range(4) r(c)
      WHERE c < CASE WHEN vec_id % 20 = 0 THEN 2 * (1 + vec_id % 2) ELSE 1 + vec_id % 2 END""",
)
def resampled_features(spark, d):
    """Feature rows of recordings of all rates; none is rejected for its rate."""

    def measured(recordings):
        features, rejects = sg.signal_features(recordings, resample=True)
        known = F.col("energy_mean").between(0.0001, 1) & F.col("pitch_mean").isNotNull() & (F.col("spectral_centroid_mean") > 0)
        rows = features.select(vec_id(), "chunk_id", known.alias("measured"), F.lit(None).cast("string").alias("error"))
        return rows.unionByName(rejects.select(vec_id(), "error"), allowMissingColumns=True)

    return of_all_recordings(spark, d, measured)
