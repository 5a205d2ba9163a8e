"""Files as tables: listings, subject folders, recordings cut into chunks of samples."""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookout.functions.resample import HIGHEST, LOBES, LOWEST, pcm_at_rate

SAMPLE_RATE = 16_000
HEAD_BYTES = 4_096
EXTENSIBLE = 0xFFFE
NO_DATA = "no data part"
LONG_BYTES = 32 << 20  # about 17 minutes
BYTES_PER_SAMPLE = 2


def list_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Path and length of the files below ``folder``; their content is not read."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length")
    )


def read_recordings(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "length", "content")
    )


def subject_files(files: DataFrame, path: str = "path") -> tuple[DataFrame, DataFrame]:
    """(subjects with a recording, subject folders without one), from folders named ``<id>_P``."""
    p = F.col(path)
    subject, name = F.regexp_extract(p, r"([^/]+)_P/[^/]+$", 1), F.regexp_extract(p, r"([^/]+)$", 1)
    found = (
        files.select(subject.alias("subject"), name.alias("name"))
        .filter(F.col("subject") != "")
        .groupBy("subject")
        .agg(F.bool_or(F.col("name") == F.concat(F.col("subject"), F.lit("_AUDIO.wav"))).alias("has_audio"))
    )
    return found.filter("has_audio").select("subject"), found.filter("NOT has_audio").select("subject")


def parse_wav_head(head: bytes) -> tuple[int, int, int, int, int, str | None]:
    """(rate, channels, bits, data offset, data bytes, error) from the first bytes of a WAV file.

    PCM16 may be marked as such or be the subformat of the extensible format.
    """
    if head is None or len(head) < 12 or head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return 0, 0, 0, 0, 0, "no WAV header"
    at, rate, channels, bits, code = 12, 0, 0, 0, 0
    while at + 8 <= len(head):
        name, size = head[at : at + 4], struct.unpack_from("<I", head, at + 4)[0]
        if name == b"fmt " and at + 24 <= len(head):
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head, at + 8)
            if code == EXTENSIBLE and size >= 26 and at + 34 <= len(head):
                code = struct.unpack_from("<H", head, at + 32)[0]
        if name == b"data":
            if not rate:
                return 0, 0, 0, 0, 0, "data before format"
            error = None if code == 1 and bits == 16 else "not PCM16"
            return rate, channels, bits, at + 8, size, error
        at += 8 + size + size % 2
    return rate, channels, bits, 0, 0, NO_DATA


WAV_HEAD = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("rate", "channels", "bits", "start", "bytes")]
    + [T.StructField("error", T.StringType())]
)
PCM_SUMMARY = T.StructType([T.StructField(c, T.LongType()) for c in ("n", "total", "low", "high")])


@F.pandas_udf(WAV_HEAD)
def wav_head(head: pd.Series) -> pd.DataFrame:
    rows = [parse_wav_head(h) for h in head]
    return pd.DataFrame(rows, columns=["rate", "channels", "bits", "start", "bytes", "error"])


# Not to be run a second time for a filter on its result.
wav_head = wav_head.asNondeterministic()


def with_wav_head(recordings: DataFrame, rate: int = SAMPLE_RATE, resample: bool = False) -> DataFrame:
    """Adds ``head`` and ``error``. Only the first bytes of a file go to Python, unless the sound starts behind them:
    a file with long parts in front of it is sent whole. Another rate than ``rate`` is an error unless it can be converted."""
    content = F.col("content")
    first = recordings.withColumn("head", wav_head(F.substring(content, 1, HEAD_BYTES)))
    beyond = (F.col("head.error") == NO_DATA) & (F.length("content") > HEAD_BYTES)
    full = first.withColumn("__full", wav_head(F.when(beyond, content)))
    checked = full.withColumn("head", F.when(beyond, F.col("__full")).otherwise(F.col("head"))).drop("__full")
    usable = F.col("head.rate").between(LOWEST, HIGHEST) if resample else F.col("head.rate") == rate
    return checked.withColumn(
        "error",
        F.when(F.col("head.error").isNotNull(), F.col("head.error"))
        .when(F.col("head.channels") < 1, F.lit("no channels"))
        .when(~usable, F.lit("other sample rate")),
    )


def _checked(recordings: DataFrame, rate: int, min_seconds: float, max_seconds: float | None, resample: bool = False) -> DataFrame:
    """Adds ``held`` and ``samples`` (how many there are per channel in the file and at ``rate``) and completes ``error``."""
    frame = F.greatest(F.col("head.channels"), F.lit(1)) * BYTES_PER_SAMPLE
    held = F.floor(F.least(F.col("head.bytes"), F.length("content") - F.col("head.start")) / frame)
    there = F.when(F.col("head.rate") == rate, F.col("held")).otherwise(F.ceil(F.col("held") * rate / F.greatest(F.col("head.rate"), F.lit(1))))
    if max_seconds is not None:
        there = F.least(there, F.lit(int(max_seconds * rate)))
    checked = with_wav_head(recordings, rate, resample).withColumn("held", held).withColumn("samples", there)
    short = F.col("samples") < int(min_seconds * rate)
    return checked.withColumn("error", F.coalesce("error", F.when(short, F.lit("too short"))))


def _cut(
    recordings: DataFrame,
    check: Callable[[DataFrame], DataFrame],
    count: Column,
    number: str,
    first: Column,
    width: Column,
    long_bytes: int,
    rate: int,
    resample: bool,
) -> DataFrame:
    """PCM16 bytes of ``count`` parts of each recording; ``first`` and ``width`` are in samples at ``rate``.

    With ``resample``, parts of a recording of another rate are taken with what their ends need and converted to one
    channel at ``rate``; bytes of recordings that have the rate do not pass through Python.

    A rejected recording gives one row with its error and without a part, so one reading of the files serves both.
    Parts of recordings above ``long_bytes`` are dealt out to all tasks; those of shorter ones stay where the file was
    read, without a shuffle. The length is tested before the content is touched, so each file is read for one of the two.
    """
    length = F.col("length")

    def parts(some: DataFrame) -> DataFrame:
        frame = F.col("head.channels") * BYTES_PER_SAMPLE
        low, high, channels = first, first + width, F.col("head.channels").cast("int")
        if resample:
            alike, source = F.col("head.rate") == rate, F.col("head.rate")
            reach = F.ceil(F.lit(float(LOBES)) * F.greatest(F.lit(1.0), source / rate))
            low = F.when(alike, low).otherwise(F.greatest(F.lit(0), F.floor(first * source / rate) - reach))
            high = F.when(alike, high).otherwise(F.least(F.col("held"), F.floor((first + width - 1) * source / rate) + reach + 1))
        start = (F.col("head.start") + low * frame + 1).cast("int")
        pcm = F.when(F.col(number).isNotNull(), F.substring(F.col("content"), start, ((high - low) * frame).cast("int")))
        if resample:
            there = pcm_at_rate(F.when(~alike, pcm), channels, source, low, first, width, rate)
            pcm, channels = F.when(alike, pcm).otherwise(there), F.when(alike, channels).otherwise(F.lit(1))
        numbers = F.when(F.col("error").isNull() & (count > 0), F.sequence(F.lit(0).cast("bigint"), count.cast("bigint") - 1))
        rows = check(some).withColumn(number, F.explode_outer(numbers))
        rows = rows.filter(F.col(number).isNotNull() | F.col("error").isNotNull())
        return rows.select("path", number, channels.alias("channels"), pcm.alias("pcm"), "error")

    short, long = recordings.filter(length <= long_bytes), recordings.filter(length > long_bytes)
    return parts(short).unionByName(parts(long).repartition("path", number))


def recording_parts(
    recordings: DataFrame,
    seconds: int = 5,
    rate: int = SAMPLE_RATE,
    keep_tail: bool = False,
    min_seconds: float = 0.5,
    max_seconds: float | None = None,
    long_bytes: int = LONG_BYTES,
    resample: bool = False,
) -> DataFrame:
    """Chunks of PCM16 bytes, all channels as they lie in the file, and a row with the reason per rejected recording.

    ``recordings`` has path, length and content. The tail is dropped unless ``keep_tail``; then it
    must last ``min_seconds``. With ``max_seconds`` only the beginning of a recording is read. With ``resample`` recordings of
    other rates are converted to ``rate``, else they are rejected.
    """
    check = partial(_checked, rate=rate, min_seconds=0.0, max_seconds=max_seconds, resample=resample)
    width = seconds * rate
    shortest = int(min_seconds * rate) if keep_tail else width
    count = F.floor((F.col("samples") + (width - shortest)) / width)
    first = F.col("chunk_id") * width
    size = F.least(F.lit(width), F.col("samples") - first)
    chunks = _cut(recordings, check, count, "chunk_id", first, size, long_bytes, rate, resample)
    return chunks.withColumn("chunk_start", F.col("chunk_id") * seconds)


def recording_chunks(recordings: DataFrame, *args, **options) -> tuple[DataFrame, DataFrame]:
    """(chunks, rejected recordings with a reason) as two tables over ``recording_parts``; each reads the files."""
    return parted(recording_parts(recordings, *args, **options), "chunk_id")


def recording_blocks(
    recordings: DataFrame,
    length: int,
    hop: int,
    block: int,
    halo: int,
    rate: int = SAMPLE_RATE,
    min_seconds: float = 1.0,
    max_seconds: float | None = None,
    long_bytes: int = LONG_BYTES,
    resample: bool = False,
) -> DataFrame:
    """Parts of whole recordings, and a row with the reason per rejected recording.

    Part number b holds the samples of frames b * block - halo .. (b + 1) * block + halo - 1, as far as
    there are such frames, so every frame of the recording is whole in the part it belongs to.
    """
    check = partial(_checked, rate=rate, min_seconds=min_seconds, max_seconds=max_seconds, resample=resample)
    frames = F.floor((F.col("samples") - length) / hop) + 1
    from_frame = F.greatest(F.lit(0), F.col("block") * block - halo)
    to_frame = F.least(frames, (F.col("block") + 1) * block + halo)
    width = (to_frame - from_frame - 1) * hop + length
    return _cut(recordings, check, F.ceil(frames / block), "block", from_frame * hop, width, long_bytes, rate, resample)


def parted(rows: DataFrame, number: str) -> tuple[DataFrame, DataFrame]:
    """(rows of parts, rejected recordings with a reason)."""
    return rows.filter(F.col(number).isNotNull()).drop("error"), rows.filter(F.col(number).isNull()).select("path", "error")


def decode_pcm16(pcm: bytes, channels: int = 1) -> np.ndarray:
    """Samples in -1 .. 1; several channels are mixed to their mean."""
    frame = 2 * channels
    y = np.frombuffer(pcm[: len(pcm) // frame * frame], dtype="<i2") / 32768.0
    return y if channels == 1 else y.reshape(-1, channels).mean(axis=1)


@F.pandas_udf(PCM_SUMMARY)
def pcm_summary(pcm: pd.Series) -> pd.DataFrame:
    rows = []
    for b in pcm:
        x = np.frombuffer(b, dtype="<i2")
        rows.append((len(x), int(x.sum(dtype=np.int64)), int(x.min()), int(x.max())))
    return pd.DataFrame(rows, columns=["n", "total", "low", "high"])


def wav_content(samples: np.ndarray, rate: int = SAMPLE_RATE) -> bytes:
    """A PCM16 WAV file with the given samples in -1 .. 1, one row per sample and one column per channel if several."""
    channels = samples.shape[1] if samples.ndim == 2 else 1
    data = np.clip(np.rint(samples * 32768.0), -32768, 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, channels, rate,
                       rate * 2 * channels, 2 * channels, 16, b"data", len(data))
    return head + data


def chunk_number(ts: Column, seconds: float) -> Column:
    """Tumbling bin of a timestamp since the epoch."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(int(seconds * 1_000_000))).cast("bigint")
