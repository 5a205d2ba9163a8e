"""Measures of signal frames.

Row measures (energy, zero crossings) are array expressions. Pitch, harmonicity and the
spectral measures run in numpy over Arrow batches of frames. Frames are full frames without
padding; the definitions are in the docstrings.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lookout.operators.scan import many_to_one
from lookout.operators.windows import active_islands
from lookout.session import settled
from lookout.sources.files import SAMPLE_RATE, decode_pcm16, parted, recording_blocks, recording_parts

FRAME_LENGTH, HOP = 2048, 512
PITCH_LOW, PITCH_HIGH = 80.0, 400.0
TOP_DB = 30.0
ROLLOFF = 0.85
N_MFCC, N_MELS, MEL_RANGE_DB = 13, 128, 80.0
ONSET_WIDTH, ONSET_DELTA_DB = 3, 6.0
VOICED_FROM = 0.45
FLOOR = 1e-10
CACHED_FRAMES = 32
CACHED_HOPS = 64
FRAMES_PER_BLOCK = 160


# --- frames as array expressions -------------------------------------------------------


def frame_series(df: DataFrame, ids: Sequence[str], samples: str, length: int, hop: int) -> DataFrame:
    """Overlapping frames of a sample array, one row each; only full frames."""
    n = F.floor((F.size(samples) - length) / hop) + 1
    starts = F.sequence(F.lit(0).cast("bigint"), n - 1)
    cut = F.transform(starts, lambda i: F.slice(F.col(samples), (i * hop + 1).cast("int"), F.lit(length)))
    return df.filter(F.size(samples) >= length).select(*ids, F.posexplode(cut).alias("frame", "samples"))


def rms(samples: Column) -> Column:
    return F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples))


def zero_crossing_rate(samples: Column) -> Column:
    """Sign changes per sample; a zero counts as positive."""
    n = F.size(samples)
    pairs = F.zip_with(
        F.slice(samples, F.lit(1), n - 1), F.slice(samples, F.lit(2), n - 1), lambda a, b: (a >= 0) != (b >= 0)
    )
    return F.size(F.filter(pairs, lambda changed: changed)) / n


def loud(level: Column, top: Column, top_db: float) -> Column:
    """Is a frame within ``top_db`` of the loudest one? Silence is never loud."""
    return F.coalesce((top > 0) & (F.lit(20.0) * F.log10(level / F.nullif(top, F.lit(0.0))) > -top_db), F.lit(False))


def with_top(frames: DataFrame, keys: Sequence[str], level: str) -> DataFrame:
    """Adds the highest level of the chunk; the frames of a chunk are few and go to one window."""
    return frames.withColumn("top", F.max(level).over(Window.partitionBy(*keys)))


def pause_ratio(frames: DataFrame, keys: Sequence[str], level: str, top_db: float = TOP_DB) -> DataFrame:
    """Share of the frames of a chunk that are not loud."""
    marked = with_top(frames, keys, level)
    is_loud = loud(F.col(level), F.col("top"), top_db)
    return marked.groupBy(*keys).agg((1 - F.count_if(is_loud) / F.count(F.lit(1))).alias("pause_ratio"))


def loud_intervals(frames: DataFrame, keys: Sequence[str], pos: str, level: str, top_db: float = TOP_DB) -> DataFrame:
    """First and last position and length of each run of loud frames."""
    marked = with_top(frames, keys, level).withColumn("__loud", loud(F.col(level), F.col("top"), top_db))
    return active_islands(marked.select(*keys, pos, "__loud"), keys, pos, F.col("__loud"))


def onset_rows(frames: DataFrame, keys: Sequence[str], pos: str, level: str, width: int, delta_db: float) -> DataFrame:
    """Frames whose level in dB tops both neighbours and the mean of the frames around by ``delta_db``.

    A chunk is a fixed number of seconds, so its frames are few and go to one window.
    """
    w = Window.partitionBy(*keys).orderBy(pos)
    db = F.lit(20.0) * F.log10(F.col(level) + FLOOR)
    measured = frames.withColumn("__db", db)
    x = F.col("__db")
    peak = (
        (x > F.lag(x).over(w))
        & (x >= F.lead(x).over(w))
        & (x >= F.avg(x).over(w.rowsBetween(-width, width)) + delta_db)
    )
    return measured.withColumn("onset", F.coalesce(peak, F.lit(False))).drop("__db")


def event_rate(
    frames: DataFrame,
    keys: Sequence[str],
    pos: str,
    level: str,
    seconds: Column,
    width: int = ONSET_WIDTH,
    delta_db: float = ONSET_DELTA_DB,
) -> DataFrame:
    """Onsets per second of a chunk. ``seconds`` is an aggregate expression."""
    marked = onset_rows(frames, keys, pos, level, width, delta_db)
    return marked.groupBy(*keys).agg(F.try_divide(F.count_if("onset").cast("double"), seconds).alias("event_rate"))


# --- kernels on a matrix of frames, one frame per row ----------------------------------


def fft_size(at_least: int) -> int:
    """Smallest number 2^a 3^b 5^c that is not below ``at_least``."""
    best = 1 << (at_least - 1).bit_length()
    five = 1
    while five < best:
        three = five
        while three < best:
            twos = max(0, -(-at_least // three) - 1).bit_length()
            best = min(best, three << twos)
            three *= 3
        five *= 5
    return best


def autocorrelation_peak(x: np.ndarray, rate: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(lag, normalised height) of the highest autocorrelation in rate/high .. rate/low.

    Ties go to the shorter lag. A silent frame has lag 0 and height 0.
    """
    n = x.shape[1]
    first, last = lag_range(n, rate, low, high)
    if last < first:
        return np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    size = fft_size(n + last)  # enough padding for the lags in question
    spectrum = np.fft.rfft(x, size, axis=1)
    whole = np.fft.irfft(spectrum.real**2 + spectrum.imag**2, size, axis=1)[:, first : last + 1]
    return highest(whole, (x * x).sum(axis=1), first)


def lag_range(n: int, rate: float, low: float, high: float) -> tuple[int, int]:
    return max(1, int(np.ceil(rate / high))), min(n - 1, int(np.floor(rate / low)))


def highest(products: np.ndarray, energy: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """The peak of each frame from its sums of products at the lags from ``first`` on."""
    heights = np.round(products / np.where(energy > 0, energy, 1.0)[:, None], 9)
    best = heights.argmax(axis=1)
    height = heights[np.arange(len(heights)), best]
    silent = energy <= 0
    return np.where(silent, 0, best + first), np.where(silent, 0.0, height)


def overlapping_peaks(y: np.ndarray, length: int, hop: int, rate: float, low: float, high: float) -> tuple[np.ndarray, np.ndarray] | None:
    """``autocorrelation_peak`` of all full frames of ``y`` that lie ``hop`` samples apart; None where frames are not whole hops.

    A frame is a number of hops. The products that begin in a hop are summed once for all frames that it belongs to, and the last hop of a
    frame has those that also end in it.
    """
    first, last = lag_range(length, rate, low, high)
    per = length // hop
    if length % hop or not first <= last <= hop:
        return None
    hops = (len(y) - length) // hop + per
    size = fft_size(hop + last)
    padded = np.zeros((hops - 1) * hop + size, y.dtype)
    known = min(len(y), len(padded))
    padded[:known] = y[:known]
    windows = np.lib.stride_tricks.sliding_window_view(padded, size)[::hop]
    begun, within, energy = (np.empty((hops, *rest), y.dtype) for rest in ((last + 1 - first,), (last + 1 - first,), ()))
    for at in range(0, hops, CACHED_HOPS):
        some = slice(at, at + CACHED_HOPS)
        here = windows[some, :hop]
        reach = windows[some].copy()
        reach[:, hop + last :] = 0
        own, far = np.fft.rfft(here, size, axis=1), np.fft.rfft(reach, axis=1)
        begun[some] = np.fft.irfft(own.conj() * far, size, axis=1)[:, first : last + 1]
        within[some] = np.fft.irfft(own.real**2 + own.imag**2, size, axis=1)[:, first : last + 1]
        energy[some] = (here * here).sum(axis=1)
    frames = hops - per + 1
    products = within[per - 1 :] + sum(begun[k : k + frames] for k in range(per - 1))
    return highest(products, sum(energy[k : k + frames] for k in range(per)), first)


def harmonicity_db(height: np.ndarray) -> np.ndarray:
    """10 log10(r / (1 - r)) of the normalised autocorrelation peak."""
    r = np.clip(height, 1e-6, 1 - 1e-6)
    return 10.0 * np.log10(r / (1.0 - r))


@lru_cache(maxsize=8)
def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2.0 * np.pi * np.arange(n) / n)


def power_spectrum(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(power, frequencies) of frames under a Hann window."""
    spectrum = np.fft.rfft(x * hann(x.shape[1]).astype(x.dtype), axis=1)
    return spectrum.real**2 + spectrum.imag**2, np.arange(x.shape[1] // 2 + 1) * (rate / x.shape[1])


def spectral_shape(power: np.ndarray, hz: np.ndarray, share: float = ROLLOFF) -> tuple[np.ndarray, np.ndarray]:
    """(centroid, roll-off) of the magnitudes; 0 for silence."""
    magnitude = np.sqrt(power)
    upto = magnitude.cumsum(axis=1)
    total = upto[:, -1]
    safe = np.where(total > 0, total, 1.0)
    centroid = magnitude @ hz / safe
    reached = upto >= (safe * (share - 1e-12))[:, None]
    rolloff = np.where(total > 0, hz[reached.argmax(axis=1)], 0.0)
    return centroid, rolloff


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    """Slaney's mel scale: linear up to 1 kHz (15 mel), logarithmic above."""
    return np.where(mel < 15.0, mel * 200.0 / 3.0, 1000.0 * np.exp(np.log(6.4) / 27.0 * (mel - 15.0)))


@lru_cache(maxsize=8)
def mel_matrix(rate: float, n: int, n_mels: int = N_MELS) -> np.ndarray:
    """Triangular filters of equal area, evenly spaced on the mel scale up to half the rate."""
    top = rate / 2.0
    top_mel = top * 3.0 / 200.0 if top < 1000.0 else 15.0 + 27.0 * np.log(top / 1000.0) / np.log(6.4)
    edges = mel_to_hz(np.linspace(0.0, top_mel, n_mels + 2))
    hz = np.arange(n // 2 + 1) * (rate / n)
    up = (hz[None, :] - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - hz[None, :]) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(up, down)) * (2.0 / (edges[2:] - edges[:-2]))[:, None]


@lru_cache(maxsize=8)
def mel_weights(rate: float, n: int, n_mels: int, dtype: str) -> np.ndarray:
    """The filters as columns, in the precision of the spectra."""
    return np.ascontiguousarray(mel_matrix(rate, n, n_mels).T.astype(dtype))


@lru_cache(maxsize=8)
def cosine_basis(count: int, n_mels: int) -> np.ndarray:
    k, m = np.arange(count)[:, None], np.arange(n_mels)[None, :]
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * n_mels)) * np.sqrt(2.0 / n_mels)
    basis[0] /= np.sqrt(2.0)
    return basis


def mel_db(power: np.ndarray, rate: float, n: int, n_mels: int = N_MELS) -> np.ndarray:
    return 10.0 * np.log10(np.maximum(power @ mel_weights(rate, n, n_mels, power.dtype.str), FLOOR))


def mfcc(levels: np.ndarray, count: int = N_MFCC, range_db: float = MEL_RANGE_DB) -> np.ndarray:
    """DCT-II of mel levels, first ``count`` coefficients; levels far below the highest one are raised."""
    levels = np.maximum(levels, levels.max() - range_db)
    return levels @ cosine_basis(count, levels.shape[1]).T


def spectral_kernel(
    x: np.ndarray, rate: float, low: float, high: float, peaks: tuple[np.ndarray, np.ndarray] | None = None
) -> tuple[np.ndarray, ...]:
    """(lag, height, centroid, roll-off, mel levels) of frames, a few frames at a time to stay in the cache. ``peaks`` are
    the lags and heights, where they are known."""
    parts = []
    for block in (slice(i, i + CACHED_FRAMES) for i in range(0, len(x), CACHED_FRAMES)):
        power, hz = power_spectrum(x[block], rate)
        peak = (peaks[0][block], peaks[1][block]) if peaks else autocorrelation_peak(x[block], rate, low, high)
        parts.append((*peak, *spectral_shape(power, hz), mel_db(power, rate, x.shape[1])))
    return tuple(np.concatenate(column) for column in zip(*parts))


def matrices(samples: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each frame length that occurs in a batch."""
    lengths = samples.map(len).to_numpy()
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, np.vstack([np.asarray(s, dtype=np.float64) for s in samples.iloc[rows]])


def spectral_measures(samples: str, rate: float, low: float = PITCH_LOW, high: float = PITCH_HIGH) -> Column:
    """Struct of lag, pitch, hnr, centroid, rolloff and mfcc of a frame column."""
    fields = [T.StructField("lag", T.LongType())]
    fields += [T.StructField(c, T.DoubleType()) for c in ("pitch", "hnr", "centroid", "rolloff")]
    fields += [T.StructField("mfcc", T.ArrayType(T.DoubleType()))]

    @F.pandas_udf(T.StructType(fields))
    def measure(frames: pd.Series) -> pd.DataFrame:
        out = {c.name: np.zeros(len(frames)) for c in fields[:-1]}
        out["lag"] = np.zeros(len(frames), dtype=np.int64)
        cepstra: list = [None] * len(frames)
        for rows, x in matrices(frames):
            lag, height, out["centroid"][rows], out["rolloff"][rows], found = spectral_kernel(x, rate, low, high)
            out["lag"][rows] = lag
            out["pitch"][rows] = np.where(lag > 0, rate / np.maximum(lag, 1), 0.0)
            out["hnr"][rows] = harmonicity_db(height)
            for row, levels in zip(rows, found):
                cepstra[row] = mfcc(levels[None, :])[0]
        return pd.DataFrame({**out, "mfcc": cepstra})

    return measure(F.col(samples))


# --- recordings ------------------------------------------------------------------------

FRAME_MEASURES = ("energy", "zcr", "pitch", "hnr", "spectral_centroid", "spectral_rolloff")
MFCCS = tuple(f"mfcc_{i + 1}" for i in range(N_MFCC))
SPREAD = {"pitch": "voiced", "energy": "frames"}  #: measures with a spread, and what counts their frames
SUMMED = (*FRAME_MEASURES, *MFCCS)
SPREADS = tuple(f"{c}_spread" for c in SPREAD)
SUMS = ", ".join(
    ["path string, chunk_id long, frames long, voiced long, onsets long, louds long, levels array<double>"]
    + [f"{c} double" for c in (*SUMMED, *SPREADS)]
    + ["error string"]
)


@lru_cache(maxsize=1)
def sums_schema() -> pa.Schema:
    whole = [(c, pa.int64()) for c in ("chunk_id", "frames", "voiced", "onsets", "louds")]
    parts = [("path", pa.string()), *whole, ("levels", pa.list_(pa.float64())), *((c, pa.float64()) for c in (*SUMMED, *SPREADS))]
    return pa.schema([*parts, ("error", pa.string())])


def loud_and_onset(energy: np.ndarray, top_db: float, width: int, delta_db: float) -> tuple[np.ndarray, np.ndarray]:
    """The marks of ``loud`` and ``onset_rows`` for the frames of one chunk."""
    top = energy.max()
    db = 20.0 * np.log10(energy + FLOOR)
    is_loud = energy > top * 10.0 ** (-top_db / 20.0)
    upto = np.concatenate([[0.0], db.cumsum()])
    at = np.arange(len(db))
    first, last = np.maximum(at - width, 0), np.minimum(at + width + 1, len(db))
    around = (upto[last] - upto[first]) / (last - first)
    onset = np.zeros(len(db), dtype=bool)
    onset[1:-1] = (db[1:-1] > db[:-2]) & (db[1:-1] >= db[2:]) & (db[1:-1] >= around[1:-1] + delta_db)
    return is_loud, onset


def chunk_frames(pcm: bytes | None, rate: int, length: int, hop: int, top_db: float, channels: int = 1) -> dict[str, np.ndarray] | None:
    """All frame measures of one chunk. Frames without a pitch have NaN there."""
    y = decode_pcm16(pcm or b"", channels)
    if len(y) < length:
        return None
    # Single precision is ample for the spectra of 16-bit samples and halves their time.
    single = y.astype(np.float32)
    x = np.lib.stride_tricks.sliding_window_view(single, length)[::hop]
    start = np.arange(len(x)) * hop
    # Sums over frames from running sums over the chunk.
    squares = np.concatenate([[0.0], np.cumsum(y * y)])
    changes = np.concatenate([[0], np.cumsum((y[1:] >= 0) != (y[:-1] >= 0))])
    energy = np.sqrt((squares[start + length] - squares[start]) / length)
    lag, height, centroid, rolloff, levels = spectral_kernel(x, rate, PITCH_LOW, PITCH_HIGH, overlapping_peaks(single, length, hop, rate, PITCH_LOW, PITCH_HIGH))
    voiced = (lag > 0) & (height >= VOICED_FROM)
    is_loud, onset = loud_and_onset(energy, top_db, ONSET_WIDTH, ONSET_DELTA_DB)
    return {
        "frame": np.arange(len(x)),
        "energy": energy,
        "zcr": (changes[start + length - 1] - changes[start]) / length,
        "pitch": np.where(voiced, rate / np.maximum(lag, 1), np.nan),
        "hnr": harmonicity_db(height),
        "spectral_centroid": centroid,
        "spectral_rolloff": rolloff,
        "loud": is_loud,
        "onset": onset,
        **dict(zip(MFCCS, mfcc(levels).T)),
    }


def chunk_sums(found: dict[str, np.ndarray], mine: slice, with_levels: bool) -> dict:
    """Counts, sums and spreads (squared distances from their mean) of the frames ``mine`` of one chunk. Missing pitches are skipped."""
    pitch, energy = found["pitch"][mine], found["energy"][mine]
    pitch = pitch[~np.isnan(pitch)]
    sums = {c: x[mine].sum(dtype=np.float64) for c, x in found.items() if c in SUMMED}
    spreads = {f"{c}_spread": ((x - x.mean()) ** 2).sum() if len(x) else 0.0 for c, x in (("pitch", pitch), ("energy", energy))}
    counts = {"frames": len(energy), "voiced": len(pitch), "onsets": found["onset"][mine].sum(), "louds": found["loud"][mine].sum()}
    return {**counts, **sums, **spreads, "pitch": pitch.sum(), "levels": energy if with_levels else None}


def measured_chunks(
    chunks: DataFrame, rate: int, length: int, hop: int, top_db: float = TOP_DB, block: int | None = None, halo: int = 0
) -> DataFrame:
    """The sums over the frames of each chunk, from rows of PCM16 chunk bytes; chunks without a full frame have no row. A row with an
    error is passed on.

    Frames are made and summed up in the same task, so one row per chunk leaves it. With ``block`` chunk number b has ``halo`` frames
    around the frames b * block .. (b + 1) * block - 1, which are summed; then the sums hold the level of each frame.
    """

    def sums_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for values in zip(*batch.columns, strict=True):
                path, chunk, channels, pcm, error = (v.as_py() for v in values)
                if error is not None:
                    rows.append({"path": path, "chunk_id": chunk, "error": error})
                    continue
                found = chunk_frames(pcm, rate, length, hop, top_db, channels)
                if found is None:
                    continue
                before = min(halo, chunk * block) if block else 0
                mine = slice(before, before + block if block else None)
                if len(found["frame"][mine]):
                    rows.append({"path": path, "chunk_id": chunk, **chunk_sums(found, mine, block is not None)})
            yield pa.RecordBatch.from_pylist(rows, sums_schema())

    error = F.col("error") if "error" in chunks.columns else F.lit(None).cast("string")
    return chunks.select("path", "chunk_id", F.coalesce("channels", F.lit(1)).alias("channels"), "pcm", error.alias("error")).mapInArrow(sums_of, SUMS)


def chunk_features(sums: DataFrame, rate: int, length: int, hop: int, also: Sequence[Column] = ()) -> DataFrame:
    """One feature row per (path, chunk): means and spreads, pause ratio, onset rate, mean MFCCs."""
    n = F.sum("frames")
    seconds = ((n - 1) * hop + length) / float(rate)
    zero = F.lit(0.0)

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(c), F.sum(SPREAD.get(c, "frames")))

    def std(c: str) -> Column:
        """Rows of the same chunk, if there are several, add the distances of their means."""
        count = F.sum(SPREAD[c])
        apart = F.sum(F.try_divide(F.col(c) * F.col(c), F.col(SPREAD[c]))) - F.try_divide(F.sum(c) * F.sum(c), count)
        return F.sqrt(F.try_divide(F.sum(f"{c}_spread") + F.when(F.count(F.lit(1)) > 1, F.greatest(zero, apart)).otherwise(zero), count))

    return sums.groupBy("path", "chunk_id").agg(
        F.coalesce(mean("pitch"), zero).alias("pitch_mean"),
        F.coalesce(std("pitch"), zero).alias("pitch_std"),
        mean("energy").alias("energy_mean"),
        std("energy").alias("energy_std"),
        (F.sum("onsets") / seconds).alias("speech_rate"),
        (1 - F.sum("louds") / n).alias("pause_ratio"),
        mean("hnr").alias("hnr"),
        mean("zcr").alias("zcr_mean"),
        mean("spectral_centroid").alias("spectral_centroid_mean"),
        mean("spectral_rolloff").alias("spectral_rolloff_mean"),
        *[mean(c).alias(c) for c in MFCCS],
        *also,
    )


def signal_features(
    recordings: DataFrame,
    seconds: int = 5,
    rate: int = SAMPLE_RATE,
    length: int = FRAME_LENGTH,
    hop: int = HOP,
    keep_tail: bool = False,
    min_seconds: float = 0.5,
    resample: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(feature row per recording and chunk, rejected recordings with a reason). The files are read once for both."""
    parts = recording_parts(recordings, seconds, rate, keep_tail, min_seconds, resample=resample)
    sums = measured_chunks(parts, rate, length, hop)
    features = chunk_features(sums, rate, length, hop, [F.first("error", True).alias("error")])
    return parted(settled(features), "chunk_id")


def file_features(
    recordings: DataFrame,
    rate: int = SAMPLE_RATE,
    length: int = FRAME_LENGTH,
    hop: int = HOP,
    top_db: float = TOP_DB,
    min_seconds: float = 1.0,
    max_seconds: float | None = None,
    block: int = FRAMES_PER_BLOCK,
    resample: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(one feature row per whole recording, rejected recordings with a reason).

    Frames are measured in blocks, with enough frames on both sides to judge onsets at the cuts, and
    summed per block. Pauses are told from the loudest frame of the recording, so each block keeps
    its levels and is looked at once more when the highest one is known.
    """
    halo = ONSET_WIDTH
    parts = recording_blocks(recordings, length, hop, block, halo, rate, min_seconds, max_seconds, resample=resample)
    blocks = measured_chunks(parts.withColumnRenamed("block", "chunk_id"), rate, length, hop, top_db, block, halo)
    spread, counts = tuple(SPREAD), SPREAD
    blocks, rejects = parted(settled(blocks), "chunk_id")
    top = blocks.groupBy("path").agg(
        F.max(F.array_max("levels")).alias("top"), *[F.try_divide(F.sum(c), F.sum(counts[c])).alias(f"{c}_center") for c in spread]
    )
    told = many_to_one(blocks, top, ["path"], "inner", spread_by=["chunk_id"])
    limit = F.col("top") * 10.0 ** (-top_db / 20.0)
    told = told.withColumn("__loud", F.size(F.filter("levels", lambda x: x > limit)))

    n, voiced = F.sum("frames"), F.sum("voiced")
    seconds = ((n - 1) * hop + length) / float(rate)
    zero = F.lit(0.0)

    def mean(c: str, count: Column) -> Column:
        return F.coalesce(F.try_divide(F.sum(c), count), zero)

    def std(c: str, count: Column) -> Column:
        """From the spreads inside the blocks and the distances of their means, without large squares."""
        away = F.coalesce(F.try_divide(F.col(c), F.col(counts[c])) - F.col(f"{c}_center"), zero)
        return F.sqrt(F.coalesce(F.try_divide(F.sum(F.coalesce(f"{c}_spread", zero) + F.col(counts[c]) * away * away), count), zero))

    features = told.groupBy("path").agg(
        mean("pitch", voiced).alias("pitch_mean"),
        std("pitch", voiced).alias("pitch_std"),
        mean("energy", n).alias("energy_mean"),
        std("energy", n).alias("energy_std"),
        (F.sum("onsets") / seconds).alias("speech_rate"),
        (1 - F.sum("__loud") / n).alias("pause_ratio"),
        mean("hnr", n).alias("hnr"),
        mean("zcr", n).alias("zcr_mean"),
        mean("spectral_centroid", n).alias("spectral_centroid_mean"),
        mean("spectral_rolloff", n).alias("spectral_rolloff_mean"),
        *[mean(c, n).alias(c) for c in MFCCS],
    )
    return features, rejects
