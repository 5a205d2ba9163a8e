"""Rate conversion by a windowed-sinc polyphase kernel.

Output sample n of a recording stands at source place n * source / target. Every output is the sum of the source samples within
``reach`` places around it, weighted by a sinc at the lower of the two Nyquist frequencies under a Hann window; a recording is zero
outside of its samples. An output depends on its place in the recording only, so parts that are converted on their own, with
``reach`` samples more on both sides, fit together without a seam. Places that fall on source samples keep their value when
the rate goes up.
"""

from __future__ import annotations

from math import ceil, gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LOBES = 32  #: zero crossings of the sinc on each side
LOWEST, HIGHEST = 1_000, 768_000  #: source rates that are converted


def reach_of(source: int, target: int) -> int:
    """Source samples that an output needs on each side."""
    return ceil(LOBES * max(1.0, source / target))


def taps(offset: np.ndarray, source: int, target: int) -> np.ndarray:
    """The weights of source samples at distances ``offset`` (in source samples) from an output; rows sum to 1."""
    share = min(1.0, target / source)
    x = offset * share
    weight = np.where(np.abs(x) < LOBES, np.sinc(x) * (0.5 + 0.5 * np.cos(np.pi * x / LOBES)), 0.0)
    return weight / weight.sum(axis=1, keepdims=True)


def converted(y: np.ndarray, first: int, source: int, target: int, start: int, count: int) -> np.ndarray:
    """Outputs ``start`` .. ``start + count - 1`` of a recording of which ``y`` holds the samples from ``first`` on."""
    common = gcd(source, target)
    up, down = target // common, source // common
    reach = reach_of(source, target)
    # Zeros where the recording, or what is known of it, ends.
    lowest, highest = start * down // up - reach, (start + count - 1) * down // up + reach + 1
    padded = np.zeros(highest - lowest + 1)
    a, b = max(first, lowest), min(first + len(y), highest + 1)
    if b > a:
        padded[a - lowest : b - lowest] = y[a - first : b - first]
    around = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    out = np.empty(count)
    near = np.arange(-reach, reach + 1)
    for k in range(min(up, count)):  # outputs of one phase stand alike between source samples
        n = start + k
        place, phase = n * down // up, n * down % up
        weight = taps((near - phase / up)[None], source, target)[0]
        number = len(range(k, count, up))
        rows = around[place - reach - lowest :: down][:number]
        out[k::up] = rows @ weight
    return out


def pcm_at_rate(pcm: Column, channels: Column, source: Column, first: Column, start: Column, count: Column, target: int) -> Column:
    """PCM16 of one channel at the rate ``target`` from PCM16 bytes of a part; NULL bytes stay NULL."""
    from lookout.sources.files import decode_pcm16

    @F.pandas_udf("binary")
    def convert(pcm: pd.Series, channels: pd.Series, source: pd.Series, first: pd.Series, start: pd.Series, count: pd.Series) -> pd.Series:
        out = []
        for part in zip(pcm, channels, source, first, start, count):
            if part[0] is None:
                out.append(None)
                continue
            y = converted(decode_pcm16(part[0], int(part[1])), int(part[3]), int(part[2]), target, int(part[4]), int(part[5]))
            out.append(np.clip(np.rint(y * 32768.0), -32768, 32767).astype("<i2").tobytes())
        return pd.Series(out, dtype=object)

    return convert(pcm, channels, source, first, start, count)
