"""The mel scale (Slaney's: linear below 1 kHz, logarithmic above) and its triangular filters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from refrain.functions.clock import Config

#: Hertz per mel below the knee, the knee in hertz and mels, and the logarithmic step above it.
HZ_PER_MEL, KNEE_HZ, KNEE_MEL, STEP = 200.0 / 3.0, 1000.0, 15.0, np.log(6.4) / 27.0


def hz_to_mel(f: Column) -> Column:
    return F.when(f >= KNEE_HZ, KNEE_MEL + F.log(F.greatest(f, F.lit(KNEE_HZ)) / KNEE_HZ) / F.lit(float(STEP))).otherwise(f / F.lit(HZ_PER_MEL))


def mel_to_hz(m: Column) -> Column:
    return F.when(m >= KNEE_MEL, KNEE_HZ * F.exp(F.lit(float(STEP)) * (m - KNEE_MEL))).otherwise(m * F.lit(HZ_PER_MEL))


def filterbank(c: Config = Config()) -> np.ndarray:
    """Weights (band, bin) of triangles of equal area between evenly spaced mels; a band without a bin raises ValueError."""
    to_mel = lambda f: KNEE_MEL + np.log(f / KNEE_HZ) / STEP if f >= KNEE_HZ else f / HZ_PER_MEL
    mels = np.linspace(to_mel(c.f_min), to_mel(c.f_max), c.n_mels + 2)
    edges = np.where(mels >= KNEE_MEL, KNEE_HZ * np.exp(STEP * (mels - KNEE_MEL)), mels * HZ_PER_MEL)
    bins = np.arange(c.n_fft // 2 + 1) * c.sample_rate / c.n_fft
    low, mid, high = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    weights = np.clip(np.minimum((bins - low) / (mid - low), (high - bins) / (high - mid)), 0, None) * (2 / (high - low))
    if not (weights > 0).any(axis=1).all():
        raise ValueError("a band holds no bin of the transform")
    return weights
