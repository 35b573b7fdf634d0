"""Signals to fingerprints: frames, spectra, mel bands, moving means, the silence gate, features, components.

The transform has no native form, so the part up to the moving means runs over Arrow batches, a recording at a time and its spectra in
blocks; the rest are column expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.functions import clock, mel, vectors
from refrain.functions.clock import Config
from refrain.operators.pca import Pca

#: Frames whose spectra are in memory at once.
BLOCK = 2048


def mel_bands(pcm: np.ndarray, c: Config) -> np.ndarray:
    """Band energies by frame; a signal shorter than a frame has none."""
    weights = mel.filterbank(c)
    x = np.pad(pcm, c.n_fft // 2) if c.pad else pcm
    if len(x) < c.n_fft:
        return np.zeros((0, c.n_mels))
    frames = np.lib.stride_tricks.sliding_window_view(x, c.n_fft)[:: c.hop]
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(c.n_fft) / c.n_fft)
    return np.concatenate([np.abs(np.fft.rfft(frames[i : i + BLOCK] * window)) ** c.power @ weights.T for i in range(0, len(frames), BLOCK)])


def moving_mean(bands: np.ndarray, width: int, stride: int) -> np.ndarray:
    """Means of so many frames in a row; with fewer frames than that none."""
    if len(bands) < width:
        return bands[:0]
    sums = np.concatenate([np.zeros((1, bands.shape[1])), np.cumsum(bands, axis=0)])
    return ((sums[width:] - sums[:-width]) / width)[::stride]


def resampled(pcm: np.ndarray, rate: int, wanted: int) -> np.ndarray:
    """Mono at the wanted rate: channels averaged, then a windowed-sinc low-pass at the ratio of the rates, of which only the wanted samples are computed:
    those of one phase of the filter are products of strided windows."""
    x = np.asarray(pcm, float)
    x = x.mean(axis=1) if x.ndim == 2 else x
    if not np.isfinite(x).all():
        raise ValueError("a sample is not finite")
    if rate == wanted or not len(x):
        return x
    g = np.gcd(rate, wanted)
    up, down = int(wanted // g), int(rate // g)
    taps = 10 * max(up, down)
    n = np.arange(-taps, taps + 1)
    low_pass = np.sinc(n / max(up, down)) * np.kaiser(2 * taps + 1, 5.0) / max(up, down) * up
    total = -(-len(x) * up // down)
    width = 2 * taps // up + 2
    out = np.empty(total)
    wide = np.concatenate([np.zeros(width), x, np.zeros(width + down + 1)])
    for phase in range(min(up, total)):
        first = -((taps - phase * down) // up)  # the first sample that the filter reaches from there
        reach = np.arange(first, (taps + phase * down) // up + 1)
        count = -(-(total - phase) // up)
        windows = np.lib.stride_tricks.sliding_window_view(wide, len(reach))[width + first :: down][:count]
        weights = low_pass[taps + phase * down - reach * up]
        for at in range(0, count, BLOCK * 16):  # so many rows of the strided view are copied at once
            part = windows[at : at + BLOCK * 16]
            out[phase + at * up : phase + (at + len(part) - 1) * up + 1 : up] = part @ weights
    return out


def means(signals: DataFrame, c: Config = Config()) -> DataFrame:
    """recording_id, frame and bands of signals (recording_id, sample_rate, pcm). A null or empty signal has no rows."""
    schema = pa.schema([("recording_id", pa.string()), ("frame", pa.int64()), ("bands", pa.list_(pa.float64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for name, rate, pcm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                samples = pcm.values.to_numpy(zero_copy_only=False).astype(float) if pcm.is_valid else np.zeros(0)
                rows = moving_mean(mel_bands(resampled(samples, rate or c.sample_rate, c.sample_rate), c), c.window, c.stride)
                bands = pa.ListArray.from_arrays(np.arange(0, rows.size + 1, c.n_mels, dtype=np.int32), rows.ravel())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array(np.arange(len(rows)) * c.stride), bands], schema=schema)

    return signals.select(F.col("recording_id").cast("string"), "sample_rate", "pcm").mapInArrow(run, "recording_id string, frame bigint, bands array<double>")


def sparse_windows(signals: DataFrame, seconds: float, hop: float, factor: int = 1) -> DataFrame:
    """recording_id, start (samples), t and window of signals: whole windows of so many seconds, one every round(hop * factor * rate) samples; what remains is dropped."""
    size, step = F.rint(F.lit(seconds) * F.col("sample_rate")).cast("int"), F.rint(F.lit(hop * factor) * F.col("sample_rate")).cast("int")
    own = signals.where(F.size("pcm") >= size).select("recording_id", "sample_rate", "pcm", size.alias("size"), F.explode(F.sequence(F.lit(0), F.size("pcm") - size, step)).alias("start"))
    return own.select("recording_id", "start", (F.col("start") / F.col("sample_rate")).alias("t"), F.slice("pcm", F.col("start") + 1, F.col("size")).alias("window"))


def derived(raw: DataFrame, name: str, bands: int = 32) -> DataFrame:
    """The raw features (frame, raw, ...) of a variant, from those of the base, where these hold what it takes; else ValueError."""
    if name in ("default", "no_pca") or name.startswith("pca"):
        return raw
    if name == "no_deltas":
        return raw.withColumn("raw", F.slice("raw", 1, bands))
    if name == "fp16_roundtrip":
        return half_precision(raw, "raw")
    if name == "stride2":
        return raw.where(clock.on_grid(F.col("frame"), 2))
    raise ValueError(f"{name} needs other features than the base's")


def raw_features(bands: DataFrame, c: Config = Config()) -> DataFrame:
    """recording_id, frame, t and raw of what is audible. Frames keep their numbers."""
    heard = bands.where(vectors.audible(F.col("bands"), c.silence_sd, c.silence_mean))
    own = vectors.standardized(F.col("bands"), c.eps) if c.standardize else vectors.doubles(F.col("bands"))
    steps = vectors.differences(F.col("bands"))
    steps = vectors.standardized(steps, c.eps) if c.standardize else steps
    raw = (F.concat(own, steps) if c.deltas else own).cast("array<float>")
    return heard.select("recording_id", "frame", clock.time_of(F.col("frame"), c).alias("t"), raw.alias("raw"))


def half_precision(rows: DataFrame, column: str) -> DataFrame:
    """The column rounded to half precision; what overflows raises ValueError."""
    at = rows.columns.index(column)
    schema = rows.schema

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            found = []
            for v in batch.column(at).to_pylist():
                with np.errstate(over="ignore"):
                    half = np.array(v, np.float32).astype(np.float16)
                if not np.isfinite(half).all():
                    raise ValueError("a value overflows half precision")
                found.append(half.astype(np.float32).tolist())
            columns = list(batch.columns)
            columns[at] = pa.array(found, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, schema)


def fingerprints(raw: DataFrame, model: Pca | None) -> DataFrame:
    """recording_id, frame, t and v: the raw features in the model's components, or as they are."""
    v = F.col("raw") if model is None else vectors.projected(F.col("raw"), model.components, model.mean).cast("array<float>")
    return raw.select("recording_id", "frame", "t", v.alias("v"))
