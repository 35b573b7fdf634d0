import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.functions import clock, mel, vectors
from refrain.functions.clock import Config
from refrain.operators import pca
from refrain.plans import encode


def noise(seconds=3.0, seed=42):
    return np.random.default_rng(seed).normal(0, 0.15, int(8000 * seconds))


def signals(spark, *named):
    return spark.createDataFrame([(n, 8000, x.tolist()) for n, x in named], "recording_id string, sample_rate int, pcm array<double>")


def rows(df):
    return {r.frame: r for r in df.collect()}


def test_constants_of_the_clock():
    c = Config()
    assert (c.raw_dim, c.dim) == (63, 32) and round(c.rate, 4) == 43.0108 and c.support == 0.84875 and c.first_centre == 0.360375
    assert round(c.bytes_per_hour() / 1e6, 3) == 19.819
    assert all(v.dim >= 1 for v in clock.variants().values())


@pytest.mark.parametrize("bad", [{"hop": 0}, {"f_min": 2000.0}, {"pca_dim": 64}, {"f_max": 5000.0}])
def test_bad_configs(bad):
    with pytest.raises(ValueError):
        Config(**bad)


def test_mel_bands_equal_a_direct_transform():
    x, c = noise(1.0), Config()
    padded = np.pad(x, 512)
    window = np.hanning(1025)[:-1]
    got = encode.mel_bands(x, c)
    for k in (0, 7, len(got) - 1):
        frame = padded[k * 186 : k * 186 + 1024] * window
        spectrum = np.abs([np.sum(frame * np.exp(-2j * np.pi * b * np.arange(1024) / 1024)) for b in range(513)])
        assert np.allclose(got[k], mel.filterbank(c) @ spectrum, rtol=1e-9)


def test_features_equal_numpy(spark):
    got = rows(encode.raw_features(encode.means(signals(spark, ("a", noise())))))
    bands = encode.moving_mean(encode.mel_bands(noise(), Config()), 32, 1)
    for k in (0, 5, len(bands) - 1):
        z = lambda v: (v - v.mean()) / v.std()
        assert np.allclose(got[k].raw, np.concatenate([z(bands[k]), z(np.diff(bands[k]))]), atol=1e-5)
        assert got[k].t == k * 186 / 8000 + 0.360375


def test_loudness_does_not_matter_and_silence_has_no_rows(spark):
    quiet, loud = (rows(encode.raw_features(encode.means(signals(spark, ("a", noise() * g))))) for g in (1, 4))
    assert quiet.keys() == loud.keys() and all(np.allclose(quiet[k].raw, loud[k].raw, atol=1e-4) for k in quiet)
    assert not rows(encode.raw_features(encode.means(signals(spark, ("s", np.zeros(8000)), ("e", np.zeros(0)), ("short", np.ones(100))))))


def test_frames_keep_their_numbers_across_a_pause(spark):
    x = np.concatenate([noise(1), np.zeros(16000), noise(1)])
    frames = sorted(rows(encode.raw_features(encode.means(signals(spark, ("a", x))))))
    gaps = np.diff(frames)
    assert gaps.max() > 30 and (gaps >= 1).all()


def test_half_precision_overflow(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "i int, raw array<float>")
    assert encode.half_precision(df, "raw").first().raw == [1.0, 2.0]
    with pytest.raises(Exception, match="overflows"):
        encode.half_precision(spark.createDataFrame([(1, [1e6])], "i int, raw array<float>"), "raw").collect()


def test_resampling_keeps_a_tone():
    t = np.arange(16000) / 16000
    out = encode.resampled(np.sin(2 * np.pi * 440 * t), 16000, 8000)
    assert abs(len(out) - 8000) <= 1 and np.allclose(out[500:-500], np.sin(2 * np.pi * 440 * np.arange(len(out)) / 8000)[500:-500], atol=0.02)
    with pytest.raises(ValueError):
        encode.resampled(np.array([np.nan]), 8000, 8000)


def test_pca(spark, tmp_path):
    x = np.random.default_rng(1).normal(size=(500, 6)) * [9, 5, 3, 1, 0.5, 0.1]
    model = pca.fit(spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(5), 3)
    values, axes = np.linalg.eigh(np.cov(x.T))
    for got, want in zip(model.components, axes.T[::-1]):
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-8) and got[np.abs(got).argmax()] > 0
    assert np.allclose(model.explained, values[::-1][:3] / values.sum()) and np.allclose(model.mean, x.mean(axis=0))
    pca.save(model, spark, str(tmp_path / "m"))
    assert pca.load(spark, str(tmp_path / "m")) == model
    with pytest.raises(ValueError):
        pca.fit(spark.createDataFrame([([1.0, 2.0],)], "v array<double>"), 2)


def test_flat_rows_standardize_to_zeros(spark):
    df = spark.createDataFrame([([2.0] * 5,)], "v array<double>").select(vectors.standardized(F.col("v")).alias("z"))
    assert df.first().z == [0.0] * 5
