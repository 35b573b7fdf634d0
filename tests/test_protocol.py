import numpy as np
import pytest
from pyspark.sql import functions as F

from refrain.operators import bootstrap, calibrate, evaluate, protocol, relating, validate
from refrain.sources import files


def test_roles_do_not_depend_on_order(spark):
    ids = [(f"t{i:03d}",) for i in range(100)]
    a, b = ({r.s: r.role for r in protocol.assign_roles(spark.createDataFrame(x, "s string").repartition(p), "s", "1").collect()} for x, p in ((ids, 1), (ids[::-1], 5)))
    assert a == b
    sizes = {role: list(a.values()).count(role) for role in set(a.values())}
    assert sizes == {"pca_fit": 10, "calibration_known": 15, "calibration_unknown": 10, "test_known": 55, "test_unknown": 10}


def test_contaminated_unknowns_are_not_evaluated(spark):
    roles = spark.createDataFrame([("k", "test_known"), ("u", "test_unknown"), ("p", "pca_fit")], "source_id string, role string")
    qs = spark.createDataFrame([(1, "u", ["k"]), (2, "u", ["p"]), (3, "k", ["k"]), (4, "u", None)], "query_id int, source_id string, overlapping array<string>")
    assert {r.query_id: (r.contaminated, r.evaluate) for r in protocol.split(qs, roles).collect()} == {1: (True, False), 2: (False, True), 3: (False, True), 4: (False, True)}


def scores(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "score double")


@pytest.mark.parametrize("values, accepts", [(np.arange(100) / 100, 1), (np.arange(74) / 100, 0), ([0.5] * 100, 0)])
def test_thresholds(spark, values, accepts):
    g = calibrate.threshold(scores(spark, values), 0.01).first()
    assert g.false_accepts == accepts == sum(v > g.gate for v in values)
    assert calibrate.next_above(g.gate) > g.gate


def test_thresholds_of_nothing_and_of_infinities(spark):
    assert calibrate.threshold(scores(spark, []), 0.01).collect() == []
    with pytest.raises(Exception, match="finite"):
        calibrate.threshold(scores(spark, [1.0, float("inf")]), 0.01).collect()


def test_wilson(spark):
    r = spark.range(1).select(*(c.alias(n) for c, n in zip(calibrate.wilson(F.lit(0), F.lit(71)), ("low", "high"))), *(c.alias(n) for c, n in zip(calibrate.wilson(F.lit(0), F.lit(0)), ("a", "b")))).first()
    assert r.low == 0 and 0.05 < r.high < 0.052 and r.a is None


def test_bootstrap(spark):
    rows = spark.createDataFrame([("all", i, 1 - i, 3 * (1 - i), 3) for i in (0, 1)], "g string, place int, x int, s int, n int")
    r = bootstrap.cluster_interval(rows, ["g"]).first()
    assert (r.estimate, r.low, r.high) == (0.5, 0.0, 1.0)
    crossed = spark.createDataFrame([("all", i // 2, i % 2, int(i % 2 == 0), 1) for i in range(12)], "g string, source int, montage int, s int, n int")
    r = bootstrap.crossed_interval(crossed, ["g"]).first()
    assert r.low <= r.estimate <= r.high
    again = bootstrap.crossed_interval(crossed.repartition(5), ["g"]).first()
    assert (r.low, r.high) == (again.low, again.high)


def test_band_gains(spark):
    r = np.random.default_rng(8)
    log = np.linspace(-1, 1, 8)
    rows = []
    for i in range(40):
        base = np.exp(r.normal(size=8))
        rows += [(i, "reference", base.tolist()), (i, "query", (base * np.exp(-log) * r.choice([0.2, 1, 5])).tolist())]
    got = [x.gain for x in evaluate.band_gains(spark.createDataFrame(rows, "pair_id int, side string, mel array<double>")).orderBy("band").collect()]
    assert np.allclose(np.log(got), log - log.mean(), atol=1e-9)


def test_flags_never_take_null_for_a_hit(spark):
    rows = spark.createDataFrame([(None, None, 9.0, None, 1.0), ("a", "a", 0.5, 3.5, 1.0), ("a", "a", 0.4, 1.0, 1.0), ("a", "b", 0.9, 1.0, 1.0)], "target_id string, found_id string, score double, offset_s double, expected_s double")
    got = [(x.correct, x.localized, x.accepted, x.accepted_wrong) for x in evaluate.flags(rows, F.lit(0.4)).collect()]
    assert got == [(False, False, False, False), (True, False, True, False), (True, True, False, False), (False, False, True, True)]


def test_nearest_time_ties_and_edges(spark):
    left = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 0.0), ("k", 3, 99.0), ("other", 4, 1.0)], "key string, id int, t double")
    right = spark.createDataFrame([("k", 4.0), ("k", 6.0)], "key string, t double")
    assert {r.id: r.near for r in relating.nearest_time(left, right, "key").collect()} == {1: 6.0, 2: 4.0, 3: 6.0, 4: None}


def test_segments(spark):
    segments = spark.createDataFrame([("a", 0, 3), ("empty", 3, 3), ("b", 3, 7), ("c", 7, 10_000)], 'content_id string, start bigint, end bigint')
    rows = spark.createDataFrame([(i,) for i in (0, 2, 3, 6, 7, 4095, 4096, 9999, 10_000)], "row bigint")
    assert {r.row: r.content_id for r in relating.in_segment(rows, segments).collect()} == {0: "a", 2: "a", 3: "b", 6: "b", 7: "c", 4095: "c", 4096: "c", 9999: "c"}


def test_constraints(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0), (2, 2.0)], "k int, x double")
    assert validate.repeated(a, ["k"]).count() == 1 and validate.not_the_same(a, a.repartition(3)).count() == 0
    b = spark.createDataFrame([(1, 1.0 + 1e-13), (3, 1.0)], "k int, x double")
    assert {r.k for r in validate.unequal(a.distinct(), b, "k", "x").collect()} == {2, 3}
    members = spark.createDataFrame([(n, 1, False, False) for n in ("ok/a", "/abs", "a/../b", "w\\x", "C:x", "twice", "twice")], "name string, size int, is_link boolean, is_encrypted boolean")
    assert {r.name for r in validate.unsafe_members(members, 10).collect()} == {"/abs", "a/../b", "w\\x", "C:x", "twice"}


def test_audio_and_csv_sources(spark, tmp_path):
    import wave

    x = (np.sin(np.arange(8000) / 5) * 30000).astype("<i2")
    for name in ("one", "two"):
        with wave.open(str(tmp_path / f"{name}.wav"), "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(8000)
            w.writeframes(x.tobytes())
    found = {r.recording_id: r for r in files.audio(spark, str(tmp_path)).collect()}
    assert found.keys() == {"one", "two"} and found["one"].duration_s == 1.0 and np.allclose(found["one"].pcm, x / 32768, atol=1e-6)
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "one.wav").write_bytes((tmp_path / "one.wav").read_bytes())
    with pytest.raises(ValueError, match="stem"):
        files.audio(spark, str(tmp_path))
    (tmp_path / "a.csv").write_bytes("﻿name,note\nx,\"a,\nb\"\n".encode())
    assert [tuple(r) for r in files.csv(spark, str(tmp_path / "a.csv"), ["name", "note"]).collect()] == [("x", "a,\nb")]
    (tmp_path / "b.csv").write_text(",track,track\n,title,genre\nid,,\n2,T,G\n")
    assert [tuple(r) for r in files.csv_two_headers(spark, str(tmp_path / "b.csv"), [("track", "title"), ("track", "genre")]).collect()] == [("000002", "T", "G")]


def test_cache_computes_what_it_lacks(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []
    wanted = spark.createDataFrame([("c", "a"), ("c", "b")], "config_key string, source_key string")

    def compute(missing):
        calls.append(missing.count())
        return missing.withColumn("v", F.lit(1))

    assert files.cached(spark, path, wanted.limit(1), compute).count() == 1
    assert files.cached(spark, path, wanted, compute).count() == 2 and calls == [1, 1]


def test_keys_crops_and_conditions(spark):
    row = files.creator_key(spark.createDataFrame([("  Ａßc ",), (None,)], "creator string"), "creator").collect()
    assert [r.creator_key for r in row] == ["assc", None]
    signal = spark.createDataFrame([(8, [float(i) for i in range(24)], 10.0, 2.0)], "sample_rate int, pcm array<float>, expected_start double, scale double")
    forms = {r.condition: r for r in files.boundary_variants(signal).collect()}
    assert forms["lead_one"].pcm[:9] == [0.0] * 8 + [0.0] and forms["lead_one"].expected_start == 8.0 and forms["trim_one"].pcm[0] == 8.0 and forms["trim_one"].expected_start == 12.0
    crop = signal.select(files.pcm_crop(F.col("pcm"), F.col("sample_rate"), F.lit(1.0), F.lit(1.0)).alias("x"), files.pcm_crop(F.col("pcm"), F.col("sample_rate"), F.lit(2.5), F.lit(2.0)).alias("y")).first()
    assert crop.x == [float(i) for i in range(8, 16)] and crop.y is None
    x = np.sin(np.arange(8000) / 3)
    for name in ("clean", "gain_up", "gain_down", "clip", "noise", "preemphasis", "tilt_up", "tilt_down", "packets"):
        assert len(files.perturbed(x, 8000, name, 1)) == 8000
    assert abs(np.abs(files.perturbed(x, 8000, "clip", 1)).max() - 0.4 * np.abs(x).max()) < 1e-12
    assert spark.range(1).select(files.portable(F.lit("/data/root/a\\b.wav"), "/data/root").alias("p")).first().p == "a/b.wav"


def test_enrolment_holds_each_recording_once(spark, tmp_path):
    from refrain.streaming.enroll import digest, enroll_batch

    prints = spark.createDataFrame([(c, k, [float(k)]) for c in "abc" for k in range(10)], "content_id string, frame bigint, v array<double>")
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    for i, part in enumerate(["a", "b", "a", "c"]):
        enroll_batch(prints.where(F.col("content_id") == part), i, one, 2)
    enroll_batch(prints.where("content_id = 'c'"), 3, one, 2)  # the last batch comes again
    enroll_batch(prints, 0, two, 2)
    assert digest(spark, one) == digest(spark, two) and spark.read.parquet(one).count() == 15
