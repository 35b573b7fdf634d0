"""Cells of time, quantile bounds, drawn parts, frozen studies, resumable extraction, archives and paths."""

import io
import random
import time
import wave
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from refrain.functions import clock
from refrain.operators import bootstrap, calibrate, evaluate, matching, protocol, relating, validate
from refrain.plans import encode, freeze
from refrain.plans.gallery import Gallery
from refrain.sources import files
from refrain.streaming import enroll


def test_nearest_time_equals_brute_force(spark):
    r = random.Random(1)
    left = [(r.choice("ab"), i, r.choice([None, float(r.randrange(400))])) for i in range(300)]
    right = [(r.choice("abc"), r.choice([None, float(r.randrange(400))])) for _ in range(60)]
    a, b = spark.createDataFrame(left, "k string, id int, t double"), spark.createDataFrame(right, "k string, t double")
    want = {}
    for k, i, t in left:
        own = [x for key, x in right if key == k and x is not None]
        want[i] = min(own, key=lambda x: (abs(x - t), -x)) if own and t is not None else None
    for width in (7.0, 1e6):
        assert {x.id: x.near for x in relating.nearest_time(a, b, "k", width).collect()} == want


def test_nearest_time_is_linear_in_a_hot_key(spark):
    def took(n):
        left = spark.range(n).select(F.lit("k").alias("k"), "id", (F.col("id") * 2.0).alias("t"))
        right = spark.range(n).select(F.lit("k").alias("k"), (F.col("id") * 2.0 + 0.5).alias("t"))
        began = time.perf_counter()
        assert relating.nearest_time(left, right, "k", 1e9).agg(F.sum("near")).first()[0] > 0
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 2 * took(20_000) + 2


def test_overlaps_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.choice("ab"), r.choice("xyz"), float(b := r.randrange(200)), float(b + r.choice([0, 1, 5, 40, 150, -3]))) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, k string, n string, begin double, end double")
    want = {(a[0], b[0], b[2], min(a[4], b[4]) - max(a[3], b[3])) for a in rows for b in rows if a[0] != b[0] and a[1] == b[1] and min(a[4], b[4]) - max(a[3], b[3]) > 0}
    for width in (10.0, 3600.0):
        got = [tuple(x) for x in relating.overlapping(df, "k", "n", width=width).collect()]
        assert len(got) == len(want) and set(got) == want
        crops = df.select(F.col("id").alias("crop"), "k", "begin", "end")
        got = {tuple(x) for x in relating.admissible(crops, df, "k", "n", width=width).collect()}
        assert got == {(a[0], b[2]) for a in rows for b in rows if a[1] == b[1] and min(a[4], b[4]) - max(a[3], b[3]) > 1e-6}


@pytest.mark.parametrize("accuracy", [100, 10_000])
def test_thresholds_equal_a_sort(spark, accuracy):
    r = np.random.default_rng(3)
    for values in (r.normal(size=3000), np.round(r.normal(size=3000), 1), np.zeros(50), r.normal(size=7)):
        scores = spark.createDataFrame([(float(v), i % 3) for i, v in enumerate(values)], "score double, g int").repartition(3)
        for target in (0.0, 0.001, 0.01, 0.3, 0.999):
            order = np.sort(values)[::-1]
            gate = order[int(np.floor(target * len(values)))]
            x = calibrate.threshold(scores, target, accuracy=accuracy).first()
            assert (x.gate, x.unknowns, x.false_accepts) == (gate, len(values), int((values > gate).sum()))
        for x in calibrate.threshold(scores, 0.05, ["g"], accuracy).collect():
            own = values[x.g :: 3]
            gate = np.sort(own)[::-1][int(np.floor(0.05 * len(own)))]
            assert (x.gate, x.unknowns, x.false_accepts) == (gate, len(own), int((own > gate).sum()))


def test_rows_are_numbered_in_order(spark):
    keys = random.Random(4).sample(range(-10**6, 10**6), 500)
    df = spark.createDataFrame([(k,) for k in keys], "k bigint").repartition(4)
    for cells in (1, 7, 4096):
        assert {x.k: x.row for x in relating.numbered(df, "k", cells=cells).collect()} == {k: i for i, k in enumerate(sorted(keys))}
    assert relating.numbered(df.limit(0), "k").collect() == []


def test_draws_in_parts_are_the_same_draws(monkeypatch):
    r = np.random.default_rng(1)
    rows = pd.DataFrame({"source": r.integers(0, 9, 60), "montage": r.integers(0, 5, 60), "s": r.integers(0, 3, 60), "n": 3})
    whole = bootstrap.crossed_rates(rows, 5, 300, ["s"])["s"]
    monkeypatch.setattr(bootstrap, "DRAWN", 700)
    assert np.array_equal(bootstrap.crossed_rates(rows, 5, 300, ["s"])["s"], whole)
    one, parts = np.random.default_rng(7), np.random.default_rng(7)
    assert np.array_equal(one.integers(0, 13, (50, 13)), np.concatenate([parts.integers(0, 13, (k, 13)) for k in (7, 7, 36)]))


def test_studies_are_frozen_once(spark, tmp_path):
    path = f"file://{tmp_path}/gate"
    rows = spark.createDataFrame([("calibration_unknown", i / 100) for i in range(100)] + [("calibration_known", 5.0)], "role string, score double")
    with pytest.raises(FileNotFoundError):
        freeze.gate_of(spark, path)
    with pytest.raises(ValueError, match="calibration rows"):
        freeze.freeze_gate(rows.unionByName(rows.limit(1).withColumn("role", F.lit("test_known"))), 0.05, path)
    assert freeze.freeze_gate(rows, 0.05, path, code="a") == 0.94 == freeze.freeze_gate(rows, 0.05, path, code="a")
    with pytest.raises(ValueError, match="another plan"):
        freeze.freeze_gate(rows, 0.05, path, code="b")
    assert spark.range(1).select(freeze.gate_of(spark, path)).first()[0] == 0.94
    flags = lambda *xs: spark.createDataFrame(list(xs), "correct boolean, accepted boolean")
    before = flags((True, False), (False, False))
    assert freeze.helpful(before, flags((True, True), (True, False)), ["correct", "accepted"])
    assert not freeze.helpful(before, flags((True, True), (False, False)), ["correct", "accepted"])


def test_gains_are_checked_and_applied(spark):
    gains = [2.0, 0.5, 1.0]
    rows = spark.createDataFrame([([1.0, 2.0, 3.0],), (None,)], "bands array<double>")
    assert [x.bands for x in evaluate.with_gains(rows, gains, 3).collect()] == [[2.0, 1.0, 3.0], None]
    for bad in ([1.0, 1.0], [2.0, 1.0, 1.0], [0.0, 1.0, 1.0], [float("nan"), 1.0, 1.0]):
        with pytest.raises(ValueError):
            evaluate.with_gains(rows, bad, 3)
    with pytest.raises(PySparkException):
        evaluate.with_gains(spark.createDataFrame([([1.0],)], "bands array<double>"), gains, 3).collect()


def test_protocols_reject_what_breaks_them(spark):
    refs = spark.createDataFrame([("a", "x", "s0"), ("a", "x", "s1")], "reference_id string, creator string, session string")
    with pytest.raises(PySparkException):
        protocol.session_protocol(refs, "s0", "open").collect()
    q = spark.createDataFrame([("q", 1, "test_known", 0.0, 5.0, 0.0)], "query_id string, source_id int, role string, start_s double, duration_s double, expected_s double")
    with pytest.raises(PySparkException):
        protocol.extended_unknowns(q, spark.createDataFrame([(1, 9.0)], "source_id int, duration_s double"), q, "x").collect()
    with pytest.raises(PySparkException):
        protocol.unseen(spark.createDataFrame([("a",)], "reference_id string"), spark.createDataFrame([], "reference_id string, subset string"), []).collect()
    names = spark.createDataFrame([("a@b@c",), ("plain",), (None,)], "x string").select(protocol.base_id(F.col("x")).alias("a"), protocol.base_id(F.col("x"), True).alias("b"))
    assert [tuple(x) for x in names.collect()] == [("a", "a@b"), ("plain", "plain"), (None, None)]
    speech = protocol.speech_protocol(spark.createDataFrame([(f"{s}-{u}", 4.0 + u) for s in range(40) for u in range(4)], "reference_id string, duration_s double"), "s").collect()
    assert {x.reference_id.split("-")[1] for x in speech} == {"2", "3"} and len({(x.speaker, x.role) for x in speech}) == len({x.speaker for x in speech})


def test_affine_never_falls_below_the_consensus(spark):
    r = np.random.default_rng(2)
    rows = []
    for g in range(12):
        slope = r.choice([1.0, 1.0, 0.8, 1.5])
        for i in range(r.integers(2, 12)):
            for _ in range(2):
                t = i * 0.3
                rows.append((g, "c", i, t, float(slope * t + 5 + r.choice([0, 0.1, 0.23, 3.0])), float(r.random())))
    rows += [(50, "c", i, float(i), float(i + off), 0.5) for i, off in enumerate((0, 0.23, 0, 0.23))]
    near = spark.createDataFrame(rows, "query_id int, content_id string, qrow int, qt double, rt double, distance double")
    counts = near.groupBy("query_id").agg(F.countDistinct("qrow").alias("n"))
    unit = {x.query_id: (x.votes, -round(x.mean_distance, 9)) for x in matching.consensus(near, counts).collect()}
    found = {x.query_id: (x.votes, -round(x.mean_distance, 9)) for x in matching.affine(near).collect()}
    assert unit[50][0] == 4 == found[50][0]
    assert all(found[g] >= unit[g] for g in unit) and any(found[g][0] > unit[g][0] for g in unit)
    with pytest.raises(ValueError):
        matching.affine(near, low=1.1)


def test_galleries_check_times_and_keep_centroids(spark, tmp_path):
    prints = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(8)], "content_id string, frame bigint, v array<double>")
    centroids = [(0, [0.0, 1.0]), (1, [7.0, 1.0])]
    gallery = Gallery.from_fingerprints(prints, centroids=centroids, probes=2)
    ask = lambda *ts: spark.createDataFrame([("q", i, t, [float(i), 1.0]) for i, t in enumerate(ts)], "query_id string, qrow bigint, qt double, v array<double>")
    for bad in ((0.0, 0.0), (1.0, 0.5), (float("nan"), 1.0), (0.0, float("inf"))):
        with pytest.raises(ValueError, match="increasing"):
            gallery.match(ask(*bad))
    gallery.save(str(tmp_path / "g"))
    again = Gallery.load(spark, str(tmp_path / "g"))
    assert list(again.centroids) == centroids and again.probes == 2
    key = lambda g: [tuple(x) for x in g.match(ask(0.0, 0.02325)).collect()]
    assert key(again) == key(gallery) != []


@pytest.mark.parametrize("rate, wanted", [(16000, 8000), (11025, 8000), (44100, 8000), (6000, 8000)])
def test_resampling_equals_the_plain_filter(rate, wanted):
    r = np.random.default_rng(1)
    up, down = wanted // np.gcd(rate, wanted), rate // np.gcd(rate, wanted)
    taps = 10 * max(up, down)
    n = np.arange(-taps, taps + 1)
    filter_ = np.sinc(n / max(up, down)) * np.kaiser(2 * taps + 1, 5.0) / max(up, down) * up
    for size in (1, 40, 999):
        x = r.normal(size=size)
        wide = np.zeros(size * up)
        wide[::up] = x
        assert np.allclose(encode.resampled(x, rate, wanted), np.convolve(wide, filter_)[taps : taps + len(wide)][::down], atol=1e-9)


def test_a_minute_is_resampled_in_seconds():
    x = np.sin(np.arange(44_100 * 60) * 2 * np.pi * 500 / 44_100)
    began = time.perf_counter()
    y = encode.resampled(x, 44_100, 8000)
    assert time.perf_counter() - began < 5 and np.abs(y[100:-100] - np.sin(np.arange(480_000) * 2 * np.pi * 500 / 8000)[100:-100]).max() < 0.02


def test_variants_and_what_the_base_gives(spark):
    found = clock.variants()
    assert set(found) == {"default", "no_standardization", "no_deltas", "fp16_roundtrip", "no_pca", "window16", "window48", "stride2", "pca16", "pca32", "mel64_pca64"}
    wide = clock.variants(clock.Config(n_mels=64))
    assert "pca64" in wide and "mel64_pca64" not in wide
    raw = spark.createDataFrame([(i, [i / 3] * 63) for i in range(4)], "frame bigint, raw array<float>")
    assert [len(x.raw) for x in encode.derived(raw, "no_deltas").collect()] == [32] * 4
    assert [x.frame for x in encode.derived(raw, "stride2").collect()] == [0, 2] and encode.derived(raw, "pca16") is raw
    assert encode.derived(raw, "fp16_roundtrip").collect()[1].raw[0] == float(np.float16(1 / 3))
    with pytest.raises(ValueError):
        encode.derived(raw, "window16")


def test_audio_of_all_widths_and_failures(spark, tmp_path):
    x = np.round(np.sin(np.arange(800) / 5) * 2**22).astype("<i4")
    with wave.open(str(tmp_path / "deep.wav"), "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(3)
        w.setframerate(8000)
        w.writeframes(b"".join(int(v).to_bytes(3, "little", signed=True) for v in x))
    (tmp_path / "bad.wav").write_bytes(b"no audio")
    with pytest.raises(PySparkException):
        files.audio(spark, str(tmp_path)).collect()
    found = {r.recording_id: r for r in files.audio(spark, str(tmp_path), failures=True).collect()}
    assert np.allclose(found["deep"].pcm, x / 2**23, atol=1e-6) and found["deep"].duration_s == found["deep"].container_s == 0.1 and found["deep"].error is None
    assert found["bad"].error and found["bad"].pcm is None and found["bad"].duration_s is None
    names = spark.createDataFrame([("deep",), ("missing",)], "recording_id string")
    assert {tuple(r) for r in files.same_set(files.audio(spark, str(tmp_path), failures=True), names, "recording_id").collect()} == {("bad", "file"), ("missing", "annotation")}
    assert set(files.decoder_info()) == {"decoder", "python", "numpy"}


def test_tables_in_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("m/tracks.csv", 'x,set,track,track\n,subset,title,"a,b"\nid,,,\n2,small,"T, t",G\n13,large,U,H\n')
    (tmp_path / "a.zip").write_bytes(data.getvalue())
    read = lambda *subsets: sorted(tuple(r) for r in files.csv_in_zip(spark, str(tmp_path / "a.zip"), "m/tracks.csv", [("track", "title"), ("set", "subset")], subsets).collect())
    assert read() == [("000002", "T, t", "small"), ("000013", "U", "large")] and read("small", "medium") == [("000002", "T, t", "small")]


def test_results_replace_their_partition(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = lambda v: spark.createDataFrame([("a", 5, v), ("b", 5, v)], "method string, duration_s int, v int")
    files.save_results(rows(1), path)
    files.save_results(rows(2).where("method = 'a'"), path)
    assert {(r.method, r.v) for r in spark.read.parquet(path).collect()} == {("a", 2), ("b", 1)}


def test_extraction_resumes_and_lists_failures(spark, tmp_path):
    path, asked = str(tmp_path / "e"), []
    wanted = spark.createDataFrame([(k, f"sha-{k}") for k in "abc"], "source_key string, source_sha256 string")

    def compute(bad):
        def run(missing):
            asked.append(sorted(r.source_key for r in missing.collect()))
            return missing.withColumn("error", F.when(F.col("source_key") == bad, "broken")).withColumn("v", F.when(F.col("source_key") != bad, 1))
        return run

    good, failed = files.extracted(spark, path, wanted, compute("c"), "model-1")
    assert sorted(r.source_key for r in good.collect()) == ["a", "b"] and [tuple(r) for r in failed.collect()] == [("c", "sha-c", "broken")]
    good, failed = files.extracted(spark, path, wanted, compute("none"), "model-1")
    assert good.count() == 3 and failed.count() == 0 and asked == [["a", "b", "c"], ["c"]]
    changed = wanted.withColumn("source_sha256", F.when(F.col("source_key") == "a", "new").otherwise(F.col("source_sha256")))
    assert files.extracted(spark, path, changed, compute("none"), "model-1")[0].count() == 3 and asked[-1] == ["a"]
    assert files.extracted(spark, path, wanted, compute("none"), "model-2", batch=1)[0].count() == 3 and sorted(sum(asked[3:], [])) == ["a", "b", "c"]


def test_caches_know_what_made_them(spark, tmp_path):
    spark.createDataFrame([("s1", 1), ("s2", 2)], "specification string, x int").write.parquet(str(tmp_path / "c"))
    with pytest.raises(PySparkException):
        files.embeddings(spark, str(tmp_path / "c"), "s1").collect()
    calls = []
    refs = lambda size: spark.createDataFrame([("r", "/p", size)], "reference_key string, path string, size int")

    def compute(missing):
        calls.append(missing.count())
        return missing.select("reference_key", F.lit(3).alias("t"), F.lit(9).alias("hash"))

    for size in (1, 1, 2):
        assert [tuple(r) for r in files.snapshot(spark, str(tmp_path / "h"), "1.0", refs(size), compute).collect()] == [("r", 3, 9)]
    assert calls == [1, 1]


def test_paths_are_portable_however_deep(spark):
    rows = spark.createDataFrame([("/root.x/a\\b", [("/root.x/c", "/root.x/keep")]), ("/rootyx/a", None), (None, [])], "path string, refs array<struct<path:string,note:string>>")
    got = [tuple(r) for r in files.with_portable(rows, "/root.x/").collect()]
    assert got == [("a/b", [("c", "/root.x/keep")]), ("/rootyx/a", None), (None, [])]
    back = lambda x: spark.createDataFrame([(x,)], "p string").select(files.materialised(F.col("p"), "/new")).first()[0]
    assert back("a/b") == "/new/a/b"
    for bad in ("/abs", "a/../../b"):
        with pytest.raises(PySparkException):
            back(bad)


def test_perturbations_do_not_depend_on_partitions(spark):
    x = np.random.default_rng(1).normal(size=8000).astype(np.float32)
    df = spark.createDataFrame([(f"r{i}", 8000, x.tolist()) for i in range(4)], "recording_id string, sample_rate int, pcm array<float>")
    conditions = [c for c in protocol.CONDITIONS if c != "mp3_32k"]
    key = lambda n: {(r.recording_id, r.condition): tuple(r.pcm) for r in files.perturbations(df.repartition(n), conditions, "s").collect()}
    one = key(1)
    assert one == key(3) and len(one) == 4 * len(conditions) and one["r0", "noise"] != one["r1", "noise"]
    lost = np.array(one["r0", "packets"]).reshape(50, 160)
    assert (np.abs(lost).max(axis=1) == 0).sum() == 5 and np.allclose(one["r0", "clean"], x)


def test_digests_do_not_depend_on_files(spark, tmp_path):
    rows = [(f"c{i % 3}", i, [i / 7]) for i in range(40)]
    for name, parts, own in (("a", 1, rows), ("b", 5, rows), ("c", 1, rows[:-1]), ("d", 1, rows + rows[:1])):
        spark.createDataFrame(own, "content_id string, frame bigint, v array<double>").repartition(parts).write.parquet(str(tmp_path / name))
    d = {n: enroll.digest(spark, str(tmp_path / n)) for n in "abcd"}
    assert d["a"] == d["b"] and len({d["a"], d["c"], d["d"]}) == 3


def test_audits_name_what_is_broken(spark):
    rows = spark.createDataFrame([("k", 1, 0.0), ("k", 2, 0.0), ("k", 3, None), ("j", 1, float("inf"))], "k string, n int, t double")
    assert {(r.k, r.n) for r in validate.not_increasing(rows, "k", "n", "t").collect()} == {("k", 2), ("k", 3), ("j", 1)}
    steps = spark.createDataFrame([("s", "plan", 1), ("s", "gate", 3), ("s", "gate", 5), ("s", "test", 4), ("u", "plan", 1), ("u", "test", 2)], "study string, step string, at int")
    assert {tuple(r) for r in validate.chronology(steps, "study", ["plan", "gate", "test"]).collect()} == {("s", "test", "gate"), ("u", "gate", "plan")}
    crops = spark.createDataFrame([("q1", "a", 1.0), ("q2", "a", 1.0), ("q3", "b", 1.0)], "query_id string, content_id string, start_s double")
    found = spark.createDataFrame([("q1", "a", 1.05, 3, 1), ("q1", "b", 1.0, 2, 2), ("q2", "b", 1.0, 3, 1)], "query_id string, content_id string, offset double, votes int, rank int")
    assert {r.query_id: r.passed for r in evaluate.self_matches(found, crops).collect()} == {"q1": True, "q2": False, "q3": False}
