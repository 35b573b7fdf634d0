import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from refrain.functions import clock
from refrain.operators import knn, matching
from refrain.plans.gallery import Gallery


def curve(n=200, origin=0.0):
    t = np.arange(n) * 186 / 8000 + 0.360375 + origin
    return np.stack([np.sin(2 * t), np.cos(2 * t), 0.2 * t], axis=1)


@pytest.fixture(scope="module")
def prints(spark):
    rows = [("right", k, v.tolist()) for k, v in enumerate(curve())] + [("wrong", k, (v + 3).tolist()) for k, v in enumerate(curve())]
    return spark.createDataFrame(rows, "content_id string, frame bigint, v array<double>")


def asked(spark, start, n=35, slope=1.0, step=1):
    t = np.arange(n) * step * 186 / 8000
    at = start + slope * t
    v = np.stack([np.sin(2 * at), np.cos(2 * at), 0.2 * at], axis=1)
    return spark.createDataFrame([("q", k, float(x), y.tolist()) for k, (x, y) in enumerate(zip(t, v))], "query_id string, qrow bigint, qt double, v array<double>")


@pytest.mark.parametrize("factor", [1, 2, 4, 6, 8])
def test_consensus_finds_the_offset_at_every_density(spark, prints, factor):
    best = Gallery.from_fingerprints(prints, factor).match(asked(spark, 1.137)).where("rank = 1").first()
    assert best.content_id == "right" and abs(best.offset - 1.137) < 0.12 and best.vote_fraction > 0.9


def test_knn_equals_brute_force_whatever_the_partitions(spark):
    r = np.random.default_rng(3)
    refs, qs = r.integers(0, 3, (150, 4)).astype(float), r.integers(0, 3, (20, 4)).astype(float)  # many ties
    df = lambda x, n: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{n} bigint, v array<double>")
    for inner in (False, True):
        d = -(qs @ refs.T) if inner else ((qs[:, None] - refs[None]) ** 2).sum(axis=2)
        want = {(q, int(i), k + 1) for q in range(20) for k, i in enumerate(np.lexsort((np.arange(150), d[q]))[:7])}
        for parts in (1, 6):
            got = knn.nearest(df(qs, "qid"), df(refs, "rid").repartition(parts), 7, inner_product=inner).collect()
            assert {(x.qid, x.rid, x["rank"]) for x in got} == want
    assert knn.nearest(df(qs, "qid"), df(refs[:3], "rid"), 7).count() == 60
    assert knn.nearest(df(qs, "qid"), df(refs[:0], "rid"), 7).count() == 0
    with pytest.raises(ValueError):
        knn.nearest(df(qs, "qid"), df(refs, "rid"), 0)


@pytest.mark.parametrize("inner", [False, True])
def test_blocks_of_queries_equal_one_block(spark, monkeypatch, inner):
    r = np.random.default_rng(9)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.integers(0, 4, (300, 5)).astype(float))], "rid bigint, v array<double>")
    qs = rows.where("rid % 7 = 0").withColumnRenamed("rid", "qid")
    key = lambda: {(x.qid, x.rid, x.distance, x["rank"]) for x in knn.nearest(qs, rows, 6, inner_product=inner, max_distance=None if inner else 9.0, exclude="same").collect()}
    want = key()
    monkeypatch.setattr(knn, "MOST_QUERY_BYTES", 10 * 40)
    monkeypatch.setattr(knn, "REFERENCE_BYTES", 70 * 40)
    assert key() == want and all(q != i for q, i, _, _ in want)


def test_recall_of_cells(spark):
    """Trained centroids, fewer probes than cells, against the exact search; and large cells dealt over tasks."""
    r = np.random.default_rng(8)
    centres = r.normal(size=(40, 16)) * 1.2
    data = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 16))
    rows = spark.createDataFrame([(i, i % 20, v.tolist()) for i, v in enumerate(data)], "rid bigint, source int, v array<double>")
    qs = rows.where("rid % 20 = 0").select(F.col("rid").alias("qid"), "v")
    centroids = knn.train_centroids(rows, 32, sample=2000, per_source=200)
    key = lambda d: {(x.qid, x.rid) for x in d.collect()}
    exact = key(knn.nearest(qs, rows, 10, exclude="same"))
    found = [key(knn.nearest_by_cell(qs, rows, centroids, 10, p, "same", size)) for p, size in ((8, 50_000), (8, 30), (1, 50_000))]
    assert found[0] == found[1] and len(found[0] & exact) >= 0.9 * len(exact) and len(found[2] & exact) < len(found[0] & exact)


def test_cells_with_all_probes_equal_the_exact_search(spark):
    r = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, i % 4, v.tolist()) for i, v in enumerate(r.normal(size=(200, 3)))], "rid bigint, source int, v array<double>")
    centroids = knn.train_centroids(rows, 4, sample=100, per_source=40)
    qs = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.normal(size=(15, 3)))], "qid bigint, v array<double>")
    key = lambda d: {(x.qid, x.rid) for x in d.collect()}
    exact = key(knn.nearest(qs, rows, 5))
    assert key(knn.nearest_by_cell(qs, rows, centroids, 5, 4)) == exact
    assert len(key(knn.nearest_by_cell(qs, rows, centroids, 5, 1)) & exact) > 20


def brute_consensus(rows, n, tol):
    out = []
    for content, part in rows.groupby("content_id"):
        part = part.assign(off=part.rt - part.qt)
        best = None
        for left in sorted(set(part.off)):
            inside = part[(part.off >= left) & (part.off - left <= 2 * tol + 1e-12)].sort_values(["distance", "off"])
            own = inside.drop_duplicates("qrow")
            key = (len(own), -own.distance.mean())
            if best is None or key > best[0]:
                best = (key, own)
        own = best[1]
        offset = min(max(np.median(own.off), own.off.max() - tol), own.off.min() + tol)
        out.append((-len(own), own.distance.mean(), content, len(own) / n, offset))
    return sorted(out)


def test_consensus_equals_brute_force(spark):
    r = np.random.default_rng(9)
    rows = pd.DataFrame({"query_id": "q", "content_id": r.choice(list("abcd"), 80), "qrow": r.integers(0, 20, 80), "rt": r.integers(0, 30, 80) * 0.1, "distance": r.random(80)})
    rows["qrow"] = rows["qrow"].astype("int64")
    rows["qt"] = rows["qrow"] * 0.05
    counts = spark.createDataFrame([("q", 20)], "query_id string, n bigint")
    for tol in (0.0, 0.12, 0.4):
        got = matching.consensus(spark.createDataFrame(rows), counts, tol).orderBy("rank").collect()
        want = brute_consensus(rows, 20, tol)
        assert [(x.content_id, x.votes) for x in got] == [(c, -v) for v, _, c, _, _ in want]
        assert np.allclose([(x.vote_fraction, x.mean_distance, x.offset) for x in got], [(f, m, o) for _, m, _, f, o in want])
    with pytest.raises(ValueError):
        matching.consensus(spark.createDataFrame(rows), counts, -1)


def test_affine_recovers_a_slope(spark):
    long = spark.createDataFrame([("right", k, v.tolist()) for k, v in enumerate(curve(500))] + [("wrong", k, (v + 3).tolist()) for k, v in enumerate(curve(100))], "content_id string, frame bigint, v array<double>")
    near = Gallery.from_fingerprints(long, 2).search(asked(spark, 0.8, 47, 1.2, 4), 5)
    for found in (matching.affine(near), matching.affine_all_pairs(near)):
        best = found.orderBy(F.desc("votes")).first()
        assert best.content_id == "right" and abs(best.slope - 1.2) < 0.05 and abs(best.intercept - 0.8) < 0.1 and best.votes >= 46


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("scale", [0.75, 1.0, 1.5])
def test_sequences_and_stretch(spark, scale):
    r = np.random.default_rng(2)
    refs = {c: unit(r.normal(size=(80, 16))) for c in ("a", "b")}
    pos = [round(20 + i / scale) for i in range(9)]
    refs_df = spark.createDataFrame([(c, k, v.tolist()) for c, x in refs.items() for k, v in enumerate(x)], "content_id string, pos bigint, v array<double>")
    qs = spark.createDataFrame([("q", i, refs["b"][p].tolist()) for i, p in enumerate(pos)], "query_id string, qpos bigint, v array<double>")
    met = qs.join(refs_df.withColumnRenamed("v", "w").withColumnRenamed("pos", "rpos"), F.lit(True)).withColumn("d", F.expr("aggregate(zip_with(v, w, (x, y) -> x * y), 0D, (a, x) -> a + x)"))
    near = met.withColumn("rank", F.expr("row_number() over (partition by query_id, qpos order by d desc)")).where("rank <= 3").select("query_id", "qpos", "content_id", "rpos", "rank")
    if scale == 1.0:
        best = matching.sequence_rerank(near, qs, refs_df).first()
        assert (best.content_id, best.start) == ("b", 20) and abs(best.score - 1) < 1e-9
    first = near.where("rank = 1")
    factors = {x.content_id: x.factor for x in matching.stretch_factors(first).collect()}
    assert abs(factors["b"] - scale) < 0.12
    best = matching.stretch_rerank(first, qs, refs_df).first()
    assert best.content_id == "b" and abs(best.start - 20) <= 1
    assert matching.physical_stretch(first, 0.5, 0.5).where("content_id = 'b'").first().evidence_frames == len(set(pos))


def test_waveform_correlation():
    x = np.sin(np.arange(4000) ** 1.1 / 9)
    assert matching.aligned_correlation(x[1000:1500], x, 1060, 100) == ("measured", pytest.approx(1), -60)
    assert matching.aligned_correlation(np.zeros(500), x, 1000, 100)[0] == "silent_query"
    assert matching.aligned_correlation(x[:500], x, 10, 100)[0] == "insufficient_full_crop_support"


def test_gallery_checks_and_reload(spark, prints, tmp_path):
    with pytest.raises(ValueError):
        Gallery.from_fingerprints(prints.unionByName(prints))
    with pytest.raises(ValueError):
        Gallery.from_fingerprints(prints, 4, 4)
    g = Gallery.from_fingerprints(prints, 2, 1)
    assert g.rows.where("frame % 2 = 0").isEmpty() and abs(g.rows.where("frame = 1").first().t - (186 / 8000 + 0.360375)) < 1e-15
    g.save(str(tmp_path / "g"))
    assert Gallery.load(spark, str(tmp_path / "g")).match(asked(spark, 1.137)).count() == g.match(asked(spark, 1.137)).count()
    assert g.match(asked(spark, 1.1).where("false")).collect() == []
    assert clock.Config().hop == 186
