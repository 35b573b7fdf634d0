import zlib

import numpy as np
import pytest

from refrain.llm import quality_classifier as c
from refrain.llm.shingles import WordHashes

from .conftest import ODD, frame


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    found = c.op4_quality_classifier(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    met = found.join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in met]) > 0.9
    for r in found.limit(300).collect():
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_labels_are_not_read(spark):
    rows = [(i, "good words here" if i % 2 else "bad ### junk ***") for i in range(200)]
    labels = [(i, i % 2) for i in range(200)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in labels]
    a, b = (c.train(frame(spark, rows), spark.createDataFrame(x, "doc_id bigint, label int")) for x in (labels, turned))
    assert np.array_equal(a.weights, b.weights) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)


def test_dual_descent_separates():
    p = c.ClassifierParams(bits=6)
    rows = [np.array([0, 2 + i % 5], np.int32) if i % 2 else np.array([1, 2 + i % 5], np.int32) for i in range(100)]
    model = c.fit(rows, np.array([float(i % 2) for i in range(100)]), p)
    assert model.score(rows[1]) > 0.9 and model.score(rows[0]) < 0.1


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, None), (5, 0)], [(1, 1), (1, 0), (None, 1), (7, 3)]])
def test_odd_labels_and_texts(spark, odd, labels):
    model = c.train(odd, spark.createDataFrame(labels, "doc_id bigint, label int"))
    found = c.scores(odd, model).collect()
    assert len(found) == len(ODD) and all(0 <= r.score <= 1 for r in found)
    empty = {r.score for r in found if not r.text}
    assert len(empty) == 1


def test_repeated_ids_stay_within_the_sample(spark):
    docs = frame(spark, [(1, f"text {i}") for i in range(50)] + [(2, "other")])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, label int")
    assert c.train(docs, labels, c.ClassifierParams(sample=10)).weights.shape


def test_stage_keeps_columns(spark, clashing, none):
    sf = "/root/testdata/sf0.01"
    kept = c.stage(spark, clashing, sf)
    assert kept.columns == clashing.columns
    assert c.stage(spark, none, sf).collect() == []
    assert c.scores(none, c.fit([], np.array([]))).collect() == []


def plain_columns(text, bits):
    """The columns by the definition, in whole numbers of Python."""
    import hashlib

    most = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & most
        x = (x ^ x >> 27) * 0x94D049BB133111EB & most
        return x ^ x >> 31

    odd = 0x9E3779B97F4A7C15
    words = [int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little") for w in text.split()]
    grams = words + [mix((a * odd + b) & most) for a, b in zip(words, words[1:])]
    grams += [(a << 8 | b) + (1 << 40) for a, b in zip(text, text[1:])] + [(a << 16 | b << 8 | d) + (1 << 41) for a, b, d in zip(text, text[1:], text[2:])]
    found = {(((g * odd & most) ^ (g * 0xD6E8FEB86659FD93 & most) >> 29) * odd & most) >> (64 - bits) for g in grams}
    found = {c + 2 if c < 2 else c for c in found}
    same = [a == b for a, b in zip(words, words[1:])]
    return sorted(found | ({0} if any(same) else set()) | ({1} if any(a and b for a, b in zip(same, same[1:])) else set()))


@pytest.mark.parametrize("bits", [6, 12, 18])
def test_columns_equal_the_definition(bits):
    for text in (b"", b"a", b"a a", b"a a a b", "né tout ## né".encode(), b"x y " * 4000, bytes(range(256)) * 300):
        assert c.features(text, WordHashes(), bits).tolist() == plain_columns(text, bits)


def test_the_fit_equals_a_plain_version():
    """Ratios, dual descent and scores in loops over single numbers, in the same order of rows."""
    r = np.random.default_rng(7)
    p = c.ClassifierParams(bits=5, epochs=4, folds=2)
    rows = [np.unique(r.integers(0, 32, 6)).astype(np.int32) for _ in range(40)]
    labels = np.array([float(3 in x or 7 in x) for x in rows])
    count = {q: [p.alpha + sum(q == y and j in x for x, y in zip(rows, labels)) for j in range(32)] for q in (0, 1)}
    ratios = [np.log(count[1][j] / sum(count[1]) / (count[0][j] / sum(count[0]))) for j in range(32)]
    assert np.allclose(c.log_count_ratios(rows, labels, p), ratios)
    weights, bias, dual = [0.0] * 32, 0.0, [0.0] * 40
    order = np.random.default_rng(0)
    share = labels.mean()
    for _ in range(p.epochs):
        for i in order.permutation(40):
            sign, x = (1 if labels[i] else -1), {int(j): ratios[j] / len(rows[i]) ** 0.5 for j in rows[i]}
            slope = sign * (sum(weights[j] * v for j, v in x.items()) + bias) - 1
            new = min(max(dual[i] - slope / (sum(v * v for v in x.values()) + 1), 0), 0.5 * p.c / (share if labels[i] else 1 - share))
            for j, v in x.items():
                weights[j] += (new - dual[i]) * sign * v
            bias, dual[i] = bias + (new - dual[i]) * sign, new
    got, own = c.descend(rows, labels, np.array(ratios), p)
    assert np.allclose(got, weights) and np.isclose(own, bias)
    model = c.fit(rows, labels, p)
    assert np.allclose(model.weights, np.array(weights) * ratios, atol=1e-6)
    margin = sum(weights[j] * ratios[j] for j in rows[0]) / len(rows[0]) ** 0.5 + bias
    assert np.isclose(model.score(rows[0]), 1 / (1 + np.exp(-(model.slope * margin + model.shift))), atol=1e-5)


def test_features_of_short_texts():
    for text in (b"", b"a", b" ", "é".encode(), b"a a"):
        found = c.features(text, WordHashes(), 10)
        assert found.dtype == np.int32 and len(set(found.tolist())) == len(found)
