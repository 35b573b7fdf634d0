import collections
import hashlib
import random

import numpy as np
import xxhash
from hypothesis import given
from hypothesis import strategies as st

from refrain.llm import lz_fingerprint as z

from .conftest import ODD, frame


def phrases(text):
    known, start = [], 0
    for end in range(1, len(text) + 1):
        if text[start:end] not in known:
            known.append(text[start:end])
            start = end
    return known


def of_trie(p):
    names = {0: b""}
    for key, number in p.known.items():
        names[number] = names[key >> 8] + bytes([key & 255])
    return [names[i] for i in range(1, len(names))]


@given(st.binary(max_size=80), st.integers(0, 80))
def test_phrases_equal_brute_force_also_in_two_parts(text, cut):
    assert of_trie(z.Phrases().add(text)) == phrases(text) == of_trie(z.Phrases().add(text[:cut]).copy().add(text[cut:]))


def test_likeness_follows_the_phrase_sets():
    r = random.Random(1)
    text = lambda n: bytes(r.choice(b"abcd efgh") for _ in range(n))
    a, other = text(4000), text(4000)
    edited = a[:3600] + other[:400]
    fa, fe, fo = map(z.fingerprint, (a, edited, other))
    assert z.likeness(fa, fa) == 1 and z.likeness(fa, fe) > z.likeness(fa, fo)
    sets = [set(phrases(x)) for x in (a, edited)]
    assert abs(z.likeness(fa, fe) - len(sets[0] & sets[1]) / len(sets[0] | sets[1])) < 0.25
    assert z.likeness(z.fingerprint(b""), z.fingerprint(b"")) == 1 and z.likeness(z.fingerprint(b""), fa) == 0


def expected(rows):
    code = lambda t: xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63) & (1 << 64) - 1  # signed numbers in order
    order = sorted((i is not None, i or 0, code(t or ""), t or "") for i, t in rows)
    out = collections.Counter()
    for k, (named, i, _, text) in enumerate(order):
        i = i if named else None
        half, after = len(text) // 2, order[(k + 1) % len(order)][3]
        edited = text[: len(text) - half] + after[:half]
        like = z.likeness(z.fingerprint(text.encode()), z.fingerprint(edited.encode()))
        out[(i, len(text), hashlib.sha256(edited.encode()).hexdigest(), z.text_of(z.fingerprint(text.encode())), round(like, 9), round(z.likeness(z.fingerprint(text.encode()), z.fingerprint(after.encode())), 9))] += 1
    return out


def test_next_documents_across_buckets(spark):
    r = random.Random(2)
    plain = [(i * 3, "".join(r.choice("abé ") for _ in range(r.randrange(200)))) for i in range(150)]
    for rows in (plain, plain + [x for x in ODD if not x[1] or len(x[1]) < 1000], plain[:1]):
        df = frame(spark, rows).repartition(5)
        got = collections.Counter((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, round(x.near_edited, 9), round(x.near_next, 9)) for x in z.edited_likeness(z.with_next(df, 2_000)).collect())
        assert got == expected(rows)


def test_rows_that_share_an_id_are_split(spark):
    r = random.Random(5)
    text = lambda: "".join(r.choice("abé ") for _ in range(r.randrange(60)))
    rows = [(7, text()) for _ in range(200)] + [(None, text()) for _ in range(150)] + [(i, text()) for i in range(100)] + [(7, "same")] * 20
    df = z.with_next(frame(spark, rows).repartition(5), 500)
    sizes = collections.Counter((x.doc_id, x.bucket) for x in df.where("head = 0").collect())
    assert sum(i == 7 for i, _ in sizes) > 5 and sum(i is None for i, _ in sizes) > 5
    got = collections.Counter((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, round(x.near_edited, 9), round(x.near_next, 9)) for x in z.edited_likeness(df).collect())
    assert got == expected(rows)


def test_buckets_are_bounded(spark):
    rows = [(i, "some text") for i in range(500)]
    df = z.with_next(frame(spark, rows).repartition(3), 9, 20)
    assert df.select("bucket").distinct().count() <= 21
    assert z.edited_likeness(df).count() == 500


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = collections.Counter((x.doc_id, x.n_chars, x.edited_sha256, x.fingerprint, round(x.near_edited, 9), round(x.near_next, 9)) for x in z.op7_lz_fingerprint(spark, sf).collect())
    assert got == expected(rows)


def test_odd_tables(spark, odd, none, clashing):
    assert z.edited_likeness(z.with_next(none)).collect() == [] and z.fingerprints(none).collect() == []
    found = z.fingerprints(clashing)
    assert set(found.columns) == set(clashing.columns)
    same = [r.fingerprint for r in found.where("doc_id = 8").collect()]
    assert len(same) == 2 and len(set(same)) == 1
    assert z.edited_likeness(z.with_next(odd)).count() == len(ODD)
    assert np.array_equal(z.fingerprint(b"abc" * 100), z.fingerprint(b"abc" * 100))
