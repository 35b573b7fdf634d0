import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np

from refrain.llm import quality_rules as q

from .conftest import ODD, frame


def brute(text, lim=q.Limits()):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(n - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeat = len({i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)})
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), repeat


def spans(words, least):
    n, most = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            most[i] = max(most[i], k)
    covered = {i + k for i, m in enumerate(most) if m >= least for k in range(m)}
    return len({i + k for i, m in enumerate(most) if m >= 3 for k in range(3)}), len(covered), max(most, default=0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=6), st.integers(1, 6))
def test_repeats_equal_brute_force(docs, least):
    assert q.repeats([np.array(d, np.int64) for d in docs], least) == [spans(d, least) for d in docs]


def test_counts_equal_brute_force(spark, odd):
    r = random.Random(1)
    rows = ODD + [(100 + i, "".join(r.choice("ab #é|\n\t*ß ") for _ in range(r.randrange(300)))) for i in range(200)]
    for row in q.with_counts(frame(spark, rows).repartition(3)).collect():
        assert tuple(row.quality)[:5] == brute(row.text)
        n, repeat = row.quality.n_words, row.quality.n_repeat_words
        assert row.quality.base_failed == (n < 50 or 100 * repeat > 50 * n)
        assert not (row.quality.base_failed and row.quality.kept)


def test_the_method_rejects_long_and_many_repeats(spark):
    r = random.Random(2)
    fresh = lambda n: " ".join(f"w{r.randrange(10**7)}" for _ in range(n))
    passage = fresh(100)
    rows = [(1, fresh(300)), (2, f"{passage} {fresh(40)} {passage} {fresh(400)}"), (3, " ".join(f"{fresh(6)} {passage[:60]}" for _ in range(30)))]
    assert {r.doc_id: r.quality.kept for r in q.with_counts(frame(spark, rows)).collect()} == {1: True, 2: False, 3: False}


def test_the_longest_repeat_is_bounded_in_words_whatever_the_length(spark):
    r = random.Random(3)
    fresh = lambda n: " ".join(f"w{r.randrange(10**7)}" for _ in range(n))
    passage = fresh(400)
    rows = [(n, f"{' '.join(passage.split()[:n])} {fresh(30_000)} {' '.join(passage.split()[:n])}") for n in (150, 200, 201, 400)]
    found = {x.doc_id: x.quality for x in q.with_counts(frame(spark, rows)).collect()}
    assert {i: x.kept for i, x in found.items()} == {150: True, 200: True, 201: False, 400: False}
    assert all(x.longest_repeat == i for i, x in found.items())


def test_a_text_of_five_million_words_takes_linear_memory():
    import resource

    r = np.random.default_rng(4)
    half = r.integers(0, 40_000, 2_500_000)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert q.repeats([np.concatenate([half, half])], 8) == [(5_000_000, 5_000_000, 2_500_000)]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = q.op10_quality_rules(spark, sf).collect()
    assert sorted(r.doc_id for r in found) == sorted(docs)
    for r in found:
        n, chars, symbols, lines, repeat = brute(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat)
        assert r.base_failed == (n < 50 or 100 * repeat > 50 * n) and not (r.base_failed and r.kept)


def test_odd_tables(spark, clashing, none):
    assert q.with_counts(none).collect() == []
    assert q.stage(spark, clashing, "").columns == clashing.columns
    assert {r.doc_id for r in q.stage(spark, clashing, "").collect()} == {1, 6} - {i for i in (1, 6) if not _kept(spark, i)}


def _kept(spark, i):
    return q.with_counts(frame(spark, [x for x in ODD if x[0] == i])).first().quality.kept
