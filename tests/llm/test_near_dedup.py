import itertools
import random

import numpy as np

from refrain.llm import near_dedup, shingles
from refrain.llm.common import Scratch
from refrain.llm.components import components
from refrain.llm.near_dedup import NearParams

from .conftest import ODD, frame


def brute(rows, width, percent=80):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        found = {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()
        sets.setdefault(i, []).append(found)
    parent = {i: i for i in sets if i is not None}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(parent), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in parent}, sets


def check(spark, rows, p):
    got = near_dedup.near_duplicates(frame(spark, rows).repartition(4), p).collect()
    want, sets = brute(rows, p.width, p.percent)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id) and r.kept == (r.doc_id is not None and want[r.doc_id] == r.doc_id)
        assert r.n_shingles in {len(s) for s in sets[r.doc_id]}


def family(random_, size, n_words, edits, start):
    base = [f"w{random_.randrange(5000)}" for _ in range(n_words)]
    out = []
    for k in range(size):
        words = list(base)
        for _ in range(random_.randrange(edits + 1)):
            words[random_.randrange(n_words)] = f"e{random_.randrange(10**6)}"
        out.append((start + k, " ".join(words)))
    return out


def test_families_equal_brute_force(spark):
    r = random.Random(3)
    rows = family(r, 60, 80, 12, 0) + family(r, 40, 12, 2, 100) + family(r, 30, 300, 25, 200) + [(400 + i, f"t{i % 7} u{i % 3} v") for i in range(30)]
    r.shuffle(rows)
    check(spark, rows, NearParams(width=4, block=16))  # clusters of several blocks


def test_a_large_cluster_whose_members_are_far_from_its_pivot(spark):
    """A chain: neighbours are linked, the ends share no shingle, so that most members are far from any pivot."""
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(4000)]
    rows = [(i, " ".join(words[8 * i : 8 * i + 100])) for i in range(400)]  # 89 of 105 shingles of 4 words with the next one
    rows += [(1000 + i, " ".join(words[8 * i : 8 * i + 100 - 25 * (i % 3)])) for i in range(0, 400, 3)]  # and sizes that part
    r.shuffle(rows)
    check(spark, rows, NearParams(width=4, block=24))  # some 22 blocks
    check(spark, rows[:150], NearParams(width=4, block_bytes=8 * 97 * 20))


def test_recall_of_the_query(spark):
    """Every link among all pairs of documents joins their components."""
    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in near_dedup.op3_near_dedup(spark, sf).collect()}
    sets = {}
    for r in rows:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text or "").encode().split()
        sets[r.doc_id] = {tuple(words[k : k + 4]) for k in range(max(1, len(words) - 3))} if words else set()
    assert {i: x.n_shingles for i, x in got.items()} == {i: len(x) for i, x in sets.items()}
    pairs = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert len(pairs) > 50 and all(got[i].component_id == got[j].component_id for i, j in pairs)


def test_tables_of_a_run_are_dropped(spark):
    from refrain.llm import common

    before = set(common._left)
    near_dedup.near_duplicates(frame(spark, family(random.Random(1), 60, 40, 4, 0)), NearParams(width=4, block=16)).collect()
    assert {x.rpartition("/")[2].partition("-")[0] for x in common._left - before} == {"sketches", "moved"}


def test_odd_rows_and_ties(spark):
    check(spark, ODD + [(20, "ONE TWO"), (21, "a b c d e f g h i j"), (22, "a b c d e f g h i j")], NearParams(width=5))


def test_empty_table_and_other_columns(spark, none, clashing):
    assert near_dedup.near_duplicates(none).collect() == []
    assert near_dedup.near_duplicates(clashing).count() == len(ODD)


def test_stage_keeps_one_of_each_group_and_all_columns(spark, clashing, none):
    kept = near_dedup.stage(spark, clashing, "")
    assert kept.columns == clashing.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.where("doc_id in (7, 8)").collect()) == [(7, "one two")]
    again = frame(spark, [(1, "one two three"), (1, "one two three"), (2, "other words here")])
    assert sorted(r.doc_id for r in near_dedup.stage(spark, again, "").collect()) == [1, 2]
    assert near_dedup.stage(spark, none, "").collect() == []


def test_signatures_estimate_the_similarity():
    r = np.random.default_rng(0)
    a = r.integers(0, 2**63, 600).astype(np.uint64)
    b = np.concatenate([a[:400], r.integers(0, 2**63, 200).astype(np.uint64)])
    same = (shingles.signature(a, 2000) == shingles.signature(b, 2000)).mean()
    assert abs(same - 400 / 800) < 0.06


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = {(r.id, r.component) for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark)).collect()}
    assert got == {(i, 0) for i in range(1, 51)} | {(101, 100)}
    assert components(spark.createDataFrame([], "a bigint, b bigint"), Scratch(spark)).collect() == []
