import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from refrain.llm import byte_bpe as b

from .conftest import ODD, frame


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=b.load_ranks(P.path(b.VOCABULARY)), special_tokens={})


def rows():
    r = random.Random(1)
    pick = lambda: chr(r.choice([r.randrange(0x80), r.randrange(0x3000), r.randrange(0xE000, 0x110000), 32, 39, 0x323B0, 0x10EC5, 0x16EA1]))
    return ODD + [(1000 + i, "".join(pick() for _ in range(60))) for i in range(800)] + [(2000, "a" * 3000), (2001, " " * 500 + "x"), (2002, "'s'S don't  \n\n x\t")]


def test_ids_and_round_trip_equal_tiktoken(spark, plain):
    path = P.path(b.VOCABULARY)
    found = b.decode(b.encode(frame(spark, rows()).repartition(5), path, P.PATTERN, 100_000), path)
    got = sorted((-1 if r.doc_id is None else r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in found.collect())
    want = sorted((-1 if i is None else i, np.array(plain.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t in rows())
    assert got == want


def test_query_equals_tiktoken(spark, plain):
    import hashlib

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in b.op2_byte_bpe(spark, sf).collect():
        ids = plain.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_blocks_have_a_partition_each(spark):
    names = b.spread(np.arange(1875))
    dealt = spark.createDataFrame([(int(x),) for x in names], "block int").repartition(1875, "block")
    assert [len(part) for part in dealt.rdd.glom().collect()] == [1] * 1875


def test_equal_rows_are_dealt_to_all_blocks(spark):
    dealt, parts = b.blocks(frame(spark, [(7, "the same text again")] * 4000).repartition(4), 19 * 500)
    sizes = [r[1] for r in dealt.groupBy("block").count().collect()]
    assert parts == 8 and len(sizes) == 8 and max(sizes) < 2 * min(sizes)


def test_odd_tables(none, clashing):
    path = P.path(b.VOCABULARY)
    assert b.decode(b.encode(none, path, P.PATTERN), path).collect() == []
    assert b.encode(clashing, path, P.PATTERN).count() == len(ODD)
