"""MinHash votes over documents of any length, against brute force."""

import hashlib

import pytest

from refrain.catalogue import QUERIES

md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
number = lambda t: int(md5(t)[:8], 16)


def bins(text):
    words = {w for w in text.lower().split(" ") if w}
    least = [min(md5(f"{i}:{w}") for w in words) for i in range(100)]
    return [number("-".join(least[4 * t : 4 * t + 4])) for t in range(25)]


@pytest.mark.parametrize("votes", [1, 4])
def test_long_documents_get_votes(spark, tmp_path, votes):
    item = " ".join(f"item{i}" for i in range(400))
    docs = {1: item, 2: item + " more", 3: item + "".join(f" other{i}" for i in range(200)), 4: " ".join(f"far{i}" for i in range(400)), 5: "item1 item2"}
    assert len(docs[2]) > 2000 and len(docs[3]) > 2000
    spark.createDataFrame([(7, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, t, len(t)) for i, t in docs.items()], "doc_id bigint, text string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    asked = bins(item)
    agree = {i: sum(a == b for a, b in zip(asked, bins(t), strict=True)) for i, t in docs.items()}
    got = {(r.qid, r.rid): r.votes for r in QUERIES[f"lsh_minhash_votes_{votes}"](spark, str(tmp_path)).collect()}
    assert got == {(7, i): n for i, n in agree.items() if n >= votes} and (7, 2) in got
