import base64
import gzip
import hashlib
import random
from pathlib import Path

import pytest

from refrain.llm import warc
from refrain.llm.common import new_path

PAGES = [
    (1, "http://a/ b\r\nX: y", "<p>one</p>"), (2, "http://b/é", "<p>one</p>"), (3, None, None), (4, "http://c", ""), (5, "http://d", "x" * 300_000), (6, "http://e", "\r\n\r\nWARC/1.1\r\n"),
    (7, "http://f", "dup"), (7, "http://f", "dup"), (6, "http://f", "dup"), (None, "http://g", "<p>one</p>"), (None, "http://g", "alone"), (8, "http://h", "é😀"),
]
SCHEMA = "page_id bigint, url string, html string"


def expected(pages, least=0):
    first = {}
    for i, _, html in pages:
        if i is not None:
            first[html or ""] = max(first.get(html or "", i), i)
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        top = first.get(html or "")
        again = top is not None and len(data) >= least and (i is None or i < top)
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, most", [(0, 200_000), (5, 200_000), (0, 0), (5, 1)])  # repeated digests broadcast, and joined by a shuffle
def test_archives_read_back(spark, least, most):
    p = warc.WarcParams(min_bytes=least, roll=2000, span=1000, gap=10, most_broadcast=most)
    folder = new_path(spark, "test-warc")
    index = warc.write(warc.with_types(spark.createDataFrame(PAGES, SCHEMA).repartition(3), p), folder, p)
    found = warc.read_records(index, folder, p).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str) == expected(PAGES, least)
    assert sorted((str(r.page_id), str(r.url)) for r in found) == sorted((str(i), str(u)) for i, u, _ in PAGES)  # blanks and line ends too
    for r in found:
        data = bytes(r.payload)
        assert data == b"" if r.record_type == "revisit" else base64.b32encode(hashlib.sha1(data).digest()).decode() == r.payload_digest
    some = index.where("record_type = 'response' and page_id = 5")
    assert [r.payload_bytes for r in warc.read_records(some, folder, p).collect()] == [300_000]


def test_archives_are_valid(spark):
    folder = new_path(spark, "test-warc")
    warc.write(warc.with_types(spark.createDataFrame(PAGES, SCHEMA).coalesce(1)), folder)
    for path in Path(folder.removeprefix("file://")).glob("*.warc.gz"):
        data = gzip.decompress(path.read_bytes())
        n = 0
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            assert head.startswith(b"WARC/1.1\r\n") and all(b": " in line for line in head.split(b"\r\n")[1:])
            length = int(dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert rest[length : length + 4] == b"\r\n\r\n"
            data, n = rest[length + 4 :], n + 1
        assert n == len(PAGES) + 1


def test_reads_coalesce():
    r = random.Random(1)
    at, wanted = 0, []
    for k in range(200):
        size = r.randrange(1, 500)
        if r.random() < 0.5:
            wanted.append((f"f{k // 100}", at if k < 100 else at, size))
        at += size
    p = warc.WarcParams(gap=300, span=2000)
    reads = list(warc.coalesced(wanted, p))
    assert [(n, *x) for n, _, _, records in reads for x in records] == wanted and len(reads) < len(wanted)
    for _, low, length, records in reads:
        assert low == records[0][0] and low + length >= records[-1][0] + records[-1][1]
        assert length <= 2000 or len(records) == 1


def test_damage_is_noticed():
    data = bytearray(warc.record(1, "u", b"payload", hashlib.sha1(b"payload").hexdigest(), "response", None, "1970-01-01T00:00:00Z"))
    assert warc.parse(bytes(data))[-1] == b"payload"
    data[data.index(b"payload")] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(bytes(data))


def test_empty_table_and_other_columns(spark):
    from pyspark.sql import functions as F

    folder = new_path(spark, "test-warc")
    none = spark.createDataFrame([], SCHEMA)
    assert warc.read_records(warc.write(warc.with_types(none), folder), folder).collect() == []
    more = spark.createDataFrame(PAGES, SCHEMA).withColumns({c: F.lit(1) for c in ("sha1", "payload", "first", "n", "record_type", "a.b")})
    assert warc.with_types(more).count() == len(PAGES)
