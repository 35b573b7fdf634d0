"""WARC archives: written with an index, read by coalesced byte ranges.

Each task writes its pages into an archive of its own in the shared folder, one gzip member per record, and returns the index: archive,
offset, length, URL and digest of each record. Archives of failed attempts are never in an index. Records are read through the
index: the wanted rows are sorted by archive and offset, and neighbours are fetched by one read. A record whose payload is that of
another record becomes a revisit of it.

The shared folder is reached by pyarrow's file systems (file, hdfs, viewfs, s3, gs).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import bloom
from refrain.llm.common import as_bytes, batches, new_path, read, small_batches, stored

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class WarcParams:
    """min_bytes: of payloads that may be revisits. level: of gzip. roll: bytes from which an archive is closed. gap, span:
    bytes between records that one read may skip, and bytes that it fetches at most (a larger record is read whole).
    most_broadcast: repeated digests (some 60 bytes each) that go to every task; more meet the pages in a shuffle."""

    min_bytes: int = 0
    level: int = 3
    roll: int = 1_000_000_000
    gap: int = 65_536
    span: int = 8_000_000
    most_broadcast: int = 200_000
    date: str = "1970-01-01T00:00:00Z"


def with_types(pages: DataFrame, p: WarcParams = WarcParams()) -> DataFrame:
    """page_id, url, payload, sha1 (hex), record_type and refers_to of pages (page_id, url, html).

    Of the records with equal payloads of at least min_bytes bytes, that with the largest page_id is the response and the others revisit
    it; rows that share that page_id are all responses. A null page_id is less than any other; if no other has the payload, all are responses.
    Null and empty html are the empty payload; a null URL stays null. Payloads of any length are taken whole, other columns of pages are
    not looked at, and a table without rows gives none.

    Digests meet without payloads. Where the repeated ones are too many to broadcast, only pages whose digest a Bloom filter of them may
    hold are shuffled with their payloads.
    """
    own = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", as_bytes("html", "payload")).withColumn("sha1", F.sha1("payload"))
    hashed = own.where(F.octet_length("payload") >= p.min_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    again = stored(hashed.where("n > 1 and first is not null").select("sha1", "first"), "again")
    n = again.count()
    if n <= p.most_broadcast:
        found = own.join(F.broadcast(again), "sha1", "left")
    else:
        blocks = min(bloom.blocks_for(n), bloom.MOST_BLOCKS)
        asked = bloom.marked(own, F.col("sha1"), bloom.filter_of(again, F.col("sha1"), blocks), blocks)
        met = asked.where("maybe").join(again.hint("merge"), "sha1", "left")
        found = met.unionByName(asked.where("not maybe").withColumn("first", F.lit(None).cast("bigint")))
    revisit = F.coalesce(F.col("first") > F.col("page_id"), F.col("first").isNotNull())
    return found.select("page_id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, kind: str, refers_to: int | None, date: str) -> bytes:
    """A WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'null-' + uuid.uuid4().hex if page_id is None else page_id}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        shown = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        lines.append("WARC-Target-URI: " + shown)
        if shown != url:  # what an archive's header can't hold is read back from a header of its own
            lines.append("X-Target-URI-Base64: " + base64.b64encode(url.encode()).decode())
    if kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write(pages: DataFrame, folder: str, p: WarcParams = WarcParams()) -> DataFrame:
    """The index of pages (as with_types makes them), whose records are now in archives in the folder: page_id, url, digest,
    record_type, archive, offset and length. It is stored beside them."""
    kept = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("record_type", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        info = member(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {p.date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n\r\n\r\n".encode(), p.level)

        def rows():
            out, name, at = None, "", 0
            try:
                for batch in stream:
                    for i, url, payload, sha1, kind, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                        if out is None or at >= p.roll:
                            if out is not None:
                                out.close()
                            name = f"{uuid.uuid4().hex}.warc.gz"
                            files.create_dir(root, recursive=True)
                            out = files.open_output_stream(f"{root}/{name}", compression=None)
                            out.write(info)
                            at = len(info)
                        data = member(record(i, url, payload, sha1, kind, first, p.date), p.level)
                        out.write(data)
                        yield i, url, base64.b32encode(bytes.fromhex(sha1)).decode(), kind, name, at, len(data)
                        at += len(data)
            finally:
                if out is not None:
                    out.close()

        yield from batches(rows(), kept)

    own = pages.select("page_id", "url", "payload", "sha1", "record_type", "refers_to")
    index = small_batches(own).mapInArrow(run, "page_id bigint, url string, digest string, record_type string, archive string, offset bigint, length bigint")
    index.write.parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(index.schema).parquet(f"{folder}/index")


def coalesced(wanted: list[tuple[str, int, int]], p: WarcParams) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Reads (archive, offset, length, and the records in it) for records (archive, offset, length) in order."""
    name, low, high, held = "", 0, 0, []
    for archive, offset, length in wanted:
        if held and (archive != name or offset - high > p.gap or offset + length - low > p.span):
            yield name, low, high - low, held
            held = []
        if not held:
            name, low, high = archive, offset, offset
        held.append((offset, length))
        high = max(high, offset + length)
    if held:
        yield name, low, high - low, held


def parse(data: bytes) -> tuple[int | None, str | None, str, int | None, str, int, bytes]:
    """page_id, url, record_type, refers_to, digest, payload_bytes and payload of a record; a payload that isn't what its digest says raises ValueError."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    page = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:x-page:(-?\d+)>", fields.get(name, ""))) else None
    raw = fields.get("X-Target-URI-Base64")
    url = fields.get("WARC-Target-URI") if raw is None else base64.b64decode(raw).decode()
    return page("WARC-Record-ID"), url, kind, page("WARC-Refers-To"), digest, size, payload


def read_records(index: DataFrame, folder: str, p: WarcParams = WarcParams(), payloads: bool = True) -> DataFrame:
    """The records that the rows of an index point at: page_id, url, record_type, refers_to, payload_digest, payload_bytes (both of the full payload, also for revisits) and,
    if wanted, payload (empty for revisits)."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())]
    out = pa.schema(fields if payloads else fields[:-1])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)

        def rows():
            source, name = None, None
            try:
                for batch in stream:
                    for archive, low, length, records in coalesced(list(zip(*(c.to_pylist() for c in batch.columns), strict=True)), p):
                        if archive != name:
                            if source is not None:
                                source.close()
                            source, name = files.open_input_file(f"{root}/{archive}"), archive
                        data = source.read_at(length, low)
                        for offset, size in records:
                            found = parse(zlib.decompress(data[offset - low : offset - low + size], 31))
                            yield found if payloads else found[:-1]
            finally:
                if source is not None:
                    source.close()

        yield from batches(rows(), out, 256 if payloads else 4096)

    ordered = index.select("archive", "offset", "length").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, "page_id bigint, url string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint" + ", payload binary" * payloads)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every page, read back from archives that hold all of them.

    A row per row of pages, repeated ones too; null html is empty, a null URL has no header, other columns are not looked
    at. Of equal payloads the largest page_id is the response. A table without rows gives none.
    """
    folder = new_path(spark, "warc")
    index = write(with_types(read(spark, sf_dir, "pages")), folder)
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH hashed AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), named AS (
  SELECT *, max(page_id) OVER (PARTITION BY hex) AS first,
    array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hex, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest
  FROM hashed
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to
FROM named
"""
