"""Lempel-Ziv phrase fingerprints (after Raff and Nicholas's Lempel-Ziv Jaccard distance).

A text's bytes are parsed into phrases: each is the shortest run not yet in the text's dictionary. The set of phrases is hashed,
and the fingerprint is the minimum of the hashes in each of 64 slots of the hash space (one-permutation MinHash). Two
fingerprints are as like as the share of slots, among those that either fills, in which they agree: an estimate of
the Jaccard similarity of the phrase sets.
"""

from __future__ import annotations

import collections
import hashlib
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.llm.common import batches, read, small_batches, with_computed
from refrain.llm.shingles import ODD, mix64

SLOTS = 64
EMPTY = 0xFFFFFFFF
#: Bytes of text in a bucket of neighbouring documents, on average.
BUCKET = 8_000_000
#: Buckets at most; beyond 400 GB of text they become larger instead.
MOST_BUCKETS = 50_000
LOWEST = -(1 << 63)


class Phrases:
    """The dictionary of a text's phrases so far, as a trie: (number of a phrase << 8 | next byte) to the longer phrase's number."""

    def __init__(self, known: dict[int, int] | None = None, at: int = 0):
        self.known, self.at = {} if known is None else known, at

    def copy(self) -> Phrases:
        return Phrases(self.known.copy(), self.at)

    def add(self, text: bytes) -> Phrases:
        """Parses on from where the text ended."""
        known, at = self.known, self.at
        find, last = known.get, len(known)
        for byte in text:
            key = at << 8 | byte
            found = find(key)
            if found is None:
                last += 1
                known[key] = last
                at = 0
            else:
                at = found
        self.at = at
        return self

    def fingerprint(self) -> np.ndarray:
        """The slots' least values."""
        least = np.full(SLOTS, EMPTY, np.uint32)
        if self.known:
            hashes = phrase_hashes(np.fromiter(self.known, np.int64, len(self.known)))
            np.minimum.at(least, (hashes >> np.uint64(58)).astype(np.int64), (hashes & np.uint64(0xFFFFFFFE)).astype(np.uint32))
        return least


def phrase_hashes(keys: np.ndarray) -> np.ndarray:
    """64-bit hashes of the phrases of a trie, from the keys in order of number: each of that of the phrase it extends and its last byte."""
    parent, byte = keys >> 8, (keys & 255).astype(np.uint64)
    hashes = np.zeros(len(keys) + 1, np.uint64)
    done = np.zeros(len(keys) + 1, bool)
    done[0] = True
    left = np.arange(len(keys))
    while left.size:
        ready = done[parent[left]]
        now = left[ready]
        hashes[now + 1] = mix64(hashes[parent[now]] * ODD + byte[now] + np.uint64(1))
        done[now + 1] = True
        left = left[~ready]
    return hashes[1:]


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; two texts without phrases are alike."""
    filled = (a != EMPTY) | (b != EMPTY)
    return float(((a == b) & filled).sum() / filled.sum()) if filled.any() else 1.0


def fingerprint(text: bytes) -> np.ndarray:
    return Phrases().add(text).fingerprint()


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs, with the fingerprint of the text; a column of that name is replaced. Null and empty texts have one of empty slots; equal texts have equal ones.
    Texts are parsed whole; a table without rows gives none."""

    def printer() -> Callable[[pa.Array], pa.Array]:
        return lambda texts: pa.array((text_of(fingerprint(t.as_py())) for t in texts), pa.string())

    return with_computed(docs, "text", "fingerprint", T.StringType(), printer)


def _cuts(quantiles: list[int], unnamed: int) -> list[tuple[int | None, int]]:
    """Where buckets begin, as (doc_id, hash of the text): at each quantile, and within an id that several quantiles share, or in the
    `unnamed` buckets of rows without an id, at even steps of the hash."""
    steps = lambda m: [LOWEST + j * (1 << 64) // m for j in range(1, m)]
    found: list[tuple[int | None, int]] = [(None, h) for h in steps(unnamed)]
    if unnamed:
        found.append((LOWEST, LOWEST))
    for i, m in sorted(collections.Counter(quantiles).items()):
        found += [(i, LOWEST), *((i, h) for h in steps(m))]
    return sorted(set(found), key=lambda c: (c[0] is not None, c[0] or 0, c[1]))


def _bucket(cuts: list[tuple[int | None, int]]) -> Column:
    """How many of the cuts (doc_id, hash) has reached: by groups of cuts first, then within one."""
    width = max(1, math.isqrt(len(cuts)))
    rows = [{"i": i, "h": h} for i, h in cuts]
    groups = [rows[i : i + width] for i in range(0, len(rows), width)]
    firsts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<struct<i:bigint,h:bigint>>")
    inner = F.from_json(F.lit(json.dumps(groups)), "array<array<struct<i:bigint,h:bigint>>>")
    reached = lambda cs: F.size(F.filter(cs, lambda c: c <= F.struct(F.col("doc_id").alias("i"), F.col("hash").alias("h"))))
    group = reached(firsts)
    return F.when(group == 0, 0).otherwise((group - 1) * width + reached(F.get(inner, group - 1)))


def with_next(docs: DataFrame, size: int = BUCKET, most: int = MOST_BUCKETS) -> DataFrame:
    """doc_id, text, bucket and head of documents, dealt by bucket and in order (doc_id, nulls first, then a hash of the text, then the text), so that in
    each bucket every document is followed by the next one of all, the last of all by the first. Rows with head 1 are
    copies of another bucket's first document.

    Buckets are ranges of (doc_id, hash) between quantiles of some `size` bytes, or more where there would be over `most` of them; rows that share
    an id are split like others. The driver gets a pair of numbers for each bucket, so the bound holds there too. Null texts are empty, a
    table without rows gives none, and other columns are not looked at.
    """
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    bytes_ = F.octet_length("text").cast("bigint")
    every, unnamed = (int(x or 0) for x in own.agg(F.sum(bytes_), F.sum(F.when(F.col("doc_id").isNull(), bytes_))).first())
    size = max(size, -(-every // most))
    n = max(1, -(-(every - unnamed) // size))
    quantiles = own.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 20 * n)).first()[0] if n > 1 else None
    cuts = _cuts(quantiles or [], -(-unnamed // size))
    placed = own.withColumn("bucket", _bucket(cuts) if cuts else F.lit(0))
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.min(F.struct("doc_id", "hash"))).collect())
    heads = [(bucket, of[0], of[1]) for (bucket, _), (_, of) in zip(firsts, firsts[1:] + firsts[:1], strict=True)]
    wanted = docs.sparkSession.createDataFrame(heads, "bucket int, of bigint, by bigint")  # as many rows as buckets
    met = own.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("by")))
    follow = met.groupBy("bucket", "doc_id", "hash").agg(F.min("text").alias("text"), F.lit(1).alias("head"))
    return placed.withColumn("head", F.lit(0)).unionByName(follow).repartitionById(len(cuts) + 1, F.col("bucket")).sortWithinPartitions("bucket", "head", "doc_id", "hash", "text")


def edited_likeness(ordered: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of documents as with_next deals them.

    The edited text has the last half of the code points, rounded down, replaced by as many first ones of the next document, or all.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held = None
            for batch in stream:
                for i, text, bucket, head in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    half = len(text) // 2
                    begin = text[: len(text) - half].encode()
                    start = Phrases().add(begin)
                    print_ = start.copy().add(text[len(text) - half :].encode()).fingerprint()
                    if held and held[0] == bucket:
                        _, before, n, first, parsed, own = held
                        change = text[: n // 2].encode()
                        edited = parsed.add(change).fingerprint()
                        yield before, n, hashlib.sha256(first + change).hexdigest(), text_of(own), text_of(edited), likeness(own, edited), likeness(own, print_)
                    held = None if head else (bucket, i, len(text), begin, start, print_)

        yield from batches(rows(), out, 1000)

    return small_batches(ordered).select("doc_id", "text", "bucket", "head").mapInArrow(run, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document, a row each.

    Null and empty texts have no phrases, and are alike to each other; of rows that share an id that with the smaller hash of
    its text comes first; the only document is followed by itself; texts are parsed whole; other columns are not looked
    at; a table without rows gives none.
    """
    return edited_likeness(with_next(read(spark, sf_dir, "documents")))
