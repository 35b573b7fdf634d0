"""Hashes of words as landmarks and as MinHash bins, from MD5, so that any engine finds the same ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def number(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), " "), lambda w: w != "")


def landmarks(docs: DataFrame, name: str, text: str) -> DataFrame:
    """(name, t, hash): of each word and the next one, at the word's position."""
    own = docs.select(name, words(F.col(text)).alias("w")).where("size(w) > 1")
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    return own.select(name, F.posexplode(pairs).alias("t", "pair")).select(name, F.col("t").cast("bigint").alias("t"), number(F.col("pair")).alias("hash"))


def _bins(found: pa.ListArray, tables: int, rows: int) -> pa.ListArray:
    """The bins of each list of words, none of them empty; a word of the batch is hashed once."""
    coded = found.flatten().dictionary_encode()
    own, codes = coded.dictionary.cast(pa.binary()).to_pylist(), coded.indices.to_numpy()
    starts = np.concatenate([[0], np.cumsum(found.value_lengths().to_numpy())[:-1]])
    least = []
    for i in range(tables * rows):
        digests = [hashlib.md5(b"%d:" % i + w).digest() for w in own]
        parts = np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2)
        order = np.lexsort((parts[:, 1], parts[:, 0]))
        rank = np.empty(len(own), np.int64)
        rank[order] = np.arange(len(own))
        least.append([digests[w].hex() for w in order[np.minimum.reduceat(rank[codes], starts)]])
    joined = [map("-".join, zip(*least[t * rows : (t + 1) * rows], strict=True)) for t in range(tables)]
    each = zip(*([int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in xs] for xs in joined), strict=True)
    return pa.array([list(x) for x in each], pa.list_(pa.int64()))


def minhash_bins(docs: DataFrame, name: str, text: str, tables: int, rows: int) -> DataFrame:
    """(name, bins): per table one bin, of `rows` MinHash values of the distinct words each.

    By Arrow: Spark's own MD5 would run for each word of each document and hash.
    """
    each = docs.groupBy(name).agg(F.array_distinct(F.flatten(F.transform(F.collect_list(text), words))).alias("w")).where("size(w) > 0")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), _bins(batch.column(1), tables, rows)], names=[name, "bins"])

    return each.mapInArrow(run, T.StructType([each.schema[name], T.StructField("bins", T.ArrayType(T.LongType()))]))
