"""Nearest neighbours: exact, in blocks, and by the nearest centroids.

Queries of one block travel to the tasks that read the references; each task keeps k rows per query, so that what is shuffled
grows with tasks, not with pairs. Larger query sets never pass the driver: blocks of queries and blocks of references
meet in a task each, which holds the queries and streams the references. By centroids, a cell's references are dealt
over tasks of bounded size, and only the queries that probe the cell go there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.functions import vectors

#: Bytes of query vectors that a task holds.
MOST_QUERY_BYTES = 64_000_000
#: Bytes of reference vectors in a block, where queries are more than one block. A task streams them.
REFERENCE_BYTES = 1_000_000_000
#: Reference rows that meet all queries of a block in one matrix product.
ROWS = 4096
#: References of a cell that a task holds, on average.
CELL_ROWS = 50_000
FOUND = pa.schema([("qid", pa.int64()), ("rid", pa.int64()), ("distance", pa.float64())])


def nearest(queries: DataFrame, references: DataFrame, k: int, inner_product: bool = False, max_distance: float | None = None, exclude: str | None = None) -> DataFrame:
    """(qid, rid, distance, rank) of the k nearest references of each query.

    queries: qid, v; references: rid, v (with ids that are bigint). distance is squared L2, or the inner product, of which large values are near. Ties go to
    the smaller rid. exclude="same" leaves out a reference with the id of the query. k may exceed the references; without
    either side there are no rows.
    """
    if k < 1:
        raise ValueError("k must be positive")
    size = queries.select(F.count("*"), F.max(F.size("v"))).first()
    count, width = int(size[0]), int(size[1] or 0)
    blocks = max(1, -(-count * width * 8 // MOST_QUERY_BYTES))
    queries = queries.select(F.col("qid").cast("bigint").alias("qid"), vectors.doubles(F.col("v")).alias("v"))
    references = references.select(F.col("rid").cast("bigint").alias("rid"), vectors.doubles(F.col("v")).alias("v"))
    found = (_one_block if blocks == 1 else _by_blocks)(queries, references, blocks, k, inner_product, max_distance, exclude)
    order = [F.desc("distance") if inner_product else F.asc("distance"), F.asc("rid")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Best:
    """The k best references of each query of a block, by and by."""

    def __init__(self, qids: np.ndarray, q: np.ndarray, k: int, inner: bool, most: float | None, exclude: str | None):
        self.qids, self.q, self.k, self.inner, self.most, self.exclude = qids, q, k, inner, most, exclude
        self.best = np.full((len(qids), k), np.inf)
        self.who = np.full((len(qids), k), np.iinfo(np.int64).max)

    def add(self, rids: np.ndarray, rows: np.ndarray) -> None:
        if not len(self.qids):
            return
        for at in range(0, len(rids), ROWS):
            r, own = rows[at : at + ROWS], rids[at : at + ROWS]
            for low in range(0, len(self.qids), 64):  # so many queries at a time bound the differences in memory
                part = slice(low, low + 64)
                d = -(self.q[part] @ r.T) if self.inner else _squares(self.q[part], r)
                if self.most is not None:
                    d = np.where(d > self.most, np.inf, d)
                if self.exclude:
                    d[self.qids[part, None] == own[None, :]] = np.inf
                near = d <= self.best[part, -1:]
                if not near.any():
                    continue
                keep = np.flatnonzero(near.any(axis=0))  # the others are beyond every query's k
                both = np.concatenate([self.best[part], d[:, keep]], axis=1)
                names = np.concatenate([self.who[part], np.broadcast_to(own[keep], (len(d), len(keep)))], axis=1)
                names = np.where(np.isinf(both), np.iinfo(np.int64).max, names)
                order = np.lexsort((names, both), axis=1)[:, : self.k]
                self.best[part], self.who[part] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)

    def rows(self) -> pa.RecordBatch:
        which, place = np.nonzero(np.isfinite(self.best))
        values = self.best[which, place]
        return pa.RecordBatch.from_arrays([pa.array(self.qids[which]), pa.array(self.who[which, place]), pa.array(-values if self.inner else values)], schema=FOUND)


def _one_block(queries: DataFrame, references: DataFrame, blocks: int, k: int, *how) -> DataFrame:
    held = queries.orderBy("qid").toArrow().combine_chunks()
    column = held.column("v").combine_chunks() if len(held) else pa.array([], pa.list_(pa.float64()))
    shared = queries.sparkSession.sparkContext.broadcast((held.column("qid").to_numpy(), matrix(column)))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*shared.value, k, *how)
        for batch in stream:
            best.add(batch.column(0).to_numpy(zero_copy_only=False), matrix(batch.column(1)))
        yield best.rows()

    return references.mapInArrow(run, "qid bigint, rid bigint, distance double")


def _by_blocks(queries: DataFrame, references: DataFrame, blocks: int, k: int, *how) -> DataFrame:
    """Every block of queries with every block of references; each pair of blocks is a partition, its queries come first."""
    size = references.select(F.count("*"), F.max(F.size("v"))).first()
    others = max(1, -(-int(size[0]) * int(size[1] or 0) * 8 // REFERENCE_BYTES))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, ids, rows = None, [], []
        for batch in stream:
            kind, own, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            ids.append(own[kind == 0])
            rows.append(v[kind == 0])
            if kind[-1] == 0:
                continue
            if best is None:
                best = Best(np.concatenate(ids), np.concatenate(rows), k, *how)
            best.add(own[kind == 1], v[kind == 1])
        if best is not None:
            yield best.rows()

    asked = queries.select(F.lit(0).alias("kind"), F.col("qid").alias("id"), "v", F.pmod(F.xxhash64("qid"), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("o"))
    given = references.select(F.lit(1).alias("kind"), F.col("rid").alias("id"), "v", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("b"), F.pmod(F.xxhash64("rid"), F.lit(others)).cast("int").alias("o"))
    every = asked.unionByName(given).withColumn("part", (F.col("b") * others + F.col("o")).cast("int"))
    dealt = every.repartitionById(blocks * others, F.col("part")).sortWithinPartitions("part", "kind")
    return dealt.select("kind", "id", "v").mapInArrow(run, "qid bigint, rid bigint, distance double")


def _squares(q: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(r)))
    for j in range(q.shape[1]):  # direct subtraction: exact zeros for equal rows
        out += (q[:, j, None] - r[None, :, j]) ** 2
    return out


def assign(rows: DataFrame, centroids: list[tuple[int, list[float]]], probes: int, column: str = "v") -> DataFrame:
    """rows (of numbers and arrays), once for each of its `probes` nearest centroids (id, vector; a bounded list), as column centroid. Ties go to the smaller id."""
    ordered = sorted(centroids)
    shared = rows.sparkSession.sparkContext.broadcast((np.array([i for i, _ in ordered], np.int64), np.array([v for _, v in ordered], float)))
    at, schema = rows.columns.index(column), T.StructType([*rows.schema.fields, T.StructField("centroid", T.LongType())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, table = shared.value
        for batch in stream:
            d = _squares(matrix(batch.column(at)), table)
            order = np.argsort(d, axis=1, kind="stable")[:, :probes]
            again = batch.take(pa.array(np.repeat(np.arange(len(d)), order.shape[1])))
            yield pa.RecordBatch.from_arrays([*again.columns, pa.array(ids[order].ravel())], names=[*batch.schema.names, "centroid"])

    return rows.mapInArrow(run, schema)


def nearest_by_cell(queries: DataFrame, references: DataFrame, centroids: list[tuple[int, list[float]]], k: int, probes: int, exclude: str | None = None, cell_rows: int = CELL_ROWS) -> DataFrame:
    """As nearest by squared L2, but a query meets only the references of its `probes` nearest centroids (an inverted file).

    Each reference lies in one cell. Cells of more than cell_rows references are dealt over several tasks, each of which gets all
    queries that probe the cell, and returns k rows for each.
    """
    cells = assign(references.select(F.col("rid").cast("bigint").alias("rid"), vectors.doubles(F.col("v")).alias("v")), centroids, 1)
    asked = assign(queries.select(F.col("qid").cast("bigint").alias("qid"), vectors.doubles(F.col("v")).alias("v")), centroids, probes)
    parts = F.broadcast(cells.groupBy("centroid").agg(F.ceil(F.count("*") / cell_rows).cast("int").alias("parts")))  # a row per centroid
    cells = cells.join(parts, "centroid").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int")).drop("parts")
    asked = asked.join(parts, "centroid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def meet(q: pa.Table, r: pa.Table) -> pa.Table:
        found = []
        if len(q) and len(r):
            rids, rows = r.column("rid").to_numpy(), matrix(r.column("v").combine_chunks())
            for low in range(0, len(q), 20_000):  # so many queries at a time
                some = q.slice(low, 20_000)
                best = Best(some.column("qid").to_numpy(), matrix(some.column("v").combine_chunks()), k, False, None, exclude)
                best.add(rids, rows)
                found.append(best.rows())
        return pa.Table.from_batches(found, schema=FOUND)

    pairs = asked.groupBy("centroid", "part").cogroup(cells.groupBy("centroid", "part")).applyInArrow(meet, "qid bigint, rid bigint, distance double")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "rid")))
    return ranked.where(F.col("rank") <= k)


#: Rows that centroids are trained on, of which so many from one source, the seed and the steps; fixed values.
SAMPLE, PER_SOURCE, SEED, STEPS = 50_000, 2_000, 20261002, 20


def train_centroids(rows: DataFrame, n: int, sample: int = SAMPLE, per_source: int = PER_SOURCE, seed: int = SEED, steps: int = STEPS) -> list[tuple[int, list[float]]]:
    """Centroids by k-means of at most `sample` rows (source, rid, v), of each source at most `per_source`, in the order of a hash."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    some = capped(rows, sample, per_source, seed).select(array_to_vector(vectors.doubles(F.col("v"))).alias("features"))
    model = KMeans(k=n, seed=seed, maxIter=steps).fit(some)
    return [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]


def capped(rows: DataFrame, total: int, per_source: int, seed: int) -> DataFrame:
    """At most per_source rows of each source and `total` in all, those that come first by the SHA-256 of seed and id."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("rid").cast("string")), 256)
    first = rows.withColumn("order", order).withColumn("place", F.row_number().over(Window.partitionBy("source").orderBy("order", "rid")))
    return first.where(F.col("place") <= per_source).orderBy("order", "rid").limit(total).drop("order", "place")
