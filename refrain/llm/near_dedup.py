"""Near duplicates: circulant MinHash, banding, and exact Jaccard similarity of whole shingle sets.

1. Each document's shingle set, its circulant MinHash signature (two permutations, one of them shifted circularly) and
   from that one key per band. Only the keys, the size of the set and a digest of it are kept.
2. Documents with equal sets are one class, represented by its least id. Hot copies end here, by a partial aggregation.
3. In each band's bucket, the representatives are joined with the least of them. The components of these stars are the
   candidate clusters: two representatives that share any bucket are in one cluster.
   Their texts are fetched once more: a Bloom filter of bounded size keeps most others out of the shuffle.
4. Within a cluster all pairs are compared on whole sets. Small clusters are a task's work. Of a large one, every member
   is first compared with one pivot, the leader of most stars: those linked with it need no comparison among themselves,
   and, as the Jaccard distance is a metric, no link joins members whose distances from the pivot differ by more than
   the threshold, nor any whose sizes differ by more. The others are dealt by distance and size in rings and blocks, and
   only blocks that a link may join meet, each two in a task of their own. So no task holds more than two blocks of bounded
   members and bytes (a single set is never split), a group whose members are near its pivot costs as much as it has
   rows, and per task only a spanning forest of the links is returned, never the pairs.
5. The components of the links are the result.

With 50 bands of 6 rows, a pair of similarity 0.8 shares no bucket with a probability of (1 - 0.8 ** 6) ** 50 = 3e-7.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import bloom
from refrain.llm.common import Scratch, as_bytes, batches, quoted, read, small_batches, stored
from refrain.llm.components import components
from refrain.llm.shingles import ODD, WordHashes, mix64, shingle_set, signature


@dataclass(frozen=True)
class NearParams:
    """width: words of a shingle. Link: 100 * intersection >= percent * union. block, block_bytes: members of a cluster, and bytes of
    their sets, that a task holds, or twice as many."""

    width: int = 5
    percent: int = 80
    bands: int = 50
    rows: int = 6
    block: int = 192
    block_bytes: int = 16_000_000


def band_keys(found: np.ndarray, p: NearParams) -> list[int]:
    rows = signature(found, p.bands * p.rows).astype(np.uint64).reshape(p.bands, p.rows)
    key = mix64(np.arange(1, p.bands + 1, dtype=np.uint64))
    for i in range(p.rows):
        key = mix64(key * ODD + rows[:, i])
    return key.view(np.int64).tolist()


def sketches(docs: DataFrame, p: NearParams) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and bands of documents (doc_id, text)."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()

        def rows():
            for batch in stream:
                for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    found = shingle_set(known.of(text.as_py().lower().split()), p.width)
                    if len(found):
                        yield i, len(found), hashlib.blake2b(found.tobytes(), digest_size=16).digest(), band_keys(found, p)
                    else:
                        yield i, 0, None, []

        yield from batches(rows(), out)

    return small_batches(docs).select(F.col("doc_id").cast("bigint"), as_bytes("text")).mapInArrow(run, "doc_id bigint, n_shingles bigint, set_key binary, bands array<bigint>")


def _with_sets(docs: DataFrame, p: NearParams) -> DataFrame:
    """docs (text last), with the bytes of the shingle set for the text."""
    schema = docs.drop("text").schema.add("found", "binary")
    at = len(docs.columns) - 1

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in stream:
            sets = pa.array((shingle_set(known.of(t.as_py().lower().split()), p.width).tobytes() for t in batch.column(at)), pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(at)), sets], names=schema.names)

    return docs.withColumn("text", as_bytes("text")).mapInArrow(run, schema)


def forest(ids: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges that connect what the links among these sets connect."""
    sizes = np.array([len(s) for s in sets])
    every = np.concatenate(sets)
    every.sort()
    twice = np.zeros(len(every), bool)  # the second of two equal values; others of the same value follow it
    twice[1:] = every[1:] == every[:-1]
    shared = np.unique(every[twice])
    del every, twice
    found = []
    for i, values in enumerate(sets):
        at = np.searchsorted(shared, values)
        at = at[shared[np.minimum(at, len(shared) - 1)] == values] if len(shared) else at[:0]
        found.append((np.full(len(at), i, np.int32), at.astype(np.int32)))
    member, column = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    kind = np.float32 if sizes.max() < 1 << 24 else np.float64  # counts up to that are exact
    common = np.zeros((len(sets), len(sets)), kind)
    width = 8192
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [low, low + width]))
        part_of = np.zeros((len(sets), width), kind)
        part_of[member[part], column[part] - low] = 1
        common += part_of @ part_of.T
    common = common.astype(np.int64)
    linked = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    left = np.ones(len(sets), bool)
    for start in range(len(sets)):  # breadth first; every member is left once
        if not left[start]:
            continue
        left[start] = False
        wave = [start]
        while wave:
            reached = np.flatnonzero(linked[wave].any(axis=0) & left)
            left[reached] = False
            for i in reached.tolist():
                parent[i] = start
            wave = reached.tolist()
    return [(ids[i], ids[root(i)]) for i in range(len(sets)) if root(i) != i and ids[i] != ids[root(i)]]


def _links(members: DataFrame, p: NearParams) -> DataFrame:
    """Links (a, b) among the members (cluster, p, q, id, found) of each two blocks, which follow each other in a partition."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            key, ids, sets = None, [], []
            for batch in stream:
                for *this, i, found in zip(*(batch.column(n).to_pylist() for n in ("cluster", "p", "q", "id", "found")), strict=True):
                    if this != key:
                        if len(ids) > 1:
                            yield from forest(ids, sets, p.percent)
                        key, ids, sets = this, [], []
                    ids.append(i)
                    sets.append(np.frombuffer(found, np.uint64))
            if len(ids) > 1:
                yield from forest(ids, sets, p.percent)

        yield from batches(rows(), out)

    dealt = members.repartition(F.col("cluster"), F.col("p"), F.col("q")).sortWithinPartitions("cluster", "p", "q")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _from_pivot(large: DataFrame, pivots: DataFrame, p: NearParams) -> DataFrame:
    """large (cluster, blocks, id, found) with pivot, distance from it and linked; pivots: cluster, pivot."""
    schema = pa.schema([("cluster", pa.int64()), ("id", pa.int64()), ("found", pa.binary()), ("pivot", pa.int64()), ("distance", pa.float64()), ("linked", pa.bool_())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            pivot, own = None, None
            for batch in stream:
                for cluster, head, i, found in zip(*(batch.column(n).to_pylist() for n in ("cluster", "head", "id", "found")), strict=True):
                    this = np.frombuffer(found, np.uint64)
                    if head:  # it comes first
                        pivot, own = i, this
                        continue
                    common = len(np.intersect1d(own, this, assume_unique=True))
                    every = len(own) + len(this) - common
                    yield cluster, i, found, pivot, 1 - common / every, 100 * common >= p.percent * every

        yield from batches(rows(), schema, 256)

    own = large.withColumn("own", F.expr("cast(pmod(xxhash64(id), blocks) as int)")).withColumn("head", F.lit(0))
    # where rows share the pivot's doc_id, one of their texts is the pivot
    one = large.join(pivots, (large["id"] == pivots["pivot"]) & (large["cluster"] == pivots["cluster"])).groupBy(large["cluster"], "blocks", "id").agg(F.min("found").alias("found"))
    heads = one.select("cluster", "blocks", "id", "found", F.explode(F.expr("sequence(0, blocks - 1)")).alias("own"), F.lit(1).alias("head"))
    every = own.select("cluster", "own", "head", "id", "found").unionByName(heads.select("cluster", "own", "head", "id", "found"))
    dealt = every.repartition("cluster", "own").sortWithinPartitions("cluster", "own", F.desc("head"))
    return dealt.mapInArrow(run, "cluster bigint, id bigint, found binary, pivot bigint, distance double, linked boolean")


def _blocks(members, sizes, p: NearParams):
    """Blocks for so many members of sets with so many shingles."""
    return F.greatest(F.ceil(members / p.block), F.ceil(sizes * 8 / p.block_bytes)).cast("int")


def _large_links(large: DataFrame, stars: DataFrame, p: NearParams, scratch: Scratch) -> DataFrame:
    """Links (a, b) among the members of large clusters (cluster, blocks, id, found)."""
    leaders = stars.groupBy(F.col("b").alias("pivot")).agg(F.count("*").alias("n"))
    pivots = leaders.join(large.select("cluster", F.col("id").alias("pivot")).distinct(), "pivot").groupBy("cluster").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("pivot"))
    placed = scratch.stored(_from_pivot(large, scratch.stored(pivots, "pivots"), p), "placed")
    reach = 1 - p.percent / 100
    inner, width = 4, max(reach / 4, 1e-6)
    # rings of a quarter of the threshold: 0 to 3 are linked with the pivot, the others are not
    ring = F.when(F.col("linked"), F.least(F.floor(F.col("distance") / width), F.lit(inner - 1))).otherwise(F.greatest(F.floor(F.col("distance") / width), F.lit(inner)))
    # sizes by powers of the threshold: linked sets are of the same class or of neighbouring ones
    size = F.floor(F.log(F.octet_length("found") / 8) / max(-math.log(p.percent / 100) * 1.000001, 1e-3))
    ringed = placed.withColumns({"ring": ring.cast("int"), "size": size.cast("int")})
    counts = ringed.groupBy("cluster", "ring", "size").agg(_blocks(F.count("*"), F.sum(F.octet_length("found") / 8), p).alias("subs"))
    rings = scratch.stored(counts.groupBy("cluster").agg(F.collect_list(F.struct("ring", "size", "subs")).alias("rings")), "rings")  # some hundred numbers for each large cluster
    met = ringed.select("cluster", "id", "found", "ring", "size").join(rings, "cluster")
    own = F.get(F.filter("rings", lambda r: (r["ring"] == F.col("ring")) & (r["size"] == F.col("size"))), F.lit(0))
    met = met.withColumn("sub", F.pmod(F.xxhash64("id"), own["subs"]))
    # one ring more than the threshold, as rings have width
    far = F.filter("rings", lambda r: (F.abs(r["ring"] - F.col("ring")) <= inner + 1) & ((r["ring"] >= inner) | (F.col("ring") >= inner)) & (F.abs(r["size"] - F.col("size")) <= 1))
    met = met.withColumn("to", F.explode(far)).withColumn("to_sub", F.explode(F.expr("sequence(0, to.subs - 1)")))
    code = lambda r, z, sub: (r.cast("bigint") * (1 << 16) + z) * (1 << 32) + sub
    here, there = code(F.col("ring"), F.col("size"), F.col("sub")), code(F.col("to.ring"), F.col("to.size"), F.col("to_sub"))
    links = _links(met.select("cluster", F.least(here, there).alias("p"), F.greatest(here, there).alias("q"), "id", "found"), p)
    return links.unionByName(placed.where("linked and id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")))


def near_duplicates(docs: DataFrame, p: NearParams = NearParams()) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of documents (doc_id, text, ...).

    Null and empty texts have no shingles and are linked with nothing. Rows that share a doc_id are one document, linked
    with whatever any of its texts is linked with. A null doc_id is linked with nothing: its component is null and it is
    not kept. Columns other than doc_id and text are not looked at. A table without rows gives none. Texts are taken whole; the set of
    one text must fit a task.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    scratch = Scratch(docs.sparkSession)
    found = stored(sketches(docs, p), "sketches")
    same = found.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    classes = scratch.stored(same.where("id is not null"), "classes")
    keys = classes.select(F.explode("bands").alias("key"), "id")
    leaders = keys.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).where("leader <> last").drop("last")
    stars = scratch.stored(keys.join(leaders, "key").where("id <> leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    rest = components(stars, scratch)
    clusters = rest.unionByName(rest.select(F.col("component").alias("id"), "component").distinct()).withColumnRenamed("component", "cluster")
    weighed = clusters.join(classes.groupBy("id").agg(F.sum("n_shingles").alias("w")), "id")
    sizes = weighed.groupBy("cluster").agg(_blocks(F.count("*"), F.sum("w"), p).alias("blocks"))
    members = scratch.stored(clusters.join(sizes, "cluster").select("id", "cluster", "blocks"), "members")
    n = min(bloom.blocks_for(members.count()), bloom.MOST_BLOCKS)
    wanted = bloom.possible(docs.withColumnRenamed("doc_id", "id"), F.col("id"), bloom.filter_of(members, F.col("id"), n), n)
    texts = members.join(wanted.hint("merge"), "id").select("cluster", "blocks", "id", "text")
    sets = scratch.stored(_with_sets(texts, p), "sets")
    links = _links(sets.where("blocks = 1").select("cluster", F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q"), "id", "found"), p)
    if not members.where("blocks > 1").isEmpty():
        links = links.unionByName(_large_links(sets.where("blocks > 1"), stars, p, scratch))
    linked = components(links, scratch)
    moved = stored(classes.select("set_key", "id", "n").join(linked, "id", "left").where("n > 1 or component is not null").select("set_key", F.coalesce("component", "id").alias("component")), "moved")
    scratch.drop()
    named = found.select("doc_id", "n_shingles", "set_key").join(moved, "set_key", "left")
    return named.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.expr("doc_id = component_id"), F.lit(False)))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, a row each, as near_duplicates finds them with 4-word shingles.

    Null and empty texts have no shingles and are linked with nothing; repeated rows are one document with a row each; of a
    group the least doc_id is kept; other columns are not looked at; a table without rows gives none.
    """
    return near_duplicates(read(spark, sf_dir, "documents"), NearParams(width=4))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the least doc_id; one row where rows share that."""
    gone = stored(near_duplicates(docs).where("not kept and doc_id is not null").select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*quoted(docs.columns))
    again = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").limit(1)
    return left if again.isEmpty() else left.where("doc_id is null").unionByName(left.where("doc_id is not null").dropDuplicates(["doc_id"]))
