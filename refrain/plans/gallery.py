"""A gallery of fingerprints that answers queries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions import clock
from refrain.functions.clock import Config
from refrain.operators import knn, matching, validate


@dataclass(frozen=True)
class Gallery:
    """rows: content_id, frame, t, v, rid. rid orders ties: by content, then frame. With centroids the search is by cells."""

    rows: DataFrame
    centroids: tuple | None = None
    probes: int = 16

    @staticmethod
    def _checked(rows: DataFrame, of: str, order: str, t: str) -> None:
        bad = validate.not_increasing(rows, of, order, t).take(1)
        if bad:
            raise ValueError(f"times of {bad[0][0]} are not finite and increasing")

    @staticmethod
    def from_fingerprints(prints: DataFrame, factor: int = 1, phase: int = 0, c: Config = Config(), centroids=None, probes: int = 16) -> Gallery:
        """Fingerprints (content_id, frame, v) thinned by physical frame; a repeated (content_id, frame) raises ValueError."""
        kept = prints.where(clock.on_grid(F.col("frame"), factor, phase)).select("content_id", "frame", "v")
        if not validate.repeated(kept, ["content_id", "frame"]).isEmpty():
            raise ValueError("a content has a frame twice")
        codes = kept.select("content_id").distinct().withColumn("code", F.row_number().over(Window.orderBy("content_id")) - 1)  # a row per recording
        coded = kept.join(codes, "content_id").withColumn("rid", F.col("code").cast("bigint") * (1 << 32) + F.col("frame"))
        return Gallery(coded.withColumn("t", clock.time_of(F.col("frame"), c)).select("content_id", "frame", "t", "v", "rid"), tuple(centroids) if centroids else None, probes)

    def search(self, queries: DataFrame, k: int = 5, max_distance: float | None = None) -> DataFrame:
        """query_id, qrow, qt, content_id, rt, distance and rank of the k nearest rows of each query row (query_id, qrow, qt, v)."""
        numbered = queries.withColumn("qid", F.xxhash64("query_id", "qrow"))
        refs = self.rows.select("rid", "v")
        found = knn.nearest(numbered, refs, k, max_distance=max_distance) if self.centroids is None else knn.nearest_by_cell(numbered, refs, list(self.centroids), k, self.probes)
        if max_distance is not None:
            found = found.where(F.col("distance") <= max_distance)
        met = found.join(self.rows.select("rid", "content_id", F.col("t").alias("rt")), "rid").join(numbered.select("qid", "query_id", "qrow", "qt"), "qid")
        return met.select("query_id", "qrow", "qt", "content_id", "rt", "distance", "rank")

    def match(self, queries: DataFrame, k: int = 5, tolerance: float = 0.12, min_votes: int = 1, limit: int = 10, max_distance: float | None = None) -> DataFrame:
        """Ranked recordings of each query by temporal-offset consensus. Query times that aren't finite and strictly increasing in the order of qrow raise ValueError."""
        self._checked(queries, "query_id", "qrow", "qt")
        counts = queries.groupBy("query_id").agg(F.count("*").alias("n"))
        return matching.consensus(self.search(queries, k, max_distance), counts, tolerance, min_votes, limit)

    def save(self, path: str) -> None:
        """Rows and centroids, each a table below the path."""
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        found = [(int(i), [float(x) for x in v]) for i, v in self.centroids or ()]
        self.rows.sparkSession.createDataFrame(found, "id bigint, v array<double>").withColumn("probes", F.lit(self.probes)).write.mode("overwrite").parquet(f"{path}/centroids")

    @staticmethod
    def load(spark, path: str) -> Gallery:
        found = spark.read.parquet(f"{path}/centroids").orderBy("id").collect()  # as many rows as centroids
        return Gallery(spark.read.parquet(f"{path}/rows"), tuple((r.id, list(r.v)) for r in found) or None, found[0].probes if found else 16)
