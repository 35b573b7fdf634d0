"""Enrolment of recordings that arrive over time: micro-batches, appended once per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refrain.functions import clock


def enroll_batch(batch: DataFrame, batch_id: int, path: str, factor: int, phase: int = 0) -> None:
    """Appends the thinned rows of recordings that the gallery does not hold; a batch that comes again overwrites its own folder."""
    spark = batch.sparkSession
    kept = batch.where(clock.on_grid(F.col("frame"), factor, phase))
    try:
        # what this batch wrote in an attempt before must not count as held
        held = spark.read.parquet(path).where(F.col("batch") != batch_id).select("content_id").distinct()
        kept = kept.join(held, "content_id", "left_anti")
    except Exception as none_yet:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(none_yet) and "UNABLE_TO_INFER_SCHEMA" not in str(none_yet):
            raise
    kept.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def enroll_stream(prints: DataFrame, path: str, checkpoint: str, factor: int, phase: int = 0) -> StreamingQuery:
    """Starts the enrolment of a stream of fingerprints (content_id, frame, v); all rows of a recording must come in one batch."""
    return prints.writeStream.foreachBatch(lambda b, i: enroll_batch(b, i, path, factor, phase)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def digest(spark: SparkSession, path: str) -> str:
    """The digest of an enrolled gallery, whatever the order of its files: of the number of rows and the sums of two parts of their digests."""
    row = F.sha2(F.concat_ws("|", "content_id", "frame", F.array_join(F.transform("v", lambda x: x.cast("string")), ",")), 256)
    part = lambda at: F.sum(F.conv(F.substring("row", at, 15), 16, 10).cast("decimal(20,0)"))
    found = spark.read.parquet(path).select(row.alias("row")).agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"))
    return found.select(F.sha2(F.concat_ws(":", "n", "a", "b"), 256)).first()[0]
