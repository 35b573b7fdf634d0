"""Tables of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_id, frame, vec_id, v."""
    place = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("content_id"), place.cast("bigint").alias("frame"), "vec_id", F.col("embedding").alias("v"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """content_id and pcm: the vectors of a recording, one after the other, as a signal."""
    own = frames(spark, sf_dir).groupBy("content_id").agg(F.sort_array(F.collect_list(F.struct("frame", "v"))).alias("rows"))  # a recording per row
    return own.select("content_id", F.flatten(F.transform("rows", lambda r: r["v"].cast("array<double>"))).alias("pcm"))


def r6(c: Column, name: str) -> Column:
    return (F.round(c, 6) + 0.0).alias(name)


FRAMES = """g AS (SELECT label::BIGINT AS content_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, vec_id, embedding::DOUBLE[] AS v FROM embeddings)"""


def sql_l2(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def sql_dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
