"""Principal components from moments that partitions sum up on their own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(rows: DataFrame, column: str = "v") -> DataFrame:
    """(i, j, n, sum_i, sum_j, sum_ij) for i <= j: each partition sends one row per pair of dimensions."""
    schema = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), ("si", pa.float64()), ("sj", pa.float64()), ("sij", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, ss = 0, None, None
        for batch in stream:
            if batch.num_rows:
                x = np.array(batch.column(0).to_pylist(), float)
                n += len(x)
                s = x.sum(axis=0) if s is None else s + x.sum(axis=0)
                ss = x.T @ x if ss is None else ss + x.T @ x
        if n:
            i, j = np.triu_indices(len(s))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.full(len(i), n)), pa.array(s[i]), pa.array(s[j]), pa.array(ss[i, j])], schema=schema)

    partial = rows.select(column).where(F.col(column).isNotNull()).mapInArrow(run, "i int, j int, n bigint, si double, sj double, sij double")
    return partial.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("si").alias("sum_i"), F.sum("sj").alias("sum_j"), F.sum("sij").alias("sum_ij"))


def covariances(found: DataFrame) -> DataFrame:
    return found.withColumn("cov", F.try_divide(F.col("sum_ij") - F.col("sum_i") * F.col("sum_j") / F.col("n"), F.col("n") - 1))


@dataclass(frozen=True)
class Pca:
    mean: list[float]
    components: list[list[float]]
    explained: list[float]
    rows: int


def fit(rows: DataFrame, dim: int, column: str = "v") -> Pca:
    """Components by descending variance, the largest entry of each positive; fewer than max(2, dim + 1) rows raise ValueError. The moments (dims**2 / 2 rows) reach the driver."""
    table = covariances(moments(rows, column)).toPandas()
    n = int(table["n"].iat[0]) if len(table) else 0
    if n < max(2, dim + 1):
        raise ValueError("too few rows")
    d = int(table["j"].max()) + 1
    cov = np.zeros((d, d))
    cov[table["i"], table["j"]] = cov[table["j"], table["i"]] = table["cov"]
    mean = np.zeros(d)
    mean[table["i"]] = table["sum_i"] / n
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1][:dim]
    values, axes = np.clip(values, 0, None), axes[:, order].T
    axes *= np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])[:, None]
    return Pca(mean.tolist(), axes.tolist(), (values[order] / max(values.sum(), 1e-300)).tolist(), n)


def save(model: Pca, spark, path: str) -> None:
    spark.createDataFrame(pd.DataFrame({"format_version": [1], "mean": [model.mean], "components": [model.components], "explained": [model.explained], "rows": [model.rows]})).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Pca:
    row = spark.read.parquet(path).first()
    if row["format_version"] != 1:
        raise ValueError("unknown format of a PCA model")
    return Pca(list(row["mean"]), [list(c) for c in row["components"]], list(row["explained"]), row["rows"])
