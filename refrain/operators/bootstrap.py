"""Bootstrap intervals of a rate whose rows come in clusters.

Rows are summed by cluster first; replicates draw clusters. The hashed forms take their weights from MD5, so that any engine finds
the same ones; each cluster has in each replicate a weight of the Poisson distribution with mean 1. The drawn forms draw from NumPy's generator.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Seed, replicates and quantiles of the drawn forms, which decide on the draws; fixed values.
SEED, REPLICATES, LEVELS = 20261002, 2000, (0.025, 0.975)
#: Numbers drawn at once: replicates come in parts, so that memory grows with the clusters alone.
DRAWN = 4_000_000
#: Cumulative probabilities of the Poisson distribution with mean 1; fixed values.
POISSON = [0.367879441171442, 0.735758882342885, 0.919698602928606, 0.981011843123846, 0.996340153172656, 0.999405815182418]


def weight(cluster: Column, replicate: Column, salt: str) -> Column:
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), cluster.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def hashed_interval(sums: DataFrame, replicates: int = 200) -> DataFrame:
    """(estimate, low, high) of sum(s) / sum(n) over clusters (cluster, s, n). Replicates without weight are dropped."""
    draws = sums.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight(F.col("cluster"), F.col("replicate"), "c"))
    return _interval(sums, draws.groupBy("replicate").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("rate")))


def hashed_crossed_interval(sums: DataFrame, replicates: int = 200) -> DataFrame:
    """The same with weights of two crossed clusterings (cluster, montage, s, n), multiplied. Weights are hashed once for each cluster, and once for each montage."""
    each = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    montages = sums.select("montage").distinct().withColumn("replicate", each).withColumn("w", weight(F.col("montage"), F.col("replicate"), "m")).where("w > 0")
    first = sums.groupBy("cluster", "montage").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).join(montages, "montage")
    first = first.groupBy("cluster", "replicate").agg(F.sum(F.col("w") * F.col("s")).alias("s"), F.sum(F.col("w") * F.col("n")).alias("n"))
    draws = first.withColumn("w", weight(F.col("cluster"), F.col("replicate"), "c"))
    return _interval(sums, draws.groupBy("replicate").agg((F.sum(F.col("w") * F.col("s")) / F.nullif(F.sum(F.col("w") * F.col("n")), F.lit(0))).alias("rate")))


def _interval(sums: DataFrame, drawn: DataFrame) -> DataFrame:
    bounds = drawn.agg(F.percentile("rate", F.lit(0.025)).alias("low"), F.percentile("rate", F.lit(0.975)).alias("high"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("estimate")).crossJoin(bounds)  # one row each


def _drawn(sums: DataFrame, columns: list[str], draw, by: list[str]) -> DataFrame:
    """draw on the cluster sums of each group; these are as many as clusters, not rows."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        low, high = draw(rows)
        first = {c: [rows[c].iat[0]] for c in by}
        return pd.DataFrame(first | {"estimate": [rows["s"].sum() / rows["n"].sum()], "low": [low], "high": [high]})

    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}
    return sums.select(*by, *columns, "s", "n").groupBy(*by).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "estimate double, low double, high double"]))


def _parts(replicates: int, width: int) -> list[int]:
    size = max(1, DRAWN // max(1, width))
    return [min(size, replicates - i) for i in range(0, replicates, size)]


def _bounds(found: np.ndarray) -> tuple[float, float]:
    return (float(np.quantile(found, LEVELS[0])), float(np.quantile(found, LEVELS[1]))) if len(found) else (float("nan"), float("nan"))


def cluster_interval(sums: DataFrame, by: list[str], seed: int = SEED, replicates: int = REPLICATES) -> DataFrame:
    """By group, the interval over clusters (place, s, n) drawn with replacement, in the order of `place`, where each first appears."""
    def draw(rows: pd.DataFrame) -> tuple[float, float]:
        rows = rows.sort_values("place")
        s, n = rows["s"].to_numpy(float), rows["n"].to_numpy(float)
        random, found = np.random.default_rng(seed), []
        for some in _parts(replicates, len(s)):
            picked = random.integers(0, len(s), (some, len(s)))
            found.append(s[picked].sum(axis=1) / n[picked].sum(axis=1))
        return _bounds(np.concatenate(found))

    return _drawn(sums, ["place"], draw, by)


def crossed_interval(sums: DataFrame, by: list[str], seed: int = SEED, replicates: int = REPLICATES) -> DataFrame:
    """By group, the interval with multinomial weights of the sorted sources and of the sorted montages, multiplied (source, montage, s, n)."""
    def draw(rows: pd.DataFrame) -> tuple[float, float]:
        return _bounds(next(iter(crossed_rates(rows, seed, replicates, ["s"]).values())))

    return _drawn(sums, ["source", "montage"], draw, by)


def crossed_rates(rows: pd.DataFrame, seed: int, replicates: int, values: list[str]) -> dict[str, np.ndarray]:
    """Rates of each value over n (source, montage, n, ...) in every replicate with weight, all from the same draws."""
    sources, i = np.unique(rows["source"].to_numpy(), return_inverse=True)
    montages, j = np.unique(rows["montage"].to_numpy(), return_inverse=True)
    parts = _parts(replicates, len(rows) + len(sources) + len(montages))
    one, two = np.random.default_rng(seed), np.random.default_rng(seed)
    each = lambda random, k, size: random.multinomial(k, np.full(k, 1 / k), size)
    for some in parts:  # montages are drawn after all sources
        each(two, len(sources), some)
    found: dict[str, list] = {v: [] for v in values}
    for some in parts:
        w = each(one, len(sources), some)[:, i] * each(two, len(montages), some)[:, j]
        total = w @ rows["n"].to_numpy(float)
        for v in values:
            found[v].append((w @ rows[v].to_numpy(float))[total > 0] / total[total > 0])
    return {v: np.concatenate(x) for v, x in found.items()}


def shared_intervals(rows: DataFrame, strata: str, values: list[str], replicates: int = 200) -> DataFrame:
    """(stratum, value, estimate, low, high): for each stratum (a column of arrays of names, so that strata may share rows) and each value (0 or 1, or sums)
    over n, with one set of hashed weights of the clusters for all of them. rows: cluster, strata, n and the values.
    """
    each = rows.select("cluster", F.explode(strata).alias("stratum"), "n", *values).groupBy("cluster", "stratum").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in values))
    weights = rows.select("cluster").distinct().withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w", weight(F.col("cluster"), F.col("replicate"), "c")).where("w > 0")
    drawn = each.join(weights, "cluster").groupBy("stratum", "replicate").agg(F.sum(F.col("w") * F.col("n")).alias("n"), *(F.sum(F.col("w") * F.col(v)).alias(v) for v in values))
    long = lambda df: df.select("stratum", F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.try_divide(F.col(v), F.col("n")).alias("rate")) for v in values))).alias("x")).select("stratum", "x.value", "x.rate")
    bounds = long(drawn).groupBy("stratum", "value").agg(F.percentile("rate", F.lit(LEVELS[0])).alias("low"), F.percentile("rate", F.lit(LEVELS[1])).alias("high"))
    whole = long(each.groupBy("stratum").agg(F.sum("n").alias("n"), *(F.sum(v).alias(v) for v in values))).withColumnRenamed("rate", "estimate")
    return whole.join(bounds, ["stratum", "value"])
