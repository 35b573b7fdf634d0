"""Vectors as array columns: arithmetic in double precision, element by element, without leaving the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.expr("0D"), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def mean(v: Column) -> Column:
    return total(doubles(v)) / F.size(v)


def population_sd(v: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(F.array(mean(v)), lambda m: total(F.transform(doubles(v), lambda x: (x - m) * (x - m)))), F.expr("0D"), lambda a, x: a + x) / F.size(v))


def standardized(v: Column, eps: float = 1e-8) -> Column:
    """Centred and divided by the population standard deviation; zeros where that is at most eps."""
    stats = F.array(F.struct(mean(v).alias("m"), population_sd(v).alias("s")))
    return F.flatten(F.transform(stats, lambda s: F.transform(doubles(v), lambda x: F.when(s["s"] > eps, (x - s["m"]) / s["s"]).otherwise(F.expr("0D")))))


def differences(v: Column) -> Column:
    """Each element but the first, less the one before it."""
    return F.zip_with(F.slice(doubles(v), F.lit(2), F.size(v) - 1), F.slice(doubles(v), F.lit(1), F.size(v) - 1), lambda b, a: b - a)


def features(bands: Column, eps: float = 1e-8) -> Column:
    """Standardized bands, then the standardized differences of the bands as they were."""
    return F.concat(standardized(bands, eps), standardized(differences(bands), eps))


def audible(bands: Column, least_sd: float = 1e-6, least_mean: float = 1e-3) -> Column:
    """The silence gate: both strictly above their limits."""
    return (population_sd(bands) > least_sd) & (mean(bands) > least_mean)


def projected(v: Column, components: list[list[float]], centre: list[float] | None = None) -> Column:
    """Products of the (centred) vector with each component."""
    own = doubles(v) if centre is None else F.zip_with(doubles(v), F.lit(centre), lambda x, m: x - m)
    return F.transform(F.lit(components).cast("array<array<double>>"), lambda c: total(F.zip_with(own, c, lambda x, w: x * w)))


def scaled(v: Column, gains: list[float]) -> Column:
    """Band gains of the query side."""
    return F.zip_with(doubles(v), F.lit(gains).cast("array<double>"), lambda x, g: x * g)
