"""Connected components by alternating large and small stars (Kiveris et al., 2014), as joins and group minima.

Each round is written in the shared folder. What reaches the driver is whether they are stars yet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from refrain.llm.common import Scratch


def _minima(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """For each u the least of its neighbours v; stored, so that a hot u can be split in the join that follows."""
    return scratch.stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "minima")


def _large(edges: DataFrame, scratch: Scratch) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    found = both.join(_minima(both, scratch), "u").where("v > u")
    return found.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """edges: from the larger to the smaller end."""
    least = _minima(edges, scratch)
    found = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.unionByName(least.select("u", F.col("m").alias("v")))


def _stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one at most, and none if a larger one has an edge to it."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("v").alias("id"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("id").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of the nodes of edges (a, b), but for those that are their component's least node themselves.

    Loops, repeated edges and nulls do no harm; without edges there are no rows. The result is in a table of scratch; those of
    earlier rounds are dropped.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    held = Scratch(edges.sparkSession)
    now = held.stored(now, "edges")
    while not _stars(now):
        done, held = held, Scratch(edges.sparkSession)
        large = done.stored(_large(now, done), "edges")
        now = held.stored(_small(large, done).distinct(), "edges")
        done.drop()
    scratch.paths += held.paths
    return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
