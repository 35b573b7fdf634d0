"""Joins of the domain: intervals, nearest times, shifted frames, cyclic pairs, segments, exclusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _in_cells(spans: DataFrame, width: float) -> DataFrame:
    """spans (begin, end, ...), once for each cell of time that they touch. A span that ends before it begins touches none."""
    return spans.where("end >= begin").withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / width), F.floor(F.col("end") / width))))


def overlapping(spans: DataFrame, key: str, name: str, least: float = 0.0, width: float = 3600.0) -> DataFrame:
    """Pairs of spans (id, key, name, begin, end) of the same key that share more than `least` (not negative): id, other_id, other_name, overlap.

    Spans meet by key and cell of `width` time, so that a key costs as much as its spans that are near each other; a pair
    counts in the cell in which what it shares begins.
    """
    own = _in_cells(spans.select(key, "id", name, "begin", "end"), width)
    other = own.select(F.col(key), "cell", F.col("id").alias("other_id"), F.col(name).alias("other_name"), F.col("begin").alias("b2"), F.col("end").alias("e2"))
    shared = F.least("end", "e2") - F.greatest("begin", "b2")
    met = own.join(other, [key, "cell"]).where((F.col("id") != F.col("other_id")) & (F.col("cell") == F.floor(F.greatest("begin", "b2") / width)))
    return met.withColumn("overlap", shared).where(F.col("overlap") > least).select("id", "other_id", "other_name", "overlap")


def admissible(crops: DataFrame, spans: DataFrame, key: str, name: str, least: float = 1e-6, width: float = 3600.0) -> DataFrame:
    """(crop, name): the sources of spans (key, name, begin, end) that share more than `least` with a crop (crop, key, begin, end), once each."""
    own = _in_cells(crops.select(key, "crop", "begin", "end"), width)
    other = _in_cells(spans.select(key, name, F.col("begin"), F.col("end")), width).withColumnsRenamed({"begin": "b2", "end": "e2"})
    met = own.join(other, [key, "cell"]).where(F.least("end", "e2") - F.greatest("begin", "b2") > least)
    return met.select("crop", name).distinct()


def nearest_time(left: DataFrame, right: DataFrame, key: str, width: float = 86_400.0) -> DataFrame:
    """left (key, id, t), with the time `near` in right (key, t) that is nearest; of two as near, the later. No pairs: two sorts per key and cell.

    Keys are cut into cells of `width` time, each of which knows the last time before it and the first one after it. A row without a
    time, or whose key right lacks, has a null.
    """
    cell = F.floor(F.col("t") / width)
    points = right.where("t is not null").select(key, cell.alias("cell"), "t").distinct()
    both = left.select(key, "id", "t", F.lit(False).alias("point")).unionByName(points.select(key, F.lit(None).cast(left.schema["id"].dataType).alias("id"), "t", F.lit(True).alias("point")))
    both = both.withColumns({"cell": cell, "rt": F.when(F.col("point"), F.col("t"))})
    before = Window.partitionBy(key, "cell").orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key, "cell").orderBy(F.desc("t")).rangeBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"before": F.max("rt").over(before), "after": F.min("rt").over(after)}).where("not point").drop("point", "rt")
    ends = both.groupBy(key, "cell").agg(F.min("rt").alias("first"), F.max("rt").alias("last"))  # a row per key and cell
    earlier = Window.partitionBy(key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(key).orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, -1)
    outer = ends.select(F.col(key).alias("of"), F.col("cell").alias("at"), F.max("last").over(earlier).alias("earlier"), F.min("first").over(later).alias("later"))
    met = found.join(outer, F.col(key).eqNullSafe(F.col("of")) & F.col("cell").eqNullSafe(F.col("at")), "left")
    met = met.withColumns({"before": F.coalesce("before", "earlier"), "after": F.coalesce("after", "later")})
    near = F.when(F.col("before").isNull() | (F.col("after") - F.col("t") <= F.col("t") - F.col("before")), F.col("after")).otherwise(F.col("before"))
    return met.select(key, "id", "t", F.when(F.col("t").isNotNull(), near).alias("near"))


def shifted(rows: DataFrame, shifts: list[int]) -> DataFrame:
    """Pairs of rows (content_id, frame, v) of a content that are so many frames apart: content_id, frame, shift, v, w. Gaps have no pair."""
    moved = rows.withColumn("shift", F.explode(F.lit(shifts).cast("array<bigint>"))).withColumn("to", F.col("frame") + F.col("shift"))
    other = rows.select("content_id", F.col("frame").alias("to"), F.col("v").alias("w"))
    return moved.join(other, ["content_id", "to"]).select("content_id", "frame", "shift", "v", "w")


def cyclic(sources: DataFrame) -> DataFrame:
    """Each source (source) with the next one in order, the last with the first. Sources are few: one row per recording."""
    one = Window.orderBy("source")
    numbered = sources.select("source").distinct().withColumns({"i": F.row_number().over(one) - 1, "n": F.count("*").over(Window.partitionBy())})
    return numbered.alias("a").join(numbered.alias("b"), F.pmod(F.col("a.i") + 1, F.col("a.n")) == F.col("b.i")).select(F.col("a.source").alias("source"), F.col("b.source").alias("partner"))


def numbered(rows: DataFrame, key: str, name: str = "row", cells: int = 4096) -> DataFrame:
    """rows, with their number from 0 in the order of a whole-number key, without sorting all in one task.

    The range of the key is cut into `cells`, each of which starts after the rows of those before. Rows that share a key are numbered in any order.
    """
    ends = rows.agg(F.min(key).cast("double").alias("low"), F.greatest((F.max(key).cast("double") - F.min(key) + 1) / cells, F.lit(1.0)).alias("step"))
    placed = rows.crossJoin(F.broadcast(ends)).withColumn("cell", F.floor((F.col(key) - F.col("low")) / F.col("step"))).drop("low", "step")  # ends: one row
    sizes = placed.groupBy("cell").agg(F.count("*").alias("size"))
    before = sizes.select("cell", (F.sum("size").over(Window.orderBy("cell")) - F.col("size")).alias("before"))  # as many rows as cells
    within = placed.withColumn("place", F.row_number().over(Window.partitionBy("cell").orderBy(key)) - 1)
    return within.join(F.broadcast(before), "cell").withColumn(name, (F.col("before") + F.col("place")).cast("bigint")).drop("cell", "before", "place")


def partner_frames(rows: DataFrame, seed: str = "pair") -> DataFrame:
    """Rows (content_id, frame, v), each with a row w of the next content, chosen by a hash of both: content_id, frame, v, w.

    Contents are paired cyclically; frames of a content count from 0 in order, gaps left out.
    """
    place = rows.withColumn("place", F.row_number().over(Window.partitionBy("content_id").orderBy("frame")) - 1)
    sizes = rows.groupBy(F.col("content_id").alias("partner")).agg(F.count("*").alias("n"))
    met = place.select("content_id", "frame", "v").join(F.broadcast(cyclic(rows.select(F.col("content_id").alias("source")))).withColumnRenamed("source", "content_id"), "content_id").join(F.broadcast(sizes), "partner")  # a row per recording
    code = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "content_id", "frame")), 1, 8), 16, 10).cast("bigint")
    met = met.withColumn("place", F.pmod(code, F.col("n")))
    other = place.select(F.col("content_id").alias("partner"), "place", F.col("v").alias("w"))
    return met.join(other, ["partner", "place"]).select("content_id", "frame", "v", "w")


def in_segment(rows: DataFrame, segments: DataFrame, grain: int = 4096) -> DataFrame:
    """rows (row), with the content_id of the segment [start, end) that holds the row; empty segments hold none.

    Segments are cut at multiples of `grain`, so that the range join is an equi-join on the cell.
    """
    cut = segments.where("end > start").withColumn("cell", F.explode(F.expr(f"sequence(floor(start / {grain}), floor((end - 1) / {grain}))")))
    placed = rows.withColumn("cell", F.floor(F.col("row") / grain))
    return placed.join(cut, (placed["cell"] == cut["cell"]) & (F.col("row") >= F.col("start")) & (F.col("row") < F.col("end"))).drop("cell", "start", "end")


def excluded(rows: DataFrame, banned: DataFrame, key: str) -> DataFrame:
    """rows whose key isn't banned; a null key stays."""
    return rows.join(banned.select(key).distinct(), key, "left_anti")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys in both, once each; an assertion that two cohorts are disjoint wants none."""
    return a.select(key).intersect(b.select(key))


def title_matches(a: DataFrame, b: DataFrame, creator: Column, title: Column) -> DataFrame:
    """(creator, title, a_ids, b_ids) of rows (id, ...) with the same normalised creator and title."""
    left = a.groupBy(creator.alias("creator"), title.alias("title")).agg(F.sort_array(F.collect_set("id")).alias("a_ids"))
    right = b.groupBy(creator.alias("creator"), title.alias("title")).agg(F.sort_array(F.collect_set("id")).alias("b_ids"))
    return left.join(right, ["creator", "title"])
