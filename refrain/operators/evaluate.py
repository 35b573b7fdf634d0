"""Outcomes and their summaries: flags, subsets, strata, paired methods, timings, storage."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions import vectors
from refrain.operators.calibrate import threshold, wilson


def flags(predictions: DataFrame, gate: Column, tolerance: float = 2.0) -> DataFrame:
    """predictions (target_id, found_id, score, offset_s, expected_s) with correct, localized, accepted and the accepted kinds of both. A null id is never right nor accepted."""
    correct = F.coalesce(F.col("found_id") == F.col("target_id"), F.lit(False))
    localized = correct & F.coalesce(F.abs(F.col("offset_s") - F.col("expected_s")) <= tolerance, F.lit(False))
    accepted = F.col("found_id").isNotNull() & F.coalesce(F.col("score") > gate, F.lit(False))
    return predictions.withColumns({"correct": correct, "localized": localized, "accepted": accepted, "accepted_correct": accepted & correct, "accepted_localized": accepted & localized, "accepted_wrong": accepted & ~correct})


def subsets(flagged: DataFrame) -> DataFrame:
    """flagged (stratum, overlap, ...), once for each subset that it is in: all, by alteration, by overlap."""
    which = F.array(F.lit("all"), F.when(F.col("stratum") == "neither", "no_pitch_or_tempo").otherwise("pitch_or_tempo"), F.when(F.col("overlap"), "overlap").otherwise("no_overlap"))
    return flagged.withColumn("subset", F.explode(which))


def rates(flagged: DataFrame, by: list[str]) -> DataFrame:
    """Counts of queries and of each outcome by columns."""
    count = lambda c: F.count_if(c).alias(c)
    return flagged.groupBy(*by).agg(F.count("*").alias("queries"), *(count(c) for c in ("correct", "localized", "accepted", "accepted_correct", "accepted_localized", "accepted_wrong")))


def strata(flagged: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """The outcomes by each of the columns alone and over all, in one pass by grouping sets: stratum_of, stratum and counts."""
    sets = [[F.col(c)] for c in by] + [[]]
    found = flagged.groupingSets(sets, *by).agg(F.count("*").alias("queries"), *(F.count_if(v).alias(v) for v in values), *(F.grouping(c).alias(f"g_{c}") for c in by))
    of, value = F.lit("all"), F.lit("all")
    for c in by:
        of, value = F.when(F.col(f"g_{c}") == 0, c).otherwise(of), F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return found.select(of.alias("stratum_of"), value.alias("stratum"), "queries", *values)


def paired(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many keys are right under both, only one or neither method, change their id, or are in one method alone. a, b: key, found_id, correct."""
    other = b.select(key, F.col("found_id").alias("id_b"), F.col("correct").alias("ok_b"), F.lit(True).alias("in_b"))
    met = a.select(key, "found_id", "correct", F.lit(True).alias("in_a")).join(other, key, "full")
    both = F.col("in_a") & F.col("in_b")
    return met.agg(
        F.count_if(both & F.col("correct") & F.col("ok_b")).alias("both"), F.count_if(both & F.col("correct") & ~F.col("ok_b")).alias("only_a"),
        F.count_if(both & ~F.col("correct") & F.col("ok_b")).alias("only_b"), F.count_if(both & ~F.col("correct") & ~F.col("ok_b")).alias("neither"),
        F.count_if(both & ~F.col("found_id").eqNullSafe(F.col("id_b"))).alias("id_changes"), F.count_if(F.col("in_a").isNull() | F.col("in_b").isNull()).alias("unpaired"),
    )


def timing(samples: DataFrame, key: str) -> DataFrame:
    """samples (key, query_id, ms) by key: quantiles over queries of the median over the repeats of each."""
    each = samples.groupBy(key, "query_id").agg(F.median("ms").alias("ms"))
    return each.groupBy(key).agg(F.count("*").alias("queries"), *(F.percentile("ms", F.lit(q)).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)))


def storage(rows: DataFrame, hours: Column, width: int = 4) -> DataFrame:
    """rows (v, ...) in one row: payload bytes, bytes of ids and times, and payload bytes an hour."""
    return rows.agg(F.sum(F.size("v") * width).alias("payload_bytes"), (F.count("*") * 12).alias("metadata_bytes"), (F.sum(F.size("v") * width) / hours).alias("bytes_per_hour"))


def band_gains(pairs: DataFrame, floor: float = 1e-6) -> DataFrame:
    """(band, gain): per pair the log ratio of mean bands (pair_id, side 'query' or 'reference', mel), centred; by band the median, centred again, as a factor."""
    each = pairs.select("pair_id", "side", F.posexplode(vectors.doubles(F.col("mel"))).alias("band", "x"))
    means = each.groupBy("pair_id", "band").agg(F.avg(F.when(F.col("side") == "reference", F.col("x"))).alias("r"), F.avg(F.when(F.col("side") == "query", F.col("x"))).alias("q"))
    logs = means.withColumn("g", F.log(F.greatest("r", F.lit(floor))) - F.log(F.greatest("q", F.lit(floor))))
    centred = logs.withColumn("g", F.col("g") - F.avg("g").over(Window.partitionBy("pair_id")))
    median = centred.groupBy("band").agg(F.median("g").alias("g"))
    return median.select("band", F.exp(F.col("g") - F.avg("g").over(Window.partitionBy())).alias("gain"))


def checked_gains(gains: list[float], bands: int) -> list[float]:
    """Gains fit to be applied: one for each band, finite, positive, and of geometric mean 1 within a millionth; others raise ValueError."""
    if len(gains) != bands or not all(0 < g < math.inf for g in gains):
        raise ValueError("a gain for each band must be positive and finite")
    if abs(math.exp(sum(map(math.log, gains)) / bands) - 1) > 1e-6:
        raise ValueError("gains must have a geometric mean of 1")
    return [float(g) for g in gains]


def with_gains(rows: DataFrame, gains: list[float], bands: int = 32, column: str = "bands") -> DataFrame:
    """rows of the query side, with each band times its gain, before features are taken; a row with another number of bands raises an error."""
    own = F.when(F.size(column) == bands, vectors.scaled(F.col(column), checked_gains(gains, bands))).otherwise(F.raise_error(F.lit(f"a row has not {bands} bands")))
    return rows.withColumn(column, F.when(F.col(column).isNotNull(), own))


#: What a session's answers are counted by; the tolerances in seconds are fixed values.
TIGHT_S, LOOSE_S = 0.1, 2.0


def session_flags(predictions: DataFrame) -> DataFrame:
    """predictions (target_id, found_id, offset_s, expected_s, accepted) with correct, and localized within both tolerances."""
    correct = F.coalesce(F.col("found_id") == F.col("target_id"), F.lit(False))
    near = lambda s: correct & F.coalesce(F.abs(F.col("offset_s") - F.col("expected_s")) <= s, F.lit(False))
    return predictions.withColumns({"correct": correct, "localized_tight": near(TIGHT_S), "localized_loose": near(LOOSE_S)})


def session_summary(flagged: DataFrame, by: list[str]) -> DataFrame:
    """By each of the columns alone and over all, in one pass: counts of queries, sources and creators, of raw and of accepted answers to known queries
    (role ends with known, not unknown), wrong accepted ones, and false accepts with their sources.

    flagged: session_flags' rows with role, source_id, creator and the columns.
    """
    unknown = F.col("role").endswith("unknown")
    known = F.col("role").endswith("known") & ~unknown
    kinds = ("correct", "localized_tight", "localized_loose")
    found = flagged.groupingSets([[F.col(c)] for c in by] + [[]], *by).agg(
        F.count("*").alias("queries"), F.countDistinct("source_id").alias("sources"), F.countDistinct("creator").alias("creators"), F.count_if(known).alias("known"), F.count_if(unknown).alias("unknown"),
        *(F.count_if(known & F.col(k)).alias(k) for k in kinds), *(F.count_if(known & F.col("accepted") & F.col(k)).alias(f"accepted_{k}") for k in kinds),
        F.count_if(known & F.col("accepted") & ~F.col("correct")).alias("accepted_wrong"), F.count_if(unknown & F.col("accepted")).alias("false_accepts"),
        F.countDistinct(F.when(unknown & F.col("accepted"), F.col("source_id"))).alias("false_accept_sources"), *(F.grouping(c).alias(f"g_{c}") for c in by),
    )
    of, value = F.lit("all"), F.lit("all")
    for c in by:
        of, value = F.when(F.col(f"g_{c}") == 0, c).otherwise(of), F.when(F.col(f"g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return found.select(of.alias("by"), value.alias("value"), *(c for c in found.columns if c not in by and not c.startswith("g_")))


def condition_summary(predictions: DataFrame, target: float = 0.01) -> DataFrame:
    """(condition, gate, known, correct, accepted_correct, accepted_wrong, unknown, false_accepts, low, high): by condition and pooled (`all`), under one
    gate of all conditions' calibration unknowns; low and high bound the rate of false accepts.

    predictions: role, condition, target_id, found_id, score. Only test rows are counted.
    """
    gate = threshold(predictions.where("role = 'calibration_unknown'").select("score"), target).select("gate")
    met = predictions.where(F.col("role").isin("test_known", "test_unknown")).crossJoin(F.broadcast(gate))  # one row
    correct = F.coalesce(F.col("found_id") == F.col("target_id"), F.lit(False))
    accepted = F.col("found_id").isNotNull() & (F.col("score") > F.col("gate"))
    known = F.col("role") == "test_known"
    each = met.withColumn("condition", F.explode(F.array("condition", F.lit("all"))))
    counts = each.groupBy("condition", "gate").agg(
        F.count_if(known).alias("known"), F.count_if(known & correct).alias("correct"), F.count_if(known & accepted & correct).alias("accepted_correct"),
        F.count_if(known & accepted & ~correct).alias("accepted_wrong"), F.count_if(~known).alias("unknown"), F.count_if(~known & accepted).alias("false_accepts"),
    )
    low, high = wilson(F.col("false_accepts"), F.col("unknown"))
    return counts.withColumns({"low": low, "high": high})


def quantiles(rows: DataFrame, by: list[str], value: str, levels: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Quantiles of a value, between neighbours linearly, by columns: latencies of whole queries, say."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *(F.percentile(value, F.lit(q)).alias(f"p{round(100 * q)}") for q in levels))


def weighted_overlap(rows: DataFrame, by: list[str]) -> DataFrame:
    """The share of time (duration) that others overlap (overlap), by columns: weighed by duration, and of rows with any."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.try_divide(F.sum("overlap"), F.sum("duration")).alias("share"), F.avg((F.col("overlap") > 0).cast("double")).alias("touched"))


def self_matches(found: DataFrame, crops: DataFrame, tolerance_s: float = 0.1) -> DataFrame:
    """(query_id, content_id, found_id, offset_error, votes, passed) of crops of enrolled recordings (query_id, content_id, start_s) that were asked
    for again: the first answer (found: query_id, content_id, offset, votes, rank) must name the recording and its place. A crop without an answer fails.
    """
    first = found.where("rank = 1").select("query_id", F.col("content_id").alias("found_id"), "offset", "votes")
    met = crops.join(first, "query_id", "left").withColumn("offset_error", F.abs(F.col("offset") - F.col("start_s")))
    passed = F.coalesce((F.col("found_id") == F.col("content_id")) & (F.col("offset_error") <= tolerance_s), F.lit(False))
    return met.select("query_id", "content_id", "found_id", "offset_error", "votes", passed.alias("passed"))


def spread(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """min, median and max of values by a column: ranges over replicas, not intervals."""
    return rows.groupBy(by).agg(*(f(v).alias(f"{n}_{v}") for v in values for n, f in (("min", F.min), ("median", F.median), ("max", F.max))))
