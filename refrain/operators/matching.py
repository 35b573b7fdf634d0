"""Matching: from neighbours of query rows to ranked recordings.

neighbours: query_id, qrow, qt (the query row and its time), content_id, rt (the reference row's time), distance. All
of it is joins on (query_id, content_id) and groupings of them; no group is larger than the neighbours of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from refrain.functions import vectors


def consensus(neighbours: DataFrame, query_rows: DataFrame, tolerance: float = 0.12, min_votes: int = 1, limit: int = 10) -> DataFrame:
    """Temporal-offset consensus: (query_id, content_id, votes, vote_fraction, mean_distance, offset, residual, score, rank).

    For each content the window of offsets (rt - qt) as wide as twice the tolerance that most query rows vote for, each once with its
    nearest neighbour; then the smaller mean distance, then the earlier window. The offset is the median, held within the tolerance of
    all votes. query_rows (query_id, n): all rows of a query count in vote_fraction, also those without neighbours.
    """
    if tolerance < 0 or min_votes < 1 or limit < 1:
        raise ValueError("tolerance must not be negative, min_votes and limit must be positive")
    rows = neighbours.select("query_id", "content_id", "qrow", "distance", (F.col("rt") - F.col("qt")).alias("off"))
    anchors = rows.select("query_id", "content_id", F.col("off").alias("left")).distinct()
    inside = rows.join(anchors, ["query_id", "content_id"]).where((F.col("off") >= F.col("left")) & (F.col("off") - F.col("left") <= 2 * tolerance + 1e-12))
    own = inside.groupBy("query_id", "content_id", "left", "qrow").agg(F.min(F.struct("distance", "off")).alias("best"))
    seen = own.groupBy("query_id", "content_id", "left").agg(
        F.count("*").alias("votes"), F.avg("best.distance").alias("mean_distance"), F.median("best.off").alias("middle"), F.min("best.off").alias("low"), F.max("best.off").alias("high")
    )
    # a residual needs the chosen offset, which the extremes decide: the farthest vote is one of them
    won = seen.groupBy("query_id", "content_id").agg(F.max_by(F.struct("votes", "mean_distance", "middle", "low", "high"), F.struct("votes", -F.col("mean_distance"), -F.col("left"))).alias("w"))
    offset = F.greatest(F.least(F.col("w.middle"), F.col("w.low") + tolerance), F.col("w.high") - tolerance)
    found = won.where(F.col("w.votes") >= min_votes).select("query_id", "content_id", "w.votes", "w.mean_distance", offset.alias("offset"), "w.low", "w.high").join(query_rows, "query_id")
    found = found.withColumn("vote_fraction", F.col("votes") / F.col("n")).withColumn("residual", F.greatest(F.col("high") - F.col("offset"), F.col("offset") - F.col("low")))
    found = found.withColumn("score", F.col("vote_fraction") / (1 + F.col("mean_distance")))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("votes"), "mean_distance", "content_id")))
    return ranked.where(F.col("rank") <= limit).select("query_id", "content_id", "votes", "vote_fraction", "mean_distance", "offset", "residual", "score", "rank")


def sequence_rerank(neighbours: DataFrame, queries: DataFrame, references: DataFrame, limit: int = 1) -> DataFrame:
    """Aligned sequences: each neighbour proposes a start in its recording (qpos, rpos); the mean product over the whole query decides.

    neighbours: query_id, qpos, content_id, rpos; queries: query_id, qpos, v; references: content_id, pos, v. Starts at which the query
    doesn't fit within the recording are dropped; of equal scores the smaller content_id, then start, wins.
    """
    sizes = queries.groupBy("query_id").agg(F.count("*").alias("n"))
    ends = references.groupBy("content_id").agg(F.count("*").alias("m"))
    starts = neighbours.select("query_id", "content_id", (F.col("rpos") - F.col("qpos")).alias("start")).where("start >= 0").distinct()
    starts = starts.join(sizes, "query_id").join(ends, "content_id").where("start + n <= m").select("query_id", "content_id", "start")
    return _scored(starts.withColumn("factor", F.lit(1.0)), queries, references, F.col("start") + F.col("qpos")).transform(lambda d: _top(d, limit))


def _scored(starts: DataFrame, queries: DataFrame, references: DataFrame, place: Column) -> DataFrame:
    pairs = starts.join(queries.select("query_id", "qpos", F.col("v").alias("qv")), "query_id").withColumn("pos", place)
    met = pairs.join(references.select("content_id", "pos", F.col("v").alias("rv")), ["content_id", "pos"])
    return met.groupBy("query_id", "content_id", "start", "factor").agg(F.avg(vectors.dot(F.col("qv"), F.col("rv"))).alias("score"))


def _top(scored: DataFrame, limit: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "content_id", "start")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def stretch_factors(neighbours: DataFrame) -> DataFrame:
    """(query_id, content_id, factor): the mean of query step over reference step of all pairs of a recording's first neighbours, which differ; 1 outside [0.5, 2].

    neighbours: query_id, qpos, content_id, rpos, rank. Of each query row the nearest neighbour in a recording counts.
    """
    first = neighbours.groupBy("query_id", "content_id", "qpos").agg(F.min_by("rpos", F.struct("rank", "rpos")).alias("rpos"))
    other = first.select("query_id", "content_id", F.col("qpos").alias("q2"), F.col("rpos").alias("r2"))
    pairs = first.join(other, ["query_id", "content_id"]).where("qpos <> q2 and rpos <> r2")
    means = pairs.groupBy("query_id", "content_id").agg(F.avg(F.try_divide(F.col("qpos") - F.col("q2"), F.col("rpos") - F.col("r2"))).alias("mean"))
    all_pairs = first.select("query_id", "content_id").distinct().join(means, ["query_id", "content_id"], "left")
    return all_pairs.select("query_id", "content_id", F.when(F.col("mean").between(0.5, 2.0), F.col("mean")).otherwise(1.0).alias("factor"))


def stretch_rerank(neighbours: DataFrame, queries: DataFrame, references: DataFrame, limit: int = 1) -> DataFrame:
    """As sequence_rerank, at the tempo of stretch_factors: query position i is at rint(start + i / factor)."""
    factors = stretch_factors(neighbours)
    reach = queries.groupBy("query_id").agg(F.max("qpos").alias("reach"))
    ends = references.groupBy("content_id").agg(F.count("*").alias("m"))
    starts = neighbours.join(factors, ["query_id", "content_id"]).select("query_id", "content_id", "factor", F.rint(F.col("rpos") - F.col("qpos") / F.col("factor")).cast("bigint").alias("start")).distinct()
    starts = starts.join(reach, "query_id").join(ends, "content_id").where((F.col("start") >= 0) & (F.rint(F.col("start") + F.col("reach") / F.col("factor")) < F.col("m")))
    return _scored(starts.drop("reach", "m"), queries, references, F.rint(F.col("start") + F.col("qpos") / F.col("factor")).cast("bigint")).transform(lambda d: _top(d, limit))


def physical_stretch(neighbours: DataFrame, query_hop: float, reference_hop: float) -> DataFrame:
    """(query_id, content_id, scale, evidence_frames): the tempo in seconds, for query and reference rows of different hops."""
    timed = neighbours.select("query_id", "content_id", "rank", (F.col("qpos") * query_hop).alias("qpos"), (F.col("rpos") * reference_hop).alias("rpos"))
    frames = neighbours.groupBy("query_id", "content_id").agg(F.countDistinct("rpos").alias("evidence_frames"))
    return stretch_factors(timed).join(frames, ["query_id", "content_id"]).select("query_id", "content_id", (1 / F.col("factor")).alias("scale"), "evidence_frames")


def affine_all_pairs(neighbours: DataFrame, tolerance: float = 0.12, low: float = 0.5, high: float = 2.0, min_span: float = 1.0) -> DataFrame:
    """(query_id, content_id, slope, intercept, votes): the line rt = slope * qt + intercept through two neighbours that most query rows are within the tolerance of, refitted to them.

    Every pair of neighbours at least min_span seconds apart whose slope is in [low, high] is a proposal; this form draws no random
    numbers. Of lines with as many votes that with the slope nearest 1, then the smaller slope, then intercept wins.
    """
    rows = neighbours.select("query_id", "content_id", "qt", "rt")
    other = rows.select("query_id", "content_id", F.col("qt").alias("q2"), F.col("rt").alias("r2"))
    lines = rows.join(other, ["query_id", "content_id"]).where(F.col("q2") - F.col("qt") >= min_span)
    slope = F.try_divide(F.col("r2") - F.col("rt"), F.col("q2") - F.col("qt"))
    lines = lines.select("query_id", "content_id", slope.alias("a"), (F.col("rt") - slope * F.col("qt")).alias("b")).where(F.col("a").between(low, high)).distinct()
    near = rows.join(lines, ["query_id", "content_id"]).withColumn("miss", F.abs(F.col("rt") - F.col("a") * F.col("qt") - F.col("b"))).where(F.col("miss") <= tolerance)
    votes = near.groupBy("query_id", "content_id", "a", "b").agg(F.countDistinct("qt").alias("votes"), F.regr_slope("rt", "qt").alias("slope"), F.regr_intercept("rt", "qt").alias("intercept"))
    order = Window.partitionBy("query_id", "content_id").orderBy(F.desc("votes"), F.abs(F.col("a") - 1), "a", "b")
    return votes.withColumn("place", F.row_number().over(order)).where("place = 1").select("query_id", "content_id", "slope", "intercept", "votes")


#: Pairs drawn for each content, the seed, and what a window may exceed its width by; fixed values.
PROPOSALS, SEED, SLACK = 64, 20261002, 1e-12


def unit_window(q: np.ndarray, r: np.ndarray, d: np.ndarray, tolerance: float) -> tuple[int, float, float]:
    """Votes, mean distance and offset of the best window of offsets, as consensus finds it. q: times of query rows, r: of references."""
    order = np.lexsort((d, q, r - q))
    off, row, near = (r - q)[order], q[order], d[order]
    best = (0, np.inf, 0.0)
    for left in np.unique(off):
        inside = (off >= left) & (off - left <= 2 * tolerance + SLACK)
        o, w, x = off[inside], row[inside], near[inside]
        by = np.lexsort((o, x, w))
        first = np.concatenate([[True], w[by][1:] != w[by][:-1]])
        o, x = o[by][first], x[by][first]
        if (len(o), -x.mean()) > (best[0], -best[1]):
            best = (len(o), float(x.mean()), float(max(min(np.median(o), o.min() + tolerance), o.max() - tolerance)))
    return best


def affine(neighbours: DataFrame, tolerance: float = 0.12, low: float = 0.5, high: float = 2.0, proposals: int = PROPOSALS, min_span: float = 1.0, seed: int = SEED) -> DataFrame:
    """(query_id, content_id, slope, intercept, votes, mean_distance): the line rt = slope * qt + intercept that most query rows vote for.

    First comes the window of consensus, of slope 1, which nothing removes. For contents with at least three query rows and min_span seconds
    of them, lines through up to `proposals` random pairs of neighbours are scored by votes (each query row once, with its nearest
    neighbour within the tolerance), then mean distance, then nearness of the slope to 1; the best one is fitted to its votes
    by least squares. Either replaces what was found so far only with more votes, or as many at a smaller mean distance.

    One group is one query and content.
    """
    if not 0 < low <= 1 <= high or proposals < 1 or tolerance < 0:
        raise ValueError("slope 1 must be in range, proposals positive and the tolerance not negative")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        first = rows.iloc[0]
        q, r, d = rows["qt"].to_numpy(float), rows["rt"].to_numpy(float), rows["distance"].to_numpy(float)
        n, mean, offset = unit_window(q, r, d, tolerance)
        found = (n, -mean, 1.0, offset)

        def votes(a: float, b: float) -> tuple[int, float, np.ndarray]:
            inside = np.flatnonzero(np.abs(r - a * q - b) <= tolerance + SLACK)
            order = inside[np.lexsort((d[inside], q[inside]))]
            own = order[np.concatenate([[True], q[order][1:] != q[order][:-1]])] if len(order) else order
            return len(own), float(d[own].mean()) if len(own) else np.inf, own

        if len(np.unique(q)) >= 3 and np.ptp(q) >= min_span:
            random = np.random.default_rng([seed, *str(first["content_id"]).encode()])
            i, j = random.integers(0, len(q), (2, 12 * proposals))
            wide = np.abs(q[j] - q[i]) >= min_span
            i, j = i[wide], j[wide]
            slope = (r[j] - r[i]) / (q[j] - q[i])
            good = np.flatnonzero((slope >= low) & (slope <= high))[:proposals]
            scored = sorted(((-m, x, abs(a - 1), a, b) for a, b in ((float(slope[k]), float(r[i[k]] - slope[k] * q[i[k]])) for k in good) for m, x, _ in [votes(a, b)]), key=lambda c: c[:3])
            lines = [scored[0][3:]] if scored else []
            if lines and len(np.unique(q[own := votes(*lines[0])[2]])) >= 2:
                a, b = np.polyfit(q[own], r[own], 1)
                lines += [(float(a), float(b))] if low <= a <= high else []
            for a, b in lines:
                m, x, _ = votes(a, b)
                if (m, -x) > found[:2]:
                    found = (m, -x, a, b)
        return pd.DataFrame({"query_id": [first["query_id"]], "content_id": [first["content_id"]], "slope": [found[2]], "intercept": [found[3]], "votes": [found[0]], "mean_distance": [-found[1]]})

    own = neighbours.select("query_id", "content_id", "qt", "rt", "distance")
    kinds = {f.name: f.dataType.simpleString() for f in own.schema}
    return own.groupBy("query_id", "content_id").applyInPandas(fit, f"query_id {kinds['query_id']}, content_id {kinds['content_id']}, slope double, intercept double, votes bigint, mean_distance double")


def physical_rerank(neighbours: DataFrame, queries: DataFrame, references: DataFrame, hop: float, limit: int = 1) -> DataFrame:
    """(query_id, content_id, start_s, score, scale, evidence_frames, rank): aligned sequences on the clock of the references, whose rows are `hop` seconds apart.

    neighbours: query_id, qt, content_id, rpos, rt, rank; queries: query_id, qt, v; references: content_id, pos (from 0), t, v. The tempo
    is that of stretch_factors in seconds, whatever the hops of both sides. A query row at qt is at rint(start + qt / (factor * hop)), where each
    neighbour proposes a start; sequences that leave the recording are dropped, and a sequence counts once. evidence_frames are its distinct
    reference rows. Of equal scores the smaller content_id, then start, wins.
    """
    timed = neighbours.select("query_id", "content_id", "rank", F.col("qt").alias("qpos"), F.col("rt").alias("rpos"))
    factors = stretch_factors(timed)
    reach = queries.groupBy("query_id").agg(F.min("qt").alias("low"), F.max("qt").alias("high"))
    ends = references.groupBy("content_id").agg(F.count("*").alias("m"))
    step = F.col("factor") * hop
    starts = neighbours.join(factors, ["query_id", "content_id"]).select("query_id", "content_id", "factor", F.rint(F.col("rpos") - F.col("qt") / step).cast("bigint").alias("start")).distinct()
    inside = (F.rint(F.col("start") + F.col("low") / step) >= 0) & (F.rint(F.col("start") + F.col("high") / step) < F.col("m"))
    starts = starts.join(reach, "query_id").join(ends, "content_id").where(inside).drop("low", "high", "m")
    pairs = starts.join(queries.select("query_id", "qt", F.col("v").alias("qv")), "query_id").withColumn("pos", F.rint(F.col("start") + F.col("qt") / step).cast("bigint"))
    met = pairs.join(references.select("content_id", "pos", "t", F.col("v").alias("rv")), ["content_id", "pos"])
    scored = met.groupBy("query_id", "content_id", "start", "factor").agg(F.avg(vectors.dot(F.col("qv"), F.col("rv"))).alias("score"), F.min("t").alias("start_s"), F.countDistinct("pos").alias("evidence_frames"))
    return _top(scored, limit).select("query_id", "content_id", "start_s", "score", (1 / F.col("factor")).alias("scale"), "evidence_frames", "rank")


def landmark_offsets(queries: DataFrame, references: DataFrame, around: int = 2, min_count: int = 5, limit: int = 1) -> DataFrame:
    """Landmark hashes: (query_id, content_id, offset, matched) by equal hashes (id, t, hash), counted per difference of times and its neighbours up to `around`.

    A query counts each (t, hash) once, and so does a content; repetitions go after the join, which only rows with a hash of some
    query reach. A hash that many rows of both sides hold is split by the adaptive join.
    """
    asked = queries.select("query_id", F.col("t").alias("qt"), "hash").distinct()
    hits = references.select("content_id", F.col("t").alias("rt"), "hash").join(asked, "hash").distinct()
    bins = hits.groupBy("query_id", "content_id", (F.col("rt") - F.col("qt")).alias("offset")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("query_id", "content_id").orderBy("offset").rangeBetween(-around, around)
    summed = bins.withColumn("matched", F.sum("n").over(w))
    best = summed.groupBy("query_id", "content_id").agg(F.max(F.struct("matched", "n", (-F.col("offset")).alias("back"))).alias("w"))
    found = best.select("query_id", "content_id", (-F.col("w.back")).alias("offset"), F.col("w.matched").alias("matched")).where(F.col("matched") >= min_count)
    order = Window.partitionBy("query_id").orderBy(F.desc("matched"), "content_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def lsh_votes(queries: DataFrame, references: DataFrame, votes: int = 4) -> DataFrame:
    """(qid, rid, votes): pairs (id, bins) that agree in at least so many tables, by an equi-join on table and bin."""
    left = queries.select("qid", F.posexplode("bins").alias("table", "bin"))
    right = references.select("rid", F.posexplode("bins").alias("table", "bin"))
    return left.join(right, ["table", "bin"]).groupBy("qid", "rid").agg(F.count("*").alias("votes")).where(F.col("votes") >= votes)


def canonical(score: Column, digits: int = 12) -> Column:
    """A score as results are compared by: so many decimals, halves to even."""
    return F.bround(score, digits)


def aligned_correlation(query: np.ndarray, reference: np.ndarray, start: int, reach: int) -> tuple[str, float | None, int | None]:
    """Pearson correlation of a waveform with a reference at the lag within `reach` of `start` where it is largest in size: status, r, lag."""
    n = len(query)
    if start - reach < 0 or start + reach + n > len(reference):
        return "insufficient_full_crop_support", None, None
    q = query - query.mean()
    if not (norm := np.sqrt(q @ q)):
        return "silent_query", None, None
    part = reference[start - reach : start + reach + n].astype(float)
    windows = np.lib.stride_tricks.sliding_window_view(part, n)
    centred = windows - windows.mean(axis=1, keepdims=True)
    norms = np.sqrt((centred * centred).sum(axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(norms > 0, centred @ q / (norms * norm), 0.0)
    best = int(np.abs(r).argmax())
    return "measured", float(r[best]), best - reach


def correlations(pairs: DataFrame, reach: int, flag: float = 0.95) -> DataFrame:
    """pairs (pair_id, query, reference: arrays, start) with status, r, lag and flagged (|r| of at least `flag`)."""
    schema = "pair_id bigint, status string, r double, lag bigint, flagged boolean"

    def run(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in stream:
            found = [(p, *aligned_correlation(np.asarray(q, float), np.asarray(r, float), int(s), reach)) for p, q, r, s in zip(part["pair_id"], part["query"], part["reference"], part["start"], strict=True)]
            yield pd.DataFrame([(p, status, r, lag, r is not None and abs(r) >= flag) for p, status, r, lag in found], columns=["pair_id", "status", "r", "lag", "flagged"]).astype({"lag": "Int64"})

    return pairs.select("pair_id", "query", "reference", "start").mapInPandas(run, schema)
