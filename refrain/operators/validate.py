"""Constraint queries: each returns violations, so that an empty result, or a count of 0, is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that are not unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def cohort(found: DataFrame, wanted: DataFrame, key: str, same: list[str]) -> DataFrame:
    """One row: keys missing, unexpected, repeated, and those whose columns differ (nulls are equal)."""
    other = wanted.select(key, *(F.col(c).alias(f"want_{c}") for c in same), F.lit(True).alias("wanted"))
    one = found.groupBy(key).agg(F.count("*").alias("n"), *(F.first(c).alias(c) for c in same)).withColumn("found", F.lit(True))
    met = one.join(other, key, "full")
    differ = F.lit(False)
    for c in same:
        differ = differ | ~F.col(c).eqNullSafe(F.col(f"want_{c}"))
    return met.agg(F.count_if(F.col("found").isNull()).alias("missing"), F.count_if(F.col("wanted").isNull()).alias("unexpected"), F.count_if(F.col("n") > 1).alias("repeated"), F.count_if(F.col("found") & F.col("wanted") & differ).alias("different"))


def unequal(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys whose values differ by more than the tolerance, absolute or relative, or that one side lacks."""
    met = a.select(key, F.col(value).alias("a")).join(b.select(key, F.col(value).alias("b")), key, "full")
    near = F.abs(F.col("a") - F.col("b")) <= F.greatest(F.lit(tolerance), F.lit(tolerance) * F.greatest(F.abs("a"), F.abs("b")))
    return met.where(~F.coalesce(near, F.lit(False)) & ~(F.col("a").isNull() & F.col("b").isNull()))


def not_the_same(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with repetitions, of one side alone: side and the columns."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def off_grid(rows: DataFrame, key: str, hop: float, tolerance: float = 1e-9) -> DataFrame:
    """Rows (key, pos, t) whose time isn't pos * hop."""
    return rows.where(F.abs(F.col("t") - F.col("pos") * hop) > tolerance)


def not_increasing(rows: DataFrame, of: str, order: str, t: str) -> DataFrame:
    """Rows (of, order, t) whose time is null, not finite, or not above that of the row before in the order."""
    before = F.lag(t).over(Window.partitionBy(of).orderBy(order))
    finite = F.col(t).isNotNull() & ~F.isnan(t) & (F.abs(t) != float("inf"))
    return rows.select(of, order, t).withColumn("before", before).where(~finite | F.coalesce(F.col(t) <= F.col("before"), F.lit(False))).drop("before")


def rederived(rows: DataFrame, queries: DataFrame, gallery: DataFrame, tolerance_s: float = 2.0, rel: float = 1e-12) -> DataFrame:
    """(query_id, rule) for each rule that a result row breaks when it is computed anew.

    rows: query_id, source_id, role, target_id, found_id, expected_s, offset_s, vote_fraction, mean_distance, score, correct, localized; queries: query_id,
    source_id, role, target_id, expected_s; gallery: content_id. A row without a query breaks `query`; one without a candidate has no score to derive.
    """
    asked = queries.select("query_id", *(F.col(c).alias(f"want_{c}") for c in ("source_id", "role", "target_id", "expected_s")), F.lit(True).alias("asked"))
    met = rows.join(asked, "query_id", "left").join(gallery.select(F.col("content_id").alias("found_id"), F.lit(True).alias("enrolled")).distinct(), "found_id", "left")
    correct = F.coalesce(F.col("found_id") == F.col("target_id"), F.lit(False))
    near = F.coalesce(F.abs(F.col("offset_s") - F.col("expected_s")) <= tolerance_s, F.lit(False))
    score = F.col("vote_fraction") / (1 + F.col("mean_distance"))
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") != float("inf"))
    same = lambda c: F.col(c).eqNullSafe(F.col(f"want_{c}"))
    rules = {
        "query": F.col("asked").isNotNull(),
        **{c: F.col("asked").isNull() | same(c) for c in ("source_id", "role", "target_id", "expected_s")},
        "gallery": F.col("found_id").isNull() | F.col("enrolled").isNotNull(),
        "finite": finite,
        "correct": F.col("correct").eqNullSafe(correct),
        "localized": F.col("localized").eqNullSafe(correct & near),
        "score": F.col("found_id").isNull() | finite & F.coalesce(F.abs(F.col("score") - score) <= rel * F.greatest(F.abs("score"), F.abs(score)), F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in rules.items())))
    return met.select("query_id", F.explode(broken).alias("rule"))


def ledger(rows: DataFrame, key: str, parts: list[str], total: str) -> DataFrame:
    """Rows (key, parts..., total) whose parts, nulls as 0, don't sum to the total: key, total and found."""
    found = reduce(lambda a, b: a + b, (F.coalesce(F.col(c), F.lit(0)) for c in parts))
    return rows.select(key, F.col(total).alias("total"), found.alias("found")).where(~F.col("total").eqNullSafe(F.col("found")))


def chronology(events: DataFrame, key: str, steps: list[str]) -> DataFrame:
    """(key, step, before): steps (key, step, at) that did not begin after all of the last listed step were over, or that their key lacks (at null)."""
    place = F.array_position(F.lit(steps).cast("array<string>"), F.col("step"))
    spans = events.where(place > 0).groupBy(key, place.alias("n")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    wanted = events.select(key).distinct().withColumn("n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(len(steps)).cast("bigint"))))
    met = wanted.join(spans, [key, "n"], "left").withColumn("over", F.lag("last").over(Window.partitionBy(key).orderBy("n")))
    bad = met.where(F.col("first").isNull() | F.coalesce(F.col("first") <= F.col("over"), F.lit(False)))
    return bad.select(key, F.get(F.lit(steps).cast("array<string>"), (F.col("n") - 1).cast("int")).alias("step"), F.get(F.lit(steps).cast("array<string>"), (F.col("n") - 2).cast("int")).alias("before"))


def audit(checks: dict[str, DataFrame]) -> DataFrame:
    """(check, violations, passed): the number of rows that each check returns, in one table."""
    each = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, each).withColumn("passed", F.col("violations") == 0)


def unsafe_members(members: DataFrame, most: int) -> DataFrame:
    """Members of an archive (name, size, is_link, is_encrypted) that must not be extracted: absolute, with .. or backslash, links, encrypted, repeated or too large."""
    again = repeated(members, ["name"]).select(F.col("name").alias("again"))
    name = F.col("name")
    bad = name.startswith("/") | name.contains("\\") | F.array_contains(F.split(name, "/"), "..") | name.rlike("^[A-Za-z]:") | F.col("is_link") | F.col("is_encrypted") | (F.col("size") > most)
    return members.join(again, name == F.col("again"), "left").where(bad | F.col("again").isNotNull()).drop("again")
