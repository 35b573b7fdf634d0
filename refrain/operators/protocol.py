"""Splits and protocols: by order of a hash, so that neither files nor partitions decide."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shares of the roles, in order; fixed values.
ROLES = [("pca_fit", 0.10), ("calibration_known", 0.15), ("calibration_unknown", 0.10), ("test_known", 0.55), ("test_unknown", 0.10)]


def digest(seed: str, name: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), name.cast("string")), 256)


def ordinals(rows: DataFrame, name: str, seed: str, digits: int = 2) -> DataFrame:
    """rows, with `ordinal` (from 1) in the order of their digest and `n`, their number, without sorting all in one task.

    The first hex digits of the digest cut the order into 16 ** digits ranges; a range starts after all rows of those before.
    """
    own = rows.withColumn("digest", digest(seed, F.col(name))).withColumn("range", F.substring("digest", 1, digits))
    sizes = own.groupBy("range").agg(F.count("*").alias("size"))
    before = sizes.withColumns({"before": F.coalesce(F.sum("size").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("size").over(Window.partitionBy())})
    within = own.withColumn("place", F.row_number().over(Window.partitionBy("range").orderBy("digest", name)))
    return within.join(F.broadcast(before), "range").withColumn("ordinal", F.col("before") + F.col("place")).drop("range", "size", "before", "place", "digest")  # a row per range


def assign_roles(sources: DataFrame, name: str, seed: str) -> DataFrame:
    """sources with a role: shares of the ordered list, cut at n times the shares so far, halves to even."""
    numbered = ordinals(sources, name, seed)
    role, reached = F.lit(None).cast("string"), 0.0
    cuts = []
    for who, share in ROLES:
        reached += share
        cuts.append((who, F.rint(F.col("n") * F.lit(reached))))
    for who, cut in reversed(cuts):
        role = F.when(F.col("ordinal") <= cut, who).otherwise(role)
    return numbered.withColumn("role", role).drop("n", "ordinal")


def first_by_digest(rows: DataFrame, name: str, seed: str, n: int) -> DataFrame:
    """The n rows whose digests come first."""
    return rows.orderBy(digest(seed, F.col(name)), name).limit(n)


def enrolled(name: Column, seed: str) -> Column:
    """Whether the first 64 bits of the digest are below 2**63."""
    return F.substring(digest(seed, name), 1, 1) < "8"


def manifest(annotations: DataFrame) -> DataFrame:
    """Queries of annotations (query_id, reference_id, begin, end, ref_begin, tempo in percent as text, length): the end held within
    the length, and where in the reference the query is expected to start."""
    end = F.least("end", "length")
    scale = numeric(F.col("tempo"), 100.0) / 100
    return annotations.select("query_id", "reference_id", F.col("begin").alias("start_s"), (end - F.col("begin")).alias("duration_s"), F.col("ref_begin").alias("expected_reference_start_s"), scale.alias("expected_time_scale"), (F.col("end") > F.col("length")).alias("end_clamped"))


def numeric(text: Column, default: float) -> Column:
    """A number in text; blank or null is the default."""
    return F.coalesce(F.nullif(F.trim(text), F.lit("")).try_cast("double"), F.lit(default))


def stratum(pitch: Column, tempo: Column) -> Column:
    """pitch_altered, else tempo_only, else neither."""
    return F.when(numeric(pitch, 0.0) != 0, "pitch_altered").when(numeric(tempo, 100.0) != 100, "tempo_only").otherwise("neither")


def split(queries: DataFrame, roles: DataFrame) -> DataFrame:
    """queries (query_id, source_id, overlapping: array of source ids) with role, contaminated (an unknown query overlaps an enrolled source) and evaluate."""
    known = roles.where(F.col("role").endswith("known") & ~F.col("role").endswith("unknown")).select(F.col("source_id").alias("other"))
    own = queries.join(roles.select("source_id", "role"), "source_id")
    touched = own.where(F.col("role").endswith("unknown")).select("query_id", F.explode("overlapping").alias("other")).join(known, "other", "left_semi").select("query_id").distinct()
    found = own.join(touched.withColumn("hit", F.lit(True)), "query_id", "left").withColumn("contaminated", F.coalesce("hit", F.lit(False))).drop("hit")
    return found.withColumn("evaluate", F.col("role").startswith("calibration") | (F.col("role").startswith("test") & ~F.col("contaminated")))


def nested_gallery(sources: DataFrame, name: str, seed: str, sizes: list[int]) -> DataFrame:
    """(source, size) for galleries that hold each other: the mandatory sources (mandatory), then others in the order of their digest."""
    first, others = (ordinals(sources.where(c), name, seed) for c in ("mandatory", "not mandatory"))
    ranked = first.unionByName(others.withColumn("ordinal", F.col("ordinal") + F.lit(first.count())))
    return ranked.withColumn("size", F.explode(F.lit(sizes).cast("array<int>"))).where(F.col("ordinal") <= F.col("size")).drop("ordinal", "n")


def base_id(name: Column, last: bool = False) -> Column:
    """What stands before the first (or last) @ of an id; all of it without one."""
    return F.substring_index(name, "@", 1) if not last else F.when(F.contains(name, F.lit("@")), F.regexp_replace(name, "(?s)@[^@]*$", "")).otherwise(name)


def session_protocol(references: DataFrame, calibration: str, seed: str) -> DataFrame:
    """references (reference_id, creator, session) with the role of the native closed set and that of the open one.

    Sources of the calibration session calibrate, others test; a source is known if its creator's digest enrols it, so that no unknown
    creator is in the gallery. A reference that is in several sessions raises an error.
    """
    sessions = references.groupBy("reference_id").agg(F.count_distinct("session").alias("sessions"))
    met = references.join(sessions, "reference_id")
    one = F.when(F.col("sessions") == 1, F.col("session")).otherwise(F.raise_error(F.lit("a source crosses sessions")))
    scope = F.when(one == calibration, "calibration").otherwise("test")
    kind = F.when(enrolled(F.col("creator"), seed), "_known").otherwise("_unknown")
    return met.withColumns({"native_role": F.lit("test_known"), "open_role": F.concat(scope, kind)}).drop("sessions")


def extended_unknowns(queries: DataFrame, extra: DataFrame, references: DataFrame, seed: str, crop_s: float = 5.0, share: float = 0.2) -> DataFrame:
    """(query_id, source_id, role, population, start_s, duration_s, expected_s): the queries, and one from the middle of each additional unknown source.

    queries: query_id, source_id, role, start_s, duration_s, expected_s; extra: source_id, duration_s; references: source_id. The first `share` of the additional sources in the
    order of their digest, halves to even, calibrate, the others test. One that is a reference raises an error.
    """
    known = references.select("source_id", F.lit(True).alias("enrolled")).distinct()
    numbered = ordinals(extra.join(known, "source_id", "left"), "source_id", seed)
    source = F.when(F.col("enrolled").isNull(), F.col("source_id")).otherwise(F.raise_error(F.lit("an additional unknown is a reference")).cast(extra.schema["source_id"].dataType))
    start = (F.col("duration_s") - crop_s) / 2
    role = F.when(F.col("ordinal") <= F.rint(F.lit(share) * F.col("n")), "calibration_unknown").otherwise("test_unknown")
    added = numbered.select(F.concat(F.lit("extra:"), F.col("source_id").cast("string")).alias("query_id"), source.alias("source_id"), role.alias("role"), F.lit("additional").alias("population"), start.alias("start_s"), F.lit(crop_s).alias("duration_s"), start.alias("expected_s"))
    own = queries.withColumn("population", F.when(F.col("role").endswith("unknown"), "original"))
    return own.select(F.col("query_id").cast("string").alias("query_id"), *added.columns[1:]).unionByName(added)


#: Conditions of the speech study, and the shortest utterance; fixed values.
CONDITIONS = ("clean", "mp3_32k", "gain_up", "gain_down", "clip", "noise", "preemphasis", "tilt_up", "tilt_down", "packets")
SHORTEST_S = 6.0


def speech_protocol(references: DataFrame, seed: str, conditions: tuple[str, ...] = CONDITIONS, crop_s: float = 5.0) -> DataFrame:
    """(query_id, reference_id, speaker, role, condition, start_s): every condition of the middle of each utterance of reference_id `speaker-...`, duration_s.

    Roles are those of speakers, so that no speaker is in two; utterances of speakers that fit components, and short ones, are no queries.
    """
    own = references.where(F.col("duration_s") >= SHORTEST_S).withColumn("speaker", F.substring_index("reference_id", "-", 1))
    roles = assign_roles(own.select("speaker").distinct(), "speaker", seed)
    each = own.join(roles, "speaker").where("role <> 'pca_fit'").withColumn("condition", F.explode(F.lit(list(conditions)).cast("array<string>")))
    return each.select(F.concat_ws(":", "reference_id", "condition").alias("query_id"), "reference_id", "speaker", "role", "condition", ((F.col("duration_s") - crop_s) / 2).alias("start_s"))


def unseen(references: DataFrame, catalogue: DataFrame, exposed: list[str]) -> DataFrame:
    """references (reference_id, ...) with the subset that the catalogue (reference_id, subset) gives them, and unseen: in none of the exposed subsets.

    To be in an exposed subset is possible exposure, no proof. A reference that the catalogue lacks raises an error.
    """
    met = references.join(catalogue.select("reference_id", "subset"), "reference_id", "left")
    subset = F.when(F.col("subset").isNotNull(), F.col("subset")).otherwise(F.raise_error(F.lit("a reference is not in the catalogue")))
    return met.withColumn("subset", subset).withColumn("unseen", ~F.col("subset").isin(exposed))
