"""Calibration, outcomes, intervals, summaries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.catalogue.base import r6, read
from refrain.operators import bootstrap, calibrate, evaluate
from refrain.plans import freeze
from refrain.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def _unknown(spark: SparkSession, sf: str, score: str) -> DataFrame:
    met = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return met.where("toxic = 0").select(F.expr(score).alias("score"))


def gate_sql(score: str, target: float) -> str:
    return f"""WITH s AS (SELECT {score} AS score FROM documents JOIN labels USING (doc_id) WHERE toxic = 0), o AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS n, count(*) OVER () AS t FROM s),
g AS (SELECT score AS gate, t FROM o WHERE n = floor({target}::DOUBLE * t) + 1) SELECT round(gate, 6) AS gate, t::BIGINT AS unknowns, (SELECT count(*) FROM s WHERE score > gate)::BIGINT AS false_accepts FROM g"""


def _gate(score: str, target: float):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return calibrate.threshold(_unknown(spark, sf, score), target).select(r6(F.col("gate"), "gate"), "unknowns", "false_accepts")

    return run


query(gate_sql("n_chars::DOUBLE / 100000", 0.01), "threshold_1pct")(_gate("n_chars / 100000", 0.01))
query(gate_sql("n_chars::DOUBLE / 100000", 0.001), "threshold_01pct")(_gate("n_chars / 100000", 0.001))
query(gate_sql("floor(n_chars / 1000.0)::DOUBLE / 100", 0.05), "threshold_ties")(_gate("floor(n_chars / 1000) / 100", 0.05))

P = """p AS (SELECT doc_id AS query_id, source AS population, lang, quality = 1 AS known, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE doc_id % 10 END AS found_id, doc_id % 5 AS target_id, (n_chars % 1000) / 1000.0::DOUBLE AS score,
  (doc_id % 17)::DOUBLE AS offset_s, (doc_id % 13)::DOUBLE AS expected_s, CASE WHEN doc_id % 3 = 0 THEN 'pitch_altered' WHEN doc_id % 3 = 1 THEN 'tempo_only' ELSE 'neither' END AS stratum, doc_id % 4 = 0 AS overlap FROM documents JOIN labels USING (doc_id)),
f AS (SELECT *, coalesce(found_id = target_id, false) AS correct, coalesce(found_id = target_id, false) AND abs(offset_s - expected_s) <= 2 AS localized, found_id IS NOT NULL AND score > 0.4 AS accepted FROM p),
o AS (SELECT *, accepted AND correct AS accepted_correct, accepted AND localized AS accepted_localized, accepted AND NOT correct AS accepted_wrong FROM f)"""
NAMES = ["correct", "localized", "accepted", "accepted_correct", "accepted_localized", "accepted_wrong"]
COUNTS = "count(*)::BIGINT AS queries, " + ", ".join(f"count_if({c})::BIGINT AS {c}" for c in NAMES)


def outcomes(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    own = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(
        i.alias("query_id"), F.col("source").alias("population"), "lang", (F.col("quality") == 1).alias("known"), F.when(i % 11 != 0, i % 10).alias("found_id"), (i % 5).alias("target_id"),
        (F.col("n_chars") % 1000 / 1000).alias("score"), (i % 17).cast("double").alias("offset_s"), (i % 13).cast("double").alias("expected_s"),
        F.when(i % 3 == 0, "pitch_altered").when(i % 3 == 1, "tempo_only").otherwise("neither").alias("stratum"), (i % 4 == 0).alias("overlap"),
    )
    return evaluate.flags(own, F.lit(0.4))


@query(f"WITH {P} SELECT query_id, {', '.join(NAMES)} FROM o")
def outcome_flags(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).select("query_id", *NAMES)


@query(f"""WITH {P}, s AS (SELECT *, unnest(['all', CASE WHEN stratum = 'neither' THEN 'no_pitch_or_tempo' ELSE 'pitch_or_tempo' END, CASE WHEN overlap THEN 'overlap' ELSE 'no_overlap' END]) AS subset FROM o WHERE known) SELECT subset, {COUNTS} FROM s GROUP BY subset""")
def summary_subsets(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rates(evaluate.subsets(outcomes(spark, sf).where("known")), ["subset"])


@query(f"WITH {P} SELECT known, lang, {COUNTS} FROM o GROUP BY 1, 2")
def summary_by_role(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rates(outcomes(spark, sf), ["known", "lang"])


@query(f"WITH {P} SELECT population, count(*)::BIGINT AS unknowns, round(avg(accepted::INT), 6) AS false_positive_rate FROM o WHERE NOT known GROUP BY 1")
def population_fpr(spark: SparkSession, sf: str) -> DataFrame:
    return outcomes(spark, sf).where("not known").groupBy("population").agg(F.count("*").alias("unknowns"), r6(F.avg(F.col("accepted").cast("int")), "false_positive_rate"))


@query(f"""WITH {P} SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(stratum) = 0 THEN 'stratum' ELSE 'all' END AS stratum_of, CASE WHEN grouping(lang) = 0 THEN lang WHEN grouping(stratum) = 0 THEN stratum ELSE 'all' END AS stratum,
count(*)::BIGINT AS queries, count_if(correct)::BIGINT AS correct, count_if(accepted_correct)::BIGINT AS accepted_correct FROM o GROUP BY GROUPING SETS ((lang), (stratum), ())""")
def grouping_sets_strata(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.strata(outcomes(spark, sf), ["lang", "stratum"], ["correct", "accepted_correct"])


@query("""WITH s AS (SELECT o_orderpriority, count(*)::DOUBLE AS n, count_if(o_orderstatus = 'F')::DOUBLE AS s FROM orders GROUP BY 1), z AS (SELECT *, s / n AS p, 1.959963984540054::DOUBLE AS z FROM s),
i AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM z)
SELECT o_orderpriority, n::BIGINT AS n, s::BIGINT AS successes, round(greatest(m - h, 0), 6) AS low, round(least(m + h, 1), 6) AS high FROM i""")
def wilson_by_group(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("successes"))
    low, high = calibrate.wilson(F.col("successes"), F.col("n"))
    return own.select("o_orderpriority", "n", "successes", r6(low, "low"), r6(high, "high"))


@query("""WITH l AS (SELECT l_suppkey, count(*)::DOUBLE AS n, count_if(l_returnflag = 'Z') AS e, count_if(l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT l_suppkey, e > 0 AS any_event, r > 0 AS any_return, CASE WHEN e = 0 THEN round(1 - pow(0.05, 1 / n), 6) END AS upper FROM l""")
def source_events(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"), F.bool_or(F.col("l_returnflag") == "Z").alias("any_event"), F.bool_or(F.col("l_returnflag") == "R").alias("any_return"))
    return own.select("l_suppkey", "any_event", "any_return", F.when(~F.col("any_event"), F.round(calibrate.zero_event_bound(F.col("n")), 6)).alias("upper"))


U = "(('0x' || substr(md5('{s}:' || {c} || ':' || r), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
W = "(" + " + ".join("({u} >= %r)::INT" % p for p in bootstrap.POISSON) + ")"
WC, WM = W.replace("{u}", U.format(s="c", c="cluster")), W.replace("{u}", U.format(s="m", c="montage"))


@query(f"""WITH s AS (SELECT o_custkey AS cluster, count_if(o_orderstatus = 'F') AS s, count(*) AS n FROM orders GROUP BY 1), d AS (SELECT s.*, r, {WC} AS w FROM s, (SELECT unnest(range(200)) AS r)),
b AS (SELECT r, sum(w * s)::DOUBLE / nullif(sum(w * n), 0) AS rate FROM d GROUP BY r) SELECT round((SELECT sum(s)::DOUBLE / sum(n) FROM s), 6) AS estimate, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high FROM b""")
def cluster_bootstrap_hash(spark: SparkSession, sf: str) -> DataFrame:
    sums = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cluster")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count("*").alias("n"))
    return bootstrap.hashed_interval(sums).select(*(r6(F.col(c), c) for c in ("estimate", "low", "high")))


@query(f"""WITH s AS (SELECT o_custkey AS cluster, year(o_orderdate) * 100 + month(o_orderdate) AS montage, count_if(o_orderstatus = 'F') AS s, count(*) AS n FROM orders GROUP BY 1, 2), d AS (SELECT s.*, r, {WC} * {WM} AS w FROM s, (SELECT unnest(range(100)) AS r)),
b AS (SELECT r, sum(w * s)::DOUBLE / nullif(sum(w * n), 0) AS rate FROM d GROUP BY r) SELECT round((SELECT sum(s)::DOUBLE / sum(n) FROM s), 6) AS estimate, round(quantile_cont(rate, 0.025), 6) AS low, round(quantile_cont(rate, 0.975), 6) AS high FROM b""")
def crossed_bootstrap_hash(spark: SparkSession, sf: str) -> DataFrame:
    month = F.year("o_orderdate") * 100 + F.month("o_orderdate")
    sums = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("cluster"), month.alias("montage")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count("*").alias("n"))
    return bootstrap.hashed_crossed_interval(sums, 100).select(*(r6(F.col(c), c) for c in ("estimate", "low", "high")))


def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Drawn intervals by order status; tested on clusters whose interval is known."""
    own = read(spark, sf, "orders").groupBy("o_orderpriority", "o_custkey").agg(F.min("o_orderkey").alias("place"), F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count("*").alias("n"))
    return bootstrap.cluster_interval(own, ["o_orderpriority"])


def crossed_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """The same with two crossed clusterings."""
    own = read(spark, sf, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 40).alias("source"), F.month("o_orderdate").alias("montage")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("s"), F.count("*").alias("n"))
    return bootstrap.crossed_interval(own, ["o_orderpriority"])


QUERIES["cluster_bootstrap"], QUERIES["crossed_bootstrap"] = cluster_bootstrap, crossed_bootstrap

ROC = [0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.5]


@query(f"""WITH s AS (SELECT (n_chars % 1000) / 1000.0::DOUBLE AS score, toxic = 1 AS known FROM documents JOIN labels USING (doc_id)), u AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS n, count(*) OVER () AS t FROM s WHERE NOT known),
g AS (SELECT r AS target, (SELECT score FROM u WHERE n = floor(r * t) + 1) AS gate FROM (SELECT unnest({ROC}::DOUBLE[]) AS r))
SELECT target, round(gate, 6) AS gate, round(avg(CASE WHEN NOT known THEN (score > gate)::INT END), 6) AS false_positive_rate, round(avg(CASE WHEN known THEN (score > gate)::INT END), 6) AS true_positive_rate FROM g, s GROUP BY 1, 2""")
def roc_points(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select((F.col("n_chars") % 1000 / 1000).alias("score"), (F.col("toxic") == 1).alias("known"))
    return calibrate.roc(own, ROC).select("target", r6(F.col("gate"), "gate"), r6(F.col("false_positive_rate"), "false_positive_rate"), r6(F.col("true_positive_rate"), "true_positive_rate"))


PAIR = """a AS (SELECT l_orderkey * 10 + l_linenumber AS k, l_returnflag AS id, l_quantity > 20 AS ok FROM lineitem WHERE l_orderkey % 50 <> 0), b AS (SELECT l_orderkey * 10 + l_linenumber AS k, CASE WHEN l_tax > 0.04 THEN l_linestatus ELSE l_returnflag END AS id, l_quantity + l_discount * 100 > 25 AS ok FROM lineitem)"""


def _pair(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    own = read(spark, sf, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    a = own.where("l_orderkey % 50 <> 0").select("k", F.col("l_returnflag").alias("found_id"), (F.col("l_quantity") > 20).alias("correct"))
    return a, own.select("k", F.when(F.col("l_tax") > 0.04, F.col("l_linestatus")).otherwise(F.col("l_returnflag")).alias("found_id"), (F.col("l_quantity") + F.col("l_discount") * 100 > 25).alias("correct"))


@query(f"""WITH {PAIR} SELECT count_if(a.ok AND b.ok)::BIGINT AS both, count_if(a.ok AND NOT b.ok)::BIGINT AS only_a, count_if(NOT a.ok AND b.ok)::BIGINT AS only_b, count_if(NOT a.ok AND NOT b.ok)::BIGINT AS neither,
count_if(a.id <> b.id)::BIGINT AS id_changes, count_if(a.k IS NULL OR b.k IS NULL)::BIGINT AS unpaired FROM a FULL JOIN b ON a.k = b.k""")
def paired_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.paired(*_pair(spark, sf), "k")


@query(f"WITH {PAIR} SELECT a.id AS from_id, b.id AS to_id, count_if(a.ok AND NOT b.ok)::BIGINT AS lost, count_if(NOT a.ok AND b.ok)::BIGINT AS gained, count(*)::BIGINT AS n FROM a JOIN b ON a.k = b.k GROUP BY 1, 2")
def decision_switches(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _pair(spark, sf)
    met = a.join(b.select("k", F.col("found_id").alias("to_id"), F.col("correct").alias("ok")), "k")
    return met.groupBy(F.col("found_id").alias("from_id"), "to_id").agg(F.count_if(F.col("correct") & ~F.col("ok")).alias("lost"), F.count_if(~F.col("correct") & F.col("ok")).alias("gained"), F.count("*").alias("n"))


@query("SELECT l_returnflag, min(l_quantity) AS min_l_quantity, median(l_quantity) AS median_l_quantity, max(l_quantity) AS max_l_quantity, round(median(l_discount), 6) AS median_l_discount FROM lineitem GROUP BY 1")
def replica_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.spread(read(spark, sf, "lineitem"), "l_returnflag", ["l_quantity", "l_discount"]).select("l_returnflag", "min_l_quantity", "median_l_quantity", "max_l_quantity", r6(F.col("median_l_discount"), "median_l_discount"))


@query("""WITH m AS (SELECT event_type, user_id, median(value) AS ms FROM events GROUP BY 1, 2) SELECT event_type, count(*)::BIGINT AS queries, round(quantile_cont(ms, 0.5), 6) AS p50, round(quantile_cont(ms, 0.95), 6) AS p95, round(quantile_cont(ms, 0.99), 6) AS p99 FROM m GROUP BY 1""")
def median_then_p95(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "events").select("event_type", F.col("user_id").alias("query_id"), F.col("value").alias("ms"))
    return evaluate.timing(own, "event_type").select("event_type", "queries", *(r6(F.col(c), c) for c in ("p50", "p95", "p99")))


@query("""WITH f AS (SELECT unnest([1, 2, 4, 6, 8]) AS factor), d AS (SELECT unnest([1.0, 2.0, 3.0, 5.0, 10.0]::DOUBLE[]) AS duration), r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings)
SELECT f.factor::BIGINT AS factor, d.duration, count(*)::BIGINT AS reference_rows, count_if(frame * 186.0::DOUBLE / 8000 <= d.duration)::BIGINT AS query_rows, round(8000.0::DOUBLE / 186 * 3600 / f.factor * 32 * 4 / 1e6, 6) AS mb_per_hour FROM r, f, d WHERE frame % f.factor = 0 GROUP BY f.factor, d.duration""")
def density_duration_matrix(spark: SparkSession, sf: str) -> DataFrame:
    from refrain.catalogue.base import frames
    from refrain.functions.clock import Config

    own = frames(spark, sf).select("frame", F.explode(F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 4, 6, 8)))).alias("factor")).where("frame % factor = 0")
    own = own.withColumn("duration", F.explode(F.array(*(F.lit(x) for x in (1.0, 2.0, 3.0, 5.0, 10.0)))))
    return own.groupBy("factor", "duration").agg(F.count("*").alias("reference_rows"), F.count_if(F.col("frame") * 186.0 / 8000 <= F.col("duration")).alias("query_rows")).withColumn("mb_per_hour", F.round(F.lit(Config().bytes_per_hour()) / F.col("factor") / 1e6, 6))


SETTINGS = "s AS (SELECT l_linenumber AS stride, l_returnflag AS f, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 4 ELSE 16 END AS nprobe, round(avg((l_quantity > 25)::INT), 2) AS rate FROM lineitem GROUP BY 1, 2, 3)"


def _settings(spark: SparkSession, sf: str) -> DataFrame:
    probe = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 4).otherwise(16)
    return read(spark, sf, "lineitem").groupBy(F.col("l_linenumber").alias("stride"), probe.alias("nprobe")).agg(F.round(F.avg((F.col("l_quantity") > 25).cast("int")), 2).alias("rate"))


@query(f"WITH {SETTINGS} SELECT stride, nprobe, rate FROM s ORDER BY rate DESC, stride DESC, nprobe LIMIT 1")
def select_operating_point(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.select_point(_settings(spark, sf)).select("stride", "nprobe", "rate")


@query(f"WITH {SETTINGS} SELECT stride, nprobe, rate FROM s WHERE rate >= (SELECT max(rate) FROM s) - 0.03 ORDER BY stride DESC, nprobe, rate DESC LIMIT 1")
def select_point_slack(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.select_point(_settings(spark, sf), 0.03).select("stride", "nprobe", "rate")


SESSION = """a AS (SELECT doc_id AS i, lang AS session, source AS creator, doc_id % 9 AS source_id, CASE WHEN quality = 1 THEN 'test_known' ELSE 'test_unknown' END AS role, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 10 END AS found_id, doc_id % 5 AS target_id, (doc_id % 17)::DOUBLE / 4 AS o, (doc_id % 13)::DOUBLE / 4 AS e,
  doc_id % 3 = 1 AS top, doc_id % 11 <> 0 AND (n_chars % 1000) > 400 AS accepted FROM documents JOIN labels USING (doc_id)),
f AS (SELECT *, role = 'test_known' AS k, coalesce(found_id = target_id, false) AS correct, coalesce(found_id = target_id, false) AND abs(o - e) <= 0.1 AS tight, coalesce(found_id = target_id, false) AND abs(o - e) <= 2 AS loose FROM a)"""


@query(f"""WITH {SESSION} SELECT CASE WHEN grouping(role) = 0 THEN 'role' WHEN grouping(session) = 0 THEN 'session' WHEN grouping(top) = 0 THEN 'top' ELSE 'all' END AS by, CASE WHEN grouping(role) = 0 THEN role WHEN grouping(session) = 0 THEN session WHEN grouping(top) = 0 THEN top::VARCHAR ELSE 'all' END AS value,
count(*)::BIGINT AS queries, count(DISTINCT source_id)::BIGINT AS sources, count(DISTINCT creator)::BIGINT AS creators, count_if(k)::BIGINT AS known, count_if(NOT k)::BIGINT AS unknown, count_if(k AND correct)::BIGINT AS correct, count_if(k AND tight)::BIGINT AS localized_tight, count_if(k AND loose)::BIGINT AS localized_loose,
count_if(k AND accepted AND correct)::BIGINT AS accepted_correct, count_if(k AND accepted AND tight)::BIGINT AS accepted_localized_tight, count_if(k AND accepted AND loose)::BIGINT AS accepted_localized_loose, count_if(k AND accepted AND NOT correct)::BIGINT AS accepted_wrong,
count_if(NOT k AND accepted)::BIGINT AS false_accepts, count(DISTINCT CASE WHEN NOT k AND accepted THEN source_id END)::BIGINT AS false_accept_sources FROM f GROUP BY GROUPING SETS ((role), (session), (top), ())""")
def session_summary(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    own = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id").select(
        F.col("lang").alias("session"), F.col("source").alias("creator"), (i % 9).alias("source_id"), F.when(F.col("quality") == 1, "test_known").otherwise("test_unknown").alias("role"), F.when(i % 11 != 0, i % 10).alias("found_id"),
        (i % 5).alias("target_id"), (i % 17 / 4).alias("offset_s"), (i % 13 / 4).alias("expected_s"), (i % 3 == 1).alias("top"), ((i % 11 != 0) & (F.col("n_chars") % 1000 > 400)).alias("accepted"),
    )
    return evaluate.session_summary(evaluate.session_flags(own), ["role", "session", "top"])


CONDITIONS = """p AS (SELECT lang AS condition, CASE WHEN doc_id % 4 = 0 THEN 'calibration_unknown' WHEN quality = 1 THEN 'test_known' ELSE 'test_unknown' END AS role, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 10 END AS found_id, doc_id % 5 AS target_id, (n_chars % 1000) / 1000.0::DOUBLE AS score FROM documents JOIN labels USING (doc_id)),
u AS (SELECT score, row_number() OVER (ORDER BY score DESC) AS n, count(*) OVER () AS t FROM p WHERE role = 'calibration_unknown'), g AS (SELECT score AS gate FROM u WHERE n = floor(0.05::DOUBLE * t) + 1)"""


def _conditions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("doc_id")
    role = F.when(i % 4 == 0, "calibration_unknown").when(F.col("quality") == 1, "test_known").otherwise("test_unknown")
    own = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
    return own.select(F.col("lang").alias("condition"), role.alias("role"), F.when(i % 11 != 0, i % 10).alias("found_id"), (i % 5).alias("target_id"), (F.col("n_chars") % 1000 / 1000).alias("score"))


@query(f"""WITH {CONDITIONS}, e AS (SELECT unnest([condition, 'all']) AS condition, gate, role = 'test_known' AS k, coalesce(found_id = target_id, false) AS ok, found_id IS NOT NULL AND score > gate AS a FROM p, g WHERE role LIKE 'test%'),
c AS (SELECT condition, gate, count_if(k) AS known, count_if(k AND ok) AS correct, count_if(k AND a AND ok) AS accepted_correct, count_if(k AND a AND NOT ok) AS accepted_wrong, count_if(NOT k)::DOUBLE AS n, count_if(NOT k AND a)::DOUBLE AS s FROM e GROUP BY 1, 2),
z AS (SELECT *, s / n AS q, 1.959963984540054::DOUBLE AS z FROM c), i AS (SELECT *, (q + z * z / (2 * n)) / (1 + z * z / n) AS m, z * sqrt(q * (1 - q) / n + z * z / (4 * n * n)) / (1 + z * z / n) AS h FROM z)
SELECT condition, round(gate, 6) AS gate, known::BIGINT AS known, correct::BIGINT AS correct, accepted_correct::BIGINT AS accepted_correct, accepted_wrong::BIGINT AS accepted_wrong, n::BIGINT AS unknown, s::BIGINT AS false_accepts,
CASE WHEN n > 0 THEN round(greatest(m - h, 0), 6) END AS low, CASE WHEN n > 0 THEN round(least(m + h, 1), 6) END AS high FROM i""")
def condition_summary(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.condition_summary(_conditions(spark, sf), 0.05)
    return found.withColumns({c: F.round(c, 6) + 0.0 for c in ("gate", "low", "high")})


@query(f"""WITH {CONDITIONS} SELECT role, round(gate, 6) AS gate, count(*)::BIGINT AS queries, count_if(score > gate)::BIGINT AS accepted FROM p, g GROUP BY 1, 2""")
def frozen_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Calibration rows are scored first and their gate is written; rows of all roles are then judged by what was written."""
    rows = _conditions(spark, sf)
    path = f"{files.shared_folder(spark)}/gate-{uuid.uuid4().hex}"
    freeze.freeze_gate(rows.where("role = 'calibration_unknown'"), 0.05, path, table="documents")
    gate = freeze.gate_of(spark, path)
    return rows.groupBy("role").agg(F.count("*").alias("queries"), F.count_if(F.col("score") > gate).alias("accepted")).withColumn("gate", F.round(gate, 6))


@query(f"""WITH e AS (SELECT o_custkey AS cluster, unnest(['all', o_orderpriority]) AS stratum, o_orderstatus FROM orders), s AS (SELECT cluster, stratum, count(*) AS n, count_if(o_orderstatus = 'F') AS f, count_if(o_orderstatus = 'O') AS o FROM e GROUP BY 1, 2),
d AS (SELECT s.*, r, {WC} AS w FROM s, (SELECT unnest(range(100)) AS r)), b AS (SELECT stratum, r, sum(w * f)::DOUBLE / nullif(sum(w * n), 0) AS f, sum(w * o)::DOUBLE / nullif(sum(w * n), 0) AS o FROM d GROUP BY 1, 2),
t AS (SELECT stratum, sum(f)::DOUBLE / sum(n) AS f, sum(o)::DOUBLE / sum(n) AS o FROM s GROUP BY 1)
SELECT b.stratum, 'final' AS value, round(max(t.f), 6) AS estimate, round(quantile_cont(b.f, 0.025), 6) AS low, round(quantile_cont(b.f, 0.975), 6) AS high FROM b JOIN t ON t.stratum = b.stratum GROUP BY 1
UNION ALL SELECT b.stratum, 'open', round(max(t.o), 6), round(quantile_cont(b.o, 0.025), 6), round(quantile_cont(b.o, 0.975), 6) FROM b JOIN t ON t.stratum = b.stratum GROUP BY 1""")
def shared_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """One set of weights of customers for all priorities and for both states."""
    own = read(spark, sf, "orders").select(F.col("o_custkey").alias("cluster"), F.array(F.lit("all"), "o_orderpriority").alias("strata"), F.lit(1).alias("n"), (F.col("o_orderstatus") == "F").cast("int").alias("final"), (F.col("o_orderstatus") == "O").cast("int").alias("open"))
    found = bootstrap.shared_intervals(own, "strata", ["final", "open"], 100)
    return found.select("stratum", "value", *(r6(F.col(c), c) for c in ("estimate", "low", "high")))
