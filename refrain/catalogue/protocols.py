"""Splits, exclusions, interval and time joins."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.catalogue.base import frames, r6, read
from refrain.operators import knn, protocol, relating, validate
from refrain.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query("""WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('7:' || c_custkey), c_custkey) AS n, count(*) OVER () AS t FROM customer)
SELECT c_custkey, CASE WHEN n <= round_even(t * 0.1::DOUBLE, 0) THEN 'pca_fit' WHEN n <= round_even(t * (0.1::DOUBLE + 0.15::DOUBLE), 0) THEN 'calibration_known'
WHEN n <= round_even(t * (0.1::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE), 0) THEN 'calibration_unknown' WHEN n <= round_even(t * (0.1::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE + 0.55::DOUBLE), 0) THEN 'test_known'
WHEN n <= round_even(t * (0.1::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE + 0.55::DOUBLE + 0.1::DOUBLE), 0) THEN 'test_unknown' END AS role FROM o""")
def roles_by_sha(spark: SparkSession, sf: str) -> DataFrame:
    return protocol.assign_roles(read(spark, sf, "customer").select("c_custkey"), "c_custkey", "7").select("c_custkey", "role")


@query("SELECT p_partkey FROM part ORDER BY sha256('3:' || p_partkey), p_partkey LIMIT 50")
def sample_by_sha(spark: SparkSession, sf: str) -> DataFrame:
    return protocol.first_by_digest(read(spark, sf, "part").select("p_partkey"), "p_partkey", "3", 50)


@query("SELECT s_suppkey, sha256('creator:' || s_suppkey)[1:1] < '8' AS enrolled FROM supplier")
def creator_enrolled(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "supplier").select("s_suppkey", protocol.enrolled(F.col("s_suppkey"), "creator").alias("enrolled"))


@query("""WITH r AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY sha256('5:' || vec_id), vec_id) AS n, sha256('5:' || vec_id) AS h FROM embeddings),
k AS (SELECT * FROM r WHERE n <= 20 ORDER BY h, vec_id LIMIT 150) SELECT label::BIGINT AS source, vec_id AS rid FROM k""")
def capped_sampling(spark: SparkSession, sf: str) -> DataFrame:
    rows = read(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("source"), F.col("vec_id").alias("rid"))
    return knn.capped(rows, 150, 20, 5)


@query("""WITH m AS (SELECT p_partkey AS source, (p_size >= 45) AS mandatory FROM part), o AS (SELECT source, row_number() OVER (ORDER BY mandatory DESC, sha256('g:' || source), source) AS n FROM m)
SELECT source, s::INT AS size FROM o, (SELECT unnest([100, 150]) AS s) WHERE n <= s""")
def nested_galleries(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "part").select(F.col("p_partkey").alias("source"), (F.col("p_size") >= 45).alias("mandatory"))
    return protocol.nested_gallery(own, "source", "g", [100, 150]).select("source", "size")


SPANS = "s AS (SELECT event_id AS id, user_id, event_type, epoch_us(ts)::DOUBLE / 1e6 AS begin, epoch_us(ts)::DOUBLE / 1e6 + 600 + value * 60 AS \"end\" FROM events)"


def _spans(spark: SparkSession, sf: str) -> DataFrame:
    begin = F.expr("unix_micros(cast(ts as timestamp))") / 1e6
    return read(spark, sf, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", begin.alias("begin"), (begin + 600 + F.col("value") * 60).alias("end"))


@query(f"""WITH {SPANS} SELECT a.id, b.id AS other_id, b.event_type AS other_name, round(least(a."end", b."end") - greatest(a.begin, b.begin), 6) AS overlap FROM s a JOIN s b ON a.user_id = b.user_id AND a.id <> b.id
WHERE least(a."end", b."end") - greatest(a.begin, b.begin) > 0""")
def annotation_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return relating.overlapping(_spans(spark, sf), "user_id", "event_type").select("id", "other_id", "other_name", r6(F.col("overlap"), "overlap"))


@query(f"""WITH {SPANS}, c AS (SELECT id, user_id, event_type, begin, least("end", begin + 300) AS "end" FROM s), p AS (SELECT c.id, b.event_type FROM c JOIN s b ON c.user_id = b.user_id AND least(c."end", b."end") - greatest(c.begin, b.begin) > 1e-6)
SELECT id, count(DISTINCT event_type)::BIGINT AS admissible, bool_or(event_type = 'purchase') AS purchase FROM p GROUP BY id""")
def secondary_admissible(spark: SparkSession, sf: str) -> DataFrame:
    spans = _spans(spark, sf)
    crops = spans.select(F.col("id").alias("crop"), "user_id", "begin", F.least("end", F.col("begin") + 300).alias("end"))
    met = relating.admissible(crops, spans, "user_id", "event_type")
    return met.groupBy(F.col("crop").alias("id")).agg(F.count("*").alias("admissible"), F.bool_or(F.col("event_type") == "purchase").alias("purchase"))


@query(f"""WITH {SPANS}, o AS (SELECT user_id, row_number() OVER (ORDER BY sha256('u:' || user_id), user_id) AS n, count(*) OVER () AS t FROM (SELECT DISTINCT user_id FROM s)), r AS (SELECT user_id, CASE WHEN n <= round_even(t * 0.1::DOUBLE, 0) THEN 'pca_fit' WHEN n <= round_even(t * (0.1::DOUBLE + 0.15::DOUBLE), 0) THEN 'calibration_known'
WHEN n <= round_even(t * (0.1::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE), 0) THEN 'calibration_unknown' WHEN n <= round_even(t * (0.1::DOUBLE + 0.15::DOUBLE + 0.1::DOUBLE + 0.55::DOUBLE), 0) THEN 'test_known' ELSE 'test_unknown' END AS role FROM o),
q AS (SELECT e.event_id AS query_id, e.user_id AS source_id, r.role, [(e.user_id * 7 + 1) % 150, (e.user_id * 11 + 3) % 150] AS o FROM events e JOIN r ON r.user_id = e.user_id WHERE e.event_type = 'purchase'),
x AS (SELECT q.*, role LIKE '%unknown' AND EXISTS (SELECT 1 FROM r k WHERE k.role LIKE '%\\_known' ESCAPE '\\' AND list_contains(q.o, k.user_id)) AS contaminated FROM q)
SELECT query_id, role, contaminated, (role LIKE 'calibration%' OR (role LIKE 'test%' AND NOT contaminated)) AS evaluate FROM x""")
def contamination_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    events = read(spark, sf, "events")
    roles = protocol.assign_roles(events.select("user_id").distinct(), "user_id", "u").withColumnRenamed("user_id", "source_id")
    others = F.array(F.pmod(F.col("user_id") * 7 + 1, F.lit(150)), F.pmod(F.col("user_id") * 11 + 3, F.lit(150)))
    asked = events.where("event_type = 'purchase'").select(F.col("event_id").alias("query_id"), F.col("user_id").alias("source_id"), others.alias("overlapping"))
    return protocol.split(asked, roles).select("query_id", "role", "contaminated", "evaluate")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def anti_sources(spark: SparkSession, sf: str) -> DataFrame:
    banned = read(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return relating.excluded(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), banned, "o_custkey")


@query("""WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS t FROM events), l AS (SELECT * FROM e WHERE event_type = 'click'), r AS (SELECT DISTINCT user_id, t FROM e WHERE event_type = 'purchase'),
p AS (SELECT l.event_id AS id, l.user_id, l.t, r.t AS near, row_number() OVER (PARTITION BY l.event_id ORDER BY abs(r.t - l.t), r.t DESC) AS n FROM l LEFT JOIN r ON l.user_id = r.user_id)
SELECT user_id, id, t::DOUBLE AS t, near::DOUBLE AS near FROM p WHERE n = 1""")
def nearest_time_asof(spark: SparkSession, sf: str) -> DataFrame:
    t = F.floor(F.expr("unix_micros(cast(ts as timestamp))") / 1000000).cast("double")
    events = read(spark, sf, "events").withColumn("t", t)
    left = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), "t")
    return relating.nearest_time(left, events.where("event_type = 'purchase'").select("user_id", "t"), "user_id")


@query("""WITH d AS (SELECT doc_id AS id, lower(trim(lang)) AS creator, lower(trim(split_part(text, chr(10), 1))) AS title FROM documents), a AS (SELECT creator, title, list_sort(list(id)) AS a_ids FROM d WHERE id IN (SELECT doc_id FROM labels) GROUP BY 1, 2),
b AS (SELECT creator, title, list_sort(list(id)) AS b_ids FROM d GROUP BY 1, 2) SELECT creator, title, len(a_ids)::BIGINT AS n_a, len(b_ids)::BIGINT AS n_b, b_ids[1] AS first_b FROM a JOIN b USING (creator, title)""")
def title_creator_join(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents with all that have the same language and first line."""
    own = read(spark, sf, "documents").withColumnRenamed("doc_id", "id")
    labelled = own.join(read(spark, sf, "labels").select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi")
    found = relating.title_matches(labelled, own, F.lower(F.trim("lang")), F.lower(F.trim(F.substring_index("text", "\n", 1))))
    return found.select("creator", "title", F.size("a_ids").cast("bigint").alias("n_a"), F.size("b_ids").cast("bigint").alias("n_b"), F.get("b_ids", F.lit(0)).alias("first_b"))


@query("SELECT a.doc_id, min(b.doc_id) AS first_same, count(*)::BIGINT AS same FROM documents a JOIN documents b ON sha256(a.text) = sha256(b.text) GROUP BY a.doc_id HAVING count(*) > 1")
def digest_join(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("d"))
    groups = own.groupBy("d").agg(F.min("doc_id").alias("first_same"), F.count("*").alias("same")).where("same > 1")
    return own.join(groups, "d").select("doc_id", "first_same", "same")


@query("SELECT count(*)::BIGINT AS shared FROM (SELECT doc_id FROM labels WHERE quality = 0 INTERSECT SELECT doc_id FROM labels WHERE quality = 1)")
def exists_disjoint(spark: SparkSession, sf: str) -> DataFrame:
    labels = read(spark, sf, "labels")
    return relating.shared_keys(labels.where("quality = 0"), labels.where("quality = 1"), "doc_id").agg(F.count("*").alias("shared"))


@query("""WITH f AS (SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 100 = 4 UNION ALL SELECT -o_orderkey - 1, o_orderstatus FROM orders WHERE o_orderkey % 50 = 0),
n AS (SELECT o_orderkey, count(*) AS n FROM f GROUP BY 1), w AS (SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 7 THEN 'X' ELSE o_orderstatus END AS s FROM orders)
SELECT (SELECT count(*) FROM w WHERE o_orderkey NOT IN (SELECT o_orderkey FROM n))::BIGINT AS missing, (SELECT count(*) FROM n WHERE o_orderkey NOT IN (SELECT o_orderkey FROM w))::BIGINT AS unexpected,
(SELECT count(*) FROM n WHERE n > 1)::BIGINT AS repeated, (SELECT count(*) FROM (SELECT DISTINCT f.o_orderkey FROM f JOIN w ON f.o_orderkey = w.o_orderkey WHERE f.o_orderstatus <> w.s))::BIGINT AS different""")
def cohort_completeness(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    found = orders.where("o_orderkey % 10 <> 3").unionByName(orders.where("o_orderkey % 100 = 4")).unionByName(orders.where("o_orderkey % 50 = 0").withColumn("o_orderkey", -F.col("o_orderkey") - 1))
    wanted = orders.withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 20 == 7, "X").otherwise(F.col("o_orderstatus")))
    return validate.cohort(found, wanted, "o_orderkey", ["o_orderstatus"])


@query("""SELECT o_orderkey, round(o_totalprice, 6) AS a, round(o_totalprice * (1 + (o_orderkey % 7) * 1e-9), 6) AS b FROM orders
WHERE abs(o_totalprice - o_totalprice * (1 + (o_orderkey % 7) * 1e-9)) > greatest(3e-9, 3e-9 * greatest(abs(o_totalprice), abs(o_totalprice * (1 + (o_orderkey % 7) * 1e-9))))""")
def deep_equal(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    other = orders.select("o_orderkey", (F.col("o_totalprice") * (1 + (F.col("o_orderkey") % 7) * 1e-9)).alias("o_totalprice"))
    return validate.unequal(orders, other, "o_orderkey", "o_totalprice", 3e-9).select("o_orderkey", r6(F.col("a"), "a"), r6(F.col("b"), "b"))


@query("""SELECT event_id, coalesce(try_cast(nullif(json_extract_string(props, '$.k'), '') AS DOUBLE), 100.0) AS tempo FROM events""")
def numeric_string_default(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", protocol.numeric(F.get_json_object("props", "$.k"), 100.0).alias("tempo"))


@query("""SELECT CASE WHEN l_discount <> 0 THEN 'pitch_altered' WHEN l_tax <> 0 THEN 'tempo_only' ELSE 'neither' END AS stratum, count(*)::BIGINT AS n FROM lineitem GROUP BY 1""")
def strata_classify(spark: SparkSession, sf: str) -> DataFrame:
    pitch = F.when(F.col("l_discount") == 0, "").otherwise(F.col("l_discount").cast("string"))
    tempo = F.when(F.col("l_tax") == 0, " ").otherwise((100 + F.col("l_tax")).cast("string"))
    return read(spark, sf, "lineitem").groupBy(protocol.stratum(pitch, tempo).alias("stratum")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS name, length(html) AS size FROM pages), a AS (SELECT name FROM m GROUP BY 1 HAVING count(*) > 1)
SELECT page_id FROM m WHERE name LIKE '/%' OR name LIKE '%\\\\%' OR list_contains(string_split(name, '/'), '..') OR regexp_matches(name, '^[A-Za-z]:') OR size > 5000 OR name IN (SELECT name FROM a)""".replace("'%\\\\\\\\%'", "'%\\\\%'"))
def unsafe_members(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("name"), F.length("html").alias("size"), F.lit(False).alias("is_link"), F.lit(False).alias("is_encrypted"))
    return validate.unsafe_members(own, 5000).select("page_id")


@query("""WITH a AS (SELECT l_orderkey AS query_id, l_linenumber AS reference_id, l_quantity AS begin, l_quantity + l_linenumber * 10 AS "end", l_extendedprice AS ref_begin, CASE WHEN l_tax = 0 THEN 100.0 ELSE 100 + l_tax * 100 END AS tempo, 80.0 AS length FROM lineitem)
SELECT query_id, reference_id, begin AS start_s, round(least("end", length) - begin, 6) AS duration_s, ref_begin AS expected_reference_start_s, round(tempo / 100, 6) AS expected_time_scale, "end" > length AS end_clamped FROM a""")
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("reference_id"), F.col("l_quantity").alias("begin"), (F.col("l_quantity") + F.col("l_linenumber") * 10).alias("end"), F.col("l_extendedprice").alias("ref_begin"), F.when(F.col("l_tax") == 0, "").otherwise((100 + F.col("l_tax") * 100).cast("string")).alias("tempo"), F.lit(80.0).alias("length"))
    return protocol.manifest(own).withColumns({"duration_s": F.round("duration_s", 6), "expected_time_scale": F.round("expected_time_scale", 6)})


@query("""WITH g AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame FROM embeddings) SELECT label::VARCHAR AS content_id, count(*)::BIGINT AS n_rows, max(frame)::BIGINT AS last_frame FROM g WHERE frame % 4 = 0 GROUP BY 1""")
def stream_enroll(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings enrolled from a stream of files, a file for each part of them, then counted."""
    from refrain.streaming.enroll import enroll_stream

    folder = f"{files.shared_folder(spark)}/enroll-{uuid.uuid4().hex}"
    prints = frames(spark, sf).select(F.col("content_id").cast("string").alias("content_id"), "frame", "v")
    prints.repartition("content_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(prints.schema).parquet(f"{folder}/in")
    enroll_stream(stream, f"{folder}/gallery", f"{folder}/state", 4).awaitTermination()
    return spark.read.parquet(f"{folder}/gallery").groupBy("content_id").agg(F.count("*").alias("n_rows"), F.max("frame").alias("last_frame"))


def roles_sql(n: str, t: str) -> str:
    """The role of the n-th of t in order, by shares summed as the engine sums them."""
    reached, cases, terms = "", [], []
    for who, share in protocol.ROLES:
        terms.append(f"{share}::DOUBLE")
        reached = terms[0] if len(terms) == 1 else f"({reached} + {terms[-1]})"
        cases.append(f"WHEN {n} <= round_even({t} * {reached}, 0) THEN '{who}'")
    return f"CASE {' '.join(cases)} END"


@query("""SELECT c_custkey, 'test_known' AS native_role, CASE WHEN c_nationkey % 4 = 0 THEN 'calibration' ELSE 'test' END || CASE WHEN sha256('open:' || c_name)[1:1] < '8' THEN '_known' ELSE '_unknown' END AS open_role FROM customer""")
def session_protocol(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "customer").select(F.col("c_custkey").alias("reference_id"), F.col("c_name").alias("creator"), F.concat(F.lit("s"), F.pmod("c_nationkey", F.lit(4))).alias("session"))
    return protocol.session_protocol(own, "s0", "open").select(F.col("reference_id").alias("c_custkey"), "native_role", "open_role")


@query("""WITH o AS (SELECT p_partkey + 1000000 AS source_id, p_size + 5.0::DOUBLE AS duration_s, row_number() OVER (ORDER BY sha256('x:' || (p_partkey + 1000000)), p_partkey) AS n, count(*) OVER () AS t FROM part)
SELECT s_suppkey::VARCHAR AS query_id, s_suppkey AS source_id, CASE WHEN s_suppkey % 3 = 0 THEN 'test_unknown' ELSE 'test_known' END AS role, CASE WHEN s_suppkey % 3 = 0 THEN 'original' END AS population, 1.0::DOUBLE AS start_s, 5.0::DOUBLE AS duration_s, 1.0::DOUBLE AS expected_s FROM supplier
UNION ALL SELECT 'extra:' || source_id, source_id, CASE WHEN n <= round_even(0.2::DOUBLE * t, 0) THEN 'calibration_unknown' ELSE 'test_unknown' END, 'additional', (duration_s - 5) / 2, 5.0, (duration_s - 5) / 2 FROM o""")
def extended_unknowns(spark: SparkSession, sf: str) -> DataFrame:
    role = F.when(F.col("s_suppkey") % 3 == 0, "test_unknown").otherwise("test_known")
    queries = read(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"), F.col("s_suppkey").alias("source_id"), role.alias("role"), F.lit(1.0).alias("start_s"), F.lit(5.0).alias("duration_s"), F.lit(1.0).alias("expected_s"))
    extra = read(spark, sf, "part").select((F.col("p_partkey") + 1000000).alias("source_id"), (F.col("p_size") + F.lit(5.0)).alias("duration_s"))
    return protocol.extended_unknowns(queries, extra, queries, "x")


@query(f"""WITH r AS (SELECT c_nationkey || '-' || c_custkey AS reference_id, c_nationkey::VARCHAR AS speaker, 3.0::DOUBLE + c_custkey % 20 AS duration_s FROM customer WHERE 3 + c_custkey % 20 >= 6),
o AS (SELECT speaker, row_number() OVER (ORDER BY sha256('sp:' || speaker), speaker) AS n, count(*) OVER () AS t FROM (SELECT DISTINCT speaker FROM r)), w AS (SELECT speaker, {roles_sql('n', 't')} AS role FROM o)
SELECT reference_id || ':' || condition AS query_id, reference_id, r.speaker, role, condition, (duration_s - 5) / 2 AS start_s FROM r JOIN w ON w.speaker = r.speaker, (SELECT unnest({list(protocol.CONDITIONS)}) AS condition) WHERE role <> 'pca_fit'""")
def speech_protocol(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "customer").select(F.concat_ws("-", "c_nationkey", "c_custkey").alias("reference_id"), (F.lit(3.0) + F.col("c_custkey") % 20).alias("duration_s"))
    return protocol.speech_protocol(own, "sp")


@query("""SELECT c_mktsegment AS subset, c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AS unseen, count(*)::BIGINT AS refs, sum(n)::BIGINT AS queries FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2""")
def exposure_audit(spark: SparkSession, sf: str) -> DataFrame:
    refs = read(spark, sf, "orders").groupBy(F.col("o_custkey").alias("reference_id")).agg(F.count("*").alias("n"))
    catalogue = read(spark, sf, "customer").select(F.col("c_custkey").alias("reference_id"), F.col("c_mktsegment").alias("subset"))
    return protocol.unseen(refs, catalogue, ["BUILDING", "MACHINERY"]).groupBy("subset", "unseen").agg(F.count("*").alias("refs"), F.sum("n").alias("queries"))


LEDGER = """ledger AS (SELECT l_orderkey AS key, count_if(l_linestatus = 'O') + count_if(l_linestatus = 'F') AS found, count(*) + (l_orderkey % 97 = 0)::INT AS total FROM lineitem GROUP BY l_orderkey)"""


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.count_if(F.col("l_linestatus") == "O").alias("o"), F.count_if(F.col("l_linestatus") == "F").alias("f"), F.count("*").alias("total"))
    own = own.withColumn("total", F.col("total") + F.when(F.col("key") % 97 == 0, 1).otherwise(0))
    return validate.ledger(own, "key", ["o", "f"], "total")


@query(f"WITH {LEDGER} SELECT key, total::BIGINT AS total, found::BIGINT AS found FROM ledger WHERE total <> found")
def ledger_sums(spark: SparkSession, sf: str) -> DataFrame:
    return _ledger(spark, sf)


CHRONOLOGY = """steps AS (SELECT user_id, event_type, min(epoch_us(ts)) AS first, max(epoch_us(ts)) AS last FROM events WHERE event_id % 7 < 2 GROUP BY 1, 2), wanted AS (SELECT user_id, n, ['view', 'click', 'purchase'][n] AS step FROM (SELECT DISTINCT user_id FROM events), range(1, 4) t(n)),
chronology AS (SELECT * FROM (SELECT w.user_id, w.n, w.step, s.first, lag(s.last) OVER (PARTITION BY w.user_id ORDER BY n) AS over FROM wanted w LEFT JOIN steps s ON s.user_id = w.user_id AND s.event_type = w.step) WHERE first IS NULL OR coalesce(first <= over, false))"""


def _chronology(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("unix_micros(cast(ts as timestamp))")
    events = read(spark, sf, "events").select("user_id", F.when(F.col("event_id") % 7 < 2, F.col("event_type")).otherwise("other").alias("step"), at.alias("at"))
    return validate.chronology(events, "user_id", ["view", "click", "purchase"])


@query(f"WITH {CHRONOLOGY} SELECT user_id, step, CASE n WHEN 2 THEN 'view' WHEN 3 THEN 'click' END AS before FROM chronology")
def chronology_audit(spark: SparkSession, sf: str) -> DataFrame:
    return _chronology(spark, sf)


REDERIVED = """b AS (SELECT doc_id AS i, n_chars AS n, CASE WHEN doc_id % 11 <> 0 THEN doc_id % 10 END AS found_id, doc_id % 5 AS target_id, (doc_id % 17)::DOUBLE AS offset_s, (doc_id % 13)::DOUBLE AS expected_s, (n_chars % 100) / 100.0::DOUBLE AS f, (n_chars % 7)::DOUBLE AS m FROM documents),
c AS (SELECT *, coalesce(found_id = target_id, false) AS ok, coalesce(found_id = target_id, false) AND abs(offset_s - expected_s) <= 2 AS near FROM b),
rederived AS (SELECT i, 'query' AS rule FROM c WHERE i % 23 = 0 UNION ALL SELECT i, 'source_id' FROM c WHERE i % 23 <> 0 AND i % 19 = 0 UNION ALL SELECT i, 'role' FROM c WHERE i % 23 <> 0 AND i % 29 = 0 UNION ALL SELECT i, 'target_id' FROM c WHERE i % 23 <> 0 AND i % 31 = 0
UNION ALL SELECT i, 'expected_s' FROM c WHERE i % 23 <> 0 AND i % 37 = 0 UNION ALL SELECT i, 'gallery' FROM c WHERE found_id > 7 UNION ALL SELECT i, 'finite' FROM c WHERE i % 41 = 0 UNION ALL SELECT i, 'correct' FROM c WHERE i % 43 = 0
UNION ALL SELECT i, 'localized' FROM c WHERE i % 47 = 0 UNION ALL SELECT i, 'score' FROM c WHERE found_id IS NOT NULL AND (i % 41 = 0 OR i % 13 = 0))"""


def _rederived(spark: SparkSession, sf: str) -> DataFrame:
    i, n = F.col("doc_id"), F.col("n_chars")
    every = lambda k: i % k == 0
    own = read(spark, sf, "documents").select(
        i.alias("query_id"), (i % 7).alias("source_id"), F.lit("test_known").alias("role"), (i % 5).alias("target_id"), F.when(~every(11), i % 10).alias("found_id"),
        (i % 13).cast("double").alias("expected_s"), (i % 17).cast("double").alias("offset_s"), (n % 100 / 100).alias("vote_fraction"), (n % 7).cast("double").alias("mean_distance"),
    )
    right = F.coalesce(F.col("found_id") == F.col("target_id"), F.lit(False))
    near = right & (F.abs(F.col("offset_s") - F.col("expected_s")) <= 2)
    q = F.col("query_id")
    rows = own.withColumns({
        "score": F.when(q % 41 == 0, float("nan")).otherwise(F.col("vote_fraction") / (1 + F.col("mean_distance")) + F.when(q % 13 == 0, 0.01).otherwise(0.0)),
        "correct": F.when(q % 43 == 0, ~right).otherwise(right), "localized": F.when(q % 47 == 0, ~near).otherwise(near),
    })
    asked = own.where(q % 23 != 0).select("query_id", F.when(q % 19 == 0, -1).otherwise(F.col("source_id")).alias("source_id"), F.when(q % 29 == 0, "other").otherwise(F.col("role")).alias("role"), F.when(q % 31 == 0, -1).otherwise(F.col("target_id")).alias("target_id"), F.when(q % 37 == 0, -1.0).otherwise(F.col("expected_s")).alias("expected_s"))
    return validate.rederived(rows, asked, spark.range(8).select(F.col("id").alias("content_id")))


@query(f"WITH {REDERIVED} SELECT i AS query_id, rule FROM rederived")
def rederived_rows(spark: SparkSession, sf: str) -> DataFrame:
    return _rederived(spark, sf)


@query(f"""WITH {LEDGER}, {CHRONOLOGY}, {REDERIVED}, every AS (SELECT 'ledger' AS "check", count(*) AS violations FROM ledger WHERE total <> found UNION ALL SELECT 'chronology', count(*) FROM chronology UNION ALL SELECT 'rows', count(*) FROM rederived UNION ALL SELECT 'regions', 0)
SELECT "check", violations::BIGINT AS violations, violations = 0 AS passed FROM every""")
def composed_audit(spark: SparkSession, sf: str) -> DataFrame:
    return validate.audit({"ledger": _ledger(spark, sf), "chronology": _chronology(spark, sf), "rows": _rederived(spark, sf), "regions": validate.repeated(read(spark, sf, "region"), ["r_regionkey"])})
