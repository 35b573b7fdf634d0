"""Neighbours and matching."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.catalogue.base import FRAMES, frames, r6, read, signals, sql_dot, sql_l2
from refrain.functions import clock, vectors
from refrain.operators import evaluate, hashing, knn, matching, relating, validate
from refrain.plans.gallery import Gallery
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


def sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every row whose id is divisible by 20 (qid, v) asks all rows (rid, v)."""
    own = read(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return own.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "qid"), own.withColumnRenamed("vec_id", "rid")


def ranked_sql(distance: str, order: str, k: int, where: str = "true") -> str:
    return f"""WITH {FRAMES}, d AS (SELECT q.vec_id AS qid, r.vec_id AS rid, {distance} AS d FROM g q, g r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d {order}, rid) AS rank FROM d WHERE {where})
SELECT qid, rid, round(d, 6) AS distance, rank::BIGINT AS rank FROM k WHERE rank <= {k}"""


def shown(found: DataFrame) -> DataFrame:
    return found.select("qid", "rid", r6(F.col("distance"), "distance"), F.col("rank").cast("bigint").alias("rank"))


@query(ranked_sql(sql_l2("q.v", "r.v"), "", 5))
def knn_l2_top5(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn.nearest(*sides(spark, sf), 5, exclude="same"))


@query(ranked_sql(sql_dot("q.v", "r.v"), "DESC", 20))
def knn_ip_top20(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn.nearest(*sides(spark, sf), 20, inner_product=True, exclude="same"))


@query(ranked_sql(sql_l2("q.v", "r.v"), "", 5, "d <= 1.2"))
def knn_maxdist(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn.nearest(*sides(spark, sf), 5, max_distance=1.2, exclude="same"))


@query(f"""WITH {FRAMES}, d AS (SELECT q.vec_id AS qid, r.vec_id AS rid, {sql_l2('q.v', 'r.v')} AS d FROM g q, g r WHERE q.vec_id % 20 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rank FROM d) SELECT qid, rid, round(d, 6) AS distance, rank::BIGINT AS rank FROM k WHERE rank <= 3""")
def knn_with_self(spark: SparkSession, sf: str) -> DataFrame:
    return shown(knn.nearest(*sides(spark, sf), 3))


def ivf_sql(probes: int) -> str:
    return f"""WITH {FRAMES}, c AS (SELECT content_id AS i, v AS c FROM g WHERE frame = 0),
a AS (SELECT g.vec_id, g.frame, g.v, c.i, row_number() OVER (PARTITION BY g.vec_id ORDER BY {sql_l2('g.v', 'c.c')}, c.i) AS p FROM g, c),
d AS (SELECT q.vec_id AS qid, r.vec_id AS rid, {sql_l2('q.v', 'r.v')} AS d FROM a q JOIN a r ON q.i = r.i WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id AND q.p <= {probes} AND r.p = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d, rid) AS rank FROM d) SELECT qid, rid, round(d, 6) AS distance, rank::BIGINT AS rank FROM k WHERE rank <= 5"""


def _ivf(probes: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        firsts = frames(spark, sf).where("frame = 0").select("content_id", "v").orderBy("content_id").collect()  # one row per label
        return shown(knn.nearest_by_cell(*sides(spark, sf), [(r[0], [float(x) for x in r[1]]) for r in firsts], 5, probes, "same"))

    return run


query(ivf_sql(1), "ivf_knn_probe1")(_ivf(1))
query(ivf_sql(4), "ivf_knn_probe4")(_ivf(4))


def ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many of the exact 10 nearest rows a search with trained centroids finds, by probes; tested against the exact search."""
    queries, rows = sides(spark, sf)
    source = read(spark, sf, "embeddings").select(F.col("vec_id").alias("rid"), F.col("label").alias("source"), F.col("embedding").alias("v"))
    centroids = knn.train_centroids(source, 16)
    exact = knn.nearest(queries, rows, 10, exclude="same").select("qid", "rid")
    each = [knn.nearest_by_cell(queries, rows, centroids, 10, p, "same").select("qid", "rid", F.lit(True).alias("hit")).join(exact, ["qid", "rid"], "right").agg(F.lit(p).alias("probes"), F.count("*").alias("wanted"), F.count("hit").alias("found")) for p in (1, 4, 12, 16)]
    return reduce(DataFrame.unionByName, each).withColumn("recall", F.round(F.col("found") / F.col("wanted"), 4))


QUERIES["ivf_recall"] = ivf_recall


@query(f"""WITH {FRAMES}, s AS (SELECT content_id, count(*) AS n FROM g GROUP BY 1), e AS (SELECT content_id, sum(n) OVER (ORDER BY content_id) - n AS start, sum(n) OVER (ORDER BY content_id) AS "end" FROM s),
r AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row FROM g) SELECT r.row::BIGINT AS row, e.content_id FROM r JOIN e ON r.row >= e.start AND r.row < e."end" """)
def segment_lookup(spark: SparkSession, sf: str) -> DataFrame:
    sizes = frames(spark, sf).groupBy("content_id").agg(F.count("*").alias("n"))
    ends = sizes.withColumn("end", F.expr("sum(n) over (order by content_id)")).withColumn("start", F.col("end") - F.col("n")).drop("n")  # a row per recording
    rows = relating.numbered(read(spark, sf, "embeddings").select("vec_id"), "vec_id").select("row")
    return relating.in_segment(rows, ends).select("row", "content_id")


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """Queries of ten odd frames: query_id, qrow, qt, v."""
    own = frames(spark, sf).where("frame % 2 = 1")
    return own.select((F.col("content_id") * 1000 + F.floor(F.col("frame") / 20)).alias("query_id"), F.col("vec_id").alias("qrow"), clock.time_of(F.col("frame")).alias("qt"), "v")


def consensus_sql(tolerance: float = 0.12, votes: int = 1, limit: int = 10, named: str = "q.content_id * 1000 + q.frame // 20", asked: str = "q.frame % 2 = 1", qt: str = "q.t", shown: str = "") -> str:
    shown = shown or """query_id, content_id, votes::BIGINT AS votes, round(f, 6) AS vote_fraction, round(m, 6) AS mean_distance, round("off", 6) AS "offset", round(f / (1 + m), 6) AS score, rank::BIGINT AS rank"""
    return f"""WITH {FRAMES}, t AS (SELECT *, frame * 186.0::DOUBLE / 8000.0::DOUBLE + 0.360375::DOUBLE AS t FROM g),
d AS (SELECT {named} AS query_id, q.vec_id AS qrow, r.content_id, r.t - {qt} AS off, {sql_l2('q.v', 'r.v')} AS d,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_l2('q.v', 'r.v')}, r.content_id * 4294967296 + r.frame) AS rk FROM t q, t r WHERE {asked} AND r.frame % 2 = 0),
n AS (SELECT * FROM d WHERE rk <= 5), a AS (SELECT DISTINCT query_id, content_id, off AS l FROM n),
i AS (SELECT n.query_id, n.content_id, a.l, n.qrow, n.d, n.off, row_number() OVER (PARTITION BY n.query_id, n.content_id, a.l, n.qrow ORDER BY n.d, n.off) AS p
  FROM n JOIN a ON n.query_id = a.query_id AND n.content_id = a.content_id AND n.off >= a.l AND n.off - a.l <= 2 * {tolerance}::DOUBLE + 1e-12::DOUBLE),
w AS (SELECT query_id, content_id, l, count(*) AS votes, avg(d) AS m, median(off) AS mid, min(off) AS lo, max(off) AS hi FROM i WHERE p = 1 GROUP BY 1, 2, 3),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_id ORDER BY votes DESC, m, l) AS p FROM w),
c AS (SELECT {named} AS query_id, count(*) AS n FROM t q WHERE {asked} GROUP BY 1),
o AS (SELECT b.query_id, content_id, votes, m, greatest(least(mid, lo + {tolerance}::DOUBLE), hi - {tolerance}::DOUBLE) AS off, votes / n::DOUBLE AS f FROM b JOIN c ON b.query_id = c.query_id WHERE p = 1 AND votes >= {votes}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, m, content_id) AS rank FROM o)
SELECT {shown} FROM r WHERE rank <= {limit}"""


def _consensus(tolerance: float = 0.12, votes: int = 1, limit: int = 10):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        found = Gallery.from_fingerprints(frames(spark, sf), 2).match(asked(spark, sf), 5, tolerance, votes, limit)
        return found.select("query_id", "content_id", "votes", r6(F.col("vote_fraction"), "vote_fraction"), r6(F.col("mean_distance"), "mean_distance"), r6(F.col("offset"), "offset"), r6(F.col("score"), "score"), F.col("rank").cast("bigint").alias("rank"))

    return run


query(consensus_sql(), "temporal_consensus")(_consensus())
query(consensus_sql(votes=3), "temporal_consensus_min_votes")(_consensus(votes=3))
query(consensus_sql(limit=1), "temporal_consensus_top1")(_consensus(limit=1))
query(consensus_sql(0.5), "temporal_consensus_wide")(_consensus(0.5))


@query(consensus_sql())
def compact_parity(spark: SparkSession, sf: str) -> DataFrame:
    """The answers of a gallery that computes time and content from frame numbers and segment ends; those of one that holds them are temporal_consensus."""
    own = frames(spark, sf).where("frame % 2 = 0")
    sizes = own.groupBy("content_id").agg(F.count("*").alias("n"))
    ends = sizes.withColumn("end", F.expr("sum(n) over (order by content_id)")).withColumn("start", F.col("end") - F.col("n")).drop("n")  # a row per recording
    place = F.row_number().over(Window.partitionBy("content_id").orderBy("frame")) - 1
    rows = own.join(F.broadcast(ends), "content_id").select((F.col("start") + place).alias("row"), "frame", "v")
    compact = relating.in_segment(rows, ends).select("content_id", "frame", "v")
    found = Gallery.from_fingerprints(compact, 1).match(asked(spark, sf))
    return found.select("query_id", "content_id", "votes", r6(F.col("vote_fraction"), "vote_fraction"), r6(F.col("mean_distance"), "mean_distance"), r6(F.col("offset"), "offset"), r6(F.col("score"), "score"), F.col("rank").cast("bigint").alias("rank"))


#: The first frame of the crops that recordings are asked for by, and its time.
CROP, CROP_S = 8, "(8 * 186.0::DOUBLE / 8000.0::DOUBLE)"


@query(consensus_sql(limit=1, named="q.content_id", asked=f"q.frame BETWEEN {CROP} AND {CROP + 9}", qt=f"(q.t - {CROP_S})", shown=f"""query_id, query_id AS content_id, content_id AS found_id, round(abs("off" - {CROP_S}), 6) AS offset_error, votes::BIGINT AS votes, query_id = content_id AND abs("off" - {CROP_S}) <= 0.1 AS passed"""))
def self_match_audit(spark: SparkSession, sf: str) -> DataFrame:
    own = frames(spark, sf).where(F.col("frame").between(CROP, CROP + 9))
    shift = F.lit(CROP) * F.lit(186.0) / F.lit(8000.0)
    queries = own.select(F.col("content_id").alias("query_id"), F.col("vec_id").alias("qrow"), (clock.time_of(F.col("frame")) - shift).alias("qt"), "v")
    found = Gallery.from_fingerprints(frames(spark, sf), 2).match(queries, limit=1)
    crops = queries.select("query_id", F.col("query_id").alias("content_id")).distinct().withColumn("start_s", shift)
    return evaluate.self_matches(found, crops).withColumn("offset_error", F.round("offset_error", 6) + 0.0)


def _sequences(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own = frames(spark, sf)
    pos = F.floor(F.col("frame") / 2)
    queries = own.where("frame % 2 = 1").select((F.col("content_id") * 1000 + F.floor(pos / 8)).alias("query_id"), F.pmod(pos, F.lit(8)).alias("qpos"), "vec_id", "v")
    refs = own.where("frame % 2 = 0").select("content_id", pos.alias("pos"), "vec_id", "v")
    near = knn.nearest(queries.select(F.col("vec_id").alias("qid"), "v"), refs.select(F.col("vec_id").alias("rid"), "v"), 20, inner_product=True)
    met = near.join(queries.select(F.col("vec_id").alias("qid"), "query_id", "qpos"), "qid").join(refs.select(F.col("vec_id").alias("rid"), "content_id", F.col("pos").alias("rpos")), "rid")
    return met.select("query_id", "qpos", "content_id", "rpos", "rank"), queries.select("query_id", "qpos", "v"), refs.select("content_id", "pos", "v")


SEQ = f"""WITH {FRAMES}, q AS (SELECT content_id * 1000 + frame // 2 // 8 AS query_id, (frame // 2) % 8 AS qpos, vec_id, v FROM g WHERE frame % 2 = 1),
r AS (SELECT content_id, frame // 2 AS pos, vec_id, v FROM g WHERE frame % 2 = 0),
d AS (SELECT query_id, qpos, content_id, pos AS rpos, row_number() OVER (PARTITION BY q.vec_id ORDER BY {sql_dot('q.v', 'r.v')} DESC, r.vec_id) AS rank FROM q, r),
n AS (SELECT * FROM d WHERE rank <= 20), sz AS (SELECT query_id, count(*) AS n, max(qpos) AS reach FROM q GROUP BY 1), en AS (SELECT content_id, count(*) AS m FROM r GROUP BY 1)"""


@query(SEQ + f""", s AS (SELECT DISTINCT n.query_id, n.content_id, rpos - qpos AS start FROM n JOIN sz ON sz.query_id = n.query_id JOIN en ON en.content_id = n.content_id WHERE rpos - qpos >= 0 AND rpos - qpos + sz.n <= m),
c AS (SELECT s.query_id, s.content_id, s.start, avg({sql_dot('q.v', 'r.v')}) AS score FROM s JOIN q ON q.query_id = s.query_id JOIN r ON r.content_id = s.content_id AND r.pos = s.start + q.qpos GROUP BY 1, 2, 3),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content_id, start) AS rank FROM c)
SELECT query_id, content_id, start, round(score, 6) AS score FROM t WHERE rank = 1""")
def sequence_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return matching.sequence_rerank(*_sequences(spark, sf)).select("query_id", "content_id", "start", r6(F.col("score"), "score"))


STRETCH = """, f AS (SELECT query_id, content_id, qpos, arg_min(rpos, rank) AS rpos FROM n GROUP BY 1, 2, 3),
p AS (SELECT a.query_id, a.content_id, avg((a.qpos - b.qpos)::DOUBLE / (a.rpos - b.rpos)) AS mean FROM f a JOIN f b ON a.query_id = b.query_id AND a.content_id = b.content_id AND a.qpos <> b.qpos AND a.rpos <> b.rpos GROUP BY 1, 2),
x AS (SELECT k.query_id, k.content_id, CASE WHEN mean BETWEEN 0.5 AND 2.0 THEN mean ELSE 1.0 END AS factor FROM (SELECT DISTINCT query_id, content_id FROM f) k LEFT JOIN p ON p.query_id = k.query_id AND p.content_id = k.content_id)"""


@query(SEQ + STRETCH + " SELECT query_id, content_id, round(factor, 6) AS factor FROM x")
def stretch_factor(spark: SparkSession, sf: str) -> DataFrame:
    return matching.stretch_factors(_sequences(spark, sf)[0]).select("query_id", "content_id", r6(F.col("factor"), "factor"))


@query(SEQ + STRETCH + f""", s AS (SELECT DISTINCT n.query_id, n.content_id, factor, round_even(rpos - qpos / factor, 0)::BIGINT AS start FROM n JOIN x ON x.query_id = n.query_id AND x.content_id = n.content_id),
k AS (SELECT s.* FROM s JOIN sz ON sz.query_id = s.query_id JOIN en ON en.content_id = s.content_id WHERE start >= 0 AND round_even(start + reach / factor, 0) < m),
c AS (SELECT k.query_id, k.content_id, k.start, k.factor, avg({sql_dot('q.v', 'r.v')}) AS score FROM k JOIN q ON q.query_id = k.query_id JOIN r ON r.content_id = k.content_id AND r.pos = round_even(k.start + q.qpos / k.factor, 0)::BIGINT GROUP BY 1, 2, 3, 4),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content_id, start) AS rank FROM c)
SELECT query_id, content_id, start, round(factor, 6) AS factor, round(score, 6) AS score FROM t WHERE rank = 1""")
def stretch_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return matching.stretch_rerank(*_sequences(spark, sf)).select("query_id", "content_id", "start", r6(F.col("factor"), "factor"), r6(F.col("score"), "score"))


@query(SEQ.replace("rank FROM q, r)", "rank FROM q, r)").split(", sz AS")[0] + """, l AS (SELECT query_id, content_id, qpos * 0.5::DOUBLE AS qt, rpos * 0.5::DOUBLE AS rt FROM n WHERE rank <= 5),
p AS (SELECT DISTINCT a.query_id, a.content_id, (b.rt - a.rt) / (b.qt - a.qt) AS a, a.rt - (b.rt - a.rt) / (b.qt - a.qt) * a.qt AS b FROM l a JOIN l b ON a.query_id = b.query_id AND a.content_id = b.content_id AND b.qt - a.qt >= 1.0),
k AS (SELECT * FROM p WHERE a BETWEEN 0.5 AND 2.0),
v AS (SELECT k.query_id, k.content_id, k.a, k.b, count(DISTINCT qt) AS votes, regr_slope(rt, qt) AS slope, regr_intercept(rt, qt) AS intercept FROM k JOIN l ON l.query_id = k.query_id AND l.content_id = k.content_id AND abs(rt - k.a * qt - k.b) <= 0.12::DOUBLE GROUP BY 1, 2, 3, 4),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_id ORDER BY votes DESC, abs(a - 1), a, b) AS p FROM v)
SELECT query_id, content_id, round(slope, 6) AS slope, round(intercept, 6) AS intercept, votes::BIGINT AS votes FROM t WHERE p = 1""")
def affine_all_pairs(spark: SparkSession, sf: str) -> DataFrame:
    near = _sequences(spark, sf)[0].where("rank <= 5")
    timed = near.select("query_id", "content_id", (F.col("qpos") * 0.5).alias("qt"), (F.col("rpos") * 0.5).alias("rt"))
    return matching.affine_all_pairs(timed).select("query_id", "content_id", r6(F.col("slope"), "slope"), r6(F.col("intercept"), "intercept"), "votes")


def affine_sampled(spark: SparkSession, sf: str) -> DataFrame:
    """The form that draws pairs; tested on lines that are known."""
    near = Gallery.from_fingerprints(frames(spark, sf), 2).search(asked(spark, sf), 5)
    return matching.affine(near.withColumn("content_id", F.col("content_id").cast("string")))


QUERIES["affine_sampled"] = affine_sampled


WORDS = "list_filter(string_split(lower(text), ' '), lambda w: w <> '')"
NUMBER = "('0x' || substr(md5({}), 1, 8))::BIGINT"


def _lsh(votes: int):
    """J19 with 5 tables of 2; lsh_minhash_votes_1 and _4 take 25 tables of 4."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        q = hashing.minhash_bins(read(spark, sf, "benchmark"), "item_id", "text", 5, 2).withColumnRenamed("item_id", "qid")
        r = hashing.minhash_bins(files.evened(read(spark, sf, "documents")), "doc_id", "text", 5, 2).withColumnRenamed("doc_id", "rid")
        return matching.lsh_votes(q, r, votes)

    return run


def lsh_sql(votes: int) -> str:
    least = ", ".join(f"min(md5('{i}:' || w)) AS m{i}" for i in range(10))
    bins = ", ".join(NUMBER.format(f"m{2 * t} || '-' || m{2 * t + 1}") for t in range(5))
    one = "(SELECT {k} AS id, " + least + " FROM (SELECT DISTINCT {k}, unnest(" + WORDS + ") AS w FROM {t}) GROUP BY 1)"
    side = lambda k, t: f"SELECT id, unnest(range(5)) AS tb, unnest([{bins}]) AS bin FROM " + one.format(k=k, t=t)
    return f"WITH q AS ({side('item_id', 'benchmark')}), r AS ({side('doc_id', 'documents')}) SELECT q.id AS qid, r.id AS rid, count(*)::BIGINT AS votes FROM q JOIN r ON q.tb = r.tb AND q.bin = r.bin GROUP BY 1, 2 HAVING count(*) >= {votes}"


query(lsh_sql(1), "lsh_votes_1")(_lsh(1))
query(lsh_sql(2), "lsh_votes_2")(_lsh(2))


def _lsh_whole(votes: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        q = hashing.minhash_bins(read(spark, sf, "benchmark"), "item_id", "text", 25, 4).withColumnRenamed("item_id", "qid")
        r = hashing.minhash_bins(files.evened(read(spark, sf, "documents")), "doc_id", "text", 25, 4).withColumnRenamed("doc_id", "rid")
        return matching.lsh_votes(q, r, votes)

    return run


def lsh_whole_sql(votes: int) -> str:
    least = ", ".join(f"min(md5('{i}:' || w)) AS m{i}" for i in range(100))
    bins = ", ".join(NUMBER.format(" || '-' || ".join(f"m{4 * t + r}" for r in range(4))) for t in range(25))
    side = lambda k, t: f"SELECT id, unnest(range(25)) AS tb, unnest([{bins}]) AS bin FROM (SELECT {k} AS id, {least} FROM (SELECT DISTINCT {k}, unnest({WORDS}) AS w FROM {t}) GROUP BY 1)"
    return f"WITH q AS ({side('item_id', 'benchmark')}), r AS ({side('doc_id', 'documents')}) SELECT q.id AS qid, r.id AS rid, count(*)::BIGINT AS votes FROM q JOIN r ON q.tb = r.tb AND q.bin = r.bin GROUP BY 1, 2 HAVING count(*) >= {votes}"


query(lsh_whole_sql(1), "lsh_minhash_votes_1")(_lsh_whole(1))
query(lsh_whole_sql(4), "lsh_minhash_votes_4")(_lsh_whole(4))


LAND = "SELECT DISTINCT {k} AS id, unnest(range(len(w) - 1)) AS t, unnest(list_transform(range(1, len(w)), lambda i: " + NUMBER.format("w[i] || ' ' || w[i + 1]") + ")) AS h FROM (SELECT {k}, " + WORDS + " AS w FROM {t}) WHERE len(w) > 1"


@query(f"""WITH q AS ({LAND.format(k='item_id', t='benchmark')}), r AS ({LAND.format(k='doc_id', t='documents')}),
b AS (SELECT q.id AS query_id, r.id AS content_id, r.t - q.t AS off, count(*) AS n FROM q JOIN r ON q.h = r.h GROUP BY 1, 2, 3),
s AS (SELECT *, sum(n) OVER (PARTITION BY query_id, content_id ORDER BY off RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS matched FROM b),
m AS (SELECT *, row_number() OVER (PARTITION BY query_id, content_id ORDER BY matched DESC, n DESC, off) AS p FROM s),
k AS (SELECT query_id, content_id, off, matched, row_number() OVER (PARTITION BY query_id ORDER BY matched DESC, content_id) AS rank FROM m WHERE p = 1 AND matched >= 5)
SELECT query_id, content_id, "off"::BIGINT AS "offset", matched::BIGINT AS matched FROM k WHERE rank <= 3""")
def landmark_offsets(spark: SparkSession, sf: str) -> DataFrame:
    q = hashing.landmarks(read(spark, sf, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "query_id")
    r = hashing.landmarks(files.evened(read(spark, sf, "documents")), "doc_id", "text").withColumnRenamed("doc_id", "content_id")
    return matching.landmark_offsets(q, r, limit=3).select("query_id", "content_id", "offset", "matched")


SHIFTS = [1, 2, 4, 6, 8, 16, 32, 64]
PARTNERS = """c AS (SELECT DISTINCT content_id FROM g), p AS (SELECT content_id, coalesce(lead(content_id) OVER (ORDER BY content_id), min(content_id) OVER ()) AS partner FROM c)"""


@query(f"""WITH {FRAMES}, {PARTNERS}, s AS (SELECT unnest({SHIFTS}) AS shift), z AS (SELECT content_id, count(*) AS n FROM g GROUP BY 1),
d AS (SELECT shift, {sql_l2('a.v', 'b.v')} AS d FROM g a JOIN s ON true JOIN g b ON a.content_id = b.content_id AND b.frame = a.frame + shift
UNION ALL SELECT -1, {sql_l2('a.v', 'b.v')} FROM g a JOIN p ON p.content_id = a.content_id JOIN z ON z.content_id = partner JOIN g b ON b.content_id = partner AND b.frame = {NUMBER.format("'pair:' || a.content_id || ':' || a.frame")} % z.n)
SELECT shift::BIGINT AS shift, count(*)::BIGINT AS n_pairs, round(quantile_cont(d, 0.1), 6) AS p10, round(quantile_cont(d, 0.5), 6) AS p50, round(quantile_cont(d, 0.9), 6) AS p90, round(quantile_cont(d, 0.95), 6) AS p95 FROM d GROUP BY shift""")
def shift_distance_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """By shift within a content; -1 stands for pairs of rows of different contents."""
    own = frames(spark, sf)
    pairs = relating.shifted(own, SHIFTS).select("shift", vectors.squared_l2(F.col("v"), F.col("w")).alias("d"))
    cross = relating.partner_frames(own.select("content_id", "frame", "v")).select(F.lit(-1).cast("bigint").alias("shift"), vectors.squared_l2(F.col("v"), F.col("w")).alias("d"))
    return pairs.unionByName(cross).groupBy("shift").agg(F.count("*").alias("n_pairs"), *(r6(F.percentile("d", F.lit(q)), f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9, 0.95)))


@query(f"""WITH {FRAMES} SELECT a.content_id, a.frame, b.frame - a.frame AS shift, round({sql_l2('a.v', 'b.v')}, 6) AS distance FROM g a JOIN g b ON a.content_id = b.content_id AND b.frame - a.frame IN ({', '.join(map(str, SHIFTS))})""")
def frame_shift_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return relating.shifted(frames(spark, sf), SHIFTS).select("content_id", "frame", "shift", r6(vectors.squared_l2(F.col("v"), F.col("w")), "distance"))


@query("""WITH s AS (SELECT DISTINCT label::BIGINT AS source FROM embeddings), n AS (SELECT source, row_number() OVER (ORDER BY source) - 1 AS i, count(*) OVER () AS n FROM s)
SELECT a.source, b.source AS partner FROM n a JOIN n b ON (a.i + 1) % a.n = b.i""")
def cyclic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return relating.cyclic(read(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("source")))


@query(f"""WITH {FRAMES}, {PARTNERS}, s AS (SELECT content_id, frame * 64 + j AS i, v[j + 1] AS x FROM g, range(64) t(j)), e AS (SELECT content_id, count(*) AS n FROM s GROUP BY 1),
q AS (SELECT a.content_id, a.i - 256 AS j, a.x * 0.75::DOUBLE + b.x * 0.25::DOUBLE AS y FROM s a JOIN p ON p.content_id = a.content_id JOIN s b ON b.content_id = p.partner AND b.i = a.i WHERE a.i BETWEEN 256 AND 383),
k AS (SELECT *, CASE WHEN content_id % 5 = 4 THEN 7 ELSE 263 END AS start FROM q),
l AS (SELECT k.content_id, lag, corr(y, r.x) AS r FROM k JOIN e ON e.content_id = k.content_id, range(-20, 21) t(lag), s r WHERE r.content_id = k.content_id AND r.i = start + lag + j AND start - 20 >= 0 AND start + 20 + 128 <= n GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY content_id ORDER BY abs(r) DESC, lag) AS p FROM l)
SELECT c.content_id AS pair_id, CASE WHEN r IS NULL THEN 'insufficient_full_crop_support' ELSE 'measured' END AS status, round(r, 6) AS r, lag::BIGINT AS lag, coalesce(abs(r) >= 0.95, false) AS flagged FROM (SELECT DISTINCT content_id FROM k) c LEFT JOIN b ON b.content_id = c.content_id AND p = 1""")
def waveform_pearson(spark: SparkSession, sf: str) -> DataFrame:
    """Each recording's samples 256 to 383, mixed with the next one's, against the recording around a place that is 7 samples off, or at its very start."""
    own = signals(spark, sf).select("content_id", "pcm")
    pairs = own.join(F.broadcast(relating.cyclic(own.select(F.col("content_id").alias("source")))).withColumnRenamed("source", "content_id"), "content_id")  # a row per recording
    met = pairs.join(own.select(F.col("content_id").alias("partner"), F.col("pcm").alias("other")), "partner").where("size(pcm) >= 384 and size(other) >= 384")
    mixed = F.zip_with(F.slice("pcm", 257, 128), F.slice("other", 257, 128), lambda x, y: x * 0.75 + y * 0.25)
    start = F.when(F.col("content_id") % 5 == 4, 7).otherwise(263).cast("bigint")
    found = matching.correlations(met.select(F.col("content_id").alias("pair_id"), mixed.alias("query"), F.col("pcm").alias("reference"), start.alias("start")), 20)
    return found.withColumn("r", F.round("r", 6) + 0.0)


PHYSICAL = """, f AS (SELECT query_id, content_id, qpos, arg_min(rpos, rank) AS rpos FROM n GROUP BY 1, 2, 3),
p AS (SELECT a.query_id, a.content_id, avg((a.qpos - b.qpos) * 0.5::DOUBLE / (a.rpos - b.rpos)) AS mean FROM f a JOIN f b ON a.query_id = b.query_id AND a.content_id = b.content_id AND a.qpos <> b.qpos AND a.rpos <> b.rpos GROUP BY 1, 2),
x AS (SELECT k.query_id, k.content_id, CASE WHEN mean BETWEEN 0.5 AND 2.0 THEN mean ELSE 1.0 END AS factor FROM (SELECT DISTINCT query_id, content_id FROM f) k LEFT JOIN p ON p.query_id = k.query_id AND p.content_id = k.content_id)"""


@query(SEQ + PHYSICAL + f""", s AS (SELECT DISTINCT n.query_id, n.content_id, factor, round_even(rpos - qpos * 0.5::DOUBLE / factor, 0)::BIGINT AS start FROM n JOIN x ON x.query_id = n.query_id AND x.content_id = n.content_id),
k AS (SELECT s.* FROM s JOIN sz ON sz.query_id = s.query_id JOIN en ON en.content_id = s.content_id WHERE start >= 0 AND round_even(start + reach * 0.5::DOUBLE / factor, 0) < m),
c AS (SELECT k.query_id, k.content_id, k.start, k.factor, avg({sql_dot('q.v', 'r.v')}) AS score, min(r.pos) AS first, count(DISTINCT r.pos) AS evidence FROM k JOIN q ON q.query_id = k.query_id JOIN r ON r.content_id = k.content_id AND r.pos = round_even(k.start + q.qpos * 0.5::DOUBLE / k.factor, 0)::BIGINT GROUP BY 1, 2, 3, 4),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content_id, start) AS rank FROM c)
SELECT query_id, content_id, first::DOUBLE AS start_s, round(score, 6) AS score, round(1 / factor, 6) AS scale, evidence::BIGINT AS evidence_frames FROM t WHERE rank = 1""")
def physical_rerank(spark: SparkSession, sf: str) -> DataFrame:
    """Queries with a row each half second, references with one each second."""
    near, queries, refs = _sequences(spark, sf)
    near = near.withColumns({"qt": F.col("qpos") * 0.5, "rt": F.col("rpos").cast("double")})
    found = matching.physical_rerank(near, queries.withColumn("qt", F.col("qpos") * 0.5), refs.withColumn("t", F.col("pos").cast("double")), 1.0)
    return found.select("query_id", "content_id", "start_s", r6(F.col("score"), "score"), r6(F.col("scale"), "scale"), "evidence_frames")


@query(f"""WITH {FRAMES} SELECT vec_id, frame FROM g WHERE vec_id % 50 = 0""")
def grid_audit(spark: SparkSession, sf: str) -> DataFrame:
    hop = 186 / 8000
    t = F.col("frame") * F.lit(hop) + F.when(F.col("vec_id") % 50 == 0, 1e-6).otherwise(0.0)
    return validate.off_grid(frames(spark, sf).withColumns({"pos": F.col("frame"), "t": t}), "vec_id", hop).select("vec_id", "frame")


@query("""SELECT user_id, event_id FROM (SELECT user_id, event_id, epoch_us(ts) // 60000000 AS t, lag(epoch_us(ts) // 60000000) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE t <= before""")
def clock_audit(spark: SparkSession, sf: str) -> DataFrame:
    minute = F.floor(F.expr("unix_micros(cast(ts as timestamp))") / 60000000).cast("double")
    return validate.not_increasing(read(spark, sf, "events").withColumn("minute", minute), "user_id", "event_id", "minute").select("user_id", "event_id")
