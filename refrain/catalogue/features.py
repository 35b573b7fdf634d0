"""Clock, thinning, features, components, storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refrain.catalogue.base import FRAMES, frames, r6, read, signals
from refrain.functions import clock, mel, vectors
from refrain.operators import evaluate, matching, pca, protocol

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {FRAMES} SELECT content_id, frame, round(frame * 186.0::DOUBLE / 8000.0::DOUBLE + 0.360375::DOUBLE, 6) AS t, frame AS recovered FROM g")
def grid_frames(spark: SparkSession, sf: str) -> DataFrame:
    t = clock.time_of(F.col("frame"))
    return frames(spark, sf).select("content_id", "frame", r6(t, "t"), clock.frame_of(t).alias("recovered"))


@query(f"""WITH {FRAMES}, f AS (SELECT unnest([1, 2, 4, 6, 8]) AS factor), p AS (SELECT factor, unnest(range(factor)) AS phase FROM f)
SELECT factor::BIGINT AS factor, phase::BIGINT AS phase, count(*)::BIGINT AS n_rows, sum(frame)::BIGINT AS frames FROM g, p WHERE frame % factor = phase GROUP BY 1, 2""")
def thin_phase(spark: SparkSession, sf: str) -> DataFrame:
    own = frames(spark, sf).withColumn("factor", F.explode(F.array(*(F.lit(x).cast("bigint") for x in (1, 2, 4, 6, 8)))))
    return own.withColumn("phase", F.pmod("frame", "factor")).groupBy("factor", "phase").agg(F.count("*").alias("n_rows"), F.sum("frame").alias("frames"))


@query("""SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS n FROM events) WHERE n % 4 = 0""")
def thin_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return read(spark, sf, "events").withColumn("n", n).where(F.pmod("n", F.lit(4)) == 0).select("user_id", "event_id")


@query(f"WITH {FRAMES} SELECT content_id, " + ", ".join(f"count_if(frame % 8 = {i})::BIGINT AS r{i}" for i in range(8)) + " FROM g GROUP BY content_id")
def phase_residue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).groupBy("content_id").agg(*(F.count_if(clock.on_grid(F.col("frame"), 8, i)).alias(f"r{i}") for i in range(8)))


@query("""SELECT l_orderkey, l_linenumber, round(l_linenumber + (l_quantity - least(l_quantity, 10.0)) / 2, 6) AS crop_start, least(l_quantity, 10.0) AS crop_duration,
round(l_extendedprice / 1000 + (l_quantity - least(l_quantity, 10.0)) / 2 * (1 + l_discount), 6) AS crop_expected FROM lineitem""")
def crop_centered(spark: SparkSession, sf: str) -> DataFrame:
    c = clock.crop(F.col("l_linenumber"), F.col("l_quantity"), F.col("l_extendedprice") / 1000, 1 + F.col("l_discount"), 10.0)
    return read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r6(c["crop_start"], "crop_start"), c["crop_duration"].alias("crop_duration"), r6(c["crop_expected"], "crop_expected"))


@query("""WITH s AS (SELECT user_id, (epoch_us(ts) // 3600000000) AS hour FROM events), d AS (SELECT DISTINCT user_id, hour FROM s),
l AS (SELECT *, hour - lag(hour) OVER (PARTITION BY user_id ORDER BY hour) AS step FROM d)
SELECT user_id, (max(hour) - min(hour) + 1)::BIGINT AS span, (1 + sum(coalesce(least(step, 1), 0)))::BIGINT AS covered, count(*)::BIGINT AS evidence FROM l GROUP BY user_id""")
def evidence_span(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.floor(F.expr("unix_micros(cast(ts as timestamp))") / 3600000000).cast("bigint")
    own = read(spark, sf, "events").select("user_id", hour.alias("hour")).distinct()
    own = own.withColumn("step", F.col("hour") - F.lag("hour").over(Window.partitionBy("user_id").orderBy("hour")))
    return own.groupBy("user_id").agg((F.max("hour") - F.min("hour") + 1).alias("span"), (1 + F.sum(F.coalesce(F.least("step", F.lit(1)), F.lit(0)))).alias("covered"), F.count("*").alias("evidence"))


Z = "CASE WHEN {s} > 1e-8 THEN list_transform({v}, lambda x: (x - {m}) / {s}) ELSE list_transform({v}, lambda x: 0.0::DOUBLE) END"


@query(f"""WITH {FRAMES}, m AS (SELECT vec_id, v, list_avg(v) AS m, list_stddev_pop(v) AS s FROM g), z AS (SELECT vec_id, {Z.format(v='v', m='m', s='s')} AS z FROM m)
SELECT vec_id, round(z[1], 6) AS first, round(z[64], 6) AS last, round(list_sum(list_transform(z, lambda x: abs(x))), 6) AS size FROM z""")
def zscore_rows(spark: SparkSession, sf: str) -> DataFrame:
    z = frames(spark, sf).select("vec_id", vectors.standardized(F.col("v")).alias("z"))
    return z.select("vec_id", r6(F.get("z", F.lit(0)), "first"), r6(F.get("z", F.lit(63)), "last"), r6(vectors.total(F.transform("z", F.abs)), "size"))


@query(f"""WITH {FRAMES}, d AS (SELECT vec_id, v, list_transform(range(1, 64), lambda i: v[i + 1] - v[i]) AS d FROM g),
m AS (SELECT vec_id, v, d, list_avg(v) AS vm, list_stddev_pop(v) AS vs, list_avg(d) AS dm, list_stddev_pop(d) AS ds FROM d),
z AS (SELECT vec_id, list_concat({Z.format(v='v', m='vm', s='vs')}, {Z.format(v='d', m='dm', s='ds')}) AS z FROM m)
SELECT vec_id, len(z)::BIGINT AS dims, round(z[65], 6) AS first_delta, round(z[127], 6) AS last_delta, round(list_sum(list_transform(z, lambda x: abs(x))), 6) AS size FROM z""")
def delta_features(spark: SparkSession, sf: str) -> DataFrame:
    z = frames(spark, sf).select("vec_id", vectors.features(F.col("v")).alias("z"))
    return z.select("vec_id", F.size("z").cast("bigint").alias("dims"), r6(F.get("z", F.lit(64)), "first_delta"), r6(F.get("z", F.lit(126)), "last_delta"), r6(vectors.total(F.transform("z", F.abs)), "size"))


@query(f"""WITH {FRAMES}, b AS (SELECT content_id, frame, unnest(range(1, 65)) AS band, unnest(v) AS x FROM g),
w AS (SELECT content_id, frame, band, avg(x) OVER x AS mean, count(*) OVER x AS n FROM b WINDOW x AS (PARTITION BY content_id, band ORDER BY frame ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING))
SELECT content_id, frame, (band - 1)::BIGINT AS band, round(mean, 6) AS mean FROM w WHERE n = 32""")
def window_mean32(spark: SparkSession, sf: str) -> DataFrame:
    own = frames(spark, sf).select("content_id", "frame", F.posexplode(vectors.doubles(F.col("v"))).alias("band", "x"))
    w = Window.partitionBy("content_id", "band").orderBy("frame").rowsBetween(0, 31)
    return own.withColumns({"mean": F.avg("x").over(w), "n": F.count("*").over(w)}).where("n = 32").select("content_id", "frame", F.col("band").cast("bigint").alias("band"), r6(F.col("mean"), "mean"))


@query(f"WITH {FRAMES} SELECT vec_id, (list_stddev_pop(v) > 1e-6 AND list_avg(v) > 1e-3) AS audible FROM g")
def silence_gate(spark: SparkSession, sf: str) -> DataFrame:
    return frames(spark, sf).select("vec_id", vectors.audible(F.col("v")).alias("audible"))


@query("""WITH f AS (SELECT (i * 50)::DOUBLE AS hz FROM range(81) t(i)),
m AS (SELECT hz, CASE WHEN hz >= 1000 THEN 15 + ln(greatest(hz, 1000) / 1000) / (ln(6.4) / 27) ELSE hz / (200.0::DOUBLE / 3) END AS mel FROM f)
SELECT hz, round(mel, 6) AS mel, round(CASE WHEN mel >= 15 THEN 1000 * exp(ln(6.4) / 27 * (mel - 15)) ELSE mel * (200.0::DOUBLE / 3) END, 6) AS back FROM m""")
def mel_scale(spark: SparkSession, sf: str) -> DataFrame:
    own = spark.range(81).select((F.col("id") * 50).cast("double").alias("hz"))
    own = own.withColumn("m", mel.hz_to_mel(F.col("hz")))
    return own.select("hz", r6(F.col("m"), "mel"), r6(mel.mel_to_hz(F.col("m")), "back"))


@query("""WITH c AS (SELECT 315 / (200.0::DOUBLE / 3) AS lo, 15 + ln(1.96::DOUBLE) / (ln(6.4) / 27) AS hi),
e AS (SELECT i, lo + (hi - lo) * i / 33 AS m FROM c, range(34) t(i)), h AS (SELECT i, CASE WHEN m >= 15 THEN 1000 * exp(ln(6.4) / 27 * (m - 15)) ELSE m * (200.0::DOUBLE / 3) END AS hz FROM e),
b AS (SELECT a.i AS band, a.hz AS l, m.hz AS c, r.hz AS h FROM h a JOIN h m ON m.i = a.i + 1 JOIN h r ON r.i = a.i + 2)
SELECT band::BIGINT AS band, k::BIGINT AS bin, round(least((k * 7.8125 - l) / (c - l), (h - k * 7.8125) / (h - c)) * 2 / (h - l), 6) AS weight
FROM b, range(513) t(k) WHERE k * 7.8125 > l AND k * 7.8125 < h""")
def mel_filterbank(spark: SparkSession, sf: str) -> DataFrame:
    rows = [(b, k, float(w)) for b, row in enumerate(mel.filterbank()) for k, w in enumerate(row) if w > 0]
    return spark.createDataFrame(rows, "band bigint, bin bigint, weight double").select("band", "bin", r6(F.col("weight"), "weight"))


@query(f"""WITH {FRAMES}, i AS (SELECT unnest(range(1, 65)) AS i), p AS (SELECT a.i AS i, b.i AS j FROM i a, i b WHERE a.i <= b.i),
s AS (SELECT p.i, p.j, count(*) AS n, sum(v[p.i]) AS si, sum(v[p.j]) AS sj, sum(v[p.i] * v[p.j]) AS sij FROM g, p GROUP BY 1, 2)
SELECT (i - 1)::BIGINT AS i, (j - 1)::BIGINT AS j, n::BIGINT AS n, round(si, 6) AS sum_i, round(sij, 6) AS sum_ij, round((sij - si * sj / n) / (n - 1), 6) AS cov FROM s""")
def pca_moments(spark: SparkSession, sf: str) -> DataFrame:
    found = pca.covariances(pca.moments(frames(spark, sf)))
    return found.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), "n", r6(F.col("sum_i"), "sum_i"), r6(F.col("sum_ij"), "sum_ij"), r6(F.col("cov"), "cov"))


#: Components of the projection query: ((7 i + 3 j) mod 11 - 5) / 10 for component i and dimension j.
COMPONENTS = [[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(64)] for i in range(4)]


@query(f"""WITH {FRAMES} SELECT vec_id, """ + ", ".join(f"round(list_sum(list_transform(v, lambda x, j: x * (({7 * i} + 3 * (j - 1)) % 11 - 5) / 10)), 6) AS p{i}" for i in range(4)) + " FROM g")
def pca_project(spark: SparkSession, sf: str) -> DataFrame:
    own = frames(spark, sf).select("vec_id", vectors.projected(F.col("v"), COMPONENTS).alias("p"))
    return own.select("vec_id", *(r6(F.get("p", F.lit(i)), f"p{i}") for i in range(4)))


@query(f"""WITH {FRAMES} SELECT sum(len(v) * 4)::BIGINT AS payload_bytes, (count(*) * 12)::BIGINT AS metadata_bytes, round(sum(len(v) * 4) / (count(*) * 186.0::DOUBLE / 8000 / 3600), 6) AS bytes_per_hour FROM g""")
def storage_accounting(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluate.storage(frames(spark, sf), F.count("*") * F.lit(186.0) / 8000 / 3600)
    return found.select(F.col("payload_bytes").cast("bigint").alias("payload_bytes"), F.col("metadata_bytes").cast("bigint").alias("metadata_bytes"), r6(F.col("bytes_per_hour"), "bytes_per_hour"))


GAINS = f"""{FRAMES}, p AS (SELECT content_id, frame // 2 AS pair_id, frame % 2 AS side, v FROM g), f AS (SELECT content_id * 100000 + pair_id AS pair_id, side, v FROM p),
x AS (SELECT pair_id, side, unnest(range(1, 65)) AS band, unnest(v) AS e FROM f), y AS (SELECT pair_id, band, avg(abs(e)) FILTER (side = 0) AS r, avg(abs(e)) FILTER (side = 1) AS q FROM x GROUP BY 1, 2),
l AS (SELECT pair_id, band, ln(greatest(r, 1e-6)) - ln(greatest(q, 1e-6)) AS d FROM y WHERE r IS NOT NULL AND q IS NOT NULL),
c AS (SELECT band, d - avg(d) OVER (PARTITION BY pair_id) AS d FROM l), m AS (SELECT band, median(d) AS d FROM c GROUP BY band), gains AS (SELECT band, exp(d - avg(d) OVER ()) AS gain FROM m)"""


def _gains(spark: SparkSession, sf: str) -> DataFrame:
    own = frames(spark, sf).select((F.col("content_id") * 100000 + F.floor(F.col("frame") / 2)).alias("pair_id"), F.when(F.col("frame") % 2 == 0, "reference").otherwise("query").alias("side"), F.transform("v", lambda x: F.abs(x.cast("double"))).alias("mel"))
    whole = own.groupBy("pair_id").count().where("count = 2").select("pair_id")
    return evaluate.band_gains(own.join(whole, "pair_id"))


@query(f"WITH {GAINS} SELECT (band - 1)::BIGINT AS band, round(gain, 6) AS gain FROM gains")
def band_gain_median(spark: SparkSession, sf: str) -> DataFrame:
    return _gains(spark, sf).select(F.col("band").cast("bigint").alias("band"), r6(F.col("gain"), "gain"))


@query(f"""WITH {GAINS}, a AS (SELECT vec_id, band, e * gain AS e FROM (SELECT vec_id, unnest(range(1, 65)) AS band, unnest(v) AS e FROM g WHERE frame % 2 = 1) JOIN gains USING (band))
SELECT vec_id, round(sum(abs(e)), 6) AS size, round(max(e) FILTER (band = 1), 6) AS first, round(max(e) FILTER (band = 64), 6) AS last FROM a GROUP BY vec_id""")
def band_gain_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the query side, with the fitted gains (a number for each band)."""
    gains = [r.gain for r in _gains(spark, sf).orderBy("band").collect()]
    own = frames(spark, sf).where("frame % 2 = 1").select("vec_id", vectors.doubles(F.col("v")).alias("bands"))
    own = evaluate.with_gains(own, gains, 64)
    return own.select("vec_id", r6(vectors.total(F.transform("bands", F.abs)), "size"), r6(F.get("bands", F.lit(0)), "first"), r6(F.get("bands", F.lit(63)), "last"))


@query("""SELECT event_id, round_even(value / 7, 12)::DOUBLE AS rounded FROM events""")
def canonical_round12(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("event_id", matching.canonical(F.col("value") / 7).alias("rounded"))


#: The grid of the encoding query: frames of 64 samples, eight bands, means of four.
SMALL = clock.Config(n_fft=64, hop=32, n_mels=8, window=4, pca_dim=None)


@query(f"""WITH {FRAMES}, s AS (SELECT content_id, frame * 64 + j AS i, v[j + 1] AS x FROM g, range(64) t(j)), e AS (SELECT content_id, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT content_id, unnest(range(n // 32 + 1)) AS frame FROM e), y AS (SELECT f.content_id, frame, s.i - frame * 32 + 32 AS j, x FROM f JOIN s ON s.content_id = f.content_id AND s.i BETWEEN frame * 32 - 32 AND frame * 32 + 31),
z AS (SELECT content_id, frame, j, x * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * j / 64)) AS x FROM y),
m AS (SELECT content_id, frame, k, sqrt(pow(sum(x * cos(2 * pi() * k * j / 64)), 2) + pow(sum(x * sin(2 * pi() * k * j / 64)), 2)) AS mag FROM z, range(33) t(k) GROUP BY 1, 2, 3),
c AS (SELECT 315 / (200.0::DOUBLE / 3) AS lo, 15 + ln(1.96::DOUBLE) / (ln(6.4) / 27) AS hi), o AS (SELECT i, lo + (hi - lo) * i / 9 AS m FROM c, range(10) t(i)),
h AS (SELECT i, CASE WHEN m >= 15 THEN 1000 * exp(ln(6.4) / 27 * (m - 15)) ELSE m * (200.0::DOUBLE / 3) END AS hz FROM o), b AS (SELECT a.i AS band, a.hz AS l, m.hz AS c, r.hz AS h FROM h a JOIN h m ON m.i = a.i + 1 JOIN h r ON r.i = a.i + 2),
u AS (SELECT band, k, least((k * 125 - l) / (c - l), (h - k * 125) / (h - c)) * 2 / (h - l) AS w FROM b, range(33) t(k) WHERE k * 125 > l AND k * 125 < h),
e2 AS (SELECT content_id, frame, band, sum(mag * w) AS x FROM m JOIN u ON u.k = m.k GROUP BY 1, 2, 3),
a AS (SELECT content_id, frame, band, avg(x) OVER w AS x, count(*) OVER w AS n FROM e2 WINDOW w AS (PARTITION BY content_id, band ORDER BY frame ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)),
r AS (SELECT content_id, frame, list(x ORDER BY band) AS v FROM a WHERE n = 4 GROUP BY 1, 2), t AS (SELECT *, list_transform(range(1, 8), lambda i: v[i + 1] - v[i]) AS d FROM r WHERE list_stddev_pop(v) > 1e-6 AND list_avg(v) > 1e-3)
SELECT content_id::VARCHAR AS recording_id, frame, round(frame * 32.0::DOUBLE / 8000 + 0.006::DOUBLE, 6) AS t, 15::INT AS dims, round(list_sum(v), 5) AS energy, round((v[1] - list_avg(v)) / list_stddev_pop(v), 5) AS first, round((d[7] - list_avg(d)) / list_stddev_pop(d), 5) AS last FROM t""")
def encode_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of whole recordings to audible features, on a small grid."""
    from refrain.plans import encode

    own = signals(spark, sf).select(F.col("content_id").cast("string").alias("recording_id"), F.lit(8000).alias("sample_rate"), "pcm")
    bands = encode.means(own, SMALL)
    raw = encode.raw_features(bands, SMALL).select("recording_id", "frame", "t", F.size("raw").alias("dims"))
    z = vectors.features(F.col("bands"))
    met = raw.join(bands.select("recording_id", "frame", vectors.total(F.col("bands")).alias("energy"), F.get(z, F.lit(0)).alias("first"), F.get(z, F.lit(14)).alias("last")), ["recording_id", "frame"])
    return met.select("recording_id", "frame", r6(F.col("t"), "t"), "dims", *((F.round(c, 5) + 0.0).alias(c) for c in ("energy", "first", "last")))


@query(f"""WITH {FRAMES}, s AS (SELECT content_id, frame * 64 + j AS i, v[j + 1] AS x FROM g, range(64) t(j)), e AS (SELECT content_id, count(*) AS n FROM s GROUP BY 1),
w AS (SELECT content_id, unnest(range(0, n - 319, 640)) AS start FROM e WHERE n >= 320) SELECT w.content_id, start, start / 640.0::DOUBLE AS t, count(*)::BIGINT AS samples, round(sum(x), 6) AS total FROM w JOIN s ON s.content_id = w.content_id AND i >= start AND i < start + 320 GROUP BY 1, 2""")
def sparse_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of half a second, one each half second times a factor of two, of signals of 640 samples a second."""
    from refrain.plans import encode

    own = signals(spark, sf).select(F.col("content_id").alias("recording_id"), F.lit(640).alias("sample_rate"), "pcm")
    found = encode.sparse_windows(own, 0.5, 0.5, 2)
    return found.select(F.col("recording_id").alias("content_id"), F.col("start").cast("bigint").alias("start"), "t", F.size("window").cast("bigint").alias("samples"), r6(vectors.total(F.col("window")), "total"))


@query("""SELECT DISTINCT o_orderpriority, split_part(o_orderpriority || '@' || o_orderstatus || '@5s', '@', 1) AS first, regexp_replace(o_orderpriority || '@' || o_orderstatus || '@5s', '@[^@]*$', '') AS last FROM orders""")
def base_ids(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat_ws("@", "o_orderpriority", "o_orderstatus", F.lit("5s"))
    return read(spark, sf, "orders").select("o_orderpriority", protocol.base_id(name).alias("first"), protocol.base_id(name, last=True).alias("last")).distinct()


@query("SELECT l_returnflag, count(*)::BIGINT AS n, round(sum(l_tax * 100) / sum(l_quantity), 6) AS share, round(avg((l_tax > 0)::INT), 6) AS touched FROM lineitem GROUP BY 1")
def weighted_overlap(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "lineitem").select("l_returnflag", (F.col("l_tax") * 100).alias("overlap"), F.col("l_quantity").alias("duration"))
    return evaluate.weighted_overlap(own, ["l_returnflag"]).select("l_returnflag", "n", r6(F.col("share"), "share"), r6(F.col("touched"), "touched"))


@query("SELECT event_type, count(*)::BIGINT AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.quantiles(read(spark, sf, "events"), ["event_type"], "value").select("event_type", "n", *(r6(F.col(c), c) for c in ("p50", "p95", "p99")))
