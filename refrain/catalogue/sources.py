"""Sources, sinks and caches, each written to the shared folder and read back; crops and changes of signals."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from refrain.catalogue.base import FRAMES, r6, read, signals
from refrain.functions import clock, vectors
from refrain.operators import hashing, validate
from refrain.sources import files

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def folder(spark: SparkSession, name: str) -> str:
    return f"{files.shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name || ', \"' || s_name || '\"' AS note FROM supplier")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "csv")
    note = F.concat("s_name", F.lit(', "'), "s_name", F.lit('"'))
    read(spark, sf, "supplier").select("s_suppkey", note.alias("note")).write.csv(path, header=True, escape='"', quoteAll=True)
    return files.csv(spark, path, ["s_suppkey", "note"])


@query("SELECT p_brand AS method, p_size % 4 AS duration_s, count(*)::BIGINT AS n FROM part GROUP BY 1, 2")
def results_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Results by method and duration; those of the first brands are written again, in place of what was there."""
    path = folder(spark, "results")
    rows = read(spark, sf, "part").select(F.col("p_brand").alias("method"), (F.col("p_size") % 4).alias("duration_s"), "p_partkey")
    files.save_results(rows, path)
    files.save_results(rows.where("method < 'Brand#3'"), path)
    return spark.read.schema(rows.schema).parquet(path).groupBy("method", "duration_s").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def protocol_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = folder(spark, "json")
    regions = read(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.struct(F.col("r_name").alias("name")).alias("region"))
    read(spark, sf, "nation").join(regions, "n_regionkey").select("n_nationkey", "n_name", "region").write.json(path)
    schema = T.StructType([T.StructField("n_nationkey", T.IntegerType()), T.StructField("n_name", T.StringType()), T.StructField("region", T.StructType([T.StructField("name", T.StringType())]))])
    return spark.read.schema(schema).json(path).select("n_nationkey", "n_name", F.col("region.name").alias("region"))


@query("SELECT 'c' AS config_key, s_suppkey::VARCHAR AS source_key, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 2 END::INT AS computed FROM supplier")
def feature_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Even sources are asked for first, then all: each is computed once."""
    path = folder(spark, "cache")
    wanted = read(spark, sf, "supplier").select(F.lit("c").alias("config_key"), F.col("s_suppkey").cast("string").alias("source_key"))
    even = F.col("source_key").cast("bigint") % 2 == 0
    files.cached(spark, path, wanted.where(even), lambda missing: missing.withColumn("computed", F.lit(1)))
    return files.cached(spark, path, wanted, lambda missing: missing.withColumn("computed", F.lit(2)))


@query("SELECT s_suppkey::VARCHAR AS source_key, CASE WHEN s_suppkey % 10 = 0 THEN 'failed' WHEN s_suppkey % 5 = 0 THEN 'second' ELSE 'first' END AS state FROM supplier")
def extraction_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """Sources that fail at first are tried again, and some of them fail again."""
    path = folder(spark, "extraction")
    number = F.col("source_key").cast("bigint")
    wanted = read(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("source_key"), F.sha2("s_name", 256).alias("source_sha256"))
    run = lambda k, state: lambda missing: missing.withColumns({"error": F.when(number % k == 0, "broken"), "state": F.lit(state)})
    files.extracted(spark, path, wanted, run(5, "first"), "model")
    good, failed = files.extracted(spark, path, wanted, run(10, "second"), "model")
    return good.select("source_key", "state").unionByName(failed.select("source_key", F.lit("failed").alias("state")).distinct())


@query("""SELECT item_id AS reference_key, count(*)::BIGINT AS hashes FROM (SELECT item_id, unnest(range(len(w) - 1)) FROM (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda w: w <> '') AS w FROM benchmark) WHERE len(w) > 1) GROUP BY 1""")
def hash_snapshot(spark: SparkSession, sf: str) -> DataFrame:
    """The landmarks of every passage, kept by package, path and size; the second call computes none."""
    path = folder(spark, "hashes")
    texts = read(spark, sf, "benchmark")
    refs = texts.select(F.col("item_id").alias("reference_key"), F.concat(F.lit("b/"), "item_id").alias("path"), F.length("text").alias("size"))
    found = hashing.landmarks(texts, "item_id", "text").withColumnRenamed("item_id", "reference_key")
    files.snapshot(spark, path, "1.0", refs, lambda missing: found)
    again = files.snapshot(spark, path, "1.0", refs, lambda missing: found.where(F.lit(False)))
    return again.groupBy("reference_key").agg(F.count("*").alias("hashes"))


@query("""SELECT page_id, CASE WHEN starts_with(replace(url, chr(92), '/'), 'https:/') THEN substr(replace(url, chr(92), '/'), 8) ELSE replace(url, chr(92), '/') END AS path FROM pages""")
def portable_paths(spark: SparkSession, sf: str) -> DataFrame:
    own = read(spark, sf, "pages").select("page_id", F.col("url").alias("path"))
    return files.with_portable(own, "https:")


@query("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf: str) -> DataFrame:
    return validate.repeated(read(spark, sf, "documents"), ["source"])


@query("""SELECT f::INT AS factor, 8000.0::DOUBLE / 186 AS rate, 0.84875::DOUBLE AS support, 0.360375::DOUBLE AS first_centre, round(8000.0::DOUBLE / 186 * 3600 / f * 32 * 4, 3) AS bytes_per_hour FROM (SELECT unnest([1, 2, 4, 6, 8]) AS f)""")
def clock_scalars(spark: SparkSession, sf: str) -> DataFrame:
    c = clock.Config()
    return spark.createDataFrame([(f, c.rate, c.support, c.first_centre, round(c.bytes_per_hour(f), 3)) for f in (1, 2, 4, 6, 8)], "factor int, rate double, support double, first_centre double, bytes_per_hour double")


@query("""SELECT * FROM (VALUES ('default', 63, 32), ('no_standardization', 63, 32), ('no_deltas', 32, 32), ('fp16_roundtrip', 63, 32), ('no_pca', 63, 63), ('window16', 63, 32), ('window48', 63, 32), ('stride2', 63, 32), ('pca16', 63, 16), ('pca32', 63, 32), ('mel64_pca64', 127, 64)) t(name, raw_dim, dim)""")
def ablation_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(n, c.raw_dim, c.dim) for n, c in clock.variants().items()], "name string, raw_dim int, dim int")


SIGNAL = f"""{FRAMES}, s AS (SELECT content_id, frame * 64 + j AS i, v[j + 1] AS x FROM g, range(64) t(j)), e AS (SELECT content_id, count(*) AS n FROM s GROUP BY 1)"""


def _signals(spark: SparkSession, sf: str, rate: int) -> DataFrame:
    return signals(spark, sf).select(F.col("content_id").alias("recording_id"), F.lit(rate).alias("sample_rate"), F.col("pcm"))


@query(f"""WITH {SIGNAL}, c AS (SELECT content_id, n, round_even((1.0::DOUBLE + content_id % 5 * 0.7::DOUBLE) * 640, 0) AS start FROM e)
SELECT c.content_id AS recording_id, count(*)::BIGINT AS samples, round(sum(x), 6) AS total FROM c JOIN s ON s.content_id = c.content_id AND i >= start AND i < start + 960 WHERE n - start >= 955 GROUP BY 1""")
def pcm_crops(spark: SparkSession, sf: str) -> DataFrame:
    """A second and a half of each signal, from a place of its own; crops that lack more than five samples go. They are written, checked for their length, and read back."""
    start = F.lit(1.0) + F.col("recording_id") % 5 * F.lit(0.7)
    own = _signals(spark, sf, 640).withColumn("crop", files.pcm_crop(F.col("pcm"), F.col("sample_rate"), start, F.lit(1.5)))
    found = files.save_crops(own.where("crop is not null").select("recording_id", "sample_rate", F.col("crop").alias("pcm")), folder(spark, "crops"), 1.5)
    return found.select("recording_id", F.size("pcm").cast("bigint").alias("samples"), r6(vectors.total(F.col("pcm")), "total"))


@query(f"""WITH {SIGNAL}, f AS (SELECT unnest(['unchanged', 'lead_half', 'lead_one', 'trim_one']) AS condition, unnest([0, 320, 640, 0]) AS quiet, unnest([0, 0, 0, 640]) AS gone, unnest([0.0, -0.5, -1.0, 1.0]::DOUBLE[]) AS moved)
SELECT e.content_id AS recording_id, condition, (n - gone)::BIGINT AS samples, round(coalesce(sum(x), 0), 4) AS total, 10 + moved * 2 AS expected_start FROM e JOIN f ON true LEFT JOIN s ON s.content_id = e.content_id AND i >= gone AND i < n - quiet GROUP BY e.content_id, condition, n, gone, moved""")
def boundary_variants(spark: SparkSession, sf: str) -> DataFrame:
    own = _signals(spark, sf, 640).withColumns({"pcm": F.col("pcm").cast("array<float>"), "expected_start": F.lit(10.0), "scale": F.lit(2.0)})
    found = files.boundary_variants(own)
    return found.select("recording_id", "condition", F.size("pcm").cast("bigint").alias("samples"), (F.round(vectors.total(F.col("pcm").cast("array<double>")), 4) + 0.0).alias("total"), "expected_start")


@query(f"""WITH {SIGNAL}, m AS (SELECT content_id, max(abs(x)) * 0.4::DOUBLE AS top FROM s GROUP BY 1), l AS (SELECT s.*, top, lag(x, 1, 0) OVER (PARTITION BY s.content_id ORDER BY i) AS before FROM s JOIN m ON m.content_id = s.content_id),
c AS (SELECT content_id, unnest(['clean', 'gain_up', 'gain_down', 'clip', 'preemphasis']) AS condition, unnest([x, x * pow(10, 0.3::DOUBLE), x * pow(10, -0.3::DOUBLE), greatest(-top, least(top, x)), CASE WHEN i = 0 THEN x ELSE x - 0.9::DOUBLE * before END]) AS x FROM l)
SELECT content_id AS recording_id, condition, round(sum(abs(x)), 3) AS size FROM c GROUP BY 1, 2""")
def perturbations(spark: SparkSession, sf: str) -> DataFrame:
    """The changes that draw no numbers."""
    own = _signals(spark, sf, 8000)
    found = files.perturbations(own, ["clean", "gain_up", "gain_down", "clip", "preemphasis"], "s")
    return found.select("recording_id", "condition", (F.round(vectors.total(F.transform(F.col("pcm").cast("array<double>"), F.abs)), 3) + 0.0).alias("size"))
