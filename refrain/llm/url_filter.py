"""URL filters: a blocked Bloom filter of the listed keys, then an exact join that removes its false positives.

A rule names a host and the beginning of a path; it fits that host and all below it. The keys of a URL are its host
and all hosts above, each with all beginnings of the path of a length that some rule has. A key first meets the Bloom filter, one
block of 256 bits per key (see bloom). What passes is joined with the rules exactly.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import bloom
from refrain.llm.common import fresh, quoted, read, stored

#: Rules (host, path, verdict) of the query; fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
DEFAULT = "allow"
#: Rules up to which the lists and the filter (about 2 bytes a rule) are broadcast; more are joined by shuffles.
MOST_BROADCAST = 500_000


def host_of(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def above(host: Column) -> Column:
    """The host and all hosts above it; none for an empty host."""
    labels = F.split(host, r"\.", -1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))


def possible(keys: DataFrame, rules: DataFrame, n: int) -> DataFrame:
    """Those rows of keys (key, ...) whose key the filter of the n rules may hold."""
    blocks = bloom.blocks_for(n)
    return bloom.possible(keys, F.col("key"), bloom.filter_of(rules, F.col("key"), blocks), blocks, n <= MOST_BROADCAST)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """pages with host, path, rule and verdict of the url column.

    rules: host, path, verdict; one with a null is not read. Of rules for the same host and path, block wins. Of those that fit, the one with the
    longest host wins, then the one with the longest path. A null url, or one without ://, has an empty host and path and
    fits none: its rule is null and its verdict the default. Repeated rows and ids are judged row by row. Other columns
    stay; those named host, path, rule or verdict are replaced. A URL of any length is judged whole; a table without rows gives none.
    """
    known = rules.where("host is not null and path is not null and verdict is not null").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.select("host", "path", F.concat("host", F.lit("\x00"), "path").alias("key"), F.concat("host", "path").alias("listed"), F.col("verdict").alias("said"))
    known = known.select("key", "host", "path", F.length("host").alias("rule_host"), F.length("path").alias("rule_path"), "listed", "said")
    n = known.count()
    keep = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    own = pages.select(*quoted(keep)).withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    columns, won_as = quoted(own.columns), fresh(own, "won")
    if not n:
        return own.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    # as many lengths at most as paths have characters
    shape = known.agg(F.struct(F.sort_array(F.collect_set(F.length("path"))).alias("lengths"), F.max(F.size(F.split("host", r"\.", -1))).alias("labels")).alias("shape"))
    each = own.select("host", "path", shape.scalar().alias("shape")).where("host <> ''")
    each = each.select("host", "path", "shape", F.explode(above(F.col("host"))).alias("own")).where(F.size(F.split("own", r"\.", -1)) <= F.col("shape.labels"))
    each = each.select("host", "path", "own", F.explode("shape.lengths").alias("length")).where(F.length("path") >= F.col("length"))
    each = each.select("host", "path", F.concat("own", F.lit("\x00"), F.expr("substring(path, 1, length)")).alias("key"))
    maybe = possible(each, known, n)
    listed = known.drop("host", "path")
    exact = maybe.join(F.broadcast(listed) if n <= MOST_BROADCAST else listed, "key")
    choice = F.struct("rule_host", "rule_path", "listed", "said")
    won = stored(exact.groupBy("host", "path").agg(F.max(choice).alias(won_as)), "won")
    found = own.join(won.hint("merge"), ["host", "path"], "left")
    return found.select(*columns, F.col(f"{won_as}.listed").alias("rule"), F.coalesce(f"{won_as}.said", F.lit(default)).alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule and verdict of every page, a row each, as judge finds them by RULES.

    Null and empty URLs, and those without ://, are allowed with an empty host and path; repeated rows are judged each,
    other columns of pages are not looked at, and a table without rows gives none.
    """
    rules = spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, RULES))} AS rules(host, path, verdict)")
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH parts AS (
  SELECT page_id,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), cut AS (
  SELECT page_id, regexp_extract(coalesce(rest, ''), '^[^/?#]*') AS raw_host, coalesce(rest, '') AS rest FROM parts
), named AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM cut
), rules(host, path, said) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')
)
SELECT n.page_id, n.host, n.path,
       (SELECT r.host || r.path FROM rules r
        WHERE (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
        ORDER BY length(r.host) DESC, length(r.path) DESC LIMIT 1) AS rule,
       coalesce((SELECT r.said FROM rules r
        WHERE (n.host = r.host OR ends_with(n.host, '.' || r.host)) AND starts_with(n.path, r.path)
        ORDER BY length(r.host) DESC, length(r.path) DESC LIMIT 1), 'allow') AS verdict
FROM named n
"""
