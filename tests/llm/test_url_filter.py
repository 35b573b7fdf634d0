import random
import re

import pytest
from pyspark.sql import functions as F

from refrain.llm import url_filter as u

URLS = [
    "http://example.com/en/", "https://WWW.Example.COM/en/x?y#z", "http://a.net/es/1", "net", "http://net/es/", "http://com", "http://com/", "x://y://z.com/en/", "://a.example.com/en/#", "", None,
    "http://example.com.evil.org/en/", "http://notexample.com/en/", "http://sub.example.com/EN/", "http://example.com:80/en/", "http:///en/", "http://a..com/", "http://example.com/en", "ftp://ÄB.com/é", "http://.net/fr/", "a\nb://c.com/\nd",
]


def brute(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if not fits:
        return host, path, None, default
    best = max(fits)
    return host, path, best[2], best[3]


def frame(spark, urls):
    return spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")


def listed(spark, rules):
    return spark.createDataFrame(rules, "host string, path string, verdict string")


@pytest.mark.parametrize("most", [500_000, 0])  # broadcast, and joined by shuffles
def test_verdicts_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(u, "MOST_BROADCAST", most)
    r = random.Random(1)
    name = lambda: ".".join(r.choice(["a", "b", "com", "net", "x"]) for _ in range(r.randrange(1, 4)))
    rules = list({(h, p): (h, p, r.choice(["allow", "block"])) for h, p in ((name(), r.choice(["/", "/en/", "", "/e", "/en/q"])) for _ in range(60))}.values())
    urls = URLS + [f"{r.choice(['http', 'https'])}://{name()}{r.choice(['', '/', '/en/', '/en/q/r', '/e?x', '#f'])}" for _ in range(400)]
    for own in (rules, u.RULES, []):
        for x in u.judge(frame(spark, urls).repartition(3), listed(spark, own)).collect():
            assert (x.host, x.path, x.rule, x.verdict) == brute(urls[x.page_id], own)


def test_the_filter_passes_every_key_and_few_others(spark):
    rules = spark.range(3000).select(F.concat(F.lit("k"), "id").alias("key"))
    asked = spark.range(30_000).select(F.concat(F.lit("k"), "id").alias("key"))
    passed = {r.key for r in u.possible(asked, rules, 3000).collect()}
    assert {f"k{i}" for i in range(3000)} <= passed and len(passed) < 3000 + 27_000 * 0.02


def test_nulls_repeats_and_other_columns(spark):
    rules = listed(spark, [*u.RULES, ("com", "/", "block"), (None, "/", "block"), ("com", None, "block")])
    pages = frame(spark, URLS + URLS).withColumns({"won": F.lit(1), "HOST": F.lit("x"), "rule": F.lit(2), "a.b": F.lit(3)})
    found = u.judge(pages, rules)
    assert found.count() == 2 * len(URLS) and "won" in found.columns and "a.b" in found.columns
    assert {r.verdict for r in found.where("url = 'http://com/'").collect()} == {"block"}
    assert u.judge(frame(spark, []), rules).collect() == []


def test_the_plan_reads_the_filter_once(spark):
    plan = u.judge(frame(spark, URLS), listed(spark, u.RULES))._jdf.queryExecution().toString()
    assert plan.count("Subquery subquery") <= 1  # the lengths of the rules; the result reads a stored table
    keys = spark.range(10).select(F.concat(F.lit("k"), "id").alias("key"))
    assert "scalar-subquery" not in u.possible(keys, keys, 10)._jdf.queryExecution().toString()
