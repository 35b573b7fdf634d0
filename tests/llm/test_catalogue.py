"""The queries as the catalogue lists them: against their SQL, and on tables of no rows, nulls, ties, long texts and clashing names."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from refrain.llm.catalogue import ORACLE_SQL, QUERIES

from .conftest import LONG, ODD, frame

ON_DOCUMENTS = ["op2_byte_bpe", "op3_near_dedup", "op4_quality_classifier", "op7_lz_fingerprint", "op8_packing", "op9_pii", "op10_quality_rules"]
CLASHING = ["text_", "key", "id", "n", "block", "bucket", "hash", "row", "piece", "deal", "score", "quality", "base", "spans", "found", "cluster", "maybe", "first", "sha1", "raw", "a.b", "`x"]


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    found = QUERIES[name](spark, sf)
    names = sorted(found.columns)
    cursor = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == names
    assert sorted(tuple(str(r[c]) for c in names) for r in found.collect()) == sorted(tuple(str(r[columns.index(c)]) for c in names) for r in cursor.fetchall())


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Folders with the tables of the queries: odd rows, the same with more columns, and none."""
    docs = frame(spark, [*ODD, (12, LONG + " " + LONG[::-1]), (13, "tie"), (14, "tie")]).repartition(3)
    pages = spark.createDataFrame([(1, "http://a.net/es/", "<p>"), (2, None, None), (2, None, None), (3, "x", ""), (None, "http://net/es/", "<p>"), (4, "http://b.com/" + "q" * 100_000, LONG)], "page_id bigint, url string, html string")
    talks = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", LONG), (1, 1, "assistant", LONG), (2, None, None, None), (None, 3, "assistant", "[INST]"), (3, 0, "assistant", "")], "conv_id bigint, turn int, role string, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(14)] + [(1, None, None), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    every = {"documents": docs, "pages": pages, "conversations": talks, "labels": labels}
    out = {}
    for kind in ("odd", "more", "none"):
        out[kind] = str(tmp_path_factory.mktemp(kind))
        for name, df in every.items():
            if kind == "more":
                df = df.select("*", *(F.lit("7").alias(c) for c in CLASHING if c not in df.columns))
            (df.limit(0) if kind == "none" else df).write.parquet(f"{out[kind]}/{name}.parquet")
    return out


def rows(df):
    return sorted(str(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, tables, name):
    run = QUERIES[name]
    odd = run(spark, tables["odd"])
    if name == "op8_packing":  # which sequence a piece is in depends on the columns beside it
        pick = lambda df: df.select("doc_id", "piece", "start", "length", "ids_crc32")
    else:
        pick = lambda df: df
    got = rows(pick(odd))
    assert got == rows(pick(run(spark, tables["more"]))) and (name not in ON_DOCUMENTS or odd.select("doc_id").count() >= len(ODD) + 3)
    none = run(spark, tables["none"])
    assert none.schema.simpleString() == odd.schema.simpleString() and none.count() == (name == "op5_chat_format")
    if name in ON_DOCUMENTS and name not in ("op8_packing", "op7_lz_fingerprint"):  # equal texts have equal results
        alike = {tuple(v for c, v in r.asDict().items() if c not in ("doc_id", "component_id", "kept", "held_out")) for r in odd.where("doc_id in (13, 14)").collect()}
        assert len(alike) == 1


def test_the_pipeline_on_odd_tables(spark, tables):
    import corpus_pipeline

    odd = corpus_pipeline.run(spark, tables["odd"])
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert rows(odd.select(key)) == rows(corpus_pipeline.run(spark, tables["more"]).select(key))
    assert corpus_pipeline.run(spark, tables["none"]).collect() == []
