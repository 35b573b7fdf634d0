import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
ODD = [
    (1, "A plain text about nothing much, with words enough to count and an end. " * 5), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, "x" * 50_000), (6, LONG),
    (7, "one two"), (8, "one two"), (8, "one two"), (9, "é😀 ünï çödé \x85   　   end"), (None, "no id here"), (None, None), (10, "\x00\x1c\x7f <|endoftext|> </s>"), (11, "don't 'tis they'll I'M it''s"),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null texts and ids, empty, blank and very long texts, repeated rows, odd characters."""
    return frame(spark, ODD).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="session")
def clashing(odd):
    """Extra columns with the names that operators use inside."""
    out = odd
    for name in ("quality", "score", "base", "spans", "terms", "won", "raw", "Kept", "bucket", "block", "ids", "fingerprint", "id", "cluster", "a.b"):
        out = out.withColumn(name, out["doc_id"].cast("string"))
    return out
