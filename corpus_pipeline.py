"""The corpus pipeline: documents, judged, deduplicated, sanitised and packed.

Each stage takes what the one before has kept, from Parquet in the shared folder. All but the last return the columns of
documents; the last returns the places of all pieces in the packed sequences.

Null and empty texts have no words and are rejected by the quality rules at the latest; rows that share a doc_id are one document for near
duplicates, of which one row stays; a null doc_id is never a duplicate; of a group the least doc_id stays. Texts are read
whole. Columns beside those of documents are kept up to the last stage, whatever their names, and change nothing. A table without rows
gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from refrain.llm import near_dedup, packing, pii, quality_classifier, quality_rules
from refrain.llm.common import read, stored

STAGES = [
    ("quality_classifier", quality_classifier.stage),
    ("quality_rules", quality_rules.stage),
    ("near_dedup", near_dedup.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

#: A trained model and suffix arrays decide on the rows, which SQL can't express; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
