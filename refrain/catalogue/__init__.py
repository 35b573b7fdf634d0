"""The queries over the reference's operators on the driver's tables, and their SQL for DuckDB.

embeddings stand for fingerprints: the label is the content, the row number by vec_id in a label the frame; odd frames are
queries, even ones references.
"""

from __future__ import annotations

from refrain.catalogue import evaluation, features, matching, protocols, sources

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for part in (features, matching, protocols, evaluation, sources):
    QUERIES |= part.QUERIES
    ORACLE_SQL |= part.ORACLE_SQL
