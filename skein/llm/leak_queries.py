"""Queries on evaluation items inside documents (8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.leaks import leaked_items
from skein.shared import table


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return p8_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"))


def p8_edited(spark: SparkSession, d: str) -> DataFrame:
    """Whole items, as they are or edited: at least 0.8 of their weighted shingles."""
    return leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), size=None, radius=10, similarity=0.8)


_FOUND = r"""
q AS (SELECT DISTINCT item_id, regexp_extract_all(lower(question), '[\p{L}\p{N}]+') AS w FROM eval_items),
qw AS (SELECT DISTINCT item_id, array_to_string(w[i:i+12], ' ') AS p FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM q WHERE len(w) >= 13)),
t AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
tw AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+12], ' ') AS p FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t WHERE len(w) >= 13)),
found AS (SELECT DISTINCT doc_id, item_id FROM tw JOIN qw USING (p))
"""

QUERIES = {"p8_found": p8_found, "p8_report": p8_report, "p8_edited": p8_edited}
SQL = {
    "p8_found": f"WITH {_FOUND} SELECT doc_id, item_id FROM found",
    "p8_report": f"WITH {_FOUND} SELECT item_id, count(*) AS n_docs FROM found GROUP BY item_id",
}
