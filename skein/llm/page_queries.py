"""Queries on fetched pages: main bodies (2), residue (4), alike pages (7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skein.llm.pagejobs import alike_page_classes, alike_pages, body_blocks, residue_pages
from skein.shared import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return body_blocks(table(spark, d, "responses"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue_pages(table(spark, d, "responses"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return alike_pages(table(spark, d, "responses"))


def p7_classes(spark: SparkSession, d: str) -> DataFrame:
    return alike_page_classes(table(spark, d, "responses"))


QUERIES = {"p2_found": p2_found, "p4_found": p4_found, "p7_found": p7_found, "p7_classes": p7_classes}
SQL: dict[str, str] = {}
