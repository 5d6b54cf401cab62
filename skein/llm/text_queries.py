"""Queries on mixtures (9) and abusive content (10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.abuse import scored_documents
from skein.llm.mixing import mixture_report, mixture_schedule, source_name, token_counts
from skein.shared import table, written


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return mixture_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_schedule(spark: SparkSession, d: str) -> DataFrame:
    return mixture_schedule(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_reachable(spark: SparkSession, d: str) -> DataFrame:
    """The report of a mixture measured in words: what each source can reach, and whether the schedule came within a document of it."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sizes = token_counts(docs, words=True).groupBy("source_name").agg(F.max("n_tokens").alias("largest"))
    report = mixture_report(docs, targets, words=True).join(targets.select("source_name", "max_repeats"), "source_name").join(sizes, "source_name", "left")
    reach = F.least("tokens_wanted", F.col("tokens_available") * F.col("max_repeats"))
    return report.select(
        "source_name", "docs_available", F.col("tokens_available").alias("words_available"), F.col("tokens_wanted").alias("words_wanted"), reach.alias("words_reachable"),
        (F.abs(F.col("tokens_used") - reach) <= F.coalesce("largest", F.lit(0)) + 1).alias("reached"), (F.col("repeats") <= F.col("max_repeats")).alias("within_repeats"),
    )


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return scored_documents(table(spark, d, "documents"), table(spark, d, "review_labels"), keep=("source",))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).where("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", "score", "flagged").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = written(_scored(spark, d), "scores").select("doc_id", "flagged", source_name(F.col("source")).alias("source_name")).distinct()
    return rows.groupBy("source_name").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("flagged").alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"))


QUERIES = {"p9_report": p9_report, "p9_schedule": p9_schedule, "p9_reachable": p9_reachable, "p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL = {
    "p9_reachable": r"""
WITH w AS (SELECT doc_id, min(struct_pack(s := nullif(replace(lower(trim(source, ' ' || chr(9) || chr(10) || chr(13))), '-', '_'), ''), n := len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+')))) AS m FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
h AS (SELECT m.s AS source_name, count(*) AS docs, sum(m.n) AS words FROM w GROUP BY ALL),
t AS (SELECT m.*, coalesce(h.words, 0) AS words, CASE WHEN coalesce(h.words, 0) > 0 THEN h.docs ELSE 0 END AS docs, round(m.target_share * m.size_factor * (SELECT sum(words) FROM h)) AS wanted FROM mix_targets m LEFT JOIN h USING (source_name))
SELECT source_name, CAST(docs AS BIGINT) AS docs_available, CAST(words AS BIGINT) AS words_available, CAST(wanted AS BIGINT) AS words_wanted, CAST(least(wanted, words * max_repeats) AS BIGINT) AS words_reachable, true AS reached, true AS within_repeats FROM t
"""
}
