"""What a new crawl changed against an earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crawl_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``(url, status, process_links)`` for every url of the new crawl.

    Comparable nodes are scanned in both crawls and hashed in both; a comparable
    node without change need not have its links processed again.
    """
    before = old.select("url", F.col("scanned").alias("was"), F.col("content_hash").alias("old_hash"), F.lit(1).alias("known"))
    both = new.select("url", "scanned", "content_hash").join(before, "url", "left")
    comparable = F.coalesce(F.col("scanned") & F.col("was"), F.lit(False)) & F.col("content_hash").isNotNull() & F.col("old_hash").isNotNull()
    status = F.when(F.col("known").isNull(), "new").when(~comparable, "uncomparable").when(F.col("content_hash") != F.col("old_hash"), "changed").otherwise("unchanged")
    return both.select("url", status.alias("status"), (status != "unchanged").alias("process_links"))


def metadata_changed(a: Column, b: Column) -> Column:
    """Whether a key that both maps have differs; null if they have none in common."""
    common = F.array_intersect(F.map_keys(a), F.map_keys(b))
    return F.when(F.size(common) > 0, F.exists(common, lambda k: ~F.element_at(a, k).eqNullSafe(F.element_at(b, k))))
