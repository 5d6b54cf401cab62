"""What changed between consecutive full deliveries of a table.

Method: EXCEPT ALL in both directions removes the rows that two deliveries
share; a full join of what is left, by key, labels additions, removals and
changes.  Both directions are evaluated in one pass: every valid row of a
delivery counts +1 for its own delivery and -1 for the one after it, and the
signed sum per (delivery, key, value) is exactly ``new EXCEPT ALL old`` where
positive and ``old EXCEPT ALL new`` where negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Deliveries whose numbers may be listed on the driver (one integer each).
MAX_LISTED = 10_000


def _packed(value: Column) -> Column:
    """Value in lower case as bytes; a sha256 in hex takes 32 of them instead of 64."""
    low = F.lower(value)
    return F.when(low.rlike("^[0-9a-f]{64}$"), F.unhex(low)).otherwise(low.cast("binary"))


def snapshot_changes(
    rows: DataFrame,
    *,
    snapshot: str = "snapshot_no",
    key: str = "url",
    value: str = "content_hash",
    version: str = "created_at",
) -> DataFrame:
    """Added, removed and changed keys of each delivery against the one before.

    Returns ``(snapshot, key, change_kind)`` under the given column names.
    Within a delivery the row with the latest ``version`` is valid for a key;
    a null version is older than any other, and of rows with equal version the
    greatest value wins (null is smallest), so ties give one defined row.
    Values compare without letter case; null against a value is a change, null
    against null is none.  Rows with a null snapshot or key are no records.
    Keys compare exactly, the empty key included.  Other columns of ``rows``
    are ignored whatever their names; an empty table gives no rows.
    """
    valid = (
        rows.select(F.col(snapshot).alias("s"), F.col(key).alias("k"), F.col(version).alias("v"), _packed(F.col(value)).alias("h"))
        .where(F.col("s").isNotNull() & F.col("k").isNotNull())
        .groupBy("s", "k")
        .agg(F.max(F.struct("v", "h"))["h"].alias("h"))
    )
    numbers = rows.select(F.col(snapshot).alias("s")).where(F.col("s").isNotNull()).distinct()
    listed = sorted(r[0] for r in numbers.limit(MAX_LISTED + 1).collect())
    if len(listed) <= MAX_LISTED:
        follows = {a: b for a, b in zip(listed, listed[1:])}
        pairs = [F.lit(x).cast(rows.schema[snapshot].dataType) for ab in follows.items() for x in ab]
        after = F.try_element_at(F.create_map(*pairs), F.col("s")) if pairs else F.lit(None).cast(rows.schema[snapshot].dataType)
        first = listed[0] if listed else None
        chained = valid.withColumn("next", after).withColumn("first", F.col("s") == F.lit(first))
    else:  # so many deliveries that their numbers are a table of their own
        from pyspark.sql import Window

        order = numbers.withColumn("next", F.lead("s").over(Window.orderBy("s"))).withColumn("first", F.lag("s").over(Window.orderBy("s")).isNull())
        chained = valid.join(order, "s")
    # A key now has at most one row per delivery, so that no key is hot any more.
    signed = (
        chained.repartition("k")
        .select("k", "h", F.explode(F.array(F.struct(F.when(~F.col("first"), F.col("s")).alias("s"), F.lit(1).alias("d")), F.struct(F.col("next").alias("s"), F.lit(-1).alias("d")))).alias("x"))
        .select("k", "h", "x.s", "x.d")
        .where(F.col("s").isNotNull())
    )
    residue = signed.groupBy("k", "s", "h").agg(F.sum("d").alias("n")).where(F.col("n") != 0)
    # Full join of both residues by key: partitioned by k already, so that it needs no exchange.
    kinds = residue.groupBy("k", "s").agg(F.max(F.col("n") > 0).alias("new"), F.max(F.col("n") < 0).alias("old"))
    return kinds.select(
        F.col("s").alias(snapshot),
        F.col("k").alias(key),
        F.when(F.col("new") & F.col("old"), "changed").when(F.col("new"), "added").otherwise("removed").alias("change_kind"),
    )
