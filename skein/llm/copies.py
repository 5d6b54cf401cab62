"""Copies hidden by formatting: one canonical text per address, counted.

Method: byte-identical raw rows collapse first, with counts; only distinct
survivors are canonicalised; these are grouped again on the full canonical text
and their counts summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.shared import written

#: Rows of one spelling that one task should receive when groups go back to their members.
MEMBERS_PER_TASK = 200_000


def _bare(c: Column) -> Column:
    """Letters and digits only, without letter case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def _parts(c: Column, pattern: str) -> Column:
    """Non-empty bare parts of a text."""
    return F.filter(F.transform(F.split(c, pattern), _bare), lambda x: x != "")


def canonical_address(url: Column) -> Column:
    """Scheme, host, path segments, sorted parameters and fragment, each by its letters and digits.

    The text is percent-decoded first; a ``%`` without two hex digits stands
    for itself.  Empty segments, parameters and fragments count for nothing, an
    address without a scheme has an empty one.  Null stays null.
    """
    lenient = F.regexp_replace(F.regexp_replace(url, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    plain = F.when(F.instr(url, "%") > 0, F.coalesce(F.try_url_decode(lenient), url)).otherwise(url)
    part = lambda k: F.regexp_extract(F.regexp_replace(plain, r"(?U)^[\s​﻿]+", ""), r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$", k)
    params = F.filter(
        F.transform(F.split(part(4), "&"), lambda p: F.concat_ws("=", _bare(F.split_part(p, F.lit("="), F.lit(1))), _bare(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)))),
        lambda x: x != "=",
    )
    # The signs between parts can't occur within them.
    text = F.concat_ws(
        "\n",
        F.concat(_bare(part(1)), F.lit(":")),
        F.concat(F.lit("//"), _bare(part(2))),
        F.concat(F.lit("/"), F.concat_ws("/", _parts(part(3), "/"))),
        F.concat(F.lit("?"), F.concat_ws("&", F.array_sort(params))),
        F.concat(F.lit("#"), _bare(part(5))),
    )
    return F.when(url.isNotNull(), text)


def formatting_copies(rows: DataFrame, *, key: str = "node_id", text: str = "url") -> DataFrame:
    """Members of each group of two or more rows that agree up to formatting.

    Returns ``(group_node_id, node_id, n_copies)``: the group's smallest id, the
    member, and the number of different members.  A repeated row counts once; an
    id under several spellings of one text counts once.  Rows with a null id or
    text are no members.  Other columns are ignored.
    """
    pairs = rows.select(F.col(key).alias("id"), F.col(text).alias("raw")).where(F.col("id").isNotNull() & F.col("raw").isNotNull()).distinct()
    spelled = pairs.groupBy("raw").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"))
    canonical = written(spelled.withColumn("canon", canonical_address(F.col("raw"))), "canonical")
    groups = canonical.groupBy("canon").agg(F.sum("n").alias("copies"), F.min("least").alias("group_id")).where(F.col("copies") > 1)
    named = canonical.join(groups, "canon").select("raw", "n", "canon", "group_id", "copies")
    # A spelling with very many members is joined in as many salted parts.
    salted = named.select("raw", "canon", "group_id", "copies", F.explode(F.sequence(F.lit(0), F.least(F.lit(1023), F.floor(F.col("n") / MEMBERS_PER_TASK)).cast("int"))).alias("salt"), F.least(F.lit(1024), F.floor(F.col("n") / MEMBERS_PER_TASK) + 1).alias("salts"))
    hot = canonical.where(F.col("n") > MEMBERS_PER_TASK).select("raw", F.least(F.lit(1024), F.floor(F.col("n") / MEMBERS_PER_TASK) + 1).alias("salts"))
    spread = pairs.join(F.broadcast(hot), "raw", "left") if hot.limit(10_001).count() <= 10_000 else pairs.join(hot, "raw", "left")
    members = spread.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("salts")), F.lit(0)).cast("int")).drop("salts")
    found = members.join(salted.drop("salts"), ["raw", "salt"]).select("canon", "group_id", "id").distinct()
    # Copies are counted by id: an id with two spellings of one text is one copy.
    found = written(found, "members")
    twice = written(found.groupBy("canon", "group_id").agg(F.count(F.lit(1)).alias("n_copies")).where(F.col("n_copies") > 1), "groups")
    last = F.least(F.lit(1023), F.floor(F.col("n_copies") / MEMBERS_PER_TASK)).cast("int")
    large = twice.where(last > 0).select("canon", last.alias("last"))
    placed = found.join(F.broadcast(large) if large.limit(10_001).count() <= 10_000 else large, "canon", "left").withColumn("salt", F.pmod(F.xxhash64("id"), F.coalesce("last", F.lit(0)) + 1).cast("int")).drop("last")
    split = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), last)))
    return placed.join(split, ["canon", "group_id", "salt"]).select(F.col("group_id").alias("group_node_id"), F.col("id").alias(key), F.col("n_copies").cast("int").alias("n_copies"))
