"""What a node knows of its page, its scan state, and the memory that a graph would take."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bytes of a node and of an edge in memory, and what their containers add.
NODE_BYTES, EDGE_BYTES, OVERHEAD = 1000, 500, 1.2


def meta_value(metadata: Column, key: str, default: Column | None = None) -> Column:
    """Value of a metadata key; the default (or null) where the map or the key is missing."""
    value = F.try_element_at(metadata, F.lit(key))
    return value if default is None else F.when(F.coalesce(F.map_contains_key(metadata, F.lit(key)), F.lit(False)), value).otherwise(default)


def title(metadata: Column) -> Column:
    return meta_value(metadata, "title")


def description(metadata: Column) -> Column:
    return meta_value(metadata, "description")


def h1(metadata: Column) -> Column:
    return meta_value(metadata, "h1")


def keywords(metadata: Column) -> Column:
    return meta_value(metadata, "keywords")


def canonical_url(metadata: Column) -> Column:
    return meta_value(metadata, "canonical_url")


def language(metadata: Column) -> Column:
    return meta_value(metadata, "language")


def mark_scanned(nodes: DataFrame, scans: DataFrame) -> DataFrame:
    """Nodes with the state of ``scans(node_id, response_status, content_hash)``: scanned, in the html stage.

    Of several scans of a node the one with the largest status and hash counts;
    nodes without a scan stay as they are.
    """
    last = scans.where(F.col("node_id").isNotNull()).groupBy("node_id").agg(F.max(F.struct("response_status", "content_hash")).alias("_scan"))
    hit = F.col("_scan").isNotNull()
    new = {"scanned": F.lit(True), "lifecycle_stage": F.lit("html_stage"), "response_status": F.coalesce("_scan.response_status", "response_status"), "content_hash": F.coalesce("_scan.content_hash", "content_hash")}
    return nodes.join(last, "node_id", "left").withColumns({c: F.when(hit, x).otherwise(F.col(c)) for c, x in new.items()}).select(*nodes.columns)


def estimated_memory_mb(n_nodes: int, n_edges: int, metadata_bytes: int = 500) -> float:
    """Megabytes that nodes and edges take as objects of one process."""
    return (n_nodes * (NODE_BYTES + metadata_bytes) + n_edges * EDGE_BYTES) * OVERHEAD / 2**20
