"""A web graph as a pair of DataFrames, and its algebra.

Nodes are identified by their url: two graphs agree on a node if they have the
url.  Edges name node ids; across graphs they are carried over id -> url -> id.
A graph is immutable and lazy; Catalyst plans what an expression of several
operators needs.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.schema import EDGES, NODES
from skein.shared import salted_join

STRATEGIES = {
    "first": "the left graph's node",
    "last": "the right graph's node",
    "merge": "the left node with the right one's values where it has any",
    "newest": "the node created last, the left one if equal",
    "oldest": "the node created first, the left one if equal",
    "custom": "what the given function makes of both",
}
_strategy: ContextVar[tuple[str, ...]] = ContextVar("merge_strategy", default=())


@contextmanager
def merge_strategy(name: str):
    """Strategy of unions within the block."""
    _check(name)
    token = _strategy.set((*_strategy.get(), name))
    try:
        yield
    finally:
        _strategy.reset(token)


def _check(name: str) -> str:
    if name not in STRATEGIES:
        raise ValueError(f"unknown merge strategy {name!r}; one of {', '.join(STRATEGIES)}")
    return name


def _merged_map(a: Column, b: Column) -> Column:
    """Both maps, the second's values where both have a key; null if both are null."""
    both = F.map_from_entries(F.concat(F.filter(F.map_entries(F.coalesce(a, F.create_map().cast("map<string,string>"))), lambda e: ~F.coalesce(F.map_contains_key(b, e["key"]), F.lit(False))), F.map_entries(F.coalesce(b, F.create_map().cast("map<string,string>")))))
    return F.when(a.isNull() & b.isNull(), F.lit(None)).otherwise(both)


def merged_node(strategy: str, left: Callable[[str], Column], right: Callable[[str], Column], columns: list[str], custom: Callable | None = None) -> dict[str, Column]:
    """Column of the merged node for each name; both sides are present."""
    _check(strategy)
    if strategy == "custom":
        if custom is None:
            raise ValueError("the custom strategy needs a function")
        return custom(left, right, columns)
    if strategy in ("first", "last"):
        return {c: (left if strategy == "first" else right)(c) for c in columns}
    if strategy in ("newest", "oldest"):
        a, b = left("created_at"), right("created_at")
        take = F.coalesce(b > a if strategy == "newest" else b < a, F.lit(False))
        return {c: F.when(take, right(c)).otherwise(left(c)) for c in columns}
    special = {
        "metadata": lambda c: _merged_map(left(c), right(c)),
        "user_data": lambda c: _merged_map(left(c), right(c)),
        "scanned": lambda c: F.coalesce(left(c), F.lit(False)) | F.coalesce(right(c), F.lit(False)),
        "response_status": lambda c: F.coalesce(right(c), left(c)),
        "content_hash": lambda c: F.coalesce(right(c), left(c)),
        "created_at": lambda c: F.least(left(c), right(c)),
        "depth": lambda c: F.least(left(c), right(c)),
        "lifecycle_stage": lambda c: F.when(right(c) == "html_stage", right(c)).otherwise(left(c)),
    }
    return {c: special[c](c) if c in special else left(c) for c in columns}


@dataclass(frozen=True, eq=False)
class WebGraph:
    """Nodes and edges; other columns than the schema's are passed through."""

    nodes: DataFrame
    edges: DataFrame
    default_strategy: str = "last"

    def __post_init__(self) -> None:
        _check(self.default_strategy)

    def with_strategy(self, name: str) -> WebGraph:
        """The same graph with another default strategy of unions."""
        return replace(self, default_strategy=name)

    @classmethod
    def from_json_rows(cls, rows: DataFrame) -> WebGraph:
        """Graph from the texts of :meth:`to_json_rows`."""
        read = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("row", schema).alias("r")).select("r.*")
        return cls(read("node", NODES), read("edge", EDGES))

    @classmethod
    def empty(cls, spark) -> WebGraph:
        return cls(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES))

    # --- access -----------------------------------------------------------------------------------
    def node_by_url(self, url: str) -> DataFrame:
        return self.nodes.where(F.col("url") == url)

    def node_by_id(self, node_id: str) -> DataFrame:
        return self.nodes.where(F.col("node_id") == node_id)

    def has_edge(self, source: str, target: str) -> bool:
        return not self.edges.where((F.col("source_node_id") == source) & (F.col("target_node_id") == target)).isEmpty()

    def unscanned(self) -> DataFrame:
        return self.nodes.where(~F.coalesce("scanned", F.lit(False)))

    def at_depth(self, depth: int) -> DataFrame:
        return self.nodes.where(F.col("depth") == depth)

    def __len__(self) -> int:
        return self.nodes.count()

    def __contains__(self, url: str) -> bool:
        return not self.node_by_url(url).isEmpty()

    def __iter__(self):
        """Rows of the nodes, partition by partition."""
        return self.nodes.toLocalIterator()

    def __getitem__(self, key: str | int):
        """The node of a url, or at a place in the order of creation and id; KeyError or IndexError if there is none."""
        if isinstance(key, int):
            row = self.nodes.orderBy("created_at", "node_id").offset(key).limit(1).head(1) if key >= 0 else []
            if not row:
                raise IndexError(key)
            return row[0]
        row = self.node_by_url(key).head(1)
        if not row:
            raise KeyError(key)
        return row[0]

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """``pairs(source_node_id, target_node_id)`` with ``linked``: whether the graph has such an edge."""
        known = self.edges.select("source_node_id", "target_node_id").distinct().withColumn("linked", F.lit(True))
        return pairs.join(known, ["source_node_id", "target_node_id"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))

    # --- change -----------------------------------------------------------------------------------
    def add_nodes(self, new: DataFrame, overwrite: bool = False) -> WebGraph:
        """New urls are added; of known ones the old node stays, or its values are replaced under the old id."""
        old = self.nodes.withColumn("side", F.lit(0))
        both = old.unionByName(new.withColumn("side", F.lit(1)), allowMissingColumns=True)
        w = Window.partitionBy("url")
        kept = both.withColumn("old_id", F.first(F.when(F.col("side") == 0, F.col("node_id")), ignorenulls=True).over(w)).withColumn("rn", F.row_number().over(w.orderBy(F.desc("side") if overwrite else F.asc("side"), "node_id")))
        return replace(self, nodes=kept.where("rn = 1").withColumn("node_id", F.coalesce("old_id", "node_id")).drop("side", "rn", "old_id"))

    def add_edges(self, new: DataFrame) -> WebGraph:
        return replace(self, edges=self.edges.unionByName(new, allowMissingColumns=True))

    def remove_nodes(self, ids: DataFrame) -> WebGraph:
        """Without the nodes of ``ids`` (column node_id) and all edges that touch them."""
        ids = ids.select("node_id").distinct()
        edges = self.edges
        for end in ("source_node_id", "target_node_id"):
            edges = salted_join(edges, ids.select(F.col("node_id").alias(end)), end, "left_anti", counted=self.edges).select(*self.edges.columns)
        return replace(self, nodes=self.nodes.join(ids, "node_id", "left_anti"), edges=edges)

    def handle_redirects(self, redirects: DataFrame) -> WebGraph:
        """``redirects(node_id, final_url, redirect_chain array<string>)`` applied at once.

        Same url: nothing.  A node with the final url exists: incoming edges go
        there and are marked, the redirected node and its outgoing edges go.
        Otherwise the node takes the final url and notes where it came from.
        """
        r = redirects.join(self.nodes.select("node_id", F.col("url").alias("old_url")), "node_id").where(F.col("old_url") != F.col("final_url"))
        r = r.join(self.nodes.select(F.col("url").alias("final_url"), F.col("node_id").alias("final_id")), "final_url", "left")
        chain = F.to_json(F.coalesce("redirect_chain", F.array().cast("array<string>")))
        moved = r.select(F.col("node_id").alias("target_node_id"), "final_id", "old_url", "final_url", chain.alias("chain"))
        marked = F.map_from_arrays(F.array(*map(F.lit, ("was_redirect", "original_url", "final_url", "redirect_chain"))), F.array(F.lit("true"), F.col("old_url"), F.col("final_url"), F.col("chain")))
        edges = (
            self.edges.join(moved, "target_node_id", "left")
            .withColumn("metadata", F.when(F.col("final_url").isNotNull(), _merged_map(F.col("metadata"), marked)).otherwise(F.col("metadata")))
            .withColumn("target_node_id", F.coalesce("final_id", "target_node_id"))
            .select(*self.edges.columns)
        )
        gone = r.where(F.col("final_id").isNotNull()).select(F.col("node_id").alias("source_node_id"))
        edges = edges.join(gone, "source_node_id", "left_anti").select(*self.edges.columns)
        renamed = r.where(F.col("final_id").isNull()).select("node_id", F.col("final_url").alias("new_url"), "old_url", chain.alias("chain"))
        note = F.map_from_arrays(F.array(F.lit("was_redirected_from"), F.lit("redirect_chain")), F.array(F.col("old_url"), F.col("chain")))
        nodes = (
            self.nodes.join(gone.select(F.col("source_node_id").alias("node_id")), "node_id", "left_anti")
            .join(renamed, "node_id", "left")
            .withColumn("metadata", F.when(F.col("new_url").isNotNull(), _merged_map(F.col("metadata"), note)).otherwise(F.col("metadata")))
            .withColumn("url", F.coalesce("new_url", "url"))
            .select(*self.nodes.columns)
        )
        return replace(self, nodes=nodes, edges=edges)

    def filter(self, condition: Column, keep_edges: bool = True) -> WebGraph:
        """Induced subgraph, or the nodes alone."""
        nodes = self.nodes.where(condition)
        return replace(self, nodes=nodes, edges=_induced(self.edges, nodes) if keep_edges else self.edges.limit(0))

    # --- algebra ----------------------------------------------------------------------------------
    def union(self, other: WebGraph, strategy: str | None = None, custom: Callable | None = None) -> WebGraph:
        """All urls; conflicts merged by the strategy; edges of both, each pair once, left ones first.

        Edges with an end that is in neither graph are dropped.  Edge ids and
        metadata are those of the first edge of a pair: left before right, then
        by creation and id.
        """
        name = _check(strategy or (_strategy.get() or (self.default_strategy,))[-1])
        columns = [c for c in self.nodes.columns if c != "url"]
        columns += [c for c in other.nodes.columns if c not in columns and c != "url"]
        pack = lambda g: g.nodes.select("url", F.struct(*[(F.col(c) if c in g.nodes.columns else F.lit(None)).alias(c) for c in columns]).alias("n"))
        both = pack(self).withColumnRenamed("n", "l").join(pack(other).withColumnRenamed("n", "r"), "url", "full_outer")
        merged = merged_node(name, lambda c: F.col(f"l.{c}"), lambda c: F.col(f"r.{c}"), columns, custom)
        nodes = both.select("url", *[F.when(F.col("r").isNull(), F.col(f"l.{c}")).when(F.col("l").isNull(), F.col(f"r.{c}")).otherwise(merged[c]).alias(c) for c in columns]).select(*[c for c in self.nodes.columns], *[c for c in columns if c not in self.nodes.columns])
        ids = nodes.select("url", F.col("node_id").alias("new_id"))
        edges = self._carried(ids).withColumn("side", F.lit(0)).unionByName(other._carried(ids).withColumn("side", F.lit(1)), allowMissingColumns=True)
        w = Window.partitionBy("source_node_id", "target_node_id").orderBy("side", "created_at", "edge_id")
        return replace(self, nodes=nodes, edges=edges.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("side", "rn"))

    def _carried(self, ids: DataFrame) -> DataFrame:
        """Edges with both ends renamed to the ids of the same urls."""
        edges = self.edges
        for end in ("source_node_id", "target_node_id"):
            names = self.nodes.select(F.col("node_id").alias(end), "url").join(ids, "url").select(end, "new_id")
            edges = edges.join(names, end).withColumn(end, F.col("new_id")).drop("new_id")
        return edges.select(*self.edges.columns)

    def difference(self, other: WebGraph) -> WebGraph:
        """Nodes whose url the other lacks, and the edges between them (parallel ones kept)."""
        nodes = self.nodes.join(other.nodes.select("url").distinct(), "url", "left_anti").select(*self.nodes.columns)
        return replace(self, nodes=nodes, edges=_induced(self.edges, nodes))

    def intersection(self, other: WebGraph) -> WebGraph:
        """Common urls with this graph's nodes; its edges between them, and the other's for pairs that it lacks."""
        nodes = self.nodes.join(other.nodes.select("url").distinct(), "url", "left_semi").select(*self.nodes.columns)
        own = _induced(self.edges, nodes)
        pair = ["source_node_id", "target_node_id"]
        theirs = other._carried(nodes.select("url", F.col("node_id").alias("new_id"))).join(own.select(*pair).distinct(), pair, "left_anti")
        first = theirs.withColumn("rn", F.row_number().over(Window.partitionBy(*pair).orderBy("created_at", "edge_id"))).where("rn = 1").drop("rn").select(*other.edges.columns)
        return replace(self, nodes=nodes, edges=own.unionByName(first, allowMissingColumns=True))

    def symmetric_difference(self, other: WebGraph) -> WebGraph:
        return self.difference(other).union(other.difference(self), "last")

    __add__ = union
    __or__ = union
    __sub__ = difference
    __and__ = intersection
    __xor__ = symmetric_difference

    # --- comparison: of url sets only ----------------------------------------------------------------
    def _misses(self, other: WebGraph) -> bool:
        return self.nodes.select("url").join(other.nodes.select("url").distinct(), "url", "left_anti").isEmpty()

    def same_urls(self, other: WebGraph) -> bool:
        return self._misses(other) and other._misses(self)

    def is_subgraph(self, other: WebGraph, strict: bool = False) -> bool:
        return self._misses(other) and not (strict and other._misses(self))

    def is_supergraph(self, other: WebGraph, strict: bool = False) -> bool:
        return other.is_subgraph(self, strict)

    def __eq__(self, other: object) -> bool:
        return self.same_urls(other) if isinstance(other, WebGraph) else NotImplemented

    __hash__ = object.__hash__

    def __le__(self, other: WebGraph) -> bool:
        return self.is_subgraph(other)

    def __lt__(self, other: WebGraph) -> bool:
        return self.is_subgraph(other, strict=True)

    def __ge__(self, other: WebGraph) -> bool:
        return other.is_subgraph(self)

    def __gt__(self, other: WebGraph) -> bool:
        return other.is_subgraph(self, strict=True)

    def compare(self, newer: WebGraph) -> DataFrame:
        """One row: urls new, removed and common, and their Jaccard similarity (1 for two empty graphs)."""
        both = self.nodes.select("url").distinct().withColumn("o", F.lit(1)).join(newer.nodes.select("url").distinct().withColumn("n", F.lit(1)), "url", "full_outer")
        counted = both.agg(F.count_if(F.col("o").isNull()).alias("n_new"), F.count_if(F.col("n").isNull()).alias("n_removed"), F.count_if(F.col("o").isNotNull() & F.col("n").isNotNull()).alias("n_common"))
        total = F.col("n_new") + F.col("n_removed") + F.col("n_common")
        return counted.withColumn("similarity", F.when(total == 0, 1.0).otherwise(F.col("n_common") / total))

    def to_json_rows(self) -> DataFrame:
        """Nodes and edges as JSON texts: ``(kind, row)``."""
        return self.nodes.select(F.lit("node").alias("kind"), F.to_json(F.struct("*")).alias("row")).unionByName(self.edges.select(F.lit("edge").alias("kind"), F.to_json(F.struct("*")).alias("row")))

    def compact(self) -> WebGraph:
        """Empty metadata values dropped, one edge per pair kept."""
        full = lambda c: F.map_filter(F.col(c), lambda k, v: v.isNotNull() & (v != ""))
        w = Window.partitionBy("source_node_id", "target_node_id").orderBy("created_at", "edge_id")
        return replace(self, nodes=self.nodes.withColumn("metadata", full("metadata")).withColumn("user_data", full("user_data")), edges=self.edges.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn"))


def _induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    out = edges
    for end in ("source_node_id", "target_node_id"):
        out = out.join(nodes.select(F.col("node_id").alias(end)), end, "left_semi").select(*edges.columns)
    return out


def merge_graphs(graphs: list[WebGraph], strategy: str = "last", custom: Callable | None = None) -> WebGraph | None:
    """Union of all, from the left; None for no graphs, the graph itself for one."""
    if not graphs:
        return None
    out = graphs[0]
    for g in graphs[1:]:
        out = out.union(g, strategy, custom)
    return out
