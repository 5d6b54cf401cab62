"""Statistics of a graph: counts, degrees, popular nodes, edge kinds, components and cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.shared import parts_for, written

#: Pairs of ids that one task may join (some 250 bytes each in Python).
FINISH_PAIRS = 500_000
#: Nodes up to which a list of them is broadcast.
BROADCAST_NODES = 200_000


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of counts; parallel edges count, an empty graph has zeros."""
    n = nodes.agg(
        F.count(F.lit(1)).alias("total_nodes"),
        F.count_if("scanned").alias("scanned_nodes"),
        F.count_if(~F.coalesce("scanned", F.lit(False))).alias("unscanned_nodes"),
        F.coalesce(F.avg("depth"), F.lit(0.0)).alias("avg_depth"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("max_depth"),
    )
    return n.crossJoin(edges.agg(F.count(F.lit(1)).alias("total_edges")))


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("source_node_id", "target_node_id").distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct neighbours in and out of every node; a self-loop counts once in each.

    Pairs are made distinct first, so that the hub of a hot target is counted
    from partial sums.
    """
    pairs = _pairs(edges)
    ins = pairs.groupBy(F.col("target_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("i"))
    outs = pairs.groupBy(F.col("source_node_id").alias("node_id")).agg(F.count(F.lit(1)).alias("o"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return nodes.select("node_id", "url", "created_at").join(ins, "node_id", "left").join(outs, "node_id", "left").select("node_id", "url", "created_at", zero("i").alias("in_degree"), zero("o").alias("out_degree"), (zero("i") + zero("o")).alias("total_degree"))


def neighbours(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct ``(node_id, neighbour_id)`` in either direction, both nodes known."""
    pairs = _pairs(edges)
    both = pairs.select(F.col("source_node_id").alias("node_id"), F.col("target_node_id").alias("neighbour_id")).unionByName(pairs.select(F.col("target_node_id").alias("node_id"), F.col("source_node_id").alias("neighbour_id"))).distinct()
    known = nodes.select("node_id").distinct()
    return both.join(known, "node_id", "left_semi").join(known.select(F.col("node_id").alias("neighbour_id")), "neighbour_id", "left_semi").select("node_id", "neighbour_id")


def popular_nodes(nodes: DataFrame, edges: DataFrame, top_n: int = 10, by: str = "in_degree") -> DataFrame:
    """The ``top_n`` nodes by a degree; ties by creation, then id."""
    if by not in ("in_degree", "out_degree", "total_degree"):
        raise ValueError(f"unknown degree {by!r}")
    pairs = _pairs(edges)
    ends = {"in_degree": ["target_node_id"], "out_degree": ["source_node_id"], "total_degree": ["source_node_id", "target_node_id"]}[by]
    counts = pairs.select(F.explode(F.array(*ends)).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    known = nodes.select("node_id", "url", "created_at")
    counts = written(counts.join(nodes.select("node_id"), "node_id", "left_semi"), "degrees")
    # Only what is not below the last place can be on the list; names are looked up for that alone.
    last = counts.orderBy(F.desc("degree")).limit(max(top_n, 1)).agg(F.count(F.lit(1)), F.min("degree")).first()
    if last[0] < top_n:
        ranked = known.join(counts, "node_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    else:
        top = counts.where(F.col("degree") >= last[1])
        ranked = known.join(F.broadcast(top) if top.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else top, "node_id")
    return ranked.orderBy(F.desc("degree"), "created_at", "node_id").limit(top_n).select("node_id", "url", "degree")


def link_types(edge_metadata: Column) -> Column:
    """Types of an edge: a JSON list, a bare name, or none."""
    raw = F.element_at(edge_metadata, "link_type")
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(raw.startswith("["), F.coalesce(F.from_json(raw, "array<string>"), F.array().cast("array<string>"))).otherwise(F.array(raw))


def edge_type_counts(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(link_types(F.col("metadata"))).alias("link_type")).groupBy("link_type").agg(F.count(F.lit(1)).alias("n_edges"))


def edge_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: edges, mean depth difference, with and without anchor text, to scanned and unscanned targets."""
    m = F.col("metadata")
    anchor = F.coalesce(F.element_at(m, "anchor_text"), F.lit("")) != ""
    diff = F.element_at(m, "depth_diff").try_cast("int")
    # Summed by target first, so that the links of a hub are one row when the state of targets is looked up.
    per = edges.groupBy("target_node_id").agg(F.count(F.lit(1)).alias("n"), F.sum(diff).alias("diff"), F.count(diff).alias("n_diff"), F.count_if(anchor).alias("anchors"))
    known = nodes.groupBy(F.col("node_id").alias("target_node_id")).agg(F.max(F.coalesce("scanned", F.lit(False))).alias("t_scanned"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.join(known, "target_node_id", "left").agg(
        total("n").alias("total_edges"),
        (F.sum("diff") / F.nullif(F.sum("n_diff"), F.lit(0))).alias("avg_depth_diff"),
        total("anchors").alias("with_anchor"),
        total(F.col("n") - F.col("anchors")).alias("without_anchor"),
        total(F.when(F.col("t_scanned"), F.col("n"))).alias("to_scanned"),
        total(F.when(~F.col("t_scanned"), F.col("n"))).alias("to_unscanned"),
    )


def edges_by_type(edges: DataFrame, types: list[str], match: str = "any") -> DataFrame:
    """Edges with any, all or exactly the types; no types select every edge."""
    if match not in ("any", "all", "exact"):
        raise ValueError(f"unknown match {match!r}")
    if not types:
        return edges
    wanted, have = F.array(*map(F.lit, sorted(set(types)))), link_types(F.col("metadata"))
    if match == "any":
        return edges.where(F.arrays_overlap(have, wanted))
    missing = F.size(F.array_except(wanted, have)) == 0
    return edges.where(missing if match == "all" else missing & (F.size(F.array_except(have, wanted)) == 0))


def depth_histogram(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n_nodes"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Least id of each component of the pairs of one task, by union-find."""
    parent: dict[str, str] = {}

    def root(x: str) -> str:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    names = list(parent)
    if names:
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([root(x) for x in names], pa.string())], names=["a", "b"])


def components(nodes: DataFrame, edges: DataFrame, *, finish_pairs: int = FINISH_PAIRS) -> DataFrame:
    """Weakly connected component of each node: ``(node_id, component)``, the least id in it.

    Edges with an unknown end are left out.  Labels spread by large-star and
    small-star turns, which need about the logarithm of a component's width in
    rounds and keep the edges within a constant of the node count; each round is
    written to the shared folder.  One task joins what is left once that is at
    most ``finish_pairs`` pairs; the result does not depend on it.
    """
    known = nodes.select("node_id").distinct()
    pairs = edges.select(F.col("source_node_id").alias("a"), F.col("target_node_id").alias("b")).where("a != b").distinct()
    for end in ("a", "b"):
        pairs = pairs.join(known.withColumnRenamed("node_id", end), end, "left_semi").select("a", "b")
    now = written(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    while True:
        n_pairs = now.count()
        if n_pairs <= finish_pairs:
            now = now.repartition(1).mapInArrow(_joined, "a string, b string")
            break
        n = parts_for(n_pairs)
        # Large star: every greater neighbour of a node points to the least one around it.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        # Small star: a node and its lesser neighbours point to the least of them.
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        now = written(small.coalesce(n), "cc")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if before == tuple(mark):
            break
        before = tuple(mark)
    return known.join(now.select(F.col("a").alias("node_id"), F.col("b").alias("component")), "node_id", "left").select("node_id", F.coalesce("component", "node_id").alias("component"))


def is_connected(nodes: DataFrame, edges: DataFrame) -> bool:
    """Weakly connected; an empty graph is."""
    return components(nodes, edges).select("component").distinct().limit(2).count() <= 1


def cycles(edges: DataFrame, length: int) -> DataFrame:
    """Simple cycles of exactly ``length`` different nodes, each once, beginning at its least id: ``(cycle array)``.

    Paths grow from the node of a cycle with the fewest links, so that the links
    of a hub are not paired with each other.
    """
    arcs = _pairs(edges).select(F.col("source_node_id").alias("s"), F.col("target_node_id").alias("t"))
    if length == 1:
        return arcs.where("s = t").select(F.array("s").alias("cycle"))
    arcs = written(arcs.where("s != t"), "arcs")
    rank = arcs.select(F.explode(F.array("s", "t")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).select("id", F.struct("n", "id").alias("k"))
    ranked = written(arcs.join(rank.select(F.col("id").alias("s"), F.col("k").alias("ks")), "s").join(rank.select(F.col("id").alias("t"), F.col("k").alias("kt")), "t").select("s", "t", "ks", "kt"), "ranked")
    paths = ranked.where("kt > ks").select(F.array("s", "t").alias("p"), F.col("s").alias("first"), F.col("ks").alias("k"), F.col("t").alias("last"))
    for _ in range(length - 3):
        paths = paths.join(ranked.select("s", "t", "kt"), F.col("last") == F.col("s")).where((F.col("kt") > F.col("k")) & ~F.array_contains("p", F.col("t"))).select(F.concat("p", F.array("t")).alias("p"), "first", "k", F.col("t").alias("last"))
    if length == 2:
        found = paths.join(arcs.select(F.col("s").alias("last"), F.col("t").alias("first")), ["last", "first"], "left_semi")
    else:
        # The last node is one that leads back to the first; whether the path reaches it is looked up.
        ends = ranked.where("ks > kt").select(F.col("t").alias("first"), F.col("s").alias("end"))
        met = paths.join(ends, "first").where(~F.array_contains("p", F.col("end")))
        found = met.join(arcs.select(F.col("s").alias("last"), F.col("t").alias("end")), ["last", "end"], "left_semi").select(F.concat("p", F.array("end")).alias("p"))
    least = F.array_position("p", F.array_min("p")).cast("int")
    return found.select(F.concat(F.slice("p", least, F.size("p")), F.slice("p", F.lit(1), least - 1)).alias("cycle"))


def find_cycles(edges: DataFrame, max_cycles: int | None = None, max_length: int = 5) -> DataFrame:
    """Simple cycles up to ``max_length`` nodes, shorter ones first, then by ids: at most ``max_cycles`` of ``(cycle)``."""
    out, n = None, 0
    for length in range(1, max_length + 1):
        found = cycles(edges, length)
        out = found if out is None else out.unionByName(found)
        if max_cycles is not None:
            out = written(out, "cycles")
            n = out.count()
            if n >= max_cycles:
                break
    return out if max_cycles is None else out.orderBy(F.size("cycle"), "cycle").limit(max_cycles)


def cycle_members(edges: DataFrame, *, finish_pairs: int = FINISH_PAIRS) -> DataFrame:
    """Nodes on a cycle of any length: ``(node_id, component)``, by strong components; a node that links itself is its own."""
    from skein.operators.hierarchy import strong_components

    pairs = written(_pairs(edges).select(F.col("source_node_id").alias("p"), F.col("target_node_id").alias("c")).where("p is not null and c is not null"), "arcs")
    strong = strong_components(pairs.where("p != c"), finish_pairs)
    loops = pairs.where("p = c").select(F.col("p").alias("node_id"))
    if strong is None:
        return loops.select("node_id", F.col("node_id").alias("component"))
    least = strong.groupBy("part").agg(F.min("node").alias("component"))
    found = strong.join(least, "part").select(F.col("node").alias("node_id"), "component")
    return found.unionByName(loops.join(found, "node_id", "left_anti").select("node_id", F.col("node_id").alias("component")))


def reachable(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Least number of steps, up to ``depth``, from the seeds (column node_id): ``(node_id, steps)``."""
    arcs = _pairs(edges)
    seen = written(seeds.select("node_id").distinct().withColumn("steps", F.lit(0)), "seen")
    front = seen
    for k in range(1, depth + 1):
        step = front.join(arcs, front["node_id"] == arcs["source_node_id"]).select(F.col("target_node_id").alias("node_id")).distinct().join(seen, "node_id", "left_anti").withColumn("steps", F.lit(k))
        front = written(step, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen
