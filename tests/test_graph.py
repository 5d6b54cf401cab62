"""The hand-made graphs of the fixtures, and laws of the algebra."""

from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.functions import nodes as N
from skein.functions import validate as V
from skein.operators import stats
from skein.operators.graph import WebGraph, merge_graphs, merge_strategy
from skein.schema import EDGES, NODES
from skein.shared import salted_join
from skein.sources.io import Catalog, dot_lines, export_edges, graph_summary, read_graph, upsert_nodes, write_graph

T1, T2 = datetime(2025, 1, 1), datetime(2025, 2, 1)


def make(spark, nodes, edges, prefix="", created=T1):
    rows = [(prefix + u, "http://x.y/" + u, d, s, True, True, m, None, status, None, None, created, "html_stage" if s else "url_stage") for u, d, s, m, status in nodes]
    arcs = [(f"{prefix}e{i}", prefix + a, prefix + b, meta, created) for i, (a, b, meta) in enumerate(edges)]
    return WebGraph(spark.createDataFrame(rows, NODES), spark.createDataFrame(arcs, EDGES))


@pytest.fixture(scope="module")
def g1(spark):
    kind = lambda *t: {"link_type": "[" + ", ".join(f'"{x}"' for x in ("internal", *t)) + "]", "depth_diff": {"deeper": "1", "back": "-1", "same_depth": "0"}[t[0]]}
    return make(
        spark,
        [("A", 0, True, None, None), ("B", 1, True, {"title": "b1", "h1": "x"}, 200), ("C", 1, False, None, None), ("D", 2, False, None, None)],
        [("A", "B", kind("deeper")), ("A", "C", kind("deeper")), ("A", "B", kind("deeper")), ("B", "A", kind("back")), ("B", "D", kind("deeper")), ("D", "D", kind("same_depth"))],
    )


@pytest.fixture(scope="module")
def g2(spark):
    return make(spark, [("B", 3, False, {"title": "b2"}, None), ("D", 1, True, None, 200), ("E", 1, False, None, None)], [("B", "E", None), ("D", "B", None), ("E", "B", None)], "2-", T2)


def urls(g):
    return {r[0][-1] for r in g.nodes.select("url").collect()}


def arcs(g):
    n = g.nodes.select("node_id", F.substring("url", -1, 1).alias("u"))
    e = g.edges.join(n.select(F.col("node_id").alias("source_node_id"), F.col("u").alias("s")), "source_node_id").join(n.select(F.col("node_id").alias("target_node_id"), F.col("u").alias("t")), "target_node_id")
    return sorted(r[0] + r[1] for r in e.select("s", "t").collect())


def test_stats_and_degrees(g1):
    s = stats.graph_stats(g1.nodes, g1.edges).first()
    assert (s["total_nodes"], s["scanned_nodes"], s["unscanned_nodes"], s["total_edges"], s["avg_depth"], s["max_depth"]) == (4, 2, 2, 6, 1.0, 2)
    d = {r["node_id"]: (r["in_degree"], r["out_degree"], r["total_degree"]) for r in stats.degrees(g1.nodes, g1.edges).collect()}
    assert d == {"A": (1, 2, 3), "B": (1, 2, 3), "C": (1, 0, 1), "D": (2, 1, 3)}
    near = {}
    for a, b in stats.neighbours(g1.nodes, g1.edges).collect():
        near.setdefault(a, set()).add(b)
    assert near == {"A": {"B", "C"}, "B": {"A", "D"}, "C": {"A"}, "D": {"B", "D"}}
    assert [r[0] for r in stats.popular_nodes(g1.nodes, g1.edges, 2, "in_degree").collect()] == ["D", "A"]
    with pytest.raises(ValueError):
        stats.popular_nodes(g1.nodes, g1.edges, 2, "fame")


def test_edges_and_cycles(g1, spark):
    e = stats.edge_statistics(g1.nodes, g1.edges).first()
    assert (e["total_edges"], e["avg_depth_diff"], e["with_anchor"], e["without_anchor"], e["to_scanned"], e["to_unscanned"]) == (6, 0.5, 0, 6, 3, 3)
    kinds = {r[0]: r[1] for r in stats.edge_type_counts(g1.edges).collect()}
    assert kinds == {"internal": 6, "deeper": 4, "back": 1, "same_depth": 1}
    ids = lambda t, m: {r["edge_id"] for r in stats.edges_by_type(g1.edges, t, m).collect()}
    assert ids(["deeper"], "any") == {"e0", "e1", "e2", "e4"} and ids(["internal", "back"], "all") == {"e3"} and len(ids([], "any")) == 6
    assert [r[0] for r in stats.cycles(g1.edges, 1).collect()] == [["D"]] and [r[0] for r in stats.cycles(g1.edges, 2).collect()] == [["A", "B"]]
    assert stats.is_connected(g1.nodes, g1.edges) and stats.is_connected(g1.nodes.limit(0), g1.edges.limit(0))
    assert not stats.is_connected(g1.nodes, g1.edges.limit(0))
    assert stats.graph_stats(g1.nodes.limit(0), g1.edges.limit(0)).first()["avg_depth"] == 0.0


@pytest.mark.parametrize("finish", [10**6, 0])
def test_components(spark, finish):
    arcs = [("a", "b"), ("c", "b"), ("d", "e"), ("f", "f"), ("g", "lost"), ("h", "g")] + [(f"k{i}", f"k{i + 1}") for i in range(12)]
    ids = sorted({x for a in arcs for x in a if x != "lost"} | {"z"})
    n = spark.createDataFrame([(x,) for x in ids], "node_id string")
    e = spark.createDataFrame(arcs, "source_node_id string, target_node_id string")
    got = {r[0]: r[1] for r in stats.components(n, e, finish_pairs=finish).collect()}
    want = dict.fromkeys("abc", "a") | dict.fromkeys("de", "d") | {"f": "f", "z": "z"} | dict.fromkeys("gh", "g") | {f"k{i}": "k0" for i in range(13)}
    assert got == want


def test_remove_and_redirect(g1, spark):
    r = g1.remove_nodes(spark.createDataFrame([("B",)], "node_id string"))
    assert urls(r) == {"A", "C", "D"} and arcs(r) == ["AC", "DD"]
    to = spark.createDataFrame([("C", "http://x.y/B", ["http://x.y/C"])], "node_id string, final_url string, redirect_chain array<string>")
    r = g1.handle_redirects(to)
    assert urls(r) == {"A", "B", "D"} and arcs(r) == ["AB", "AB", "AB", "BA", "BD", "DD"]
    assert r.edges.where("metadata['was_redirect'] = 'true'").count() == 1
    renamed = g1.handle_redirects(spark.createDataFrame([("C", "http://x.y/Z", None)], to.schema))
    assert urls(renamed) == {"A", "B", "D", "Z"} and arcs(renamed).count("AZ") == 1


def test_algebra(g1, g2):
    u = g1 + g2
    assert urls(u) == set("ABCDE") and arcs(u) == sorted("AB AC BA BD DD BE DB EB".split())
    b = g1.union(g2, "merge").nodes.where("url like '%/B'").first()
    assert (b["metadata"], b["scanned"], b["response_status"], b["depth"], b["created_at"], b["node_id"]) == ({"title": "b2", "h1": "x"}, True, 200, 1, T1, "B")
    d = g1.union(g2, "merge").nodes.where("url like '%/D'").first()
    assert (d["scanned"], d["response_status"], d["depth"], d["created_at"]) == (True, 200, 1, T1)
    assert g1.union(g2, "newest").nodes.where("url like '%/B'").first()["depth"] == 3
    with merge_strategy("oldest"):
        assert (g1 + g2).nodes.where("url like '%/B'").first()["depth"] == 1
    custom = lambda l, r, cols: {c: (F.lit(7) if c == "depth" else l(c)) for c in cols}
    assert g1.union(g2, "custom", custom).nodes.where("url like '%/B'").first()["depth"] == 7
    with pytest.raises(ValueError):
        g1.union(g2, "best")
    with pytest.raises(ValueError):
        g1.union(g2, "custom")
    assert urls(g1 - g2) == {"A", "C"} and arcs(g1 - g2) == ["AC"]
    assert urls(g1 & g2) == {"B", "D"} and arcs(g1 & g2) == ["BD", "DB", "DD"]
    assert urls(g1 ^ g2) == {"A", "C", "E"} and arcs(g1 ^ g2) == ["AC"]
    c = g1.compare(g2).first()
    assert (c["n_new"], c["n_removed"], c["n_common"], c["similarity"]) == (1, 2, 2, 0.4)
    assert not g1 <= g2 and not g1.same_urls(g2) and (g1 & g2) < g1 and g1 >= g1 and not g1 > g1
    assert merge_graphs([]) is None and merge_graphs([g1]) is g1


def test_add_filter_compact(g1, spark):
    new = make(spark, [("C", 9, True, None, 200), ("Z", 4, False, None, None)], [], "n-").nodes
    kept = {r["url"][-1]: r for r in g1.add_nodes(new).nodes.collect()}
    assert kept["C"]["depth"] == 1 and kept["Z"]["node_id"] == "n-Z"
    over = {r["url"][-1]: r for r in g1.add_nodes(new, overwrite=True).nodes.collect()}
    assert over["C"]["depth"] == 9 and over["C"]["node_id"] == "C"
    assert arcs(g1.filter(F.col("scanned"))) == ["AB", "AB", "BA"] and g1.compact().edges.count() == 5
    assert len(g1) == 4 and "http://x.y/A" in g1 and g1.has_edge("A", "B") and not g1.has_edge("C", "A")


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_round_trip(g1, spark, tmp_path, fmt):
    write_graph(g1, str(tmp_path / fmt), fmt)
    back = read_graph(spark, str(tmp_path / fmt), fmt)
    order = lambda df: sorted(map(str, df.collect()))
    assert order(back.nodes.select(*g1.nodes.columns)) == order(g1.nodes) and arcs(back) == arcs(g1)


def test_catalog_and_exports(g1, g2, spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "cat"))
    assert c.names() == [] and c.versions("a") == []
    c.save("a", g1, "v1")
    c.save("a", g2, "v2")
    assert c.names() == ["a"] and c.versions("a") == ["v2", "v1"]
    assert urls(c.load("a")) == urls(g2) and urls(c.load("a", "v1")) == urls(g1)
    assert c.delete("a", "v2") and c.versions("a") == ["v1"]
    with pytest.raises(KeyError):
        c.load("b")
    lines = [r["line"] for r in dot_lines(g1).orderBy("part").collect()]
    assert lines[0] == "digraph G {" and lines[-1] == "}" and sum("->" in x for x in lines) == 6
    assert export_edges(g1).count() == 6 and graph_summary(g1).count() == 6
    assert upsert_nodes(g1.nodes, g1.nodes.limit(1)).count() == 4


names = st.lists(st.sampled_from("ABCDEFG"), min_size=0, max_size=6, unique=True)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(names, names)
def test_laws(spark, left, right):
    a = make(spark, [(u, 0, False, None, None) for u in left], [(x, y, None) for x in left for y in left[:2]])
    b = make(spark, [(u, 0, False, None, None) for u in right], [(x, y, None) for x in right for y in right[:2]], "2-")
    assert urls(a | b) == set(left) | set(right)
    assert urls((a - b) | (a & b)) == set(left)
    assert urls(a ^ b) == urls(b ^ a) == set(left) ^ set(right)


def test_access_and_equality(g1, g2, spark):
    assert g1 == g1.with_strategy("first") and g1 != g2 and not g1 == "x" and hash(g1)
    assert g1["http://x.y/B"]["depth"] == 1 and g1[0]["node_id"] == "A" and {r["node_id"] for r in g1} == set("ABCD")
    for key, error in (("nothing", KeyError), (9, IndexError), (-1, IndexError)):
        with pytest.raises(error):
            g1[key]
    with pytest.raises(ValueError):
        WebGraph(g1.nodes, g1.edges, "none")
    pairs = spark.createDataFrame([("A", "B"), ("B", "C"), (None, "A")], "source_node_id string, target_node_id string")
    assert {(r[0], r[1]): r["linked"] for r in g1.has_edges(pairs).collect()} == {("A", "B"): True, ("B", "C"): False, (None, "A"): False}
    again = WebGraph.from_json_rows(g1.to_json_rows())
    assert again == g1 and sorted(again.edges.select("edge_id").collect()) == sorted(g1.edges.select("edge_id").collect())


def test_salted_joins(spark):
    many = spark.createDataFrame([(k, "hot" if k % 3 else f"k{k}") for k in range(300)] + [(900, None)], "id int, key string")
    few = spark.createDataFrame([("hot", 1), ("k0", 2), ("other", 3)], "key string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = sorted(map(str, many.join(few, "key", how).collect()))
        assert sorted(map(str, salted_join(many, few, "key", how, rows_per_task=20).select(*many.join(few, "key", how).columns).collect())) == want


def test_cycles_of_any_length(spark):
    import itertools
    import random

    rng = random.Random(9)
    arcs = {(rng.randrange(9), rng.randrange(9)) for _ in range(26)} | {(0, k) for k in range(1, 9)}
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in arcs] * 2, "source_node_id string, target_node_id string")
    every = {}
    for n in (1, 2, 3, 4):
        every[n] = {p for p in itertools.permutations(range(9), n) if p[0] == min(p) and all((p[i], p[(i + 1) % n]) in arcs for i in range(n))}
        assert sorted(tuple(int(x[1:]) for x in r[0]) for r in stats.cycles(df, n).collect()) == sorted(every[n])
    found = [tuple(int(x[1:]) for x in r[0]) for r in stats.find_cycles(df, 5, max_length=4).collect()]
    assert found == sorted((c for n in every for c in every[n]), key=lambda c: (len(c), c))[:5]
    reach = set(arcs)
    while True:
        more = reach | {(a, d) for a, b in reach for c, d in arcs if b == c}
        if more == reach:
            break
        reach = more
    want = {(f"n{k}", f"n{min(j for j in range(9) if j == k or ((k, j) in reach and (j, k) in reach))}") for k in range(9) if (k, k) in reach}
    for finish in (10**6, 0):
        assert {tuple(r) for r in stats.cycle_members(df, finish_pairs=finish).collect()} == want
    assert stats.cycle_members(df.limit(0)).count() == 0 and stats.find_cycles(df.limit(0), 3).count() == 0


def test_popular_nodes_with_few_links(g1):
    assert [r["node_id"] for r in stats.popular_nodes(g1.nodes, g1.edges, 4, "out_degree").collect()][:2] == ["A", "B"]
    assert stats.popular_nodes(g1.nodes, g1.edges, 9).count() == 4 and stats.popular_nodes(g1.nodes, g1.edges.limit(0), 2).count() == 2


def test_node_values_and_checks(g1, spark):
    m = g1.nodes.select("node_id", N.title(F.col("metadata")).alias("t"), N.meta_value(F.col("metadata"), "x", F.lit("d")).alias("x")).where("node_id in ('A', 'B')").orderBy("node_id").collect()
    assert [(r["t"], r["x"]) for r in m] == [(None, "d"), ("b1", "d")]
    scans = spark.createDataFrame([("C", 404, None), ("C", 200, "h"), (None, 1, "z")], "node_id string, response_status int, content_hash string")
    assert {(r["node_id"], r["scanned"], r["response_status"]) for r in N.mark_scanned(g1.nodes, scans).collect()} == {("A", True, None), ("B", True, 200), ("C", True, 404), ("D", False, None)}
    assert abs(N.estimated_memory_mb(1000, 2000) - (1000 * 1500 + 2000 * 500) * 1.2 / 2**20) < 1e-9
    df = spark.createDataFrame([("https://a.b", 80, "sequential"), ("", 0, "x"), ("a.b", 70000, None), (None, None, "BATCH")], "u string, n int, c string")
    got = df.select(V.check_url(F.col("u"), "url"), V.check_port(F.col("n"), "port"), V.check_choice(F.col("c"), "mode", ["sequential", "batch"]), V.check_length(F.col("c"), "c", least=2, most=9, allow_empty=False), V.check_percentage(F.col("n"), "p")).collect()
    assert [[x is None for x in r] for r in got] == [[True, True, True, False, True], [False, False, False, False, True], [False, False, False, False, False], [False, False, True, True, False]]
