"""Snapshots, orphan references and hierarchies on small tables, and against brute force."""

import random
from datetime import datetime

import pytest

from skein.operators.hierarchy import descendants, hierarchy, hierarchy_paths
from skein.operators.orphans import orphan_references, orphan_report
from skein.operators.snapshots import snapshot_changes

SNAP = "snapshot_no int, url string, content_hash string, created_at timestamp_ntz, change_kind string"


def t(day, hour=0):
    return datetime(2025, 1, day, hour)


def test_snapshots_label_changes(spark):
    rows = [
        (1, "a", "AA", t(1), "x"), (1, "a", "AA", t(1), "x"), (1, "b", "b1", t(1), None), (1, "c", None, t(1), None), (1, "d", "d1", t(1), None), (1, "d", "d0", t(1), None),
        (3, "a", "aa", t(2), None), (3, "b", "b1", t(2), None), (3, "b", "b2", t(3), None), (3, "c", "c1", t(2), None), (3, "e", None, t(2), None), (3, "", "q", None, None),
        (4, "a", "aa", t(4), None), (4, "e", None, t(4), None), (None, "z", "z", t(1), None), (4, None, "z", t(1), None),
    ]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SNAP)).collect()}
    assert got == {(3, "b", "changed"), (3, "c", "changed"), (3, "d", "removed"), (3, "e", "added"), (3, "", "added"), (4, "b", "removed"), (4, "c", "removed"), (4, "", "removed")}


def test_snapshots_empty_and_single(spark):
    empty = spark.createDataFrame([], SNAP)
    assert snapshot_changes(empty).count() == 0
    assert snapshot_changes(spark.createDataFrame([(1, "a", "x", t(1), "")], SNAP)).count() == 0


def test_orphans(spark):
    nodes = spark.createDataFrame(
        [("n1", {"k": "v"}, t(1)), ("n2", None, t(10)), ("n3", {"removed_at": "2025-01-05T00:00:00"}, t(1)), ("n4", {"removed_at": "2025-01-05 00:00:00"}, t(1)), (None, None, t(1)), ("n5", {"removed_at": "soon"}, t(1))],
        "node_id string, metadata map<string,string>, created_at timestamp_ntz",
    )
    edges = spark.createDataFrame(
        [("e1", " N1 ", "gone", t(5)), ("e1", " N1 ", "gone", t(5)), ("e2", "n2", "n3", t(5)), ("e3", "n4\t", "  ", t(4)), ("e4", None, "n2", None), ("e5", "n5", "missing", None), ("e6", "n3", "n4", t(6))],
        "edge_id string, source_node_id string, target_node_id string, created_at timestamp_ntz",
    )
    got = {tuple(r) for r in orphan_references(edges, nodes).collect()}
    assert got == {
        ("e1", "target_node_id", "missing", "2025-01"), ("e2", "source_node_id", "late", "2025-01"), ("e2", "target_node_id", "deleted", "2025-01"),
        ("e5", "target_node_id", "missing", None), ("e6", "source_node_id", "deleted", "2025-01"), ("e6", "target_node_id", "deleted", "2025-01"),
    }
    assert orphan_report(orphan_references(edges, nodes)).count() == 5
    assert orphan_references(edges, nodes.limit(0)).where("reason = 'missing'").count() == 10
    assert orphan_references(edges.limit(0), nodes).count() == 0


def brute(rows):
    kids, over = {}, {}
    for a, b in rows:
        kids.setdefault(a, set()).add(b)
        over.setdefault(b, set()).add(a)
    nodes = set(kids) | set(over)

    def reach(n):
        seen, todo = set(), list(kids.get(n, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += kids.get(x, ())
        return seen

    below = {n: reach(n) for n in nodes}
    cyclic = {n for n in nodes if n in below[n]}
    tainted = cyclic | {x for n in cyclic for x in below[n]}
    out = {}
    for n in nodes:
        count = len(below[n] - {n})
        if n in tainted:
            out[n] = ("", -1, count, int(n in cyclic))
            continue
        now, level = {n}, 0
        while not (tops := [x for x in now if not over.get(x)]):
            now, level = {p for x in now for p in over[x]}, level + 1
        out[n] = (min(tops), level, count, 0)
    return out


@pytest.mark.parametrize("finish", [10**6, 12, 0])
def test_hierarchy_against_brute_force(spark, finish):
    random.seed(5)
    rows = [(f"n{random.randrange(k)}", f"n{k}") for k in range(1, 60)] + [("n9", "n3"), ("n30", "n30"), ("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("up", "r1"), ("r2", "low"), ("n4", "n5"), ("n2", "n50")]
    df = spark.createDataFrame([(f" {a.upper()} ", b) for a, b in rows] + rows[:5] + [(None, "n1"), ("  ", "n2")], "source_node_id string, target_node_id string")
    got = {r[0]: tuple(r[1:]) for r in hierarchy(df, finish_arcs=finish).collect()}
    assert got == brute(rows)


def test_hierarchy_paths_and_empty(spark):
    df = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "d"), ("x", "x")], "source_node_id string, target_node_id string")
    paths = {r[0]: r[1] for r in hierarchy_paths(df, hierarchy(df)).collect()}
    assert paths == {"a": ["a"], "b": ["a", "b"], "c": ["a", "b", "c"], "d": ["a", "d"]}
    assert hierarchy(df.limit(0)).count() == 0


def test_hierarchy_finishes_few_nodes_in_one_task(spark, monkeypatch):
    """A shallow forest, nodes that contain themselves and a few links: only the nodes of links reach the one task."""
    from skein.operators import hierarchy as H

    rows = [(f"r{k}", f"leaf{k}") for k in range(300)] + [(f"s{k}", f"s{k}") for k in range(50)] + [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]

    def few(batches, whole=H._finish):
        held = list(batches)
        assert sum(b.num_rows for b in held) <= 20
        yield from whole(iter(held))

    monkeypatch.setattr(H, "_finish", few)
    got = {r[0]: tuple(r[1:]) for r in hierarchy(spark.createDataFrame(rows, "source_node_id string, target_node_id string"), finish_arcs=20).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("finish", [0, 25])
def test_cycles_are_counted_by_component(spark, monkeypatch, finish):
    """Pairs of the closure are between strong components, not between the members of cycles."""
    from skein.operators import hierarchy as H

    rows = [(f"c{k:02}", f"c{(k + 1) % 30:02}") for k in range(30)] + [("c03", "x"), ("x", "y"), ("top", "c05"), ("y", "z"), ("x", "z"), ("d1", "d2"), ("d2", "d1"), ("z", "d1"), ("e", "e"), ("e", "f"), ("q", "e"), ("p1", "j"), ("p2", "j"), ("p2", "p1")]
    sizes = []
    monkeypatch.setattr(H, "_closure", lambda arcs, n, whole=H._closure: (sizes.append((r := whole(arcs, n)).count()), r)[1])
    got = {r[0]: tuple(r[1:]) for r in hierarchy(spark.createDataFrame(rows, "source_node_id string, target_node_id string"), finish_arcs=finish).collect()}
    assert got == brute(rows) and len(sizes) == 1 and sizes[0] < 40


def test_descendants(spark):
    rng = random.Random(3)
    arcs = {(rng.randrange(12), rng.randrange(12)) for _ in range(16)}
    df = spark.createDataFrame([(f" N{a}", f"n{b} ") for a, b in arcs] * 2 + [(None, "n1"), ("", "n2")], "source_node_id string, target_node_id string")
    want = {}
    for start in range(12):
        front, n, seen = {start}, 0, {start}
        while front:
            n += 1
            front = {b for a, b in arcs if a in front} - seen
            seen |= front
            want |= {(f"n{start}", f"n{b}", n): None for b in front}
    assert {tuple(r) for r in descendants(df).collect()} == set(want) and descendants(df.limit(0)).count() == 0


def test_orphans_of_a_hot_key_beyond_the_broadcast(spark, monkeypatch):
    from skein.operators import orphans as O

    edges = spark.createDataFrame([(f"e{k}", "gone" if k % 2 else f"x{k}", "p", t(2)) for k in range(60)], "edge_id string, source_node_id string, target_node_id string, created_at timestamp_ntz")
    nodes = spark.createDataFrame([("p", t(1), None), ("gone", t(1), {"removed_at": "2025-01-01"})], "node_id string, created_at timestamp_ntz, metadata map<string,string>")
    want = {tuple(r) for r in orphan_references(edges, nodes).collect()}
    assert len(want) == 60
    monkeypatch.setattr(O, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(O, "ROWS_PER_TASK", 7)
    assert {tuple(r) for r in orphan_references(edges, nodes).collect()} == want
