"""Parent-child rows to full hierarchies.

Method: bottom-up leaf peeling.  A node without unpeeled children is peeled and
sends its subtree size to its parents; roots and depths are then assigned in
reverse peel order.  What cannot be peeled contains the cycles.  Nodes from
which a cycle or a node with several parents can be reached carry descendant
lists (as rows) instead of sizes, because sizes would count twice there.

Each round's state is a table in the shared folder, so a lost executor costs a
re-read.  Rounds are as many as the hierarchy is high.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.shared import clean_id, parts_for, written

#: Links, and twice as many nodes, that one task may finish (ids of some 40 characters: about 50 MB in Python).
FINISH_ARCS = 100_000
#: Links down to which leaves are peeled in distributed rounds, as long as a round peels a share of them.
PEEL_ARCS, PEEL_SHARE = 1_000, 0.02


def _closure(arcs: DataFrame, n_parts: int) -> DataFrame:
    """Pairs (a, b, dist) with b reachable from a over one or more arcs, dist the least.

    Doubles the reach until nothing is added or shortened: log2 of the longest
    shortest path in rounds.  Only for the tangled part, whose descendant lists
    are asked for as a result in any case.
    """
    reach = written(arcs.select("a", "b", F.lit(1).alias("dist")).distinct(), "reach")
    size, total = reach.agg(F.count(F.lit(1)), F.sum("dist")).first()
    while size:
        left = reach.select("a", F.col("b").alias("m"), F.col("dist").alias("d1"))
        right = reach.select(F.col("a").alias("m"), "b", F.col("dist").alias("d2"))
        grown = left.join(right, "m").select("a", "b", (F.col("d1") + F.col("d2")).alias("dist"))
        reach = written(reach.unionByName(grown).groupBy("a", "b").agg(F.min("dist").alias("dist")).coalesce(n_parts), "reach")
        now = reach.agg(F.count(F.lit(1)), F.sum("dist")).first()
        if tuple(now) == (size, total):
            break
        size, total = now
    return reach


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Solve what is left of the hierarchies (at most ``FINISH_ARCS`` links) in one task.

    Rows are ``(p, c, below)``: a link if ``c`` is set, else a node with the
    number of nodes that were peeled below it.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    names: dict[str, int] = {}
    below: list[int] = []
    arcs: list[tuple[int, int]] = []
    for p, c, w in zip(*(t.column(i).to_pylist() for i in range(3))):
        for x in (p,) if c is None else (p, c):
            if x not in names:
                names[x] = len(names)
                below.append(0)
        if c is None:
            below[names[p]] = w
        else:
            arcs.append((names[p], names[c]))
    n = len(names)
    kids: list[list[int]] = [[] for _ in range(n)]
    n_parents, left = [0] * n, [0] * n
    over: list[list[int]] = [[] for _ in range(n)]
    looped = set()
    for p, c in arcs:
        if p == c:
            looped.add(p)
            continue
        kids[p].append(c)
        over[c].append(p)
        n_parents[c] += 1
        left[p] += 1

    # Peel: sums for single parents, everything above a joint or a loop by lists.
    total, listed = below[:], [k > 1 for k in n_parents]
    ready = [v for v in range(n) if left[v] == 0 and v not in looped]
    peeled = [False] * n
    while ready:
        v = ready.pop()
        peeled[v] = True
        for p in over[v]:
            left[p] -= 1
            listed[p] = listed[p] or listed[v]
            total[p] += 0 if listed[v] else total[v] + 1
            if left[p] == 0 and p not in looped:
                ready.append(p)
    knots = [v for v in range(n) if listed[v] or not peeled[v]]
    is_knot = [False] * n
    for v in knots:
        is_knot[v] = True

    # Descendant lists by strongly connected part: its members reach the same nodes.
    part = _strong_parts(knots, kids, is_knot)
    members: dict[int, list[int]] = {}
    for v in knots:
        members.setdefault(part[v], []).append(v)
    after = {k: {part[c] for v in vs for c in kids[v] if is_knot[c] and part[c] != k} for k, vs in members.items()}
    cyclic = {v for vs in members.values() if len(vs) > 1 for v in vs} | looped
    plain = {k: sum(total[v] + 1 for v in vs) for k, vs in members.items()}
    descendants = total[:]
    for k, vs in members.items():
        seen, stack = {k}, [k]
        while stack:
            for j in after[stack.pop()]:
                if j not in seen:
                    seen.add(j)
                    stack.append(j)
        reached = sum(plain[j] for j in seen)
        for v in vs:
            descendants[v] = reached - 1

    tainted, stack = set(cyclic), list(cyclic)
    while stack:
        for c in kids[stack.pop()]:
            if c not in tainted:
                tainted.add(c)
                stack.append(c)
    ids = list(names)
    root, level = [""] * n, [-1] * n
    front = [v for v in range(n) if not n_parents[v] and v not in tainted]
    for v in front:
        root[v], level[v] = ids[v], 0
    depth = 0
    while front:
        depth += 1
        found: dict[int, str] = {}
        for v in front:
            for c in kids[v]:
                if level[c] < 0 and c not in tainted and (c not in found or root[v] < found[c]):
                    found[c] = root[v]
        for c, r in found.items():
            root[c], level[c] = r, depth
        front = list(found)
    yield pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.string()), pa.array(root, pa.string()), pa.array(level, pa.int32()), pa.array(descendants, pa.int64()), pa.array([int(v in cyclic) for v in range(n)], pa.int32())],
        names=["node", "root", "lvl", "below", "cyc"],
    )


def _strong_parts(nodes: list[int], kids: list[list[int]], inside: list[bool]) -> dict[int, int]:
    """Strongly connected part of each node, by a search forward and one backward."""
    order, seen = [], set()
    for s in nodes:
        if s in seen:
            continue
        seen.add(s)
        stack = [(s, iter(kids[s]))]
        while stack:
            v, it = stack[-1]
            for c in it:
                if inside[c] and c not in seen:
                    seen.add(c)
                    stack.append((c, iter(kids[c])))
                    break
            else:
                order.append(v)
                stack.pop()
    back: dict[int, list[int]] = {v: [] for v in nodes}
    for v in nodes:
        for c in kids[v]:
            if inside[c]:
                back[c].append(v)
    part: dict[int, int] = {}
    for s in reversed(order):
        if s in part:
            continue
        part[s] = s
        stack2 = [s]
        while stack2:
            for u in back[stack2.pop()]:
                if u not in part:
                    part[u] = s
                    stack2.append(u)
    return part


def _parts_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strong components of the links ``(p, c)`` of one task: ``(node, part)`` of those with several members."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    names: dict[str, int] = {}
    kids: list[list[int]] = []
    for b in held:
        for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for x in (p, c):
                if x not in names:
                    names[x] = len(names)
                    kids.append([])
            kids[names[p]].append(names[c])
    part = _strong_parts(list(range(len(kids))), kids, [True] * len(kids))
    size = Counter(part.values())
    ids = list(names)
    rows = [(ids[v], ids[k]) for v, k in part.items() if size[k] > 1]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["node", "part"])


def _spread(marks: DataFrame, arcs: DataFrame) -> DataFrame:
    """Least mark ``(node, m)`` that reaches each node over ``arcs`` ``(p, c)``, nodes without marks left out.

    Rounds are as many as the longest shortest path.  Only marks that changed are sent on.
    """
    now = front = written(marks, "marks")
    while not front.isEmpty():
        sent = front.join(arcs, front["node"] == arcs["p"]).groupBy(F.col("c").alias("node")).agg(F.min("m").alias("got"))
        both = written(now.join(sent, "node", "full").select("node", F.least("m", "got").alias("m"), (F.col("got").isNotNull() & (F.col("m").isNull() | (F.col("got") < F.col("m")))).alias("new")), "marks")
        now, front = both.select("node", "m"), both.where("new").select("node", "m")
    return now


def strong_components(arcs: DataFrame, finish_arcs: int) -> DataFrame | None:
    """Strong components with several members, ``(node, part)``; None if there is none.

    What has no link in or no link out is on no cycle and is trimmed; each node
    that is left takes the least id that reaches it, and those of one id that
    reach this id in turn are its component.  One task takes at most
    ``finish_arcs`` links.
    """
    out = None
    left = arcs.select("p", "c")
    add = lambda out, found: found if out is None else out.unionByName(found)
    n = left.count()
    while n:
        if n <= finish_arcs:
            return add(out, written(left.repartition(1).mapInArrow(_parts_in_task, "node string, part string"), "strong"))
        left = written(left.join(left.select(F.col("c").alias("p")).distinct(), "p", "left_semi").join(left.select(F.col("p").alias("c")).distinct(), "c", "left_semi").select("p", "c"), "trimmed")
        before, n = n, left.count()
        if n < before:
            continue
        every = left.select(F.explode(F.array("p", "c")).alias("node")).distinct()
        color = _spread(every.select("node", F.col("node").alias("m")), left)
        inside = written(left.join(color.select(F.col("node").alias("p"), "m"), "p").join(color.select(F.col("node").alias("c"), F.col("m").alias("mc")), "c").where("m = mc").select(F.col("c").alias("p"), F.col("p").alias("c")), "inside")
        found = _spread(color.where("node = m"), inside).select("node", F.col("m").alias("part"))
        found = written(found, "strong")
        out = add(out, found.join(found.groupBy("part").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("part"), "part", "left_semi").select("node", "part"))
        left = written(left.join(found.select(F.col("node").alias("p")), "p", "left_anti").join(found.select(F.col("node").alias("c")), "c", "left_anti").select("p", "c"), "trimmed")
        n = left.count()
    return out


def _finish_wide(state: DataFrame, arcs: DataFrame, loops: DataFrame, n: int, finish_arcs: int) -> DataFrame:
    """As :func:`_finish`, distributed: for a rest that no single task should hold.

    The members of a strong component reach the same nodes, so pairs are made
    between components only.
    """
    strong = strong_components(arcs, finish_arcs)
    named = state.select("node", "below")
    named = named.withColumn("part", F.col("node")) if strong is None else named.join(strong.withColumnRenamed("part", "k"), "node", "left").select("node", "below", F.coalesce("k", "node").alias("part"))
    named = written(named, "parts")
    of = named.select("node", "part")
    weights = written(named.groupBy("part").agg(F.sum(F.col("below") + 1).alias("w"), F.count(F.lit(1)).alias("members")), "weights")
    pure = arcs.join(of.select(F.col("node").alias("p"), F.col("part").alias("a")), "p").join(of.select(F.col("node").alias("c"), F.col("part").alias("b")), "c").where("a != b").select("a", "b").distinct()
    pure = written(pure, "condensed")
    reach = _closure(pure, n)
    bad = written(weights.where("members > 1").select("part").unionByName(loops.join(of, "node").select("part")).distinct(), "bad")
    tainted = reach.join(bad.select(F.col("part").alias("a")), "a", "left_semi").select(F.col("b").alias("part")).unionByName(bad).distinct()
    listed = reach.join(weights.select(F.col("part").alias("b"), "w"), "b").groupBy(F.col("a").alias("part")).agg(F.sum("w").alias("more"))
    # A part without links in that holds a cycle is no top, but whatever it reaches has no root anyway.
    tops = weights.select("part").join(pure.select(F.col("b").alias("part")), "part", "left_anti")
    from_top = (
        reach.join(tops.select(F.col("part").alias("a")), "a", "left_semi")
        .groupBy(F.col("b").alias("part"))
        .agg(F.min(F.struct("dist", "a")).alias("m"))
        .select("part", F.col("m.a").alias("root"), F.col("m.dist").alias("lvl"))
        .unionByName(tops.select("part", F.col("part").alias("root"), F.lit(0).alias("lvl")))
    )
    flag = lambda df, name: df.withColumn(name, F.lit(1))
    return (
        of.join(weights, "part")
        .join(listed, "part", "left")
        .join(from_top, "part", "left")
        .join(flag(tainted, "bad"), "part", "left")
        .join(flag(loops.distinct(), "loop"), "node", "left")
        .select(
            "node",
            F.when(F.col("bad").isNull(), F.col("root")).otherwise("").alias("root"),
            F.when(F.col("bad").isNull(), F.col("lvl")).otherwise(-1).cast("int").alias("lvl"),
            (F.col("w") - 1 + F.coalesce("more", F.lit(0))).alias("below"),
            F.when(F.col("members") > 1, 1).otherwise(F.coalesce("loop", F.lit(0))).alias("cyc"),
        )
    )


def hierarchy(links: DataFrame, *, parent: str = "source_node_id", child: str = "target_node_id", finish_arcs: int = FINISH_ARCS, peel_arcs: int = PEEL_ARCS) -> DataFrame:
    """Root, level, number of descendants and cycle membership of every node.

    Returns ``(node_id, root_id, level_no, n_descendants, on_cycle)``, one row
    per id that occurs in ``links``.  Ids are trimmed and lower-cased; rows with
    a null or blank id on either side carry no link (the other id of such a row
    is a node only if another row links it).  Repeated rows count once.  A node
    on a cycle (one containing itself included) or reachable from one has root
    ``''`` and level -1.  If several roots reach a node, the nearest counts,
    and of equally near ones the smallest id.  Empty input gives no rows.

    Rounds of peeling are distributed until at most ``peel_arcs`` links are left
    or a round peels little; nodes without links are then done, and one task
    peels the rest the same way if it has at most ``finish_arcs`` links.  The
    result depends on neither.
    """
    raw = links.select(clean_id(F.col(parent)).alias("p"), clean_id(F.col(child)).alias("c")).where(F.col("p").isNotNull() & F.col("c").isNotNull()).distinct()
    arcs_all = written(raw, "arcs")
    n_arcs = arcs_all.count()
    n = parts_for(n_arcs)
    every = arcs_all.select(F.explode(F.array("p", "c")).alias("node")).distinct()
    loops = arcs_all.where(F.col("p") == F.col("c")).select(F.col("p").alias("node"))
    arcs = arcs_all.where(F.col("p") != F.col("c"))

    peeled: list[DataFrame] = []
    if n_arcs <= min(peel_arcs, finish_arcs):
        state = every.select("node", F.lit(0).cast("long").alias("below"))
    else:
        left = arcs.groupBy(F.col("p").alias("node")).agg(F.count(F.lit(1)).alias("left"))
        joints = arcs.groupBy(F.col("c").alias("node")).agg((F.count(F.lit(1)) > 1).alias("joint"))
        stay = loops.withColumn("looped", F.lit(True))
        state = written(
            every.join(left, "node", "left")
            .join(joints, "node", "left")
            .join(stay, "node", "left")
            .select("node", F.coalesce("left", F.lit(0)).alias("left"), F.lit(0).cast("long").alias("below"), (F.coalesce("joint", F.lit(False)) | F.coalesce("looped", F.lit(False))).alias("stays")),
            "state",
        )
        while n_arcs > min(peel_arcs, finish_arcs):
            # Nodes with several parents stay, and with them all above: sizes may be summed in what is peeled.
            leaves = written(state.where("left = 0 and not stays").join(arcs.select(F.col("c").alias("node"), "p"), "node", "left").select("node", "p", "below"), "leaves")
            gone = leaves.count()
            if not gone:
                break
            peeled.append(leaves)
            sent = leaves.where("p is not null").groupBy(F.col("p").alias("node")).agg(F.count(F.lit(1)).alias("got"), F.sum(F.col("below") + 1).alias("add"))
            state = written(
                state.where("left > 0 or stays")
                .join(sent, "node", "left")
                .select("node", (F.col("left") - F.coalesce("got", F.lit(0))).alias("left"), (F.col("below") + F.coalesce("add", F.lit(0))).alias("below"), "stays"),
                "state",
            )
            arcs = written(arcs.join(leaves.select(F.col("node").alias("c")), "c", "left_anti"), "arcs")
            n_arcs = arcs.count()
            if n_arcs <= finish_arcs and gone < PEEL_SHARE * n_arcs:
                break  # high and narrow: rounds would be many

    # Nodes without links to others are done: a root, or a node that contains only itself.
    linked = arcs.select(F.explode(F.array("p", "c")).alias("node")).distinct()
    alone = state.select("node", "below").join(linked, "node", "left_anti").join(loops.distinct().withColumn("cyc", F.lit(1)), "node", "left")
    alone = alone.select("node", F.when(F.col("cyc").isNull(), F.col("node")).otherwise("").alias("root"), F.when(F.col("cyc").isNull(), 0).otherwise(-1).cast("int").alias("lvl"), "below", F.coalesce("cyc", F.lit(0)).alias("cyc"))
    state, loops = state.join(linked, "node", "left_semi"), loops.join(linked, "node", "left_semi")
    if n_arcs <= finish_arcs:
        rest = state.select(F.col("node").alias("p"), F.lit(None).cast("string").alias("c"), "below").unionByName(
            arcs.select("p", "c", F.lit(0).cast("long").alias("below")).unionByName(loops.select(F.col("node").alias("p"), F.col("node").alias("c"), F.lit(0).cast("long").alias("below")))
        )
        solved = rest.repartition(1).mapInArrow(_finish, "node string, root string, lvl int, below bigint, cyc int")
    else:
        solved = _finish_wide(written(state.select("node", "below"), "rest"), arcs, loops, n, finish_arcs)
    solved = solved.unionByName(alone)
    if peeled:
        solved = written(solved, "solved")
    above, out = solved, solved
    for leaves in reversed(peeled):
        # Reverse peel order: the parents of these nodes were placed one round earlier at the latest.
        above = out
        placed = leaves.join(above.select(F.col("node").alias("p"), "root", "lvl"), "p", "left").select(
            "node",
            F.when(F.col("p").isNull(), F.col("node")).otherwise(F.col("root")).alias("root"),
            F.when(F.col("p").isNull(), 0).when(F.col("lvl") < 0, -1).otherwise(F.col("lvl") + 1).cast("int").alias("lvl"),
            "below",
            F.lit(0).alias("cyc"),
        )
        out = out.unionByName(written(placed, "placed"))
    return out.select(F.col("node").alias("node_id"), F.col("root").alias("root_id"), F.col("lvl").alias("level_no"), F.col("below").cast("int").alias("n_descendants"), F.col("cyc").alias("on_cycle"))


def hierarchy_paths(links: DataFrame, levels: DataFrame, *, parent: str = "source_node_id", child: str = "target_node_id") -> DataFrame:
    """Full path (root first) and ancestor rows of the nodes that :func:`hierarchy` placed.

    ``(node_id, path array<string>)``; nodes on or below a cycle have no path.
    Paths are built level by level; a node with several parents takes the
    smallest parent id one level up under its root.
    """
    arcs = links.select(clean_id(F.col(parent)).alias("p"), clean_id(F.col(child)).alias("node_id")).where("p is not null and node_id is not null and p != node_id").distinct()
    good = written(levels.where("level_no >= 0").select("node_id", "root_id", "level_no"), "good")
    chosen = written(
        arcs.join(good, "node_id")
        .join(good.select(F.col("node_id").alias("p"), F.col("root_id").alias("pr"), F.col("level_no").alias("pl")), "p")
        .where("pl = level_no - 1 and pr = root_id")
        .groupBy("node_id", "level_no")
        .agg(F.min("p").alias("p")),
        "chosen",
    )
    paths = written(good.where("level_no = 0").select("node_id", F.array("node_id").alias("path")), "paths")
    out, top = paths, good.agg(F.coalesce(F.max("level_no"), F.lit(0))).first()[0]
    for k in range(1, top + 1):
        paths = written(chosen.where(F.col("level_no") == k).join(paths.select(F.col("node_id").alias("p"), "path"), "p").select("node_id", F.concat("path", F.array("node_id")).alias("path")), "paths")
        out = out.unionByName(paths)
    return out


def descendants(links: DataFrame, *, parent: str = "source_node_id", child: str = "target_node_id") -> DataFrame:
    """All descendants of every node: distinct ``(node_id, descendant_id, steps)``, ``steps`` the least number of links.

    Ids and rows count as in :func:`hierarchy`; a node is no descendant of
    itself, also on a cycle.  A round doubles the steps, so that there are about
    the logarithm of the height of them.  The result grows with the sum of the
    levels (and with the square of a strong component), as its definition asks.
    """
    arcs = written(links.select(clean_id(F.col(parent)).alias("a"), clean_id(F.col(child)).alias("b")).where("a is not null and b is not null and a != b").distinct(), "arcs")
    reach = _closure(arcs, parts_for(arcs.count()))
    return reach.where("a != b").select(F.col("a").alias("node_id"), F.col("b").alias("descendant_id"), F.col("dist").cast("int").alias("steps"))
