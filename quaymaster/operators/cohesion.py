"""Components, cores, communities, bridges and cut points as iterated DataFrame programs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import drop, staged, staged_by
from .graph import nodes_of, undirected
from .iterate import fixpoint, levels, union
from .order import numbered
from .pieces import HELD, numbers, parted, stars, worked


def weak_components(nodes: DataFrame, edges: DataFrame, ready: bool = False) -> DataFrame:
    """node, component (the smallest node of it)."""
    got = stars(edges, [], ready=ready)
    return nodes.join(got, "node", "left").select("node", F.coalesce("root", "node").alias("component"))


def component_stats(components: DataFrame) -> DataFrame:
    sizes = components.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"), F.sum((F.col("n") == 1).cast("long")).alias("singletons"), F.sum((F.col("n") > 1).cast("long")).alias("larger"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("members"))


def strong_components(nodes: DataFrame, edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (its smallest node): nodes without edges in or out are trimmed; then smallest labels flow forward, and the nodes
    that reach their label's node backwards within the label form its component."""
    left, e = staged(nodes.select("node"), "scc-nodes"), staged(edges.where("src <> dst").select("src", "dst").distinct(), "scc-edges")
    out: list[DataFrame] = []
    for _ in range(rounds):
        while True:  # trim
            live = e.select(F.col("src").alias("node")).distinct().join(e.select(F.col("dst").alias("node")), "node", "left_semi")
            gone = staged(left.join(live, "node", "left_anti"), "scc-trim")
            if gone.isEmpty():
                break
            out.append(gone.select("node", F.col("node").alias("component")))
            left = staged(left.join(gone, "node", "left_anti"), "scc-nodes")
            e = staged(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "scc-edges")
        if left.isEmpty():
            return union(out)

        def flow(now: DataFrame, e: DataFrame = e) -> DataFrame:
            into = e.join(now, e["src"] == now["node"]).select(F.col("dst").alias("node"), "color")
            return now.unionByName(into).groupBy("node").agg(F.min("color").alias("color"))

        color = fixpoint(left.select("node", F.col("node").alias("color")), flow, "scc-color")
        own = e.join(color.select(F.col("node").alias("src"), F.col("color").alias("c1")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("c2")), "dst").where("c1 = c2").select(F.col("dst").alias("u"), F.col("src").alias("v"), F.col("c1").alias("color"))
        own = staged(own, "scc-own")

        def back(last: DataFrame, done: DataFrame, own: DataFrame = own) -> DataFrame:
            nxt = last.join(own, (last["node"] == own["u"]) & (last["component"] == own["color"])).select(F.col("v").alias("node"), "component").distinct()
            return nxt.join(done, ["node", "component"], "left_anti")

        found = staged(union(levels(color.where("node = color").select("node", F.col("color").alias("component")), back, "scc-back", 10_000)), "scc-found")
        out.append(found)
        left = staged(left.join(found.select("node"), "node", "left_anti"), "scc-nodes")
        gone = found.select("node")
        e = staged(e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "scc-edges")
        if left.isEmpty():
            return union(out)
    raise RuntimeError("strong components did not settle")


def _cores_of_pieces(c, src, dst):
    (a, b), node = numbers(src, dst)
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    core, deg, k = np.zeros(len(node), np.int64), np.bincount(a, minlength=len(node)), 0
    live = np.ones(len(node), bool)
    while live.any():
        k = max(k, int(deg[live].min()))
        gone = live & (deg <= k)
        core[gone] = k
        live &= ~gone
        deg -= np.bincount(b[gone[a]], minlength=len(node))
        left = live[a] & live[b]
        a, b = a[left], b[left]
    yield node, core


def coreness(nodes: DataFrame, edges: DataFrame, held: int = HELD, ready: bool = False) -> DataFrame:
    """node, core on the multigraph of edges in and out: components of `held` edges at most are peeled in the task that holds them, larger
    ones go by wide_coreness."""
    small, big = parted(edges.select("src", "dst"), held, ready)
    got = worked(small, ["src", "dst"], _cores_of_pieces, f"node {edges.schema['src'].dataType.simpleString()}, core long", held)
    if big is not None:
        own = big.select("src", "dst")
        got = got.unionByName(wide_coreness(nodes_of(own), own))
    return nodes.join(got, "node", "left").select("node", F.coalesce("core", F.lit(0)).alias("core"))


def wide_coreness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, core on the multigraph of edges in and out: each node's estimate falls to the h-index of its neighbours' estimates until
    nothing changes (Lü et al. 2016). The h-index comes from counts by estimate, so no neighbour list is ever gathered."""
    both = staged_by(undirected(edges, distinct=False), "core-edges", "dst")
    start = both.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("core"))

    def step(now: DataFrame) -> DataFrame:
        counts = both.join(now, both["dst"] == now["node"]).groupBy("src", "core").agg(F.count(F.lit(1)).alias("n"))
        above = W.partitionBy("src").orderBy(F.desc("core"))
        h = counts.withColumn("upto", F.sum("n").over(above)).groupBy(F.col("src").alias("node")).agg(F.max(F.least("core", "upto")).alias("h"))
        return now.join(h, "node").select("node", F.least("core", "h").alias("core"))

    return nodes.join(fixpoint(start, step, "core"), "node", "left").select("node", F.coalesce("core", F.lit(0)).alias("core"))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5, held: int = HELD, ready: bool = False) -> DataFrame:
    """node, label after so many synchronous rounds: each node takes its neighbours' most frequent label, the smallest of those. Components
    of `held` edges at most are worked out in the task that holds them, larger ones by wide_label_propagation."""
    def run(c, src, dst):
        (a, b), node = numbers(src, dst)
        a, b = np.concatenate([a, b]), np.concatenate([b, a])
        label = np.arange(len(node))
        for _ in range(rounds):
            pair, n = np.unique(a * len(node) + label[b], return_counts=True)
            own, at = np.divmod(pair, len(node))
            order = np.lexsort((at, -n, own))
            own, at = own[order], at[order]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            label = label.copy()
            label[own[first]] = at[first]
        yield node, node[label]

    small, big = parted(edges.select("src", "dst"), held, ready)
    kind = edges.schema["src"].dataType.simpleString()
    got = worked(small, ["src", "dst"], run, f"node {kind}, label {kind}", held)
    if big is not None:
        own = big.select("src", "dst")
        got = got.unionByName(wide_label_propagation(nodes_of(own), own, rounds))
    return nodes.join(got, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def wide_label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 5) -> DataFrame:
    """The same in joins."""
    both = staged_by(undirected(edges, distinct=False), "lpa-edges", "dst")
    now = nodes.select("node", F.col("node").alias("label"))
    for k in range(rounds):
        counts = both.join(now, both["dst"] == now["node"]).groupBy("src", "label").agg(F.count(F.lit(1)).alias("n"))
        best = counts.groupBy(F.col("src").alias("node")).agg(F.max_by("label", F.struct("n", -F.col("label"))).alias("best"))
        now = now.join(best, "node", "left").select("node", F.coalesce("best", "label").alias("label"))
        if k % 2 or k == rounds - 1:
            now = staged(now, "lpa")
    return now


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: q of the labels on both directions of every edge; reciprocal edges count twice."""
    both = undirected(edges, distinct=False)
    m = both.join(labels.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst")
    per = m.groupBy("a").agg(F.count(F.lit(1)).alias("out"), F.sum((F.col("a") == F.col("b")).cast("long")).alias("own"))
    total = per.agg(F.sum("out").alias("total"))
    return per.crossJoin(total).agg(F.sum(F.col("own") / F.col("total") - (F.col("out") / F.col("total")) * (F.col("out") / F.col("total"))).alias("q"))


def spanning_forest(both: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Tree edges (src, dst), src < dst, of a spanning forest, and the tables (c, p) that, one after the other, bring each node to the node
    that its tree is named by. Each component takes the first of its edges, in the order of a hash, to another (Boruvka); components that
    hang together by that become one by pointer jumping. The number of components falls to half or less in a round."""
    live = staged(both.where("src < dst").select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"), F.xxhash64("src", "dst").alias("h")), "forest-live")
    trees, maps = [], []
    while not live.isEmpty():
        ends = live.select("h", "src", "dst", F.col("a").alias("c"), F.col("b").alias("o")).unionAll(live.select("h", "src", "dst", F.col("b").alias("c"), F.col("a").alias("o")))
        pick = staged(ends.groupBy("c").agg(F.min(F.struct("h", "src", "dst", "o")).alias("m")).select("c", "m.src", "m.dst", "m.o"), "forest-pick")
        trees.append(pick.select("src", "dst").distinct())
        back = pick.select(F.col("c").alias("o"), F.col("o").alias("c"), F.lit(True).alias("mutual"))  # two that take the same edge: the smaller leads
        start = pick.join(back, ["c", "o"], "left").select("c", F.when(F.col("mutual") & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p"))

        def jump(now: DataFrame) -> DataFrame:
            return now.join(now.select(F.col("c").alias("p"), F.col("p").alias("pp")), "p").select("c", F.col("pp").alias("p"))

        led = fixpoint(start, jump, "forest-lead")
        maps.append(led)
        moved = live.join(led.select(F.col("c").alias("a"), F.col("p").alias("pa")), "a").join(led.select(F.col("c").alias("b"), F.col("p").alias("pb")), "b")
        last, live = live, staged(moved.where("pa <> pb").select("src", "dst", F.col("pa").alias("a"), F.col("pb").alias("b"), "h"), "forest-live")
        drop(last)
    return (union(trees) if trees else both.select("src", "dst").limit(0)), maps


def tree_order(tree: DataFrame, maps: list[DataFrame]) -> DataFrame:
    """node, parent (null for roots), pre and size for all nodes of a forest: a preorder number from 0 over all trees, and how many nodes the
    subtree has, so that it holds the numbers from pre to pre + size - 1. Found by an Euler tour of each tree, whose arcs are put in order by
    pointer jumping: nothing depends on the depth of a tree, and no node's neighbours are gathered."""
    arcs = tree.select("src", "dst").unionAll(tree.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    arcs = staged(numbered(arcs, ["src", "dst"], "i"), "euler-arcs")
    first = arcs.groupBy("src").agg(F.min("i").alias("first"))
    succ = arcs.join(arcs.select((F.col("i") - 1).alias("i"), F.col("src").alias("same"), F.col("i").alias("next")), "i", "left").join(first, "src")
    succ = succ.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.when(F.col("same") == F.col("src"), F.col("next")).otherwise(F.col("first")).alias("to"))  # of the arc back
    named = first.select("src", F.col("src").alias("root"))
    for m in maps:
        named = named.join(m.select(F.col("c").alias("root"), F.col("p").alias("up")), "root", "left").select("src", F.coalesce("up", "root").alias("root"))
    named = staged(named, "euler-roots")
    start = first.join(named.where("src = root"), "src").select(F.col("first").alias("to"), F.lit(True).alias("start"))
    # an arc before the first of its tree is the last one
    ring = arcs.join(succ, ["src", "dst"]).join(start, "to", "left").select("i", F.when(F.col("start"), F.col("i")).otherwise(F.col("to")).alias("to"), F.when(F.col("start"), 0).otherwise(1).cast("long").alias("d"))

    def jump(now: DataFrame) -> DataFrame:
        ahead = now.select(F.col("i").alias("to"), F.col("to").alias("then"), F.col("d").alias("more"))
        return now.join(ahead, "to").select("i", F.col("then").alias("to"), (F.col("d") + F.col("more")).alias("d"))

    left = fixpoint(ring, jump, "euler-rank").select("i", "d")
    at = staged(arcs.join(left, "i").join(named, "src").select("src", "dst", "root", "d"), "euler-at")
    up = at.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("d").alias("d_up"))
    down = at.join(up, ["src", "dst"]).where("d > d_up").select(F.col("dst").alias("node"), F.col("src").alias("parent"), "root", "d", ((F.col("d") - F.col("d_up") + 1) / 2).cast("long").alias("size"))
    sizes = named.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    tops = sizes.select(F.col("root").alias("node"), F.lit(None).cast(tree.schema["src"].dataType).alias("parent"), "root", F.lit(2**62).alias("d"), "size")
    return numbered(tops.unionByName(down), ["root", F.desc("d")], "pre").select("node", "parent", "pre", "size")


def over_subtrees(forest: DataFrame) -> DataFrame:
    """forest (node, pre, size, low, high) -> node and the least `low` and the greatest `high` in each node's subtree: intervals of the
    preorder are covered by two stretches of a power of two, and stretches come from two of half their length."""
    now = staged(forest.select("pre", "low", "high"), "range-0")
    asked = staged(forest.select("node", "pre", "size", F.floor(F.log2(F.col("size") + F.lit(0.5))).cast("int").alias("k")), "range-asked")
    deepest = asked.agg(F.max("k")).first()[0] or 0
    out = []
    for k in range(deepest + 1):
        own = asked.where(F.col("k") == k)
        end = own.withColumn("at", F.col("pre") + F.col("size") - (1 << k)).join(now.select(F.col("pre").alias("at"), F.col("low").alias("low2"), F.col("high").alias("high2")), "at")
        out.append(end.join(now, "pre").select("node", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
        if k < deepest:
            other = now.select((F.col("pre") - (1 << k)).alias("pre"), F.col("low").alias("low2"), F.col("high").alias("high2"))
            now = staged(now.join(other, "pre", "left").select("pre", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")), f"range-{k + 1}")
    return union(out)


def _cut_edges(a: list[int], b: list[int], n: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Bridges and articulation points of a simple undirected graph over the numbers below n, by one depth-first walk (Tarjan)."""
    near: list[list[int]] = [[] for _ in range(n)]
    for x, y in zip(a, b, strict=True):
        near[x].append(y)
        near[y].append(x)
    seen, low, up = [0] * n, [0] * n, [-1] * n
    bridges, cut, t = [], [False] * n, 0
    for root in range(n):
        if seen[root]:
            continue
        t += 1
        seen[root] = low[root] = t
        todo, children = [root], 0
        while todo:
            v = todo[-1]
            if near[v]:
                w = near[v].pop()
                if not seen[w]:
                    t += 1
                    seen[w] = low[w] = t
                    up[w] = v
                    todo.append(w)
                elif w != up[v] and seen[w] < low[v]:
                    low[v] = seen[w]
            else:
                todo.pop()
                p = up[v]
                if p < 0:
                    continue
                low[p] = min(low[p], low[v])
                if low[v] > seen[p]:
                    bridges.append((p, v))
                if p == root:
                    children += 1
                elif low[v] >= seen[p]:
                    cut[p] = True
        cut[root] = children > 1
    return bridges, [v for v in range(n) if cut[v]]


def _cuts_of_pieces(c, src, dst):
    (a, b), node = numbers(src, dst)
    pair = np.unique(np.minimum(a, b) * len(node) + np.maximum(a, b))
    bridges, cut = _cut_edges((pair // len(node)).tolist(), (pair % len(node)).tolist(), len(node))
    ends = np.sort(np.array(bridges, np.int64).reshape(-1, 2), axis=1)
    yield np.full(len(ends), True), node[ends[:, 0]], node[ends[:, 1]]
    yield np.full(len(cut), False), node[cut], node[cut]


def bridges_and_cuts(nodes: DataFrame, edges: DataFrame, held: int = HELD, ready: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bridges (a, b), a < b, and articulation points (node) of the simple undirected graph: components of `held` edges at most by a
    depth-first walk in the task that holds them, larger ones by wide_bridges_and_cuts."""
    small, big = parted(edges.select("src", "dst"), held, ready)
    kind = edges.schema["src"].dataType.simpleString()
    got = staged(worked(small, ["src", "dst"], _cuts_of_pieces, f"bridge boolean, a {kind}, b {kind}", held), "cuts")
    bridges, cuts = got.where("bridge").select("a", "b"), got.where("NOT bridge").select(F.col("a").alias("node"))
    if big is None:
        return bridges, cuts
    more, others = wide_bridges_and_cuts(nodes, big.select("src", "dst"))
    return bridges.unionByName(more), cuts.unionByName(others)


def wide_bridges_and_cuts(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bridges (a, b), a < b, and articulation points (node) of the simple undirected graph, after Tarjan and Vishkin: on any spanning forest
    in preorder, a tree edge is a bridge if no other edge leaves the subtree below it; tree edges are of one block if they are joined by
    another edge between subtrees, or by one that leaves the parent's subtree; a node cuts if its tree edges are of more than one block.
    The number of rounds grows with the logarithm of the graph, whatever its diameter."""
    both = staged(undirected(edges), "cut-edges")
    tree, maps = spanning_forest(both)
    tree = staged(tree, "cut-tree")
    at = staged(tree_order(tree, maps), "cut-order")
    a, b = at.select(F.col("node").alias("src"), F.col("pre").alias("pa"), F.col("size").alias("sa")), at.select(F.col("node").alias("dst"), F.col("pre").alias("pb"), F.col("size").alias("sb"))
    other = staged(both.where("src < dst").join(tree, ["src", "dst"], "left_anti").join(a, "src").join(b, "dst"), "cut-other")
    ends = other.select(F.col("src").alias("node"), F.col("pb").alias("p")).unionAll(other.select(F.col("dst").alias("node"), F.col("pa").alias("p"))).groupBy("node").agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    own = at.join(ends, "node", "left").select("node", "pre", "size", F.least("pre", "lo").alias("low"), F.greatest("pre", "hi").alias("high"))
    full = staged(at.join(over_subtrees(own), "node"), "cut-full")
    leaves = lambda p, n: (F.col("low") < p) | (F.col("high") >= p + n)
    below = full.where("parent IS NOT NULL")
    bridges = below.where(~leaves(F.col("pre"), F.col("size"))).select(F.least("node", "parent").alias("a"), F.greatest("node", "parent").alias("b"))
    # tree edges, named by their lower ends, that are of one block
    apart = other.where("(pa < pb AND pb >= pa + sa) OR (pb < pa AND pa >= pb + sb)").select("src", "dst")
    above = below.select(F.col("node").alias("parent"), F.col("pre").alias("pp"), F.col("size").alias("ps"))
    joined = below.join(above, "parent").where(leaves(F.col("pp"), F.col("ps"))).select(F.col("node").alias("src"), F.col("parent").alias("dst"))
    block = staged(weak_components(below.select("node"), apart.unionAll(joined)), "cut-blocks")
    met = below.join(block, "node").select(F.col("parent").alias("node"), "component").unionAll(block.select("node", "component"))
    cuts = met.distinct().groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("node")
    return staged(bridges, "bridges"), staged(cuts, "cuts")


def _levels_of_pieces(c, src, dst):
    (a, b), node = numbers(src, dst)
    depth, k = np.full(len(node), -1), 0
    while True:
        open_ = np.zeros(len(node), bool)
        open_[b] = True
        ready = (depth < 0) & ~open_
        if not ready.any():
            break
        depth[ready] = k
        left = depth[a] < 0
        a, b, k = a[left], b[left], k + 1
    yield node, depth


def dag_levels(nodes: DataFrame, edges: DataFrame, held: int = HELD) -> DataFrame:
    """node, depth by repeatedly taking nodes without open predecessors; nodes on or behind a cycle are never taken and have none.
    Components of `held` edges at most are worked out in the task that holds them, larger ones by wide_dag_levels."""
    e = staged(edges.where("src <> dst").join(nodes.select(F.col("node").alias("src")), "src", "left_semi").select("src", "dst"), "dag-edges")
    small, big = parted(e, held, ready=True)
    found = worked(small, ["src", "dst"], _levels_of_pieces, f"node {edges.schema['src'].dataType.simpleString()}, depth long", held)
    if big is not None:
        own = big.select("src", "dst")
        ends = own.select(F.col("src").alias("node")).union(own.select("dst")).distinct()
        deep = ends.join(wide_dag_levels(ends, own), "node", "left")
        found = found.unionByName(deep.select("node", F.coalesce(F.col("depth").cast("long"), F.lit(-1)).alias("depth")))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("depth", F.lit(0)).cast("int").alias("depth")).where("depth >= 0")


def wide_dag_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, depth by repeatedly taking nodes without open predecessors; nodes on or behind a cycle are never taken and have none."""
    e = edges.where("src <> dst").distinct()
    left, out, k = staged(nodes.select("node"), "dag"), [], 0
    while True:
        own = left.withColumnRenamed("node", "src")
        ready = staged(left.join(e.join(own, "src", "left_semi").select(F.col("dst").alias("node")), "node", "left_anti"), "dag-ready")
        if ready.isEmpty():
            break
        out.append(ready.select("node", F.lit(k).alias("depth")))
        left, k = staged(left.join(ready, "node", "left_anti"), "dag"), k + 1
    return union(out) if out else nodes.select("node", F.lit(0).alias("depth")).limit(0)
