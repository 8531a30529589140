"""Graph programs against plain walks on small random graphs and on graphs that tell right from wrong."""

import random
from collections import Counter, deque

import pytest
from pyspark.sql import functions as F

from quaymaster.operators import cohesion as C
from quaymaster.operators import graph as G
from quaymaster.operators import rank as RK
from quaymaster.operators import structure as ST
from quaymaster.operators import traverse as T

GRAPHS = {
    "diamond": (4, [(0, 1), (0, 2), (1, 3), (2, 3)]), "star": (6, [(0, i) for i in range(1, 6)]), "cycle and tail": (5, [(0, 1), (1, 2), (2, 0), (2, 3)]), "pair": (3, [(0, 1), (1, 0)]),
    "bow tie": (5, [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 2)]),
}
for _seed, (_n, _m) in enumerate([(14, 16), (18, 30), (25, 27)]):
    _r = random.Random(_seed)
    GRAPHS[f"random {_seed}"] = (_n, sorted({(_r.randrange(_n), _r.randrange(_n)) for _ in range(_m)}))


@pytest.fixture(params=list(GRAPHS), ids=lambda x: x)
def graph(request, spark):
    n, e = GRAPHS[request.param]
    return n, e, spark.createDataFrame([(i,) for i in range(n)], "node long"), spark.createDataFrame([x for x in e] or [(0, 0)], "src long, dst long")


def reach(n, adj, s):
    seen, q = {s}, deque([s])
    while q:
        for w in adj.get(q.popleft(), ()):
            if w not in seen:
                seen.add(w)
                q.append(w)
    return seen


def adjacency(edges, both=False):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        if both:
            out.setdefault(b, set()).add(a)
    return {k: sorted(v) for k, v in out.items()}


def test_components(graph):
    n, e, nodes, edges = graph
    und, fwd = adjacency(e, True), adjacency(e)
    assert {r.node: r.component for r in C.weak_components(nodes, edges).collect()} == {v: min(reach(n, und, v)) for v in range(n)}
    r = {v: reach(n, fwd, v) for v in range(n)}
    assert {x.node: x.component for x in C.strong_components(nodes, edges).collect()} == {v: min(w for w in r[v] if v in r[w]) for v in range(n)}


def test_coreness(graph):
    n, e, nodes, edges = graph
    multi = [(a, b) for a, b in e if a != b]
    left, want, k = set(range(n)), {}, 0
    while left:
        deg = Counter(x for a, b in multi if a in left and b in left for x in (a, b))
        low = [v for v in left if deg[v] <= k]
        if not low:
            k += 1
        for v in low:
            want[v] = k
            left.discard(v)
    assert {r.node: r.core for r in C.coreness(nodes, edges).collect()} == want


def test_bridges_and_articulation_points(graph):
    n, e, nodes, edges = graph
    simple = {(min(a, b), max(a, b)) for a, b in e if a != b}

    def count(vs, es):
        adj, seen, c = adjacency(es, True), set(), 0
        for v in vs:
            if v not in seen:
                c += 1
                seen |= reach(n, adj, v)
        return c

    base = count(range(n), simple)
    bridges, cuts = C.bridges_and_cuts(nodes, edges)
    assert {(r.a, r.b) for r in bridges.collect()} == {x for x in simple if count(range(n), simple - {x}) > base}
    isolated = {v for v in range(n) if not any(v in x for x in simple)}
    want = {v for v in range(n) if v not in isolated and count([w for w in range(n) if w != v], {x for x in simple if v not in x}) > base}
    assert {r.node for r in cuts.collect()} == want


def test_betweenness(graph, spark):
    n, e, nodes, edges = graph
    adj = adjacency([(a, b) for a, b in e if a != b])
    want = Counter()
    for s in range(n):
        dist, sigma, order, q = {s: 0}, Counter({s: 1.0}), [], deque([s])
        while q:
            v = q.popleft()
            order.append(v)
            for w in adj.get(v, ()):
                if w not in dist:
                    dist[w] = dist[v] + 1
                    q.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = Counter()
        for w in reversed(order):
            for v in order:
                if w in adj.get(v, ()) and dist[w] == dist[v] + 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                want[w] += delta[w]
    got = {r.node: r.betweenness for r in RK.betweenness(nodes, edges, nodes).collect()}
    assert all(abs(got[v] - want[v] / max((n - 1) * (n - 2), 1)) < 1e-9 for v in range(n))


def test_walk_keeps_the_queue_order(graph, spark):
    n, e, nodes, edges = graph
    adj = adjacency(e)
    want = {}
    for s in range(n):
        seen, q = {s: (s,)}, deque([s])
        while q:
            v = q.popleft()
            for w in adj.get(v, ()):
                if w not in seen:
                    seen[w] = (*seen[v], w)
                    q.append(w)
        want |= {(s, v): p for v, p in seen.items()}
    got = {(r.root, r.node): tuple(r.hops) for r in T.walk(nodes.select(F.col("node").alias("root"), "node"), edges, 50, hops=True).collect()}
    assert got == want


def test_pagerank_directions(spark):
    nodes, edges = spark.createDataFrame([(i,) for i in range(6)], "node long"), spark.createDataFrame([(i, 0) for i in range(1, 6)], "src long, dst long")
    to = {r.node: r.rank for r in RK.pagerank(nodes, edges, direction="dependencies").collect()}
    assert max(to, key=to.get) == 0 and abs(sum(to.values()) - 1) < 1e-9
    back = {r.node: r.rank for r in RK.pagerank(nodes, edges).collect()}
    assert min(back, key=back.get) == 0


def test_modularity_and_labels(spark):
    e = [(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)]
    nodes, edges = spark.createDataFrame([(i,) for i in range(6)], "node long"), spark.createDataFrame(e, "src long, dst long")
    labels = spark.createDataFrame([(i, i // 3) for i in range(6)], "node long, label long")
    assert abs(C.modularity(edges, labels).first()[0] - (6 / 7 - 0.5)) < 1e-9
    assert {r.label for r in C.label_propagation(nodes, edges, 5).collect()} <= set(range(6))


def test_dag_levels_stop_at_cycles(spark):
    nodes, edges = spark.createDataFrame([(i,) for i in range(5)], "node long"), spark.createDataFrame([(4, 0), (0, 1), (1, 2), (2, 0), (2, 3)], "src long, dst long")
    assert {r.node: r.depth for r in C.dag_levels(nodes, edges).collect()} == {4: 0}
    dag = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (0, 3)], "src long, dst long")
    assert {r.node: r.depth for r in C.dag_levels(nodes.where("node < 4"), dag).collect()} == {0: 0, 1: 1, 2: 1, 3: 2}


def test_powerlaw_test_tells_laws_apart(spark):
    import numpy as np

    rng = np.random.default_rng(7)
    law = np.floor(1.5 * (1 - rng.random(3000)) ** (-1 / 1.5) + 0.5)
    poisson = rng.poisson(5, 3000)
    for x, plausible in ((law, True), (poisson, False)):
        k, c = np.unique(x[x >= 1], return_counts=True)
        hist = spark.createDataFrame([(int(a), int(b)) for a, b in zip(k, c, strict=True)], "k long, c long")
        p = ST.powerlaw_gof(hist, replicas=40).first().p_value
        assert (p >= 0.1) == plausible


def test_gini(spark):
    d = spark.createDataFrame([(x,) for x in (0, 0, 0, 10)], "x long")
    assert abs(RK.gini(d, "x").first()[0] - 0.75) < 1e-9
    assert RK.gini(spark.createDataFrame([(0,), (0,)], "x long"), "x").first()[0] == 0.0


def test_package_graph_has_no_loops(spark):
    v = spark.createDataFrame([(0, 0), (1, 0), (2, 1)], "ver_id long, pkg_id long")
    r = spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "ver_id long, res_ver_id long")
    assert [tuple(x) for x in G.package_graph(r, v).collect()] == [(0, 1)]


def test_running_sums_over_a_total_order(spark):
    from quaymaster.operators.order import cumulative, numbered

    rnd = random.Random(4)
    x = [(rnd.randrange(20), i) for i in range(500)]
    df = spark.createDataFrame(x, "x long, i long").repartition(7)
    want, total = {}, 0
    for k, (v, i) in enumerate(sorted(x)):
        total += v
        want[i] = (k, total)
    got = {r.i: (r.k, r.s) for r in cumulative(numbered(df, ["x", "i"], "k"), ["x", "i"], {"s": F.col("x")}).collect()}
    assert got == want and numbered(df.limit(0), ["x"], "k").count() == 0


def test_core_nodes(spark):
    from quaymaster.operators.rank import core_nodes

    cores = spark.createDataFrame([(i, 1) for i in range(5)] + [(i, 2) for i in range(5, 605)] + [(i, 3) for i in range(605, 615)], "node long, core long")
    edges = spark.createDataFrame([(605 + i, 605 + j) for i in range(10) for j in range(i)] + [(612, 5), (607, 6)], "src long, dst long")
    ids = lambda most: sorted(r.node for r in core_nodes(cores, edges, most).collect())
    assert ids(40_000) == ids(610) == list(range(5, 615)) and ids(609) == ids(10) == list(range(605, 615)) and ids(2) == [607, 612]
    assert core_nodes(cores.where("core < 2"), edges).count() == 0


def test_trajectory_runs_all_rounds():
    import inspect

    from quaymaster.operators.temporal import trajectory
    from quaymaster.plans import catalog_graph

    assert inspect.signature(trajectory).parameters["rounds"].default == 25 and "rounds=10" not in inspect.getsource(catalog_graph)
