"""Work on whole components against programs that hold none, and both against plain walks."""

import random

import pytest
from pyspark.sql import functions as F

from quaymaster.operators import cohesion as C
from quaymaster.operators import pieces
from quaymaster.operators import temporal as TM


def draw(seed, n, m):
    r = random.Random(seed)
    return sorted({(r.randrange(n) * 7, r.randrange(n) * 7) for _ in range(m)})


def roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("held", [7, 1 << 20])
@pytest.mark.parametrize("n, m", [(60, 40), (40, 300)])
def test_stars(spark, held, n, m):
    every = {k: draw(k, n, m) for k in (1, 2)}
    df = spark.createDataFrame([(k, *e) for k, own in every.items() for e in own], "k int, src long, dst long")
    got = {(r.k, r.node): r.root for r in pieces.stars(df, ["k"], held).collect()}
    assert got == {(k, x): y for k, own in every.items() for x, y in roots([e for e in own if e[0] != e[1]]).items()}


def test_stars_of_texts(spark):
    df = spark.createDataFrame([("b", "a"), ("c", "b"), ("é", "z")], "src string, dst string")
    for held in (1, 10):
        assert {r.node: r.root for r in pieces.stars(df, [], held).collect()} == {"a": "a", "b": "a", "c": "a", "z": "z", "é": "z"}


@pytest.mark.parametrize("seed", [3])
def test_pieces_and_wide_programs_agree(spark, seed):
    e = draw(seed, 90, 85)
    edges = spark.createDataFrame(e, "src long, dst long")
    nodes = spark.range(0, 700, 7).withColumnRenamed("id", "node")
    by = {held: [sorted(map(tuple, x.collect())) for x in C.bridges_and_cuts(nodes, edges, held)] for held in (5, 1 << 20)}
    assert by[5] == by[1 << 20] and by[5][0] and by[5][1]
    levels = [sorted(map(tuple, C.dag_levels(nodes, edges, held).collect())) for held in (5, 1 << 20)]
    assert levels[0] == levels[1] == sorted(map(tuple, C.wide_dag_levels(nodes, edges).collect()))


def test_snapshots(spark):
    e = [(a, b, 1990 + i % 10) for i, (a, b) in enumerate(draw(5, 50, 70)) if a != b]
    edges = spark.createDataFrame([(a, b, float(t)) for a, b, t in e], "src long, dst long, t double")
    cuts = [1980.0, 1993.0, 1997.0, 1999.5]
    want = {}
    for c in cuts:
        own = [(a, b) for a, b, t in e if t <= c]
        r = list(roots(own).values())
        want[c] = (len(r), len(own), max(map(r.count, r), default=0))
    assert {r.cut: (r.v, r.e, r.largest) for r in TM.snapshots(edges, cuts).collect()} == want
    for held in (3,):
        assert {r.cut: r.largest for r in TM.largest(edges, cuts, held).collect()} == {c: x[2] for c, x in want.items()}
    # nothing about components is worked out where only nodes and edges are asked for
    assert TM.sizes(edges, cuts).columns == ["cut", "v", "e"]


def test_rounds_fall_with_the_edges(spark, monkeypatch):
    # a path is a hard case for one that passes labels on from neighbour to neighbour
    path = spark.range(0, 300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    seen = []
    monkeypatch.setattr(pieces, "staged", lambda df, name, own=pieces.staged: seen.append(name) or own(df, name))
    assert pieces.stars(path, [], held=100).agg(F.max("root"), F.count("node")).first()[:] == (0, 301)
    assert seen.count("hang") <= 6


def test_betweenness_of_pieces(spark):
    from quaymaster.operators import rank as RK

    e = draw(9, 60, 90)
    edges, nodes = spark.createDataFrame(e, "src long, dst long"), spark.range(0, 420, 7).withColumnRenamed("id", "node")
    some = nodes.where("node % 2 = 0")
    for pivots in (nodes, some):
        want = {r.node: r[1:] for r in RK.betweenness(nodes, edges, pivots, cutoff=4).collect()}
        assert any(b for b, _ in want.values())
        got = {r.node: r[1:] for r in RK.betweenness(nodes, edges, pivots, cutoff=4, many=0).collect()}
        assert got.keys() == want.keys() and all(got[x] == pytest.approx(y) for x, y in want.items())
    # a component that is too large for one task goes through the loops
    big = {r.node: r[1:] for r in RK.betweenness(nodes, edges, some, cutoff=4, many=0, held=20).collect()}
    assert all(big[x] == pytest.approx(y) for x, y in want.items())


def test_flows_of_a_hub():
    import numpy as np

    from quaymaster.operators import rank as RK

    # 300 nodes point to a hub, it points to 300 others: all shortest paths between them go through it
    a, b = np.r_[1:301, np.zeros(300, int)], np.r_[np.zeros(300, int), 301:601]
    total, far = RK._flows(a, b, 601, np.arange(601), np.arange(601), np.zeros(601, int), 4)
    assert total[0] == 300 * 300 and not total[1:].any() and far[1] == 1 + 150 and far[0] == 300 and far[301] == 0


def test_the_whole_core_counts(spark):
    from quaymaster.operators import rank as RK

    cores = spark.createDataFrame([(i, 2 + i % 3) for i in range(50_000)] + [(60_000, 1)], "node long, core long")
    assert RK.core_nodes(cores, cores.select(F.col("node").alias("src"), F.col("node").alias("dst"))).count() == 50_000


def test_cores_and_labels_of_pieces(spark):
    e = draw(11, 60, 75)
    edges, nodes = spark.createDataFrame(e, "src long, dst long"), spark.range(0, 490, 7).withColumnRenamed("id", "node")
    assert {r.node: r.core for r in C.coreness(nodes, edges).collect() if r.core} == {r.node: r.core for r in C.wide_coreness(nodes, edges).collect() if r.core}
    assert sorted(map(tuple, C.label_propagation(nodes, edges, 3).collect())) == sorted(map(tuple, C.wide_label_propagation(nodes, edges, 3).collect()))


def test_ranks_of_pieces(spark):
    from quaymaster.operators import rank as RK

    edges, nodes = spark.createDataFrame(draw(11, 60, 75), "src long, dst long"), spark.range(0, 490, 7).withColumnRenamed("id", "node")
    cut = [F.explode(F.array(F.lit(1.0), F.lit(2.0))).alias("cut")]
    keyed, every = edges.select("*", *cut).where("cut = 1 OR src % 3 = 0"), nodes.select("*", *cut)
    got, want = ({(r.cut, r.node): r.rank for r in f(every, keyed, rounds=3, tolerance=None, keys=["cut"]).collect()} for f in (RK.pagerank, RK.wide_pagerank))
    assert got == pytest.approx(want, abs=1e-12)


def test_quantiles(spark):
    from quaymaster.operators import structure as ST

    r = random.Random(2)
    df = spark.createDataFrame([(r.choice([r.random() * 100, 5.0, 7.25, None]),) for _ in range(501)], "v double")
    at = {"a": 0.0, "b": 0.5, "c": 0.9, "d": 0.99, "e": 1.0}
    assert ST.quantiles(df, "v", at).first() == df.agg(*[F.expr(f"percentile(v, {q})").alias(k) for k, q in at.items()]).first()
    assert ST.quantiles(df.limit(0), "v", at).first()[:] == (None,) * 5
