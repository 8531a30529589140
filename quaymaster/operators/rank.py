"""Centralities, ranks and inequality."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import staged, staged_by
from .graph import undirected
from .iterate import levels, union
from .order import cumulative, numbered
from .pieces import HELD, numbers, parted, worked


def _shares(damping: float, rounds: int, n: float, loose: list[float]) -> list[float]:
    """What every node gets in each round besides its neighbours' mass. loose[i]: the sum, over the nodes without a way out, of what is left of a
    mass of one on every node after i rounds of flow."""
    share: list[float] = []
    for k in range(rounds):
        lost = sum(share[k - 1 - i] * damping**i * loose[i] for i in range(k)) + damping**k * loose[k] / n
        share.append((1 - damping + damping * lost) / n)
    return share


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 40, tolerance: float | None = 1e-9, direction: str = "dependents", keys: list[str] | None = None, held: int = HELD, ready: bool = False) -> DataFrame:
    """node, rank. direction 'dependents': mass flows from a package to those that depend on it; 'dependencies': the other way.
    Nodes without a way out give their mass to all. With keys (one at most), one ranking for each key.

    Components meet only in the mass that all nodes share. It follows from sums that each component gives on its own, so components of
    `held` edges at most are worked out in the task that holds them: first their sums for all rounds, then, with the shares known, their
    ranks. Where a component is larger, wide_pagerank ranks all of them."""
    keys = keys or []
    (src, dst), key = ("dst", "src") if direction == "dependents" else ("src", "dst"), F.col(keys[0]).cast("string") if keys else F.lit("")
    own = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"), key.alias("k"))
    if not ready:
        own = staged(own, "pr-own")
    small, big = parted(own, held, ready=True, loops=True)
    if big is not None:
        return wide_pagerank(nodes, edges, damping, rounds, tolerance, direction, keys)
    kind = edges.schema["src"].dataType.simpleString()
    sizes = {r["k"]: r["n"] for r in nodes.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each key

    def graphs(src, dst, k):
        for name in sorted(set(k)):
            at = k == name
            (a, b), node = numbers(src[at], dst[at])
            deg = np.bincount(a, minlength=len(node))
            yield name, a, b, node, deg, lambda x, a=a, b=b, deg=deg, n=len(node): np.bincount(b, x[a] / deg[a], n)

    def sums(c, src, dst, k):
        for name, _, _, node, deg, flow in graphs(src, dst, k):
            x, loose = np.ones(len(node)), []
            for _ in range(rounds):
                loose.append(float(x[deg == 0].sum()))
                x = flow(x)
            yield [name], [len(node)], [loose]

    got = worked(small, ["src", "dst", "k"], sums, "k string, n long, loose array<double>", held)
    got = got.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col("loose")[i]).alias(f"l{i}") for i in range(rounds)]).collect()  # a row for each key
    met = {r["k"]: (r["n"], [r[f"l{i}"] for i in range(rounds)]) for r in got}
    shares = {}
    for name, n in sizes.items():
        inside, loose = met.get(name, (0, [0.0] * rounds))
        shares[name] = _shares(damping, rounds, n, [x + (n - inside if i == 0 else 0) for i, x in enumerate(loose)])  # nodes without edges

    def ranked(upto, tell):
        def run(c, src, dst, k):
            for name, _, _, node, _, flow in graphs(src, dst, k):
                x, gaps = np.full(len(node), 1 / sizes[name]), []
                for i in range(upto):
                    x, last = shares[name][i] + damping * flow(x), x
                    if i % 5 == 4:
                        gaps.append(float(np.abs(x - last).sum()))
                yield ([name], [len(node)], [gaps]) if tell else (np.full(len(node), name), node, x)

        return run

    upto = rounds
    if tolerance is not None:
        checks = [i for i in range(rounds) if i % 5 == 4]
        got = worked(small, ["src", "dst", "k"], ranked(rounds, True), "k string, n long, gaps array<double>", held)
        gaps = got.agg(*[F.coalesce(F.sum(F.col("gaps")[i]), F.lit(0.0)).alias(f"g{i}") for i in range(len(checks))]).first() if checks else []
        for i, at in enumerate(checks):
            alone = sum((n - met.get(name, (0,))[0]) * abs(shares[name][at] - (shares[name][at - 1] if at else 1 / n)) for name, n in sizes.items())
            if gaps[i] + alone < tolerance:
                upto = at + 1
                break
    got = worked(small, ["src", "dst", "k"], ranked(upto, False), f"k string, node {kind}, rank double", held)
    base = nodes.select(*keys, "node", key.alias("k")).join(got, ["k", "node"], "left")
    rest = F.create_map(*[F.lit(x) for name, s in shares.items() for x in (name, s[upto - 1] if upto else 1 / sizes[name])])[F.col("k")] if shares else F.lit(None).cast("double")
    base = staged(base.select("k", *keys, "node", F.coalesce("rank", rest).alias("rank")), "pr")
    total = base.groupBy("k").agg(F.sum("rank").alias("total"))
    return base.join(F.broadcast(total), "k").select(*keys, "node", (F.col("rank") / F.col("total")).alias("rank"))


def wide_pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 40, tolerance: float | None = 1e-9, direction: str = "dependents", keys: list[str] | None = None) -> DataFrame:
    """The same in joins, whatever the size of a component."""
    keys = keys or []
    if direction == "dependents":
        edges = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    out = edges.groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("deg"))
    e = staged_by(edges.join(out, [*keys, "src"]).select(*keys, "src", "dst", "deg"), "pr-edges", *keys, "src")
    sizes = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")) if keys else nodes.agg(F.count(F.lit(1)).alias("n"))
    base = nodes.join(sizes, keys) if keys else nodes.crossJoin(sizes)
    base = staged(base.join(out.withColumnRenamed("src", "node"), [*keys, "node"], "left").select(*keys, "node", "n", F.col("deg").isNull().alias("dangling")), "pr-nodes")
    now = base.select("*", (F.lit(1.0) / F.col("n")).alias("rank"))
    for k in range(rounds):
        flow = e.join(now.select(*keys, F.col("node").alias("src"), "rank"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("deg")).alias("got"))
        loose = now.where("dangling").groupBy(*keys).agg(F.sum("rank").alias("loose"))
        new = now.join(flow, [*keys, "node"], "left")
        new = new.join(loose, keys, "left") if keys else new.crossJoin(now.agg(F.sum(F.when(F.col("dangling"), F.col("rank"))).alias("loose")))
        share = (F.lit(1.0 - damping) + F.lit(damping) * F.coalesce("loose", F.lit(0.0))) / F.col("n")
        new = new.select(*keys, "node", "n", "dangling", (share + F.lit(damping) * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("last"))
        if tolerance is not None and k % 5 == 4 or k % 3 == 2 or k == rounds - 1:
            new = staged(new, "pr")
            if tolerance is not None and (new.agg(F.sum(F.abs(F.col("rank") - F.col("last")))).first()[0] or 0) < tolerance:
                now = new.drop("last")
                break
        now = new.drop("last")
    total = now.groupBy(*keys).agg(F.sum("rank").alias("total")) if keys else now.agg(F.sum("rank").alias("total"))
    now = now.join(total, keys) if keys else now.crossJoin(total)
    return now.select(*keys, "node", (F.col("rank") / F.col("total")).alias("rank"))


def gini(df: DataFrame, column: str) -> DataFrame:
    """One row: the Gini coefficient of a column. Equal values are folded first: c of them whose last has rank k hold the ranks k - c + 1
    to k."""
    x = df.groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    x = cumulative(x, ["x"], {"k": F.col("c")})
    s = x.agg(F.sum(F.col("x") * F.col("c") * (2 * F.col("k") - F.col("c") + 1) / 2).alias("weighted"), F.sum(F.col("x") * F.col("c")).alias("total"), F.sum("c").alias("n"))
    return s.select(F.when(F.col("total") == 0, 0.0).otherwise(2 * F.col("weighted") / (F.col("n") * F.col("total")) - (F.col("n") + 1) / F.col("n")).alias("gini"))


def ordinal_rank(df: DataFrame, column: str, tie: str, name: str, descending: bool = False) -> DataFrame:
    """Adds a rank from 0 with ties in the order of `tie`."""
    return numbered(df, [F.desc(column) if descending else F.col(column), F.col(tie)], name)


def spearman(df: DataFrame, a: str, b: str, tie: str) -> DataFrame:
    ranks = ordinal_rank(ordinal_rank(df, a, tie, "_a"), b, tie, "_b")
    return ranks.agg(F.corr("_a", "_b").alias("rho"))


def top_k(df: DataFrame, column: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(column), tie).limit(k)


def lorenz(df: DataFrame, column: str) -> DataFrame:
    """value, share_nodes, share_value: cumulative shares over the sorted distinct values."""
    x = df.groupBy(F.col(column).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    t = x.agg(F.sum("c").alias("n"), F.sum(F.col("value") * F.col("c")).alias("total"))
    got = cumulative(x, ["value"], {"nodes": F.col("c"), "sum": F.col("value") * F.col("c")})
    return got.crossJoin(t).select("value", (F.col("nodes") / F.col("n")).alias("share_nodes"), (F.col("sum") / F.col("total")).alias("share_value"))


def kendall_tau(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: tau-b of two columns (null where one is constant). Discordant pairs are counted as inversions, bit by bit of the ranks: two rows whose ranks in a and in
    b first part at some bit of the b-rank are compared in the group that shares the higher bits, with counts in order of a. So rows are
    dealt out once for each bit, and no pair is ever made."""
    x = df.select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    ra = numbered(x.select("a").distinct(), ["a"], "ra")
    rb = numbered(x.select("b").distinct(), ["b"], "rb")
    x = staged(x.join(ra, "a").join(rb, "b").select("ra", "rb", "c"), "tau")
    n, most = x.agg(F.sum("c"), F.max("rb")).first()
    bits = max(1, int(most or 0).bit_length())
    pairs = lambda c: c * (c - 1) / 2
    tie = lambda *k: x.groupBy(*k).agg(F.sum("c").cast("double").alias("c")).agg(F.sum(pairs(F.col("c"))).alias("t"))
    # rows of one (bit, higher bits): the upper half before the lower one in a is a discordant pair; rows equal in a go together
    each = x.select("ra", "rb", "c", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("k"))
    each = each.select("ra", "c", "k", F.expr("shiftright(rb, k + 1)").alias("head"), (F.expr("shiftright(rb, k)") % 2).alias("upper"))
    g = each.groupBy("k", "head", "ra").agg(F.sum(F.when(F.col("upper") == 1, F.col("c")).otherwise(0)).alias("up"), F.sum(F.when(F.col("upper") == 0, F.col("c")).otherwise(0)).alias("low"))
    at = cumulative(g, ["k", "head", "ra"], {"all_up": F.col("up")})
    first = at.groupBy("k", "head").agg(F.min(F.col("all_up") - F.col("up")).alias("before"))
    bad = at.join(first, ["k", "head"]).agg(F.sum((F.col("all_up") - F.col("up") - F.col("before")).cast("double") * F.col("low")).alias("d"))
    t = tie("ra").select(F.col("t").alias("ta")).crossJoin(tie("rb").select(F.col("t").alias("tb"))).crossJoin(tie("ra", "rb").select(F.col("t").alias("tab"))).crossJoin(bad)
    total = F.lit(float(n or 0)) * (float(n or 0) - 1) / 2
    concordant_less = total - F.col("ta") - F.col("tb") + F.col("tab") - 2 * F.coalesce("d", F.lit(0.0))
    return t.select(F.try_divide(concordant_less, F.sqrt((total - F.col("ta")) * (total - F.col("tb")))).alias("tau"))


def sampled(nodes: DataFrame, k: int) -> DataFrame:
    """k nodes in the order of a hash of theirs."""
    return nodes.orderBy(F.xxhash64("node"), "node").limit(k)


def core_nodes(cores: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """The nodes of the 2-core. With `most`, those of the largest k-core (k of 2 or more) of so many nodes at most; where even the innermost has
    more, its nodes of highest degree."""
    if most is None:
        return cores.where("core >= 2").select("node")
    total, least = 0, None
    for r in cores.where("core >= 2").groupBy("core").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("core")).collect():  # a row for each core number
        total += r["n"]
        if total > most:
            break
        least = r["core"]
    if least is not None or not total:
        return cores.where(F.col("core") >= (least or 2)).select("node")
    inner = cores.where(F.col("core") == r["core"]).select("node")
    ends = union([edges.select(F.col("src").alias("node")), edges.select(F.col("dst").alias("node"))]).groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    return inner.join(ends, "node").orderBy(F.desc("deg"), "node").limit(most).select("node")


class _Sums:
    """Sums of the rows of a matrix over the edges (a, b): row b gets those of its a."""

    WIDE = 64

    def __init__(self, a: np.ndarray, b: np.ndarray, n: int):
        by = np.argsort(b, kind="stable")
        self.a, self.deg, self.n = a[by], np.bincount(b, minlength=n), n
        self.start = np.cumsum(self.deg) - self.deg
        self.rank = np.argsort(-self.deg, kind="stable")
        self.columns = []
        for k in range(min(self.WIDE, int(self.deg.max(initial=0)))):
            own = self.rank[: np.count_nonzero(self.deg > k)]
            self.columns.append(self.a[self.start[own] + k])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        acc = np.zeros_like(x)
        for own in self.columns:  # the k-th edge of every row that has one
            acc[: len(own)] += x[own]
        for k in range(np.count_nonzero(self.deg > self.WIDE)):
            v = self.rank[k]
            rest = self.a[self.start[v] + self.WIDE : self.start[v] + self.deg[v]]
            for at in range(0, len(rest), 4096):
                acc[k] += x[rest[at : at + 4096]].sum(axis=0)
        out = np.empty_like(x)
        out[self.rank] = acc
        return out

    def spread(self, x: np.ndarray, b: np.ndarray, j: np.ndarray, turned: _Sums) -> np.ndarray:
        """The same where only the places (b, j) of x count; `turned` are the sums over the edges turned round."""
        deg = turned.deg[b]
        at = np.repeat(turned.start[b] - (np.cumsum(deg) - deg), deg) + np.arange(deg.sum())
        return np.bincount(turned.a[at] * x.shape[1] + np.repeat(j, deg), np.repeat(x[b, j], deg), x.size).reshape(x.shape)


def _flows(a: np.ndarray, b: np.ndarray, n: int, pivots: np.ndarray, column: np.ndarray, part: np.ndarray, cutoff: int) -> tuple[np.ndarray, np.ndarray]:
    """The dependencies on each of n nodes and the harmonic sums of the pivots, over the edges (a, b). Pivots of one column lie in different
    components (part, by node) and do not meet, so one pass serves them all."""
    ahead, back = _Sums(a, b, n), _Sums(b, a, n)
    total, harmonic = np.zeros(n), np.zeros(len(pivots))
    by_part = np.argsort(part, kind="stable")
    parts = np.flatnonzero(np.diff(part[by_part], prepend=-1))
    width = int(max(1, min(64, 2_000_000 // max(1, n))))

    def step(x, sums, turned):
        if np.count_nonzero(x) * 16 < x.size:
            v, j = np.divmod(np.flatnonzero(x.ravel() != 0), x.shape[1])
            if turned.deg[v].sum() * 16 < len(a) * x.shape[1]:
                return sums.spread(x, v, j, turned)
        return sums(x)

    for first in range(0, int(column.max(initial=-1)) + 1, width):
        own = np.flatnonzero((column >= first) & (column < first + width))
        at = pivots[own], column[own] - first
        sigma, depth, last = np.zeros((n, width)), np.full((n, width), -1, np.int32), 0
        sigma[at], depth[at] = 1, 0
        front = sigma
        for k in range(1, cutoff + 1):
            front = step(front, ahead, back)
            front[depth >= 0] = 0
            new = front > 0
            if not new.any():
                break
            depth[new], last = k, k
            sigma = sigma + front
        delta = np.zeros((n, width))
        for k in range(last, 0, -1):
            share = np.divide(1 + delta, sigma, out=np.zeros_like(sigma), where=depth == k)
            delta = np.where(depth == k - 1, sigma * step(share, back, ahead), delta)
        total += np.where(depth > 0, delta, 0).sum(axis=1)
        near = np.divide(1.0, depth, out=np.zeros_like(sigma), where=depth > 0)
        harmonic[own] = np.add.reduceat(near[by_part], parts, axis=0)[part[at[0]], at[1]]
    return total, harmonic


#: Edges times columns of pivots that one task works out.
UNIT = 1_000_000_000


def _piece_flows(small: DataFrame, cutoff: int, held: int) -> DataFrame:
    """node, b, h from edges (c, src, dst) of whole components, in which a loop marks a pivot. A task's components go out again for every range of
    columns, so that one with many pivots is dealt to many tasks."""
    def packed(c, src, dst):
        (a, b), node = numbers(src, dst)
        part = np.zeros(len(node), np.int64)
        part[a] = part[b] = np.unique(c, return_inverse=True)[1]
        pivot, edge = a[a == b], a != b
        by = pivot[np.argsort(part[pivot], kind="stable")]
        new = np.flatnonzero(np.diff(part[by], prepend=-1))
        column = np.arange(len(by)) - np.repeat(new, np.diff(np.append(new, len(by))))
        body = [x.astype("<i8" if x is node else "<i4").tobytes() for x in (a[edge], b[edge], node, part, by, column)]
        step = max(1, UNIT // max(1, int(edge.sum())))
        lo = np.arange(0, int(column.max(initial=-1)) + 1, step)
        yield lo, lo + step, *([x] * len(lo) for x in body)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                lo, hi, *body = (x[k].as_py() for x in batch.columns)
                a, b, node, part, by, column = (np.frombuffer(x, "<i8" if i == 2 else "<i4").astype(np.int64) for i, x in enumerate(body))
                own = (column >= lo) & (column < hi)
                total, harmonic = _flows(a, b, len(node), by[own], column[own] - lo, part, cutoff)
                far = np.zeros(len(node))
                far[by[own]] = harmonic
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(total), pa.array(far)], names=["node", "b", "h"])

    units = worked(small, ["src", "dst"], packed, "lo long, hi long, a binary, b binary, node binary, part binary, pivot binary, col binary", held)
    units = staged(units, "bw-units")
    return units.repartition(max(1, units.select("lo").count())).mapInArrow(run, "node long, b double, h double")


#: Above so many pivots each component is worked out in the tasks that hold it, and rows of the loop over levels are so many at a time.
MANY, ROWS = 1000, 200_000_000


def betweenness(nodes: DataFrame, edges: DataFrame, pivots: DataFrame, directed: bool = True, cutoff: int = 64, many: int = MANY, held: int = HELD) -> DataFrame:
    """node, betweenness and, for pivots, harmonic centrality (else 0): shortest path counts flow forward level by level, dependencies back;
    betweenness is scaled by n / pivots and by (n - 1)(n - 2). Few pivots go in one loop of joins. Many are worked out in the tasks that hold
    their components, some columns of pivots at a time; components of more than `held` edges by loops over as many pivots as keep
    a level in ROWS rows."""
    e = staged(edges.where("src <> dst").select("src", "dst").distinct() if directed else undirected(edges), "bw-edges")
    n, k = nodes.count(), pivots.count()
    if k <= many:
        got = level_flows(e, pivots, cutoff)
    else:
        own = pivots.select(F.col("node").alias("src"), F.col("node").alias("dst")).distinct()
        small, big = parted(e.unionByName(own), held, ready=True, loops=True)
        got = _piece_flows(small, cutoff, held)
        if big is not None:
            big = staged(big, "bw-big")
            far, each = big.where("src <> dst").select("src", "dst"), max(1, ROWS // max(1, n))
            marked = staged(numbered(big.where("src = dst").select(F.col("src").alias("node")), ["node"], "i"), "bw-pivots")
            for first in range(0, marked.count(), each):
                own = marked.where((F.col("i") >= first) & (F.col("i") < first + each)).select("node")
                got = got.unionByName(staged(level_flows(far, own, cutoff), "bw-part"))
    got = got.groupBy("node").agg(F.sum("b").alias("b"), F.sum("h").alias("h"))
    scale = (n / max(k, 1)) / max((n - 1) * (n - 2), 1)
    return nodes.join(got, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * F.lit(scale)).alias("betweenness"), F.coalesce("h", F.lit(0.0)).alias("harmonic"))


def level_flows(e: DataFrame, pivots: DataFrame, cutoff: int) -> DataFrame:
    """node, b (dependencies on it) and h (its harmonic sum, for pivots) of distinct edges without loops, all pivots in one loop."""
    start = pivots.select(F.col("node").alias("pivot"), "node", F.lit(0).alias("depth"), F.lit(1.0).alias("sigma"))

    def step(last: DataFrame, done: DataFrame) -> DataFrame:
        nxt = last.join(e, last["node"] == e["src"]).groupBy("pivot", F.col("dst").alias("node")).agg(F.first(F.col("depth") + 1).alias("depth"), F.sum("sigma").alias("sigma"))
        return nxt.join(done.select("pivot", "node"), ["pivot", "node"], "left_anti").select("pivot", "node", "depth", "sigma")

    fore = levels(start, step, "bw", cutoff)
    back, deltas = None, []
    for level in reversed(fore):
        if back is None:
            now = level.select("*", F.lit(0.0).alias("delta"))
        else:
            share = back.select("pivot", F.col("node").alias("dst"), ((1 + F.col("delta")) / F.col("sigma")).alias("share"))
            got = e.join(share, "dst").groupBy("pivot", F.col("src").alias("node")).agg(F.sum("share").alias("got"))
            now = level.join(got, ["pivot", "node"], "left").select("pivot", "node", "depth", "sigma", (F.col("sigma") * F.coalesce("got", F.lit(0.0))).alias("delta"))
        back = staged(now, "bw-back")
        deltas.append(back)
    every = union(deltas)
    per = every.groupBy("node").agg(F.sum(F.when(F.col("depth") > 0, F.col("delta")).otherwise(0.0)).alias("b")).select("node", "b", F.lit(0.0).alias("h"))
    far = every.where("depth > 0").groupBy(F.col("pivot").alias("node")).agg(F.sum(1.0 / F.col("depth")).alias("h")).select("node", F.lit(0.0).alias("b"), "h")
    return per.unionByName(far)


def rk_bound(diameter: Column, eps: float = 0.05, delta: float = 0.1, c: float = 0.5) -> Column:
    """How many sampled paths bound the error of betweenness by eps with probability 1 - delta, for a vertex diameter."""
    return F.ceil(F.lit(c / (eps * eps)) * (F.floor(F.log2((F.greatest(diameter, F.lit(3)) - F.lit(2)).cast("double"))) + 1 + F.lit(math.log(1 / delta))))
