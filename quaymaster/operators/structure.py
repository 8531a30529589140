"""Degree laws, distances, and the reports that sum a graph up."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import staged
from .order import cumulative
from .traverse import walk


def degree_stats(degrees: DataFrame) -> DataFrame:
    """direction, n, mean, median, p90, p99, max, zero_frac for in- and out-degrees."""
    both = degrees.select(F.explode(F.array(F.struct(F.lit("in").alias("direction"), F.col("in_degree").alias("d")), F.struct(F.lit("out").alias("direction"), F.col("out_degree").alias("d")))).alias("x")).select("x.*")
    p = lambda q: F.expr(f"percentile(d, {q})")
    return both.groupBy("direction").agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean"), p(0.5).alias("median"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("d").alias("max"), F.avg((F.col("d") == 0).cast("double")).alias("zero_frac"))


def percentiles(df: DataFrame, column: str) -> DataFrame:
    """One row: n, p50, p90, p99, max and mean of a measure such as a latency, with linear interpolation between neighbours. Equal values
    are folded before they are gathered."""
    h = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    p = lambda q: F.expr(f"percentile(x, {q}, c)")
    return h.agg(F.sum("c").alias("n"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max("x").alias("max"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"))


def quantiles(df: DataFrame, column: str, places: dict[str, float]) -> DataFrame:
    """One row: quantiles of a column by name, with linear interpolation between neighbours as percentile has it. Equal values are folded, and
    the others keep their ranges: no task gathers them all."""
    h = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    h = staged(cumulative(h, ["x"], {"upto": F.col("c")}), "quantiles")
    n = h.agg(F.sum("c")).first()[0] or 0
    at = {k: q * (n - 1) for k, q in places.items()}
    value = lambda i: F.max(F.when((F.col("upto") > i) & (F.col("upto") - F.col("c") <= i), F.col("x")))
    ends = h.agg(*[value(f(x)).alias(f"{k}_{f.__name__}") for k, x in at.items() for f in (math.floor, math.ceil)])

    def between(k, x):
        low, high = F.col(f"{k}_floor"), F.col(f"{k}_ceil")
        return F.when(low == high, low).otherwise((math.ceil(x) - x) * low + (x - math.floor(x)) * high).alias(k)

    return ends.select(*[between(k, x) for k, x in at.items()])


def histogram(degrees: DataFrame, column: str) -> DataFrame:
    """k, c: how many nodes have each degree. Everything about a degree law is computed from this small table."""
    return degrees.groupBy(F.col(column).alias("k")).agg(F.count(F.lit(1)).alias("c"))


def powerlaw(hist: DataFrame, xmin: int = 2) -> DataFrame:
    """One row: alpha by maximum likelihood, the size of the tail, and the distance of the tail from the law on its observed support; null
    with fewer than 50 in the tail."""
    tail = hist.where(F.col("k") >= xmin)
    fit = tail.agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln(F.col("k") / F.lit(xmin - 0.5))).alias("s"))
    alpha = 1 + F.col("n") / F.col("s")
    w = W.orderBy("k").rowsBetween(W.unboundedPreceding, 0)
    x = tail.crossJoin(fit.select("n", alpha.alias("alpha"))).withColumn("w", F.pow(F.col("k").cast("double"), -F.col("alpha")))
    x = x.crossJoin(x.agg(F.sum("w").alias("tw"))).withColumn("emp", F.sum("c").over(w) / F.col("n")).withColumn("fit", F.sum("w").over(w) / F.col("tw"))
    # within a run of equal degrees the empirical curve climbs in steps of 1 / n from one place past the last run's end
    low = F.col("emp") - (F.col("c") - 1) / F.col("n")
    d = x.agg(F.max(F.greatest(F.abs(F.col("emp") - F.col("fit")), F.abs(low - F.col("fit")))).alias("ks"))
    ok = F.col("n") >= 50
    return fit.crossJoin(d).select(F.when(ok, alpha).alias("alpha"), F.coalesce("n", F.lit(0)).alias("n_tail"), F.when(ok, F.col("ks")).alias("ks"))


def hurwitz(s: float, q, terms: int = 24):
    """The Hurwitz zeta function for s > 1 and q > 0, by direct terms and an Euler-Maclaurin rest; q may be an array."""
    import numpy as np

    q = np.asarray(q, float)
    head = sum((q + k) ** -s for k in range(terms))
    a = q + terms
    rest = a ** (1 - s) / (s - 1) + 0.5 * a**-s + s * a ** (-s - 1) / 12 - s * (s + 1) * (s + 2) * a ** (-s - 3) / 720
    return head + rest


def powerlaw_distance(k, c, alpha: float, xmin: int) -> float:
    """The largest gap between the tail's empirical distribution and the discrete power law."""
    import numpy as np

    fit = 1 - hurwitz(alpha, np.asarray(k, float) + 1) / hurwitz(alpha, float(xmin))
    return float(np.max(np.abs(np.cumsum(c) / np.sum(c) - fit)))


def powerlaw_gof(hist: DataFrame, xmin: int = 2, replicas: int = 250, seed: int = 0) -> DataFrame:
    """One row: alpha, n_tail, ks_observed and the share of synthetic power-law tails that lie farther from their own fit. Replicas are
    rows; each draws counts by degree, so a replica is as small as the histogram."""
    import numpy as np

    spark = hist.sparkSession
    rows = sorted((int(r["k"]), int(r["c"])) for r in hist.where(F.col("k") >= xmin).collect())  # one row for each distinct degree
    n = sum(c for _, c in rows)
    kind = "alpha double, n_tail long, ks_observed double, p_value double, n_boot int"
    if n < 50:
        return spark.createDataFrame([(None, n, None, None, 0)], kind)
    k, c = (np.array(x, float) for x in zip(*rows, strict=True))
    alpha = 1 + n / float((c * np.log(k / (xmin - 0.5))).sum())
    seen = powerlaw_distance(k, c, alpha, xmin)

    def run(it):
        import pandas as pd

        for pdf in it:
            out = []
            for i in pdf["id"]:
                rng = np.random.default_rng([seed, int(i)])
                x = np.floor((xmin - 0.5) * (1 - rng.random(n)) ** (-1 / (alpha - 1)) + 0.5)
                x = x[np.isfinite(x) & (x >= xmin)]
                kk, cc = np.unique(x, return_counts=True)
                if len(x) < 50:
                    out.append(None)
                    continue
                own = 1 + len(x) / float((cc * np.log(kk / (xmin - 0.5))).sum())
                out.append(powerlaw_distance(kk, cc, own, xmin))
            yield pd.DataFrame({"ks": out})

    got = spark.range(0, replicas, 1, 8).mapInPandas(run, "ks double")
    return got.agg((F.sum((F.col("ks") >= seen).cast("double")) / replicas).alias("p_value")).select(F.lit(alpha).alias("alpha"), F.lit(n).cast("long").alias("n_tail"), F.lit(seen).alias("ks_observed"), "p_value", F.lit(replicas).alias("n_boot"))


def distances(sources: DataFrame, edges: DataFrame, most: int = 63) -> DataFrame:
    """length, n: how many ordered pairs lie so far apart, from the sources (node)."""
    seen = walk(sources.select(F.col("node").alias("root"), "node"), edges, most, name="distances")
    return seen.where("depth > 0").groupBy(F.col("depth").alias("length")).agg(F.count(F.lit(1)).alias("n"))


def effective_diameter(lengths: DataFrame, share: float = 0.9) -> DataFrame:
    """One row: pairs, mean length, and the least length within which `share` of the pairs lie."""
    w = W.orderBy("length").rowsBetween(W.unboundedPreceding, 0)
    t = lengths.agg(F.sum("n").alias("pairs"), (F.sum(F.col("length") * F.col("n")) / F.sum("n")).alias("mean"))
    c = lengths.withColumn("upto", F.sum("n").over(w)).crossJoin(t)
    return c.groupBy("pairs", "mean").agg(F.min(F.when(F.col("upto") >= share * F.col("pairs"), F.col("length"))).alias("effective"))


def community_sizes(labels: DataFrame, packages: DataFrame) -> DataFrame:
    """label, size, dominant ecosystem (the first by name among the most frequent) and its share."""
    per = labels.join(packages.select(F.col("pkg_id").alias("node"), "ecosystem"), "node").groupBy("label", "ecosystem").agg(F.count(F.lit(1)).alias("n"))
    first = per.groupBy("label").agg(F.sum("n").alias("size"), F.max("n").alias("top"))
    return per.join(first, "label").where("n = top").groupBy("label", "size").agg(F.min("ecosystem").alias("dominant"), F.max(F.col("n") / F.col("size")).alias("purity"))


def cross_fraction(edges: DataFrame, labels: DataFrame) -> DataFrame:
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias("la")), labels.select(F.col("node").alias("dst"), F.col("label").alias("lb"))
    return edges.join(a, "src").join(b, "dst").agg(F.count(F.lit(1)).alias("edges"), F.avg((F.col("la") != F.col("lb")).cast("double")).alias("cross"))
