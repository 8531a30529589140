"""Level-synchronous traversals from many roots at once.

A first-in-first-out walk that takes neighbours in ascending order finds each node by the path that is smallest, hop by hop, among the
shortest ones; so a level keeps min(hops) for each (root, node), and hops order a level's queue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.staging import staged_by
from .iterate import levels, union


def walk(seeds: DataFrame, edges: DataFrame, max_depth: int, hops: bool = False, name: str = "walk") -> DataFrame:
    """seeds (root, node) and edges (src, dst) -> root, node, depth and, if asked for, hops (root to node). The edges lie in buckets of their
    sources, so a level exchanges only the nodes that it starts from."""
    edges = staged_by(edges.select("src", "dst"), f"{name}-edges", "src")
    start = seeds.select("root", "node", F.lit(0).alias("depth"), *([F.array("node").alias("hops")] if hops else []))

    def step(last: DataFrame, done: DataFrame) -> DataFrame:
        nxt = last.join(edges, last["node"] == edges["src"])
        if hops:
            nxt = nxt.select("root", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth"), F.concat("hops", F.array("dst")).alias("hops")).groupBy("root", "node", "depth").agg(F.min("hops").alias("hops"))
        else:
            nxt = nxt.select("root", F.col("dst").alias("node"), (F.col("depth") + 1).alias("depth")).distinct()
        return nxt.join(done.select("root", "node"), ["root", "node"], "left_anti").select(*start.columns)

    return union(levels(start, step, name, max_depth))


def resolved_edges(resolved: DataFrame) -> DataFrame:
    return resolved.select(F.col("ver_id").alias("src"), F.col("res_ver_id").alias("dst"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def exposures(reached: DataFrame, affected_versions: DataFrame, advisories: DataFrame, max_paths: int = 200) -> DataFrame:
    """reached (root, node, depth, hops) -> the ranked exposure paths of each root: at most max_paths, shallow first, then severe, then in
    order of the walk. The walk stops once it has 4 * max_paths findings."""
    hits = affected_versions.groupBy(F.col("ver_id").alias("node")).agg(F.count(F.lit(1)).alias("n_adv"))
    before = W.partitionBy("root").orderBy("depth", "hops").rowsBetween(W.unboundedPreceding, -1)
    within = reached.join(hits, "node").withColumn("before", F.coalesce(F.sum("n_adv").over(before), F.lit(0))).where(F.col("before") < 4 * max_paths)
    found = within.join(affected_versions, within["node"] == affected_versions["ver_id"]).join(advisories, "adv_id")
    order = W.partitionBy("root").orderBy("depth", F.desc("severity"), "hops", "adv_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_paths).drop("n_adv", "before", "ver_id")


def exposure_paths(roots: DataFrame, resolved: DataFrame, affected_versions: DataFrame, advisories: DataFrame, max_depth: int = 12, max_paths: int = 200) -> DataFrame:
    """All roots' exposure paths: root, adv_id, the advisory's columns, node (the affected version), depth, hops, rank."""
    reached = walk(roots.select("root", F.col("root").alias("node")), resolved_edges(resolved), max_depth, hops=True, name="paths")
    return exposures(reached, affected_versions, advisories, max_paths)


def rendered(paths: DataFrame, versions: DataFrame, packages: DataFrame, label: str = "advisory") -> DataFrame:
    """Adds `rendered`: [ADVISORY  cvss=x.y] a@1 -> b@2, with a mark on withdrawn advisories."""
    named = versions.join(packages, "pkg_id").select(F.col("ver_id").alias("hop"), F.concat("name", F.lit("@"), "version").alias("at"))
    each = paths.select("root", "rank", F.posexplode("hops").alias("k", "hop")).join(named, "hop")
    chain = each.groupBy("root", "rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "at"))), lambda x: x["at"]), " -> ").alias("chain"))
    flag = F.when(F.col("withdrawn"), "  !! WITHDRAWN").otherwise("")
    return paths.join(chain, ["root", "rank"]).withColumn("rendered", F.concat(F.lit("["), F.col(label), F.lit("  cvss="), F.format_string("%.1f", F.col("severity")), F.lit("] "), "chain", flag)).drop("chain")


def blast_radius(targets: DataFrame, resolved: DataFrame, versions: DataFrame, max_up: int = 5, node_budget: int | None = None) -> DataFrame:
    """targets (key, ver_id): for each key the default versions that reach one of its versions within max_up + 1 hops, and targets that
    are default and have no dependents. truncated: more than node_budget versions were met."""
    up = reversed_edges(resolved_edges(resolved))
    seen = walk(targets.select(F.col("key").alias("root"), F.col("ver_id").alias("node")), up, max_up + 1, name="blast")
    default = versions.where("is_default").select(F.col("ver_id").alias("node"))
    wanted = seen.join(default, "node", "left_semi")
    own = wanted.where("depth = 0").join(up.select(F.col("src").alias("node")), "node", "left_anti")
    hits = wanted.where("depth > 0").unionByName(own).select(F.col("root").alias("key"), F.col("node").alias("ver_id"))
    if node_budget is None:
        return hits.withColumn("truncated", F.lit(False))
    big = seen.groupBy(F.col("root").alias("key")).agg((F.count(F.lit(1)) > node_budget).alias("truncated"))
    return hits.join(big, "key")


def reach_counts(roots: DataFrame, edges: DataFrame, max_depth: int = 64) -> DataFrame:
    """node, n_roots: from how many roots a node can be reached; a root reaches itself."""
    seen = walk(roots.select(F.col("node").alias("root"), "node"), edges, max_depth, name="reach")
    return seen.groupBy("node").agg(F.count(F.lit(1)).alias("n_roots"))


def compromise(victims: DataFrame, edges: DataFrame, applications: DataFrame, max_depth: int = 64) -> DataFrame:
    """victims (node): for each how many nodes depend on it (itself included), how many of them are applications, and their share."""
    seen = walk(victims.select(F.col("node").alias("root"), "node"), reversed_edges(edges), max_depth, name="compromise")
    apps = applications.select(F.col("pkg_id").alias("node"), F.lit(1).alias("app"))
    n = applications.count()
    got = seen.join(apps, "node", "left").groupBy(F.col("root").alias("victim")).agg(F.count(F.lit(1)).alias("reached"), F.count("app").alias("reached_apps"))
    return got.withColumn("fraction", F.col("reached_apps") / F.lit(float(max(1, n))))
