"""Relations derived from packages, versions and resolved dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def package_graph(resolved: DataFrame, versions: DataFrame) -> DataFrame:
    """Distinct (src, dst) package edges without loops."""
    a = versions.select(F.col("ver_id"), F.col("pkg_id").alias("src"))
    b = versions.select(F.col("ver_id").alias("res_ver_id"), F.col("pkg_id").alias("dst"))
    return resolved.join(a, "ver_id").join(b, "res_ver_id").where("src <> dst").select("src", "dst").distinct()


def roots(versions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Default versions that nothing depends on."""
    return versions.where("is_default").select(F.col("ver_id").alias("root")).join(resolved.select(F.col("res_ver_id").alias("root")), "root", "left_anti")


def application_packages(edges: DataFrame) -> DataFrame:
    """Packages that depend on others and that none depends on."""
    return edges.select(F.col("src").alias("pkg_id")).distinct().join(edges.select(F.col("dst").alias("pkg_id")), "pkg_id", "left_anti")


def undirected(edges: DataFrame, distinct: bool = True) -> DataFrame:
    """Both directions of each edge without loops; with distinct, parallel and reciprocal edges count once."""
    both = edges.select("src", "dst").unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst")
    return both.distinct() if distinct else both


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, in_degree, out_degree for every node, those without edges too."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("in_degree"))
    return nodes.join(into, "node", "left").join(out, "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def default_version(versions: DataFrame) -> DataFrame:
    """pkg_id, ver_id: the first default version, else the last one."""
    first = F.min(F.when(F.col("is_default"), F.col("ver_id")))
    return versions.groupBy("pkg_id").agg(F.coalesce(first, F.max("ver_id")).alias("ver_id"))


def retention(resolved: DataFrame, versions: DataFrame) -> DataFrame:
    """How many edges have both ends among the versions."""
    known = versions.select("ver_id")
    kept = resolved.join(known, "ver_id", "left_semi").join(known.withColumnRenamed("ver_id", "res_ver_id"), "res_ver_id", "left_semi")
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(resolved.agg(F.count(F.lit(1)).alias("declared"))).select("declared", "kept", (F.col("declared") - F.col("kept")).alias("dangling"))
