"""Advisory feeds: aliases to canonical ids, ranges to affected versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import versions as V
from ..plans.staging import staged
from .pieces import stars


def canonical_ids(advisories: DataFrame, aliases: DataFrame) -> DataFrame:
    """osv_id, canon_id: ids that share an alias form a group, named by its smallest CVE id, else by its smallest id. The ids
    themselves are the nodes, so no two can be taken for one."""
    ids = advisories.select("osv_id").union(aliases.select("osv_id")).distinct()
    roots = stars(aliases.select(F.col("osv_id").alias("src"), F.col("alias").alias("dst")), [])
    known = ids.union(aliases.select("alias")).distinct().select(F.col("osv_id").alias("id"))
    grouped = staged(known.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root")), "canon")
    names = grouped.groupBy("root").agg(F.min(F.when(F.startswith("id", F.lit("CVE-")), F.col("id"))).alias("cve"))
    own = grouped.join(ids.select(F.col("osv_id").alias("id")), "id", "left_semi")
    least = own.groupBy("root").agg(F.min("id").alias("least"))
    return own.join(names, "root").join(least, "root").select(F.col("id").alias("osv_id"), F.coalesce("cve", "least").alias("canon_id"))


def first_records(records: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first record of each key."""
    return records.withColumn("_k", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("_k = 1").drop("_k")


def affected_versions(affected: DataFrame, versions: DataFrame, packages: DataFrame) -> DataFrame:
    """affected (adv_id, pkg_id, entry_json) -> distinct (adv_id, ver_id). Only versions of packages that an advisory names get keys; each
    entry's intervals get theirs once; then one equi-join on the package with a range predicate, and one on the version's text."""
    entry = affected.select("adv_id", "pkg_id", F.from_json("entry_json", V.ENTRY).alias("entry")).join(packages.select("pkg_id", "ecosystem"), "pkg_id")
    listed = entry.where(F.size(F.coalesce("entry.versions", F.array().cast("array<string>"))) > 0)
    exact = listed.select("adv_id", "pkg_id", F.explode("entry.versions").alias("version")).join(versions.select("pkg_id", "ver_id", "version"), ["pkg_id", "version"])
    ranged = entry.where(F.size(F.coalesce("entry.versions", F.array().cast("array<string>"))) <= 0)
    spans = ranged.select("adv_id", "pkg_id", "ecosystem", F.explode(V.entry_intervals(F.col("entry"))).alias("i"))
    spans = spans.select("adv_id", "pkg_id", "i.lo", "i.hi", "i.inclusive", V.version_key(F.col("i.lo"), F.col("ecosystem")).alias("lo_key"), V.version_key(F.col("i.hi"), F.col("ecosystem")).alias("hi_key"))
    keyed = versions.join(affected.select("pkg_id").distinct(), "pkg_id", "left_semi").join(packages.select("pkg_id", "ecosystem"), "pkg_id").select("pkg_id", "ver_id", V.version_key(F.col("version"), F.col("ecosystem")).alias("key"))
    keyed = staged(keyed, "version-keys")
    inside = spans.join(keyed, "pkg_id").where(V.in_interval(F.col("key"), F.col("lo"), F.col("lo_key"), F.col("hi"), F.col("hi_key"), F.col("inclusive")))
    return exact.select("adv_id", "ver_id").union(inside.select("adv_id", "ver_id")).distinct()


def fixed_by_advisory(affected: DataFrame) -> DataFrame:
    """adv_id, fixed: the sorted distinct fixed versions of all its entries."""
    each = affected.select("adv_id", F.explode(V.fixed_versions(F.from_json("entry_json", V.ENTRY))).alias("fixed"))
    return each.groupBy("adv_id").agg(F.sort_array(F.collect_set("fixed")).alias("fixed"))


def id_index(advisories: DataFrame, aliases: DataFrame, canon: DataFrame) -> DataFrame:
    """id (upper case), adv_id: an advisory under its own id, its canonical id and its aliases."""
    own = advisories.select(F.upper("osv_id").alias("id"), "adv_id")
    by_canon = advisories.join(canon, "osv_id").select(F.upper("canon_id").alias("id"), "adv_id")
    by_alias = advisories.join(aliases, "osv_id").select(F.upper("alias").alias("id"), "adv_id")
    return own.union(by_canon).union(by_alias).distinct()
