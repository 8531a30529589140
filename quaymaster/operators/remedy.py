"""Fixes: which version change clears a finding, and what a set of changes would do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import versions as V
from ..plans.staging import staged, staged_by
from .iterate import levels, union


def first_versions(paths: DataFrame, versions: DataFrame) -> DataFrame:
    """root, pkg_id, cur: the version of each vulnerable package that the root's first path (by rank) ends in, and how many advisories
    its paths hold."""
    ends = paths.join(versions.select(F.col("ver_id").alias("node"), "pkg_id"), "node")
    return ends.groupBy("root", "pkg_id").agg(F.min_by("node", "rank").alias("cur"), F.countDistinct("advisory").alias("n_adv"))


def candidates(current: DataFrame, versions: DataFrame, packages: DataFrame, affected_versions: DataFrame) -> DataFrame:
    """current (pkg_id, cur, ...) -> a row for each clean version of the package: ver_id, version, newer, is_major. A version that any
    advisory names is not clean, withdrawn or not; unfinished versions count only where the current one is unfinished."""
    keyed = versions.join(current.select("pkg_id").distinct(), "pkg_id", "left_semi").join(packages.select("pkg_id", "ecosystem"), "pkg_id")
    keyed = staged(keyed.select("pkg_id", "ver_id", "version", V.version_key(F.col("version"), F.col("ecosystem")).alias("key"), V.is_prerelease(F.col("version")).alias("pre"), V.major(F.col("version")).alias("major")), "fix-keys")
    now = keyed.select("pkg_id", F.col("ver_id").alias("cur"), F.col("version").alias("cur_version"), F.col("key").alias("cur_key"), F.col("pre").alias("cur_pre"), F.col("major").alias("cur_major"))
    clean = keyed.join(affected_versions.select("ver_id").distinct(), "ver_id", "left_anti")
    both = current.join(now, ["pkg_id", "cur"]).join(clean, "pkg_id").where(~F.col("pre") | F.col("cur_pre"))
    newer = V.compare(F.col("key"), F.col("cur_key")) >= 0
    return both.select(*current.columns, "cur_version", "ver_id", "version", newer.alias("newer"), (F.col("major") != F.col("cur_major")).alias("is_major"), V.sort_key(F.col("key")).alias("key"))


def greedy_fix(paths: DataFrame, versions: DataFrame, packages: DataFrame, affected_versions: DataFrame, allow_major: bool = True, order: str = "store") -> DataFrame:
    """root, pkg_id, from_version, to_version, is_major, n_adv, reason: for each vulnerable package of a root the first clean version that
    is not older, of the same major version if there is one; else why there is none. order 'store': by ver_id, 'version': by version."""
    current = first_versions(paths, versions)
    cands = candidates(current, versions, packages, affected_versions)
    fit = F.col("newer") if allow_major else F.col("newer") & ~F.col("is_major")
    at = F.struct("is_major", "ver_id") if order == "store" else F.struct("is_major", "key", "ver_id")
    pick = cands.groupBy("root", "pkg_id").agg(F.min_by(F.when(fit, F.struct("version", "is_major")), F.when(fit, at)).alias("pick"))
    cur = versions.select(F.col("ver_id").alias("cur"), F.col("version").alias("from_version"))
    out = current.join(cur, "cur").join(pick.withColumn("some", F.lit(True)), ["root", "pkg_id"], "left")
    reason = F.when(F.col("pick").isNotNull(), None).when(F.col("some"), "only a major bump is clean").otherwise("no published version is free of advisories")
    return out.select("root", "pkg_id", "from_version", F.col("pick.version").alias("to_version"), F.col("pick.is_major").alias("is_major"), "n_adv", reason.alias("reason"))


def cheapest_fix(paths: DataFrame, versions: DataFrame, packages: DataFrame, affected_versions: DataFrame, lam: float = 0.35, max_pkgs: int = 40) -> DataFrame:
    """The least-cost version choice for each vulnerable package of a root: 1 for a change, lam for another major version, 50 for a version
    that is not clean. The integer program has no constraint across packages, so each package's minimum is the optimum; ties go to
    the lowest version, then ver_id. At most max_pkgs packages of a root, in the order of its paths."""
    ends = paths.join(versions.select(F.col("ver_id").alias("node"), "pkg_id"), "node")
    current = ends.groupBy("root", "pkg_id").agg(F.min_by("node", "rank").alias("cur"), F.countDistinct("advisory").alias("n_adv"), F.min("rank").alias("first"))
    current = current.withColumn("k", F.row_number().over(W.partitionBy("root").orderBy("first"))).where(F.col("k") <= max_pkgs).drop("k", "first")
    keyed = versions.join(current.select("pkg_id").distinct(), "pkg_id", "left_semi").join(packages.select("pkg_id", "ecosystem"), "pkg_id")
    dirty = affected_versions.select("ver_id").distinct().withColumn("dirty", F.lit(True))
    keyed = staged(keyed.join(dirty, "ver_id", "left").select("pkg_id", "ver_id", "version", V.version_key(F.col("version"), F.col("ecosystem")).alias("key"), V.is_prerelease(F.col("version")).alias("pre"), V.major(F.col("version")).alias("major"), F.col("dirty").isNull().alias("clean")), "ilp-keys")
    now = keyed.select("pkg_id", F.col("ver_id").alias("cur"), F.col("version").alias("from_version"), F.col("pre").alias("cur_pre"), F.col("major").alias("cur_major"))
    both = current.join(now, ["pkg_id", "cur"]).join(keyed, "pkg_id").where((F.col("ver_id") == F.col("cur")) | ~F.col("pre") | F.col("cur_pre"))
    cost = F.when(F.col("ver_id") == F.col("cur"), 0.0).otherwise(1.0) + F.when(F.col("major") != F.col("cur_major"), lam).otherwise(0.0) + F.when(F.col("clean"), 0.0).otherwise(50.0)
    both = both.withColumn("cost", cost).withColumn("any_clean", F.max("clean").over(W.partitionBy("root", "pkg_id"))).where(~F.col("any_clean") | F.col("clean"))
    best = both.groupBy("root", "pkg_id", "n_adv", "cur", "from_version").agg(F.min_by(F.struct("ver_id", "version", "cost", "clean", (F.col("major") != F.col("cur_major")).alias("is_major")), F.struct("cost", V.sort_key(F.col("key")).alias("k"), "ver_id")).alias("b"))
    return best.select("root", "pkg_id", "from_version", F.col("b.version").alias("to_version"), F.col("b.is_major").alias("is_major"), F.col("b.cost").alias("cost"), (F.col("b.ver_id") != F.col("cur")).alias("changed"), F.col("b.clean").alias("clean"), "n_adv")


def summary(manifest: Column, cleared: Column, total: Column, bumps: Column, majors: Column, unfixable: Column) -> Column:
    return F.format_string("%s: cleared %d/%d  bumps=%d (%d major)  unfixable=%d", manifest, cleared, total, bumps, majors, unfixable)


def rollup(fixes: DataFrame) -> DataFrame:
    """One row over all roots with findings: how many can be fixed whole, have something unfixable, or need a major version."""
    per = fixes.groupBy("root").agg(F.sum(F.col("reason").isNotNull().cast("long")).alias("bad"), F.sum(F.coalesce("is_major", F.lit(False)).cast("long")).alias("maj"))
    return per.agg(F.count(F.lit(1)).alias("exposed"), F.sum((F.col("bad") == 0).cast("long")).alias("fixable"), F.sum((F.col("bad") > 0).cast("long")).alias("with_unfixable"), F.sum((F.col("maj") > 0).cast("long")).alias("need_major"))


def overlay_walk(starts: DataFrame, redirects: DataFrame, resolved: DataFrame, max_depth: int = 14) -> DataFrame:
    """starts (root, side, node) and redirects (root, old, new), the latter for side 'after' only -> root, side, node, depth reached over
    edges whose targets are redirected. The overlay is a join; no graph is built anew."""
    edges = staged_by(resolved.select(F.col("ver_id").alias("src"), F.col("res_ver_id").alias("dst")), "overlay-edges", "src")
    r = redirects.select("root", F.lit("after").alias("side"), F.col("old").alias("dst"), "new")

    def step(last: DataFrame, done: DataFrame) -> DataFrame:
        nxt = last.join(edges, last["node"] == edges["src"]).select("root", "side", "dst", (F.col("depth") + 1).alias("depth"))
        nxt = nxt.join(r, ["root", "side", "dst"], "left").select("root", "side", F.coalesce("new", "dst").alias("node"), "depth").distinct()
        return nxt.join(done.select("root", "side", "node"), ["root", "side", "node"], "left_anti")

    return union(levels(starts.select("root", "side", "node", F.lit(0).alias("depth")), step, "overlay", max_depth))


def diff_manifests(bumps: DataFrame, roots: DataFrame, versions: DataFrame, resolved: DataFrame, affected_versions: DataFrame, advisories: DataFrame, max_depth: int = 14) -> DataFrame:
    """bumps (root, pkg_id, to_version) applied to each root's tree: cleared, introduced (sorted ids), severity and depth before and after,
    failures (bumps to unknown versions). A bump of the root's own package moves the start. advisories: adv_id, advisory, severity, withdrawn."""
    target = versions.groupBy("pkg_id", F.col("version").alias("to_version")).agg(F.min("ver_id").alias("new"))
    got = bumps.join(target, ["pkg_id", "to_version"], "left")
    own = versions.select(F.col("ver_id").alias("root"), F.col("pkg_id").alias("root_pkg"))
    got = staged(got.join(own, "root").select("root", "pkg_id", "to_version", "new", (F.col("pkg_id") == F.col("root_pkg")).alias("self")), "bumps")
    moved = got.where("self AND new IS NOT NULL").groupBy("root").agg(F.min("new").alias("moved"))
    redirects = got.where("NOT self AND new IS NOT NULL").join(versions.select("pkg_id", F.col("ver_id").alias("old")), "pkg_id").select("root", "old", "new")
    starts = roots.select("root", F.lit("before").alias("side"), F.col("root").alias("node")).unionByName(roots.join(moved, "root", "left").select("root", F.lit("after").alias("side"), F.coalesce("moved", "root").alias("node")))
    seen = staged(overlay_walk(starts, redirects, resolved, max_depth), "overlay-seen")
    live = affected_versions.join(advisories.where(~F.col("withdrawn")), "adv_id").select(F.col("ver_id").alias("node"), "advisory", "severity")
    per = seen.join(live, "node").groupBy("root", "side", "advisory").agg(F.max("severity").alias("severity"))
    side = per.groupBy("root").agg(*[x for s in ("before", "after") for x in (F.sort_array(F.collect_set(F.when(F.col("side") == s, F.col("advisory")))).alias(s), F.coalesce(F.sum(F.when(F.col("side") == s, F.col("severity"))), F.lit(0.0)).alias(f"severity_{s}"))])
    deep = seen.groupBy("root").agg(*[F.max(F.when(F.col("side") == s, F.col("depth"))).alias(f"depth_{s}") for s in ("before", "after")])
    fails = got.groupBy("root").agg(F.sum(F.col("new").isNull().cast("long")).alias("failures"))
    none = F.array().cast("array<string>")
    out = deep.join(side, "root", "left").join(fails, "root", "left")
    before, after = F.coalesce("before", none), F.coalesce("after", none)
    one = lambda c: F.floor(F.coalesce(c, F.lit(0.0)) * 10 + 0.5) / 10
    return out.select("root", F.array_except(before, after).alias("cleared"), F.array_except(after, before).alias("introduced"), one("severity_before").alias("severity_before"), one("severity_after").alias("severity_after"), "depth_before", "depth_after", F.coalesce("failures", F.lit(0)).alias("failures"))


def portfolio(diffs: DataFrame) -> DataFrame:
    c, i = F.size("cleared"), F.size("introduced")
    n = lambda x: F.coalesce(F.sum(x.cast("long")), F.lit(0))
    one = lambda x: F.floor(F.coalesce(F.sum(x), F.lit(0.0)) * 10 + 0.5) / 10
    return diffs.agg(F.count(F.lit(1)).alias("manifests"), n(c).alias("cleared"), n(i).alias("introduced"), one("severity_before").alias("severity_before"), one("severity_after").alias("severity_after"), n((i > 0) & (i >= c)).alias("net_worse"), n((c == 0) & (i == 0)).alias("no_change"))


def ripple(packages: DataFrame, versions: DataFrame, resolved: DataFrame, max_up: int = 6) -> DataFrame:
    """packages (key, pkg_id) -> how many distinct packages have a default version that reaches one of its versions."""
    from .traverse import blast_radius

    hits = blast_radius(packages.join(versions, "pkg_id").select("key", "ver_id"), resolved, versions, max_up)
    got = hits.join(versions.select("ver_id", "pkg_id"), "ver_id").groupBy("key").agg(F.countDistinct("pkg_id").alias("reachable_roots"))
    return packages.select("key").join(got, "key", "left").select("key", F.coalesce("reachable_roots", F.lit(0)).alias("reachable_roots"))
