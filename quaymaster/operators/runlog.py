"""Run state as an append-only event table (run, seq, kind, pkg, from_version, to_version, status, why), and bisection of bump sets."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATUS = ("clean", "affected_reachable", "affected_unreachable", "affected_unknown", "patched", "yanked_blocked", "license_violation", "escalated")


def current_status(events: DataFrame) -> DataFrame:
    """run, pkg, status, why: the last status of each package; a commit sets `patched`."""
    set_ = events.where(F.col("kind").isin("status", "commit")).withColumn("status", F.when(F.col("kind") == "commit", "patched").otherwise(F.col("status")))
    return set_.groupBy("run", "pkg").agg(F.max_by(F.struct("status", "why"), "seq").alias("s")).select("run", "pkg", "s.status", "s.why")


def tentative(events: DataFrame) -> DataFrame:
    """Proposals that were neither committed nor rolled back: the last proposal of a package if nothing of the kind came after it."""
    last = events.where(F.col("kind").isin("propose", "commit", "rollback")).groupBy("run", "pkg").agg(F.max_by(F.struct("kind", "from_version", "to_version"), "seq").alias("e"))
    return last.where(F.col("e.kind") == "propose").select("run", "pkg", "e.from_version", "e.to_version")


def snapshot(events: DataFrame) -> DataFrame:
    """One row for each run: events, committed, tentative."""
    n = events.groupBy("run").agg(F.count(F.lit(1)).alias("events"))
    done = current_status(events).groupBy("run").agg(F.sum((F.col("status") == "patched").cast("long")).alias("committed"))
    open_ = tentative(events).groupBy("run").agg(F.count(F.lit(1)).alias("tentative"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return n.join(done, "run", "left").join(open_, "run", "left").select("run", "events", zero("committed"), zero("tentative"))


def bisect_build(bumps: dict, build_ok: Callable[[dict], bool]) -> dict:
    """The bumps whose removal alone makes the build pass; if there are none, the smallest subset that fails by itself. build_ok is the
    caller's build, so this runs where the caller is; it tries n builds, then subsets by size."""
    if build_ok(dict(bumps)):
        return {}
    if alone := {k: v for k, v in bumps.items() if build_ok({x: y for x, y in bumps.items() if x != k})}:
        return alone
    return next(({k: bumps[k] for k in c} for size in range(2, len(bumps) + 1) for c in combinations(bumps, size) if not build_ok({k: bumps[k] for k in c})), dict(bumps))


def recovery(culprits: DataFrame, candidates: DataFrame) -> DataFrame:
    """culprits (pkg_id, cur, to_version) and their clean candidates -> action: retry with the first clean version of the same major that is
    not the one that broke, else pin with an exception."""
    fit = F.col("newer") & ~F.col("is_major")
    alt = candidates.groupBy("pkg_id", "cur").agg(F.min_by(F.when(fit, F.col("version")), F.when(fit, F.col("ver_id"))).alias("alt"))
    got = culprits.join(alt, ["pkg_id", "cur"], "left")
    return got.select("pkg_id", "cur", "to_version", F.when(F.col("alt").isNotNull() & (F.col("alt") != F.col("to_version")), F.concat(F.lit("retry -> "), "alt")).otherwise("pin+exception").alias("action"))
