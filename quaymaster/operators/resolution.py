"""Declared requirements to concrete versions: each distinct (package, requirement) is resolved once and joined back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import requirements as R
from ..functions import versions as V
from ..plans.staging import staged


def satisfying(wanted: DataFrame, versions: DataFrame) -> DataFrame:
    """wanted (pkg_id, ecosystem, requirement), distinct -> one row for each version of the package that satisfies the requirement. Each
    distinct text of a requirement and of a version is parsed once, however many packages have it, and written before the join, so that a
    pair costs comparisons only."""
    eco = F.col("ecosystem")
    wanted = wanted.withColumn("_r", F.coalesce("requirement", F.lit("")))
    texts = staged(wanted.select("ecosystem", "_r").distinct().select("ecosystem", "_r", R.with_keys(R.parsed(F.col("_r"), eco), eco).alias("tests")), "requirements")
    named = wanted.select("pkg_id", "ecosystem").distinct().join(versions.select("pkg_id", "ver_id", "version"), "pkg_id")
    keys = staged(named.select("ecosystem", "version").distinct().select("ecosystem", "version", V.version_key(F.col("version"), eco).alias("key")), "version-texts")
    pairs = wanted.join(texts, ["ecosystem", "_r"]).join(named.join(keys, ["ecosystem", "version"]), ["pkg_id", "ecosystem"]).drop("_r")
    pip = F.lower("ecosystem").isin("pypi", "pip")
    native = pairs.where(~pip).where(R.holds(F.col("version"), F.col("key"), F.col("tests")))
    python = pairs.where(pip).where(R.pep440_satisfies(F.col("version"), F.col("requirement")))
    return native.unionByName(python).drop("tests")


def resolve(wanted: DataFrame, versions: DataFrame, allow_prerelease: bool = False) -> DataFrame:
    """wanted (pkg_id, ecosystem, requirement) -> the same with ver_id and version of the highest satisfying version, releases first;
    null where none satisfies."""
    distinct = wanted.select("pkg_id", "ecosystem", "requirement").distinct()
    got = satisfying(distinct, versions)
    stable = F.lit(True) if allow_prerelease else V.semver_fields(F.col("version"))["pre"].isNull()
    order = F.struct(stable.alias("stable"), V.sort_key(F.col("key")).alias("key"), F.col("ver_id"))
    best = got.groupBy("pkg_id", "ecosystem", "requirement").agg(F.max_by(F.struct("ver_id", "version"), order).alias("best"))
    on = [wanted[c].eqNullSafe(best[c]) for c in ("pkg_id", "ecosystem", "requirement")]
    return wanted.join(best, on[0] & on[1] & on[2], "left").select(wanted["*"], F.col("best.ver_id").alias("ver_id"), F.col("best.version").alias("version"))


def resolve_dependencies(dependencies: DataFrame, packages: DataFrame, versions: DataFrame) -> DataFrame:
    """dependencies (ecosystem, name, version, dep_ecosystem, dep_name, requirement) -> ver_id, dep_pkg, requirement, res_ver_id (null:
    dangling). Rows whose package, version or dependency is unknown are dropped."""
    p = packages.select("pkg_id", "ecosystem", "name")
    src = dependencies.join(p, ["ecosystem", "name"]).join(versions.select("pkg_id", "ver_id", "version"), ["pkg_id", "version"])
    dep = p.select(F.col("pkg_id").alias("dep_pkg"), F.col("ecosystem").alias("dep_ecosystem"), F.col("name").alias("dep_name"))
    declared = src.join(dep, ["dep_ecosystem", "dep_name"]).select("ver_id", "dep_pkg", "dep_ecosystem", "requirement")
    got = resolve(declared.select(F.col("dep_pkg").alias("pkg_id"), F.col("dep_ecosystem").alias("ecosystem"), "requirement").distinct(), versions)
    got = got.select(F.col("pkg_id").alias("dep_pkg"), F.col("requirement").alias("_r"), F.col("ver_id").alias("res_ver_id"))
    return declared.join(got, (declared["dep_pkg"] == got["dep_pkg"]) & declared["requirement"].eqNullSafe(got["_r"]), "left").select("ver_id", declared["dep_pkg"], "requirement", "res_ver_id")


def retention(declared: DataFrame) -> DataFrame:
    """How many declared dependencies were resolved, and from how many distinct resolutions."""
    return declared.agg(F.count(F.lit(1)).alias("declared"), F.count("res_ver_id").alias("resolved"), F.sum(F.col("res_ver_id").isNull().cast("long")).alias("dangling"), F.countDistinct("dep_pkg", "requirement").alias("distinct_requirements"))
