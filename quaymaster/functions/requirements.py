"""Requirement grammars: a requirement becomes a disjunction of conjunctions of (op, ref), parsed once for each distinct requirement.

Grammar `compat` keeps the quirks of common registries' loose parsing: clauses are split at white space only, bare versions are exact,
`1.x` compares text prefixes, and clauses that cannot be read count as satisfied.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from . import versions as V

ANY = ("", "*", "latest", "any")
_ATOM = r"^\s*(\^|~>|~|>=|<=|>|<|==|=)?\s*([0-9][^\s,|]*)"
_HYPHEN = r"^\s*([0-9]\S*)\s+-\s+([0-9]\S*)\s*$"
_INTERVAL = r"^([\[(])\s*([^,\])]*)\s*,\s*([^,\])]*)\s*([\])])$"
TEST = "struct<op:string,ref:string>"


def test(op, ref) -> Column:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(c(op).alias("op"), c(ref).alias("ref"))


def bump_caret(v: Column) -> Column:
    """The first version that a caret range leaves out."""
    f = lambda x: x.cast("string")
    return V.let(V.semver_fields(v), lambda p: F.when(p["major"] > 0, F.concat(f(p["major"] + 1), F.lit(".0.0"))).when(p["minor"] > 0, F.concat(F.lit("0."), f(p["minor"] + 1), F.lit(".0"))).otherwise(F.concat(F.lit("0.0."), f(p["patch"] + 1))))


def bump_tilde(v: Column) -> Column:
    f = lambda x: x.cast("string")
    return V.let(V.semver_fields(v), lambda p: F.when(v.rlike(r"^\D*\d+\.\d+"), F.concat(f(p["major"]), F.lit("."), f(p["minor"] + 1), F.lit(".0"))).otherwise(F.concat(f(p["major"] + 1), F.lit(".0.0"))))


def semver_tests(clause: Column) -> Column:
    """array<struct<op,ref>>, all of which must hold."""
    none = F.array().cast(f"array<{TEST}>")

    def atom(a: Column) -> Column:
        op, ref = F.regexp_extract(a, _ATOM, 1), F.regexp_extract(a, _ATOM, 2)
        flat = F.replace(F.replace(ref, F.lit(".x"), F.lit(".0")), F.lit(".*"), F.lit(".0"))
        prefix = F.regexp_replace(F.substring_index(F.substring_index(ref, "x", 1), "*", 1), r"\.+$", "")
        return (
            F.when(ref == "", none)
            .when(op == "^", F.array(test(">=", flat), test("<", bump_caret(flat))))
            .when(op.isin("~", "~>"), F.array(test(">=", flat), test("<", bump_tilde(flat))))
            .when(op.isin(">=", "<=", ">", "<"), F.array(test(op, flat)))
            .when((op != "==") & (ref.contains("x") | ref.contains("*")), F.array(test("prefix", prefix)))
            .otherwise(F.array(test("==", flat)))
        )

    whole = V.strip(clause)
    return (
        F.when(whole.isin("", "*", "x", "latest"), none)
        .when(whole.rlike(_HYPHEN), F.array(test(">=", F.regexp_extract(whole, _HYPHEN, 1)), test("<=", F.regexp_extract(whole, _HYPHEN, 2))))
        .otherwise(F.flatten(F.transform(F.split(whole, r"\s+"), atom)))
    )


def maven_tests(clause: Column) -> Column:
    none = F.array().cast(f"array<{TEST}>")
    whole = V.strip(clause)
    g = lambda i: V.strip(F.regexp_extract(whole, _INTERVAL, i))
    lo = F.when(g(2) != "", F.array(test(F.when(g(1) == "(", ">").otherwise(">="), g(2)))).otherwise(none)
    hi = F.when(g(3) != "", F.array(test(F.when(g(4) == ")", "<").otherwise("<="), g(3)))).otherwise(none)
    return F.when(whole.rlike(_INTERVAL), F.concat(lo, hi)).when(whole == "", none).otherwise(F.array(test(">=", whole)))


def parsed(requirement: Column, ecosystem: Column) -> Column:
    """array<array<struct<op,ref>>>: one of the arrays must hold whole. An empty inner array always holds."""
    eco = F.lower(F.coalesce(ecosystem, F.lit("")))
    none = F.array().cast(f"array<{TEST}>")

    def alternative(p: Column) -> Column:
        whole = V.strip(p)
        maven = F.transform(F.split(whole, r"(?<=[\])])\s*,\s*(?=[\[(])"), maven_tests)
        return F.when(whole.isin(*ANY), F.array(none)).when(eco == "maven", maven).otherwise(F.array(semver_tests(whole)))

    return F.flatten(F.transform(F.split(V.strip(requirement), r"\|\|"), alternative))


def with_keys(tests: Column, ecosystem: Column) -> Column:
    """Adds its key to each test's reference."""
    return F.transform(tests, lambda g: F.transform(g, lambda t: F.struct(t["op"].alias("op"), t["ref"].alias("ref"), V.version_key(t["ref"], ecosystem).alias("key"))))


def holds(version: Column, key: Column, tests: Column) -> Column:
    """Whether a version (with its key) satisfies a parsed requirement (with its keys)."""

    def one(t: Column) -> Column:
        c = V.compare(key, t["key"])
        return F.when(t["op"] == "prefix", F.startswith(version, t["ref"])).when(t["op"] == ">=", c >= 0).when(t["op"] == "<=", c <= 0).when(t["op"] == ">", c > 0).when(t["op"] == "<", c < 0).otherwise(c == 0)

    return F.exists(tests, lambda group: F.forall(group, one))


@F.pandas_udf(BooleanType())
def pep440_satisfies(version: pd.Series, requirement: pd.Series) -> pd.Series:
    """Specifier sets of PEP 440; what cannot be parsed counts as satisfied. Alternatives are parted by two bars."""
    from packaging.specifiers import SpecifierSet
    from packaging.version import Version

    def read(kind, text: str):
        try:
            return kind(text)
        except Exception:  # an invalid version or specifier says nothing against the version
            return None

    # each distinct text is parsed once
    parts = {p.strip() for r in requirement.unique() for p in (r or "").split("||")}
    sets = {p: None if p in ANY else read(lambda x: SpecifierSet(x, prereleases=True), p) for p in parts}
    parsed = {v: read(Version, v) for v in version.unique() if v is not None}

    def one(v: str, part: str) -> bool:
        spec, own = sets[part.strip()], parsed[v]
        return True if spec is None or own is None else own in spec

    return pd.Series([None if v is None else any(one(v, p) for p in (r or "").split("||")) for v, r in zip(version, requirement, strict=True)], dtype="object")


def satisfies(version: Column, requirement: Column, ecosystem: Column) -> Column:
    """The whole test for one row; for joins, parse distinct requirements first (operators.resolution)."""
    eco = F.lower(F.coalesce(ecosystem, F.lit("")))
    pip = eco.isin("pypi", "pip")
    native = V.let(V.version_key(version, ecosystem), lambda k: holds(version, k, with_keys(parsed(requirement, ecosystem), ecosystem)))
    return F.when(pip, pep440_satisfies(F.when(pip, version), requirement)).otherwise(native)
