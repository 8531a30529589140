"""The alert ladder: which findings are raised, which are suppressed, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a summary that name a symbol (fixed values).
SYMBOL_HINTS = ("function", "method", "() ", "call to", "vulnerable symbol", "api endpoint")


def verdicts(paths: DataFrame, versions: DataFrame, as_of: Column | str | None = None, min_severity: float = 0.0, reachability: DataFrame | None = None, alert_on_unreachable: bool = False, keys: tuple[str, ...] = ("root", "advisory"), floor: Column | None = None) -> DataFrame:
    """paths (keys, node, depth, severity, withdrawn, published, ...) -> one row for each group: verdict, alert, n_paths, n_usable (what is
    left at the gate that decides), min_depth, severity. Gates, in this order: installable, not withdrawn, known at the date, severe
    enough (or of unknown severity), reachable."""
    keys = list(keys)
    installable = versions.select(F.col("ver_id").alias("node"), (F.length("version") > 0).alias("installable"))
    p = paths.join(installable, "node", "left")
    date = F.lit(as_of) if isinstance(as_of, str) else as_of
    usable = F.coalesce("installable", F.lit(False))
    live = usable & ~F.col("withdrawn")
    known = live if date is None else live & (F.length(F.coalesce("published", F.lit(""))) > 0) & (F.substring("published", 1, 10) <= date)
    severe = known & ((F.col("severity") >= (F.lit(min_severity) if floor is None else floor)) | (F.col("severity") == 0))
    if reachability is not None and not alert_on_unreachable:
        p = p.join(reachability.select(*[k for k in keys if k in reachability.columns], "reach"), [k for k in keys if k in reachability.columns], "left")
        reached = severe & (F.coalesce("reach", F.lit("undetermined")) != "unreachable")
    else:
        reached = severe
    n = lambda c, name: F.sum(c.cast("long")).alias(name)
    g = p.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_paths"), n(usable, "u"), n(live, "l"), n(known, "k"), n(severe, "s"), n(reached, "r"), F.min("depth").alias("min_depth"), F.max("severity").alias("severity"))
    reason = (
        F.when(F.col("u") == 0, "only_noninstallable_evidence").when(F.col("l") == 0, "only_withdrawn_advisories").when(F.col("k") == 0, "not_knowable_as_of_date")
        .when(F.col("s") == 0, "below_severity_floor").when(F.col("r") == 0, "present_but_unreachable").otherwise("exposed")
    )
    usable_n = F.when(F.col("r") > 0, F.col("r")).when((F.col("k") > 0) & (F.col("s") == 0), F.col("k")).otherwise(0)
    return g.select(*keys, reason.alias("verdict"), (F.col("r") > 0).alias("alert"), "n_paths", usable_n.alias("n_usable"), "min_depth", "severity")


def with_empty_groups(roots: DataFrame, found: DataFrame) -> DataFrame:
    """root, verdict for every root: those without a path get `no_exposure_path`; roots that are null were not grounded."""
    some = found.select("root", "verdict")
    none = roots.join(found.select("root").distinct(), "root", "left_anti").select("root", F.when(F.col("root").isNull(), "not_grounded").otherwise("no_exposure_path").alias("verdict"))
    return some.unionByName(none)


def has_symbol(summary: Column) -> Column:
    out = F.lit(False)
    for w in SYMBOL_HINTS:
        out = out | F.lower(F.coalesce(summary, F.lit(""))).contains(w)
    return out


def reach_prior(depth: Column, severity: Column, symbol: Column, kind: Column | None = None) -> Column:
    """reachable, unreachable or undetermined from structure alone; unreachable only on strong evidence."""
    shipped = F.lit(False) if kind is None else kind.isin("dev", "test", "development", "optional")
    return F.when(shipped, "unreachable").when(depth <= 1, "reachable").when(severity >= 9, "reachable").when((depth >= 5) & (severity < 5) & ~symbol, "unreachable").otherwise("undetermined")


def reach_stub(depth: Column, severity: Column) -> Column:
    """The coordinated run's own rule."""
    return F.when((depth <= 1) | (severity >= 9), "reachable").when((depth >= 4) & (severity < 5), "unreachable").otherwise("undetermined")


def reach_map(paths: DataFrame, keys: tuple[str, ...] = ("root", "advisory")) -> DataFrame:
    """keys, reach: the most serious verdict of each group's paths (column reach)."""
    rank = F.when(F.col("reach") == "reachable", 2).when(F.col("reach") == "undetermined", 1).otherwise(0)
    return paths.groupBy(*keys).agg(F.max(rank).alias("k")).select(*keys, F.when(F.col("k") == 2, "reachable").when(F.col("k") == 1, "undetermined").otherwise("unreachable").alias("reach"))


def call_graph_reach(findings: DataFrame, symbols: DataFrame, entry_points: DataFrame, calls: DataFrame, max_depth: int = 64) -> DataFrame:
    """findings (root, advisory), symbols (advisory, symbol), entry_points (root, symbol) and calls (src, dst) from an extractor of the
    caller's -> root, advisory, reach: reachable if a call chain from one of the root's entry points ends in a vulnerable symbol, and
    undetermined where the advisory names no symbol or the root has no entry point."""
    from .traverse import walk

    seen = walk(entry_points.select("root", F.col("symbol").alias("node")), calls, max_depth, name="calls")
    hit = seen.join(symbols.select(F.col("symbol").alias("node"), "advisory"), "node").select("root", "advisory").distinct().withColumn("hit", F.lit(True))
    named = symbols.select("advisory").distinct().withColumn("named", F.lit(True))
    known = entry_points.select("root").distinct().withColumn("known", F.lit(True))
    got = findings.join(named, "advisory", "left").join(known, "root", "left").join(hit, ["root", "advisory"], "left")
    return got.select("root", "advisory", F.when(F.col("named").isNull() | F.col("known").isNull(), "undetermined").when(F.col("hit"), "reachable").otherwise("unreachable").alias("reach"))


def risk_coverage(findings: DataFrame) -> DataFrame:
    """findings (reach, is_real) -> policy, coverage, control_leak."""
    policies = {"reachable_only": F.col("reach") == "reachable", "reachable+undetermined": F.col("reach") != "unreachable", "all": F.lit(True)}
    real = F.col("is_real")
    each = F.array(*[F.struct(F.lit(k).alias("policy"), keep.alias("keep")) for k, keep in policies.items()])
    rows = findings.select(real.alias("real"), F.explode(each).alias("p"))
    share = lambda hit, of: F.sum((F.col("p.keep") & hit).cast("double")) / F.greatest(F.sum(of.cast("double")), F.lit(1.0))
    return rows.groupBy(F.col("p.policy").alias("policy")).agg(share(F.col("real"), F.col("real")).alias("coverage"), share(~F.col("real"), ~F.col("real")).alias("control_leak"))


#: Who can do what, where, and how reliably (fixed values).
CAPABILITIES = [
    ("Resolver.npm", "npm", "resolve", 0.98), ("Resolver.pypi", "pypi", "resolve", 0.95), ("Resolver.maven", "maven", "resolve", 0.93),
    ("Resolver.cargo", "cargo", "resolve", 0.97), ("Resolver.go", "go", "resolve", 0.90), ("AdvisoryMatcher", "*", "match", 0.99),
    ("Reach.JS", "npm", "reach", 0.70), ("Reach.PY", "pypi", "reach", 0.62), ("Reach.JVM", "maven", "reach", 0.80), ("LicenseAuditor", "*", "license", 1.00),
    ("PatchProposer", "*", "patch", 0.85), ("BuildVerifier", "*", "verify", 0.92), ("Escalator", "*", "escalate", 1.00),
]


def route(tasks: DataFrame, capabilities: list[tuple] | None = None) -> DataFrame:
    """tasks (task, ecosystem) -> agent: the most reliable that serves the ecosystem, the first listed of equals; null if none does."""
    caps = CAPABILITIES if capabilities is None else capabilities
    table = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(e).alias("eco"), F.lit(t).alias("task"), F.struct(F.lit(float(r)).alias("r"), F.lit(-i).alias("o")).alias("rank")) for i, (n, e, t, r) in enumerate(caps)])
    fit = F.filter(table, lambda c: (c["task"] == F.col("task")) & ((c["eco"] == "*") | (c["eco"] == F.col("ecosystem"))))
    return tasks.select("*", F.array_max(F.transform(fit, lambda c: F.struct(c["rank"].alias("rank"), c["name"].alias("name"))))["name"].alias("agent"))
