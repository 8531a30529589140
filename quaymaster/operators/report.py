"""Reports for all roots at once: rows, Markdown, software bills of materials, lock files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import band
from .policy import verdicts
from .remedy import greedy_fix
from .traverse import rendered


def exposure_rows(paths: DataFrame, versions: DataFrame, packages: DataFrame, as_of: str | None = None, min_severity: float = 0.0, reachability: DataFrame | None = None) -> DataFrame:
    """root, advisory, osv_id, severity, band, depth, path, terminal, published, reason, alert: the best path of each finding."""
    judged = verdicts(paths, versions, as_of, min_severity, reachability).select("root", "advisory", F.col("verdict").alias("reason"), "alert")
    best = paths.groupBy("root", "advisory").agg(F.min_by(F.struct("rank", "osv_id", "severity", "depth", "node", "published", "hops", "withdrawn"), F.struct("depth", -F.col("severity"), "rank")).alias("b")).select("root", "advisory", "b.*")
    named = versions.join(packages, "pkg_id").select(F.col("ver_id").alias("node"), F.concat("ecosystem", F.lit("/"), "name", F.lit("@"), "version").alias("terminal"))
    out = rendered(best, versions, packages).join(named, "node").join(judged, ["root", "advisory"])
    one = F.floor(F.col("severity") * 10 + 0.5) / 10
    return out.select("root", "advisory", "osv_id", one.alias("severity"), band(F.col("severity")).alias("band"), "depth", F.col("rendered").alias("path"), "terminal", "published", "reason", "alert")


def alerted_fixes(paths: DataFrame, rows: DataFrame, versions: DataFrame, packages: DataFrame, affected_versions: DataFrame) -> DataFrame:
    live = paths.join(rows.where("alert").select("root", "advisory"), ["root", "advisory"], "left_semi")
    return greedy_fix(live, versions, packages, affected_versions).join(packages.select("pkg_id", F.concat("ecosystem", F.lit("/"), "name").alias("package")), "pkg_id")


def manifests(versions: DataFrame, packages: DataFrame) -> DataFrame:
    return versions.join(packages, "pkg_id").select(F.col("ver_id").alias("root"), "ecosystem", "name", "version", F.concat("ecosystem", F.lit("/"), "name", F.lit("@"), "version").alias("manifest"))


def _lines(df: DataFrame, order: list, line, name: str, most: int | None = None) -> DataFrame:
    from pyspark.sql import Window as W

    n = df.withColumn("_k", F.row_number().over(W.partitionBy("root").orderBy(*order)))
    n = n if most is None else n.where(F.col("_k") <= most)
    return n.groupBy("root").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", line.alias("_s")))), lambda x: x["_s"]), "\n").alias(name))


def markdown(rows: DataFrame, fixes: DataFrame, versions: DataFrame, packages: DataFrame, generated: str, as_of: str | None = None, max_show: int = 12) -> DataFrame:
    """root, markdown."""
    severe = [F.desc("severity"), "depth", "advisory"]
    head = F.concat(F.upper("band"), F.lit(" ("), F.format_string("%.1f", "severity"), F.lit(")"))
    counts = rows.groupBy("root").agg(F.sum(F.col("alert").cast("long")).alias("n_alert"), F.count(F.lit(1)).alias("n_all"), F.sum((F.col("alert") & (F.col("depth") == 0)).cast("long")).alias("n_direct"), F.sum((F.col("alert") & (F.col("depth") > 0)).cast("long")).alias("n_trans"))
    direct = _lines(rows.where("alert AND depth = 0"), severe, F.concat(F.lit("- **"), "advisory", F.lit("**  "), head, F.lit("  -  `"), "terminal", F.lit("`")), "direct", max_show)
    trans = _lines(rows.where("alert AND depth > 0"), severe, F.concat(F.lit("### "), "advisory", F.lit("  -  "), head, F.lit("  -  depth "), F.col("depth").cast("string"), F.lit("\n```\n"), "path", F.lit("\n```\n")), "trans", max_show)
    quiet = _lines(rows.where("NOT alert"), ["advisory"], F.concat(F.lit("| "), "advisory", F.lit(" ("), "band", F.lit(") | `"), "reason", F.lit("` |")), "quiet", 40)
    bump = F.concat(F.lit("- `"), "package", F.lit("`  "), "from_version", F.lit(" → **"), "to_version", F.lit("**"), F.when(F.col("is_major"), "  **(MAJOR - review breaking changes)**").otherwise(""))
    bumps = _lines(fixes.where("reason IS NULL"), ["package"], bump, "bumps")
    bad = _lines(fixes.where("reason IS NOT NULL"), ["package"], F.concat(F.lit("- `"), "package", F.lit("`  ⚠️ **no safe fix**: "), "reason"), "bad")
    done = fixes.where("reason IS NULL").groupBy("root").agg(F.sum("n_adv").alias("cleared"), F.count(F.lit(1)).alias("n_bumps"))
    out = counts.join(manifests(versions, packages).select("root", "manifest"), "root")
    for t in (direct, trans, quiet, bumps, bad, done):
        out = out.join(t, "root", "left")
    some = lambda c, *parts: F.when(F.col(c).isNotNull(), F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    s = lambda c: F.col(c).cast("string")
    more = F.when(F.col("n_direct") > max_show, F.concat(F.lit("\n- _... and "), (F.col("n_direct") - max_show).cast("string"), F.lit(" more direct_"))).otherwise("")
    fixed = F.when(F.col("bumps").isNotNull() | F.col("bad").isNotNull(), F.concat_ws("\n", F.lit("## Minimal remediation\n"), "bumps", "bad", F.concat(F.lit("\n_"), F.coalesce(s("cleared"), F.lit("0")), F.lit("/"), s("n_alert"), F.lit(" exposures cleared by "), F.coalesce(s("n_bumps"), F.lit("0")), F.lit(" bump(s)._\n"))))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("# Supply-chain exposure - `"), "manifest", F.lit(f"`\n_generated {generated}{f' - as-of {as_of}' if as_of else ''}_\n")),
        F.concat(F.lit("**"), s("n_alert"), F.lit(" exposures** need action - "), (F.col("n_all") - F.col("n_alert")).cast("string"), F.lit(" findings suppressed (with reason) - an audit that lists everything would show all "), s("n_all"), F.lit(".\n")),
        some("direct", F.concat(F.lit("## Direct exposures ("), s("n_direct"), F.lit(") - a vulnerable version is a direct dependency\n\n")), F.col("direct"), more, "\n"),
        some("trans", "## Transitive exposures (each carries the path that proves it)\n\n", F.col("trans")),
        fixed,
        some("quiet", "## Suppressed (present in the tree, not actioned)\n\n| finding | why not an alert |\n|---|---|\n", F.col("quiet")),
    )
    return out.select("root", text.alias("markdown"))


def cyclonedx(reached: DataFrame, rows: DataFrame, versions: DataFrame, packages: DataFrame, generated: str) -> DataFrame:
    """root, bom: a CycloneDX 1.5 document with every component reached (root, node, depth, hops) and the alerted findings."""
    m = manifests(versions, packages)
    comp = reached.join(m.select(F.col("root").alias("node"), "ecosystem", "name", "version"), "node")
    part = F.struct(F.lit("library").alias("type"), "name", "version", F.concat(F.lit("pkg:"), "ecosystem", F.lit("/"), "name", F.lit("@"), "version").alias("purl"))
    comps = comp.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "node", part.alias("c")))), lambda x: x["c"]).alias("components"))
    rating = F.array(F.struct(F.col("severity").alias("score"), F.col("band").alias("severity"), F.lit("CVSSv3").alias("method")))
    vuln = F.struct(F.col("advisory").alias("id"), F.struct(F.lit("OSV").alias("name")).alias("source"), rating.alias("ratings"), F.array(F.struct(F.col("terminal").alias("ref"))).alias("affects"), F.concat(F.lit("exposure path: "), "path").alias("description"))
    vulns = rows.where("alert").groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("severity")).alias("s"), "depth", "advisory", vuln.alias("v")))), lambda x: x["v"]).alias("vulnerabilities"))
    app = F.struct(F.lit("application").alias("type"), "name", "version")
    out = comps.join(m, "root").join(vulns, "root", "left")
    bom = F.struct(F.lit("CycloneDX").alias("bomFormat"), F.lit("1.5").alias("specVersion"), F.lit(1).alias("version"), F.struct(F.lit(generated).alias("timestamp"), app.alias("component")).alias("metadata"), "components", F.coalesce("vulnerabilities", F.array()).alias("vulnerabilities"))
    return out.select("root", F.to_json(bom).alias("bom"))


def lock_files(reached: DataFrame, versions: DataFrame, packages: DataFrame, max_nodes: int = 4000) -> DataFrame:
    """root, lock: pypi requirements or an npm lock file of version 3; '' for other ecosystems. Of two versions of a name the one that
    the walk meets later stays; the walk ends once it holds max_nodes names."""
    from pyspark.sql import Window as W

    m = manifests(versions, packages)
    each = reached.join(m.select(F.col("root").alias("node"), "name", "version"), "node").withColumn("k", F.row_number().over(W.partitionBy("root").orderBy("depth", "hops")))
    new = each.withColumn("f", F.row_number().over(W.partitionBy("root", "name").orderBy("k")) == 1).withColumn("names", F.sum(F.col("f").cast("int")).over(W.partitionBy("root").orderBy("k").rowsBetween(W.unboundedPreceding, -1)))
    pins = new.where(F.coalesce("names", F.lit(0)) < max_nodes).groupBy("root", "name").agg(F.max_by("version", "k").alias("version"), F.min("k").alias("first")).where(F.length("version") > 0)
    lines = pins.groupBy("root").agg(F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit("=="), "version"))), "\n").alias("pip"), F.array_sort(F.collect_list(F.struct("first", "name", "version"))).alias("p"))
    npm = F.map_concat(F.create_map(F.lit(""), F.struct(F.lit("generated").alias("name"), F.lit("0.0.0").alias("version"))), F.map_from_entries(F.transform("p", lambda x: F.struct(F.concat(F.lit("node_modules/"), x["name"]), F.struct(F.lit(None).cast("string").alias("name"), x["version"].alias("version"))))))
    doc = F.to_json(F.struct(F.lit("generated").alias("name"), F.lit("0.0.0").alias("version"), F.lit(3).alias("lockfileVersion"), F.lit(True).alias("requires"), npm.alias("packages")))
    return lines.join(m, "root").select("root", F.when(F.col("ecosystem") == "pypi", F.concat("pip", F.lit("\n"))).when(F.col("ecosystem") == "npm", doc).otherwise("").alias("lock"))
