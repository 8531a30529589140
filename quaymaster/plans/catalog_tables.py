"""Queries over scans, projections, joins, aggregates, orders and sets, each with the SQL that states it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import requirements as R
from ..functions import scores as S
from ..functions import versions as V
from ..operators import advisories as A
from ..operators import graph as G
from ..operators import resolution as RES
from ..operators import structure as ST
from ..operators.order import numbered
from ..sources import readers
from .bridge import cte, table, tables
from .staging import kept, shared_dir, staged

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Registers a query f(spark, sf_dir); sql may use the derived tables it needs."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (cte(*needs) + "\n" if needs else "") + sql
        return f

    return add


def q6(x: str) -> str:
    """The quantised form of a number, as functions.scores.quantised has it."""
    return f"floor(({x}) * CAST(1000000 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(1000000 AS DOUBLE)"


def Q(x):
    return S.quantised(x)


def raw(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ------------------------------------------------------------------------------------------------------------ scans and sinks

@query("src13_parquet_scan", "SELECT ecosystem, count(*) AS n FROM packages GROUP BY ecosystem", ("packages",))
def _(spark, sf):
    return table(spark, sf, "packages").groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"))


@query("src14_sql_view", "SELECT e.ecosystem, count(*) AS n_versions, count(DISTINCT v.pkg_id) AS n_packages FROM versions v JOIN packages e ON v.pkg_id = e.pkg_id GROUP BY e.ecosystem", ("packages", "versions"))
def _(spark, sf):
    v, p = tables(spark, sf, "versions", "packages")
    return spark.sql("SELECT e.ecosystem, count(*) AS n_versions, count(DISTINCT v.pkg_id) AS n_packages FROM {v} v JOIN {p} e ON v.pkg_id = e.pkg_id GROUP BY e.ecosystem", v=v, p=p)


@query("src07_jsonl_scan", "SELECT p.ecosystem, p.name AS package, v.version FROM versions v JOIN packages p ON v.pkg_id = p.pkg_id WHERE v.is_default", ("packages", "versions"))
def _(spark, sf):
    v, p = tables(spark, sf, "versions", "packages")
    path = f"{shared_dir(spark)}/qm-jsonl-{abs(hash(sf))}"
    v.where("is_default").join(p, "pkg_id").select("ecosystem", F.col("name").alias("package"), "version", F.array("version").alias("versions")).write.mode("overwrite").json(path)
    return readers.dependency_records(spark, path).select("ecosystem", "package", "version")


@query("src08_csv_scan", "SELECT p.ecosystem AS platform, p.name, v.version AS number, CAST(NULL AS STRING) AS missing FROM versions v JOIN packages p ON v.pkg_id = p.pkg_id", ("packages", "versions"))
def _(spark, sf):
    v, p = tables(spark, sf, "versions", "packages")
    path = f"{shared_dir(spark)}/qm-csv-{abs(hash(sf))}"
    v.join(p, "pkg_id").select(F.col("ecosystem").alias("Platform"), F.col("name").alias("Project Name"), F.col("version").alias("Number"), F.col("published").alias("Published Timestamp"), F.lit('a "quoted", text').alias("Other")).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    got = readers.csv_shards(spark, path, ["Platform", "Project Name", "Number", "Missing"], "*.csv")
    return got.toDF("platform", "name", "number", "missing")


@query("snk01_parquet_round_trip", "SELECT ver_id, pkg_id, version, is_default, published FROM versions", ("versions",))
def _(spark, sf):
    path = f"{shared_dir(spark)}/qm-out-{abs(hash(sf))}"
    readers.write_tables({"versions": table(spark, sf, "versions").select("ver_id", "pkg_id", "version", "is_default", "published")}, path)
    return readers.graph_tables(spark, path, "versions")[0]


@query("snk03_build_stats", "SELECT (SELECT count(*) FROM packages) AS packages, (SELECT count(*) FROM versions) AS versions, (SELECT count(*) FROM resolved) AS resolved, (SELECT count(*) FROM advisories) AS advisories, (SELECT count(*) FROM affected_versions) AS affected_versions", ("packages", "versions", "resolved", "advisories", "affected_versions"))
def _(spark, sf):
    names = ("packages", "versions", "resolved", "advisories", "affected_versions")
    one = [t.agg(F.count(F.lit(1)).alias(n)) for n, t in zip(names, tables(spark, sf, *names), strict=True)]
    out = one[0]
    for t in one[1:]:
        out = out.crossJoin(t)
    return out


# ------------------------------------------------------------------------------------------------------------ projections

@query("prj01_interning", "SELECT ecosystem, name, dense_rank() OVER (ORDER BY ecosystem, name) - 1 AS id FROM packages", ("packages",))
def _(spark, sf):
    return numbered(table(spark, sf, "packages").select("ecosystem", "name"), ["ecosystem", "name"], "id")


@query("prj02_ecosystem_names", "SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN 'pypi' WHEN 1 THEN 'cargo' WHEN 2 THEN 'maven' WHEN 3 THEN 'go' ELSE 'strange' END AS ecosystem FROM part")
def _(spark, sf):
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, "PyPI").when(k == 1, "crates.io").when(k == 2, "Maven:central").when(k == 3, " Go ").otherwise("Strange")
    return raw(spark, sf, "part").select(F.col("p_partkey").alias("id"), readers.ecosystem(said).alias("ecosystem"))


@query("prj03_platform_filter", "SELECT pkg_id, name FROM packages WHERE ecosystem IN ('npm', 'pypi')", ("packages",))
def _(spark, sf):
    return table(spark, sf, "packages").where(F.lower(F.trim("ecosystem")).isin("npm", "pypi")).select("pkg_id", "name")


@query("prj04_runtime_filter", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R' AND l_linestatus <> 'F'")
def _(spark, sf):
    d = raw(spark, sf, "lineitem").withColumn("Dependency Kind", F.when(F.col("l_returnflag") == "R", "Development").otherwise("Runtime")).withColumn("Optional Dependency", (F.col("l_linestatus") == "F").cast("string"))
    return readers.runtime_dependencies(d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("prj05_advisory_fields", "SELECT adv_id, substr(summary, 1, 12) AS summary, coalesce(published, '') AS published, withdrawn FROM advisories", ("advisories",))
def _(spark, sf):
    return table(spark, sf, "advisories").select("adv_id", F.substring("summary", 1, 12).alias("summary"), F.coalesce("published", F.lit("")).alias("published"), "withdrawn")


@query("prj06_distinct_edges", "SELECT ver_id, res_ver_id FROM resolved", ("resolved",))
def _(spark, sf):
    r = table(spark, sf, "resolved")
    return r.unionAll(r).distinct()


@query("prj07_first_record", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY user_id")
def _(spark, sf):
    return A.first_records(raw(spark, sf, "events").select("user_id", "event_id"), "user_id", ["event_id"])


@query("prj08_dedupe_affected", "SELECT adv_id, pkg_id, lo_key FROM affected", ("affected",))
def _(spark, sf):
    a = table(spark, sf, "affected").select("adv_id", "pkg_id", "lo_key")
    return a.unionAll(a).dropDuplicates(["adv_id", "pkg_id", "lo_key"])


@query("prj09_candidate_canon", "SELECT a.osv_id, coalesce(min(l.alias), a.osv_id) AS canon FROM advisories a LEFT JOIN aliases l ON a.osv_id = l.osv_id GROUP BY a.osv_id", ("advisories", "aliases"))
def _(spark, sf):
    a, l = tables(spark, sf, "advisories", "aliases")
    got = a.join(l.groupBy("osv_id").agg(F.sort_array(F.collect_set("alias")).alias("al")), "osv_id", "left")
    return got.select("osv_id", F.coalesce(F.get(F.filter("al", lambda x: F.startswith(x, F.lit("CVE-"))), F.lit(0)), "osv_id").alias("canon"))


@query("prj10_default_versions", "SELECT pkg_id, version FROM versions WHERE is_default", ("versions",))
def _(spark, sf):
    v = table(spark, sf, "versions")
    latest = v.groupBy("pkg_id").agg(F.max("vkey").alias("vkey"))
    return v.join(latest, ["pkg_id", "vkey"], "left_semi").select("pkg_id", "version")


@query("prj11_package_graph", "SELECT src, dst FROM pkgdep", ("pkgdep",))
def _(spark, sf):
    return G.package_graph(*tables(spark, sf, "resolved", "versions"))


@query("prj12_real_packages", "SELECT p.pkg_id, p.name FROM packages p WHERE EXISTS (SELECT 1 FROM versions v WHERE v.pkg_id = p.pkg_id)", ("packages", "versions"))
def _(spark, sf):
    p, v = tables(spark, sf, "packages", "versions")
    return p.join(v, "pkg_id", "left_semi").select("pkg_id", "name")


@query("prj13_roots", "SELECT root FROM roots", ("roots",))
def _(spark, sf):
    return G.roots(*tables(spark, sf, "versions", "resolved"))


@query("prj13_application_packages", "SELECT DISTINCT src AS pkg_id FROM pkgdep WHERE src NOT IN (SELECT dst FROM pkgdep)", ("pkgdep",))
def _(spark, sf):
    return G.application_packages(table(spark, sf, "pkgdep"))


@query("prj13_connected_core", "SELECT src AS node FROM pkgdep UNION SELECT dst FROM pkgdep", ("pkgdep",))
def _(spark, sf):
    return G.nodes_of(table(spark, sf, "pkgdep"))


@query("prj14_live_advisories", "SELECT adv_id, osv_id FROM advisories WHERE NOT withdrawn", ("advisories",))
def _(spark, sf):
    return table(spark, sf, "advisories").where(~F.col("withdrawn")).select("adv_id", "osv_id")


@query("prj15_installable", "SELECT ver_id FROM versions WHERE length(version) > 0", ("versions",))
def _(spark, sf):
    return table(spark, sf, "versions").where(F.length("version") > 0).select("ver_id")


@query("prj16_induced_subgraph", "SELECT a.src, a.dst FROM pkgdep a JOIN packages p ON a.src = p.pkg_id JOIN packages r ON a.dst = r.pkg_id WHERE p.ecosystem = 'npm' AND r.ecosystem = 'npm'", ("pkgdep", "packages"))
def _(spark, sf):
    e, p = tables(spark, sf, "pkgdep", "packages")
    return G.induced(p.where("ecosystem = 'npm'").select(F.col("pkg_id").alias("node")), e)


@query("prj17_undirected_simple", "SELECT src, dst FROM pkgdep UNION SELECT dst, src FROM pkgdep", ("pkgdep",))
def _(spark, sf):
    return G.undirected(table(spark, sf, "pkgdep"))


@query("prj18_undirected_multi", "SELECT src, dst FROM pkgdep UNION ALL SELECT dst, src FROM pkgdep", ("pkgdep",))
def _(spark, sf):
    return G.undirected(table(spark, sf, "pkgdep"), distinct=False)


@query("prj19_edge_sample", "SELECT src, dst FROM pkgdep WHERE (src * 7919 + dst * 104729) % 1000 < 250", ("pkgdep",))
def _(spark, sf):
    # sampling is the operator: a quarter of the edges, chosen by arithmetic on their ends
    return table(spark, sf, "pkgdep").where((F.col("src") * 7919 + F.col("dst") * 104729) % 1000 < 250)


# ------------------------------------------------------------------------------------------------------------ joins

@query("jn01_endpoint_retention", "SELECT count(*) AS declared, sum(CASE WHEN a.ver_id IS NOT NULL AND b.ver_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN a.ver_id IS NOT NULL AND b.ver_id IS NOT NULL THEN 0 ELSE 1 END)::BIGINT AS dangling FROM resolved r LEFT JOIN versions a ON r.ver_id = a.ver_id LEFT JOIN versions b ON r.res_ver_id = b.ver_id", ("resolved", "versions"))
def _(spark, sf):
    return G.retention(*tables(spark, sf, "resolved", "versions"))


@query("jn02_named_dependencies", "SELECT p.ecosystem, count(*) AS n FROM resolved r JOIN versions a ON r.ver_id = a.ver_id JOIN versions b ON r.res_ver_id = b.ver_id JOIN packages p ON a.pkg_id = p.pkg_id JOIN packages s ON b.pkg_id = s.pkg_id WHERE p.ecosystem = s.ecosystem GROUP BY p.ecosystem", ("resolved", "versions", "packages"))
def _(spark, sf):
    r, v, p = tables(spark, sf, "resolved", "versions", "packages")
    named = v.join(p, "pkg_id").select("ver_id", "ecosystem")
    return r.join(named, "ver_id").join(named.toDF("res_ver_id", "eco2"), "res_ver_id").where("ecosystem = eco2").groupBy("ecosystem").agg(F.count(F.lit(1)).alias("n"))


def wanted(spark, sf) -> DataFrame:
    """A caret requirement on the version each dependency was resolved to, as if every package were of npm."""
    r, v = tables(spark, sf, "resolved", "versions")
    return r.join(v.select(F.col("ver_id").alias("res_ver_id"), "pkg_id", "version"), "res_ver_id").select("pkg_id", F.lit("npm").alias("ecosystem"), F.concat(F.lit("^"), "version").alias("requirement"))


_WANTED = "w AS (SELECT DISTINCT v.pkg_id, v.version, v.vkey FROM resolved r JOIN versions v ON r.res_ver_id = v.ver_id)"


@query("jn03_resolve_requirements", cte("resolved", "versions") + f", {_WANTED} SELECT w.pkg_id, concat('^', w.version) AS requirement, max(v.ver_id) AS ver_id FROM w JOIN versions v ON v.pkg_id = w.pkg_id AND v.vkey >= w.vkey AND floor(v.vkey / 25.0) = floor(w.vkey / 25.0) GROUP BY w.pkg_id, w.version")
def _(spark, sf):
    return RES.resolve(wanted(spark, sf).distinct(), table(spark, sf, "versions")).select("pkg_id", "requirement", "ver_id")


def entries(spark, sf) -> DataFrame:
    """The affected intervals written as OSV entries, so that they go the whole way through JSON and version keys; every package as npm."""
    a = table(spark, sf, "affected")
    text = lambda k: F.concat((F.floor(k / 25) + 1).cast("string"), F.lit("."), (F.floor(k / 5) % 5).cast("string"), F.lit("."), (k % 5).cast("string"))
    events = F.array(F.create_map(F.lit("introduced"), text(F.col("lo_key"))), F.create_map(F.lit("fixed"), text(F.col("hi_key"))))
    ranges = F.array(F.struct(F.lit("GIT").alias("type"), F.array(F.create_map(F.lit("introduced"), F.lit("0"))).alias("events")), F.struct(F.lit("ECOSYSTEM").alias("type"), events.alias("events")))
    return a.select("adv_id", "pkg_id", F.to_json(F.struct(ranges.alias("ranges"))).alias("entry_json"))


def affected_by_ranges(spark, sf) -> DataFrame:
    def make():
        v, p = tables(spark, sf, "versions", "packages")
        return A.affected_versions(entries(spark, sf), v, p.select("pkg_id", F.lit("npm").alias("ecosystem")))

    return kept(spark, (sf, "ranged"), make)


@query("jn04_affected_versions", "SELECT adv_id, ver_id FROM affected_versions", ("affected_versions",))
def _(spark, sf):
    return affected_by_ranges(spark, sf)


@query("jn05_version_advisories", "SELECT av.ver_id, a.osv_id, a.severity FROM affected_versions av JOIN advisories a ON av.adv_id = a.adv_id", ("affected_versions", "advisories"))
def _(spark, sf):
    av, a = tables(spark, sf, "affected_versions", "advisories")
    return av.join(a, "adv_id").select("ver_id", "osv_id", "severity")


@query("jn06_neighbours", "SELECT 'out' AS way, ver_id AS node, res_ver_id AS neighbour FROM resolved UNION ALL SELECT 'in', res_ver_id, ver_id FROM resolved", ("resolved",))
def _(spark, sf):
    r = table(spark, sf, "resolved")
    return r.select(F.lit("out").alias("way"), F.col("ver_id").alias("node"), F.col("res_ver_id").alias("neighbour")).unionAll(r.select(F.lit("in"), "res_ver_id", "ver_id"))


@query("jn07_package_lookup", "SELECT e.event_id, coalesce(p.pkg_id, -1) AS pkg_id FROM events e LEFT JOIN packages p ON e.user_id = p.pkg_id AND p.ecosystem = 'npm'", ("packages",))
def _(spark, sf):
    p = table(spark, sf, "packages").where("ecosystem = 'npm'").select("pkg_id")
    return raw(spark, sf, "events").join(p, F.col("user_id") == F.col("pkg_id"), "left").select("event_id", F.coalesce("pkg_id", F.lit(-1)).alias("pkg_id"))


@query("jn08_default_version", "SELECT pkg_id, max(ver_id) AS ver_id FROM versions GROUP BY pkg_id", ("versions",))
def _(spark, sf):
    return G.default_version(table(spark, sf, "versions"))


def canon(spark, sf) -> DataFrame:
    return kept(spark, (sf, "canon"), lambda: A.canonical_ids(*tables(spark, sf, "advisories", "aliases")))


#: In the derived tables an advisory has one alias at most, so groups are those of one alias.
_CANON = "SELECT a.osv_id, coalesce(l.alias, a.osv_id) AS canon_id FROM advisories a LEFT JOIN aliases l ON a.osv_id = l.osv_id"


@query("jn09_advisory_packages", cte("affected_versions", "versions", "advisories", "aliases") + f", c AS ({_CANON}), k AS (SELECT osv_id AS id, adv_id FROM advisories UNION SELECT c.canon_id, a.adv_id FROM c JOIN advisories a ON c.osv_id = a.osv_id UNION SELECT l.alias, a.adv_id FROM aliases l JOIN advisories a ON l.osv_id = a.osv_id) SELECT DISTINCT upper(k.id) AS id, v.pkg_id FROM k JOIN affected_versions av ON k.adv_id = av.adv_id JOIN versions v ON av.ver_id = v.ver_id")
def _(spark, sf):
    a, l, av, v = tables(spark, sf, "advisories", "aliases", "affected_versions", "versions")
    return A.id_index(a, l, canon(spark, sf)).join(av, "adv_id").join(v.select("ver_id", "pkg_id"), "ver_id").select("id", "pkg_id").distinct()


@query("jn10_as_of_filter", "SELECT adv_id FROM advisories WHERE substr(published, 1, 10) <= '2024-01-12'", ("advisories",))
def _(spark, sf):
    return table(spark, sf, "advisories").where(F.substring("published", 1, 10) <= "2024-01-12").select("adv_id")


@query("jn11_overlay_edges", "SELECT r.ver_id AS src, coalesce(n.ver_id, r.res_ver_id) AS dst FROM resolved r JOIN versions v ON r.res_ver_id = v.ver_id LEFT JOIN versions n ON v.pkg_id = n.pkg_id AND n.is_default", ("resolved", "versions"))
def _(spark, sf):
    r, v = tables(spark, sf, "resolved", "versions")
    redirect = v.join(v.where("is_default").select("pkg_id", F.col("ver_id").alias("new")), "pkg_id").select(F.col("ver_id").alias("res_ver_id"), "new")
    return r.join(redirect, "res_ver_id", "left").select(F.col("ver_id").alias("src"), F.coalesce("new", "res_ver_id").alias("dst"))


@query("jn12_compare_findings", "WITH a AS (SELECT DISTINCT l_orderkey k, l_partkey p FROM lineitem WHERE l_discount < 0.06), b AS (SELECT DISTINCT l_orderkey k, l_partkey p FROM lineitem WHERE l_discount > 0.03) SELECT count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both_sides, count(*) FILTER (b.k IS NULL) AS only_ours, count(*) FILTER (a.k IS NULL) AS only_theirs FROM a FULL JOIN b ON a.k = b.k AND a.p = b.p")
def _(spark, sf):
    l = raw(spark, sf, "lineitem")
    a = l.where("l_discount < 0.06D").select("l_orderkey", "l_partkey").distinct().withColumn("ours", F.lit(True))
    b = l.where("l_discount > 0.03D").select("l_orderkey", "l_partkey").distinct().withColumn("theirs", F.lit(True))
    n = lambda c, name: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(name)
    return a.join(b, ["l_orderkey", "l_partkey"], "full").agg(n(F.col("ours").isNotNull() & F.col("theirs").isNotNull(), "both_sides"), n(F.col("theirs").isNull(), "only_ours"), n(F.col("ours").isNull(), "only_theirs"))


@query("jn13_control_pairs", "SELECT src.pkg_id, c.pkg_id AS control FROM (SELECT pkg_id, ecosystem, row_number() OVER (PARTITION BY ecosystem ORDER BY (pkg_id * 7919) % 100003, pkg_id) AS k, count(*) OVER (PARTITION BY ecosystem) AS n FROM packages) src JOIN (SELECT pkg_id, ecosystem, row_number() OVER (PARTITION BY ecosystem ORDER BY (pkg_id * 7919) % 100003, pkg_id) AS k FROM packages) c ON c.ecosystem = src.ecosystem AND c.k = src.k % src.n + 1 AND c.pkg_id <> src.pkg_id", ("packages",))
def _(spark, sf):
    # each package's control is the next one of its ecosystem in a scattered order: linear, where a pairing of all would be quadratic
    p = table(spark, sf, "packages")
    w = W.partitionBy("ecosystem")
    k = p.withColumn("k", F.row_number().over(w.orderBy((F.col("pkg_id") * 7919) % 100003, "pkg_id"))).withColumn("n", F.count(F.lit(1)).over(w))
    c = k.select("ecosystem", F.col("k").alias("next"), F.col("pkg_id").alias("control"))
    return k.withColumn("next", F.col("k") % F.col("n") + 1).join(c, ["ecosystem", "next"]).where("pkg_id <> control").select("pkg_id", "control")


# ------------------------------------------------------------------------------------------------------------ aggregates over tables

@query("agg03_canonical_ids", cte("advisories", "aliases") + " " + _CANON)
def _(spark, sf):
    return canon(spark, sf)


@query("agg04_withdrawn", "SELECT osv_id FROM advisories WHERE withdrawn", ("advisories",))
def _(spark, sf):
    return table(spark, sf, "advisories").where("withdrawn").select("osv_id")


@query("agg05_fixed_versions", "SELECT adv_id, array_agg(DISTINCT concat(CAST(CAST(floor(hi_key / 25.0) AS BIGINT) + 1 AS STRING), '.', CAST(CAST(floor(hi_key / 5.0) AS BIGINT) % 5 AS STRING), '.', CAST(hi_key % 5 AS STRING))) AS fixed FROM affected GROUP BY adv_id", ("affected",))
def _(spark, sf):
    return A.fixed_by_advisory(entries(spark, sf))


@query("agg06_materialise_stats", cte("advisories", "aliases", "affected_versions") + f", c AS ({_CANON}) SELECT (SELECT count(*) FROM advisories) AS advisories, (SELECT count(DISTINCT canon_id) FROM c) AS groups, (SELECT count(*) FROM advisories WHERE withdrawn) AS withdrawn, (SELECT count(*) FROM affected_versions) AS pairs, (SELECT count(DISTINCT adv_id) FROM affected_versions) AS with_hit")
def _(spark, sf):
    a = table(spark, sf, "advisories").agg(F.count(F.lit(1)).alias("advisories"), F.sum(F.col("withdrawn").cast("long")).alias("withdrawn"))
    av = affected_by_ranges(spark, sf).agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("adv_id").alias("with_hit"))
    return a.crossJoin(canon(spark, sf).agg(F.countDistinct("canon_id").alias("groups"))).crossJoin(av).select("advisories", "groups", "withdrawn", "pairs", "with_hit")


@query("agg07_retention", cte("resolved", "versions") + f", {_WANTED} SELECT count(*) AS declared, count(*) AS resolved, CAST(0 AS BIGINT) AS dangling, (SELECT count(*) FROM w) AS distinct_requirements FROM resolved")
def _(spark, sf):
    got = RES.resolve(wanted(spark, sf), table(spark, sf, "versions"))
    return RES.retention(got.select(F.col("pkg_id").alias("dep_pkg"), "requirement", F.col("ver_id").alias("res_ver_id")))


@query("agg11_feed_by_day", f"SELECT published, count(*) AS n, {q6('avg(severity)')} AS mean, median(severity) AS mid, {q6('avg(CASE WHEN severity >= 9 THEN 1.0::DOUBLE ELSE 0 END)')} AS share_critical FROM advisories WHERE severity > 0 GROUP BY published", ("advisories",))
def _(spark, sf):
    a = table(spark, sf, "advisories").where("severity > 0")
    return a.groupBy("published").agg(F.count(F.lit(1)).alias("n"), Q(F.avg("severity")).alias("mean"), F.expr("percentile(severity, 0.5)").alias("mid"), Q(F.avg((F.col("severity") >= 9).cast("double"))).alias("share_critical"))


@query("agg11_feed_by_year", f"SELECT substr(published, 1, 4) AS year, count(*) AS n, {q6('avg(CASE WHEN severity > 0 THEN severity END)')} AS mean FROM advisories GROUP BY 1", ("advisories",))
def _(spark, sf):
    return table(spark, sf, "advisories").groupBy(F.substring("published", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"), Q(F.avg(F.when(F.col("severity") > 0, F.col("severity")))).alias("mean"))


@query("agg13_first_advisory_day", "SELECT v.pkg_id, min(a.published) AS first FROM affected_versions av JOIN advisories a ON av.adv_id = a.adv_id JOIN versions v ON av.ver_id = v.ver_id WHERE NOT a.withdrawn GROUP BY v.pkg_id", ("affected_versions", "advisories", "versions"))
def _(spark, sf):
    av, a, v = tables(spark, sf, "affected_versions", "advisories", "versions")
    return av.join(a.where(~F.col("withdrawn")), "adv_id").join(v.select("ver_id", "pkg_id"), "ver_id").groupBy("pkg_id").agg(F.min("published").alias("first"))


@query("agg14_versions_per_package", "SELECT p.pkg_id, count(v.ver_id) AS n FROM packages p LEFT JOIN versions v ON p.pkg_id = v.pkg_id GROUP BY p.pkg_id", ("packages", "versions"))
def _(spark, sf):
    p, v = tables(spark, sf, "packages", "versions")
    return p.join(v.groupBy("pkg_id").agg(F.count(F.lit(1)).alias("n")), "pkg_id", "left").select("pkg_id", F.coalesce("n", F.lit(0)).alias("n"))


_YEAR = "(CAST(substr({0}, 1, 4) AS DOUBLE) + (CAST(substr({0}, 6, 2) AS DOUBLE) - 1) / 12 + (CAST(substr({0}, 9, 2) AS DOUBLE) - 1) / 365)"


@query("agg15_package_age", f"SELECT pkg_id, {q6('min(' + _YEAR.format('published') + ')')} AS born FROM versions GROUP BY pkg_id", ("versions",))
def _(spark, sf):
    return table(spark, sf, "versions").groupBy("pkg_id").agg(Q(F.min(S.year_fraction(F.col("published")))).alias("born"))


# ------------------------------------------------------------------------------------------------------------ orders

@query("ord06_version_sort", "SELECT ver_id, row_number() OVER (PARTITION BY pkg_id ORDER BY vkey) AS pos FROM versions", ("versions",))
def _(spark, sf):
    v, p = tables(spark, sf, "versions", "packages")
    k = v.join(p, "pkg_id").withColumn("key", V.sort_key(V.version_key(F.col("version"), F.col("ecosystem"))))
    return k.select("ver_id", F.row_number().over(W.partitionBy("pkg_id").orderBy("key")).alias("pos"))


@query("ord11_empirical_cdf", f"SELECT l_quantity AS x, {q6('count(*)::DOUBLE * 1.0 / sum(count(*)) OVER () * 1.0')} AS share, {q6('sum(count(*)) OVER (ORDER BY l_quantity)::DOUBLE / sum(count(*)) OVER ()')} AS cdf FROM lineitem GROUP BY l_quantity")
def _(spark, sf):
    h = raw(spark, sf, "lineitem").groupBy(F.col("l_quantity").alias("x")).agg(F.count(F.lit(1)).alias("c"))
    t = h.agg(F.sum("c").alias("n"))
    return h.crossJoin(t).select("x", Q(F.col("c").cast("double") / F.col("n")).alias("share"), Q(F.sum("c").over(W.orderBy("x")).cast("double") / F.col("n")).alias("cdf"))


@query("ord11_quantiles", "SELECT quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.99) AS p99, max(l_extendedprice) AS top FROM lineitem")
def _(spark, sf):
    price = raw(spark, sf, "lineitem").select("l_extendedprice")
    return ST.quantiles(price, "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99}).crossJoin(price.agg(F.max("l_extendedprice").alias("top")))


# ------------------------------------------------------------------------------------------------------------ sets

@query("set01_cleared_introduced", "SELECT pkg_id, list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))) AS cleared, list_sort(list_distinct(list_filter(b, lambda x: NOT list_contains(a, x)))) AS introduced FROM (SELECT v.pkg_id, coalesce(array_agg(DISTINCT av.adv_id) FILTER (NOT v.is_default AND av.adv_id IS NOT NULL), []) AS a, coalesce(array_agg(DISTINCT av.adv_id) FILTER (v.is_default AND av.adv_id IS NOT NULL), []) AS b FROM versions v LEFT JOIN affected_versions av ON v.ver_id = av.ver_id GROUP BY v.pkg_id)", ("versions", "affected_versions"))
def _(spark, sf):
    v, av = tables(spark, sf, "versions", "affected_versions")
    g = v.join(av, "ver_id", "left").groupBy("pkg_id").agg(F.collect_set(F.when(~F.col("is_default"), F.col("adv_id"))).alias("a"), F.collect_set(F.when(F.col("is_default"), F.col("adv_id"))).alias("b"))
    return g.select("pkg_id", F.sort_array(F.array_except("a", "b")).alias("cleared"), F.sort_array(F.array_except("b", "a")).alias("introduced"))


@query("set02_overlap", "SELECT (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 5 INTERSECT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS both_sides, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity < 5 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45)) AS only_a, (SELECT count(*) FROM (SELECT l_partkey FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity < 5)) AS only_b")
def _(spark, sf):
    l = raw(spark, sf, "lineitem")
    a, b = l.where("l_quantity < 5").select("l_partkey"), l.where("l_quantity > 45").select("l_partkey")
    n = lambda d, name: d.agg(F.count(F.lit(1)).alias(name))
    return n(a.intersect(b), "both_sides").crossJoin(n(a.subtract(b), "only_a")).crossJoin(n(b.subtract(a), "only_b"))


@query("set03_union_nodes", "SELECT ver_id AS node FROM resolved UNION SELECT res_ver_id FROM resolved", ("resolved",))
def _(spark, sf):
    r = table(spark, sf, "resolved")
    return r.select(F.col("ver_id").alias("node")).union(r.select("res_ver_id")).distinct()


@query("set04_drop_sets", "SELECT t.tier, count(*) AS n FROM (VALUES (0), (1), (2), (3)) t(tier) JOIN advisories a ON NOT ((t.tier >= 1 AND a.withdrawn) OR (t.tier >= 2 AND a.severity < 4) OR (t.tier >= 3 AND a.severity < 7)) GROUP BY t.tier", ("advisories",))
def _(spark, sf):
    a = table(spark, sf, "advisories")
    drop = F.when(F.col("withdrawn"), 1).when(F.col("severity") < 4, 2).when(F.col("severity") < 7, 3).otherwise(4)
    return a.select(F.explode(F.filter(F.array(*map(F.lit, range(4))), lambda t: t < drop)).alias("tier")).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------------------------------------------------ scalars

@query("scl01_semver_fields", "SELECT ver_id, CAST(string_split(version, '.')[1] AS BIGINT) AS major, CAST(string_split(version, '.')[2] AS BIGINT) AS minor, CAST(string_split(version, '.')[3] AS BIGINT) AS patch, CASE WHEN ver_id % 3 = 0 THEN 'rc.1' END AS pre FROM versions", ("versions",))
def _(spark, sf):
    v = table(spark, sf, "versions").withColumn("said", F.concat(F.when(F.col("ver_id") % 2 == 0, "v").otherwise(""), "version", F.when(F.col("ver_id") % 3 == 0, "-rc.1").otherwise(""), F.when(F.col("ver_id") % 5 == 0, "+build7").otherwise("")))
    f = V.semver_fields(F.col("said"))
    return v.select("ver_id", f.alias("f")).select("ver_id", *[F.col(f"f.{c}").cast("long").alias(c) for c in ("major", "minor", "patch")], F.col("f.pre").alias("pre"))


@query("scl05_compare_versions", "SELECT a.ver_id, b.ver_id AS other, CASE WHEN a.vkey < b.vkey THEN -1 WHEN a.vkey > b.vkey THEN 1 ELSE 0 END AS sign FROM resolved r JOIN versions a ON r.ver_id = a.ver_id JOIN versions b ON r.res_ver_id = b.ver_id", ("resolved", "versions"))
def _(spark, sf):
    r, v = tables(spark, sf, "resolved", "versions")
    eco = F.element_at(F.array(*map(F.lit, ("npm", "maven", "pypi"))), (F.col("ver_id") % 3 + 1).cast("int"))
    j = r.join(v.select("ver_id", F.col("version").alias("a")), "ver_id").join(v.select(F.col("ver_id").alias("res_ver_id"), F.col("version").alias("b")), "res_ver_id")
    return j.select("ver_id", F.col("res_ver_id").alias("other"), V.compare(V.version_key(F.col("a"), eco), V.version_key(F.col("b"), eco)).alias("sign"))


@query("scl02_prerelease_order", "SELECT * FROM (VALUES ('1.0.0-alpha', 1), ('1.0.0-alpha.1', 2), ('1.0.0-alpha.beta', 3), ('1.0.0-beta', 4), ('1.0.0-beta.2', 5), ('1.0.0-beta.11', 6), ('1.0.0-rc.1', 7), ('1.0.0', 8)) t(version, pos)")
def _(spark, sf):
    names = ["1.0.0", "1.0.0-rc.1", "1.0.0-beta.11", "1.0.0-alpha.beta", "1.0.0-beta.2", "1.0.0-alpha", "1.0.0-beta", "1.0.0-alpha.1"]
    v = spark.createDataFrame([(n,) for n in names], "version string")
    return v.select("version", F.row_number().over(W.orderBy(V.semver_parts(F.col("version")))).alias("pos"))


@query("scl03_maven_order", "SELECT * FROM (VALUES ('1-alpha', 1), ('1-beta', 2), ('1-milestone', 3), ('1-rc', 4), ('1-SNAPSHOT', 5), ('1.0.1', 6), ('1.1', 7), ('1.1.2', 8), ('1.10', 9), ('2.0', 10)) t(version, pos)")
def _(spark, sf):
    names = ["2.0", "1.10", "1.1.2", "1.1", "1.0.1", "1-SNAPSHOT", "1-rc", "1-milestone", "1-beta", "1-alpha"]
    v = spark.createDataFrame([(n,) for n in names], "version string")
    return v.select("version", F.row_number().over(W.orderBy(V.maven_parts(F.col("version")))).alias("pos"))


@query("scl04_pep440_order", "SELECT * FROM (VALUES ('1.0.dev1', 1), ('1.0a1.dev1', 2), ('1.0a1', 3), ('1.0b2', 4), ('1.0rc1', 5), ('1.0', 6), ('1.0+abc.5', 7), ('1.0+abc.7', 8), ('1.0+5', 9), ('1.0.post1', 10), ('1.1', 11), ('1!0.1', 12)) t(version, pos)")
def _(spark, sf):
    names = ["1!0.1", "1.1", "1.0.post1", "1.0+5", "1.0+abc.7", "1.0+abc.5", "1.0", "1.0rc1", "1.0b2", "1.0a1", "1.0a1.dev1", "1.0.dev1"]
    v = spark.createDataFrame([(n,) for n in names], "version string")
    return v.select("version", F.row_number().over(W.orderBy(V.pep440_parts(F.col("version")))).alias("pos"))


@query("scl06_range_membership", "SELECT v.ver_id, (v.vkey >= 10 AND v.vkey < 30) OR v.vkey >= 80 AS hit FROM versions v", ("versions",))
def _(spark, sf):
    events = F.array(*[F.create_map(F.lit(k), F.lit(x)) for k, x in (("introduced", "1.2.0"), ("fixed", "2.1.0"), ("introduced", "4.1.0"))])
    return table(spark, sf, "versions").select("ver_id", V.in_intervals(F.col("version"), F.lit("npm"), V.intervals(events)).alias("hit"))


@query("scl07_affected_entry", "SELECT ver_id, CASE WHEN ver_id % 2 = 0 THEN version IN ('1.0.0', '1.0.3') ELSE vkey <= 12 END AS hit FROM versions", ("versions",))
def _(spark, sf):
    a, b = '{"versions":["1.0.0","1.0.3"],"ranges":[{"type":"SEMVER","events":[{"introduced":"0"}]}]}', '{"ranges":[{"type":"GIT","events":[{"introduced":"0"}]},{"type":"SEMVER","events":[{"introduced":"0"},{"last_affected":"1.2.2"}]}]}'
    v = table(spark, sf, "versions").withColumn("e", F.from_json(F.when(F.col("ver_id") % 2 == 0, a).otherwise(b), V.ENTRY))
    return v.select("ver_id", V.affected(F.col("version"), F.col("e"), F.lit("npm")).alias("hit"))


@query("scl09_satisfies", "SELECT ver_id, vkey >= 5 AND vkey < 25 AS caret, vkey >= 30 AND vkey < 35 AS tilde, vkey >= 10 AND vkey < 40 AS both_ends, vkey = 3 OR vkey >= 75 AS alternatives, vkey >= 25 AND vkey <= 50 AS hyphen, version LIKE '2.1%' AS x_range, vkey > 7 AND vkey <= 33 AS maven FROM versions", ("versions",))
def _(spark, sf):
    wishes = {"caret": "^1.1.0", "tilde": "~2.1.0", "both_ends": ">=1.2.0 <2.3.0", "alternatives": "1.0.3 || >=4.0.0", "hyphen": "2.0.0 - 3.0.0", "x_range": "2.1.x", "maven": "(1.1.2,2.1.3]"}
    eco = {k: F.lit("maven" if k == "maven" else "npm") for k in wishes}
    one = staged(spark.range(1).select(*[R.with_keys(R.parsed(F.lit(r), eco[k]), eco[k]).alias(k) for k, r in wishes.items()]), "wishes")  # parsed once, not for each row
    keyed = staged(table(spark, sf, "versions").select("ver_id", "version", V.version_key(F.col("version"), F.lit("npm")).alias("k_npm"), V.version_key(F.col("version"), F.lit("maven")).alias("k_maven")), "keyed")
    return keyed.crossJoin(F.broadcast(one)).select("ver_id", *[R.holds(F.col("version"), F.col("k_maven" if k == "maven" else "k_npm"), F.col(k)).alias(k) for k in wishes])


@query("scl09_satisfies_pypi", "SELECT ver_id, vkey >= 5 AND vkey < 50 AND vkey <> 12 AS hit FROM versions", ("versions",))
def _(spark, sf):
    return table(spark, sf, "versions").select("ver_id", R.satisfies(F.col("version"), F.lit(">=1.1.0,<3,!=1.2.2"), F.lit("pypi")).alias("hit"))


@query("scl11_bumps", "SELECT ver_id, CASE WHEN vkey % 100 < 0 THEN '' ELSE concat(CAST(CAST(floor(vkey / 25.0) AS BIGINT) + 2 AS STRING), '.0.0') END AS caret, concat(CAST(CAST(floor(vkey / 25.0) AS BIGINT) + 1 AS STRING), '.', CAST(CAST(floor(vkey / 5.0) AS BIGINT) % 5 + 1 AS STRING), '.0') AS tilde FROM versions", ("versions",))
def _(spark, sf):
    return table(spark, sf, "versions").select("ver_id", R.bump_caret(F.col("version")).alias("caret"), R.bump_tilde(F.col("version")).alias("tilde"))


@query("scl12_prerelease_test", "SELECT ver_id, ver_id % 4 IN (1, 2) AS pre, CAST(CAST(floor(vkey / 25.0) AS BIGINT) + 1 AS STRING) AS major FROM versions", ("versions",))
def _(spark, sf):
    said = F.concat("version", F.element_at(F.array(*map(F.lit, ("", "-beta.1", ".dev3", "+local"))), (F.col("ver_id") % 4 + 1).cast("int")))
    return table(spark, sf, "versions").select("ver_id", V.is_prerelease(said).alias("pre"), V.major(said).alias("major"))


_VECTOR = {"AV": "NALP", "AC": "LH", "PR": "NLH", "UI": "NR", "S": "UC", "C": "HLN", "I": "HLN", "A": "HLN"}


def _vector(engine: str) -> str:
    parts, div = [], 1
    for k, v in _VECTOR.items():
        parts.append(f"'/{k}:', substr('{v}', CAST(floor(event_id / {div}.0) AS INT) % {len(v)} + 1, 1)")
        div *= len(v)
    return f"concat('CVSS:3.1', {', '.join(parts)})"


def _cvss_sql() -> str:
    w = lambda m, name=None, d=S.WEIGHTS: "CASE substr(v, instr(v, '/%s:') + %d, 1) %s END" % (m, len(m) + 2, " ".join(f"WHEN '{k}' THEN CAST({x} AS DOUBLE)" for k, x in d[name or m].items()))
    return f"""WITH a AS (SELECT event_id, {_vector('duckdb')} AS v FROM events),
b AS (SELECT event_id, instr(v, '/S:C') > 0 AS changed, 1 - (1 - {w('C')}) * (1 - {w('I')}) * (1 - {w('A')}) AS base, {w('AV')} AS av, {w('AC')} AS ac, CASE WHEN instr(v, '/S:C') > 0 THEN {w('PR', 'PR_C')} ELSE {w('PR')} END AS pr, {w('UI')} AS ui FROM a),
c AS (SELECT event_id, changed, CASE WHEN changed THEN CAST(7.52 AS DOUBLE) * (base - CAST(0.029 AS DOUBLE)) - CAST(3.25 AS DOUBLE) * pow(base - CAST(0.02 AS DOUBLE), 15) ELSE CAST(6.42 AS DOUBLE) * base END AS impact, CAST(8.22 AS DOUBLE) * av * ac * pr * ui AS expl FROM b)
SELECT event_id, CASE WHEN impact <= 0 THEN CAST(0 AS DOUBLE) ELSE least(ceil(CASE WHEN changed THEN CAST(1.08 AS DOUBLE) * (impact + expl) ELSE impact + expl END * 10) / 10, CAST(10 AS DOUBLE)) END AS score FROM c"""


@query("scl14_cvss_v3", _cvss_sql())
def _(spark, sf):
    return raw(spark, sf, "events").select("event_id", S.score_v3(F.expr(_vector("spark"))).alias("score"))


@query("scl15_cvss_v4", _cvss_sql().replace("instr(v, '/S:C') > 0", "false"))
def _(spark, sf):
    four = F.regexp_replace(F.regexp_replace(F.expr(_vector("spark")), "^CVSS:3.1", "CVSS:4.0"), "/([CIA]):", "/V$1:")
    return raw(spark, sf, "events").select("event_id", S.score_v4(four).alias("score"))


@query("scl16_base_score", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CAST(10 AS DOUBLE) WHEN event_id % 3 = 1 THEN CAST(7.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS score FROM events")
def _(spark, sf):
    entry = lambda t, s: F.struct(F.lit(t).alias("type"), F.lit(s).alias("score"))
    full = F.array(entry("CVSS_V3", "CVSS:3.1/AV:N/AC:H/PR:L/UI:R/S:U/C:L/I:N/A:N"), entry("CVSS_V3", "CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H"))
    number = F.array(entry("CVSS_V3", "7.5"), entry("CVSS_V3", "garbage"))
    return raw(spark, sf, "events").select("event_id", S.base_score(F.when(F.col("event_id") % 3 == 0, full).when(F.col("event_id") % 3 == 1, number)).alias("score"))


@query("scl17_band", "SELECT adv_id, CASE WHEN severity = 0 THEN 'none' WHEN severity < 4 THEN 'low' WHEN severity < 7 THEN 'medium' WHEN severity < 9 THEN 'high' ELSE 'critical' END AS band FROM advisories", ("advisories",))
def _(spark, sf):
    return table(spark, sf, "advisories").select("adv_id", S.band(F.col("severity")).alias("band"))


@query("scl18_normalise", "SELECT pkg_id, trim(regexp_replace(lower(concat('Is  ', name, '?! OK')), '[^a-z0-9.:+/@_-]+', ' ', 'g')) AS norm, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS squashed FROM packages", ("packages",))
def _(spark, sf):
    return table(spark, sf, "packages").select("pkg_id", S.normalised(F.concat(F.lit("Is  "), "name", F.lit("?! OK"))).alias("norm"), S.squashed(F.col("name")).alias("squashed"))


@query("scl26_year_fraction", f"SELECT ver_id, {q6(_YEAR.format('published'))} AS t FROM versions", ("versions",))
def _(spark, sf):
    return table(spark, sf, "versions").select("ver_id", Q(S.year_fraction(F.col("published"))).alias("t"))


@query("scl25_manifest_labels", "SELECT v.ver_id, concat(p.ecosystem, '/', p.name, '@', v.version) AS manifest, concat('pkg:', p.ecosystem, '/', p.name, '@', v.version) AS purl FROM versions v JOIN packages p ON v.pkg_id = p.pkg_id", ("versions", "packages"))
def _(spark, sf):
    v, p = tables(spark, sf, "versions", "packages")
    label = F.concat("ecosystem", F.lit("/"), "name", F.lit("@"), "version")
    return v.join(p, "pkg_id").select("ver_id", label.alias("manifest"), F.concat(F.lit("pkg:"), label).alias("purl"))


@query("scl27_year_prefix", "SELECT adv_id, CAST(substr(published, 1, 4) AS INT) AS year FROM advisories", ("advisories",))
def _(spark, sf):
    return table(spark, sf, "advisories").select("adv_id", F.when(F.col("published").rlike(r"^\d{4}"), F.substring("published", 1, 4).cast("int")).alias("year"))


@query("scl29_standardise", f"SELECT pkg_id, {q6('(ln(1 + n) - avg(ln(1 + n)) OVER ()) / (stddev_pop(ln(1 + n)) OVER () + 0.000001)')} AS z FROM (SELECT pkg_id, count(*)::DOUBLE AS n FROM versions GROUP BY pkg_id)", ("versions",))
def _(spark, sf):
    n = table(spark, sf, "versions").groupBy("pkg_id").agg(F.log1p(F.count(F.lit(1)).cast("double")).alias("x"))
    return n.crossJoin(n.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))).select("pkg_id", Q((F.col("x") - F.col("m")) / (F.col("s") + 1e-6)).alias("z"))


@query("scl30_cosine", f"SELECT a.vec_id, {q6('list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))')} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = raw(spark, sf, "embeddings")
    return e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id").select("vec_id", Q(S.cosine(F.col("embedding"), F.col("other"))).alias("cosine"))


@query("scl32_symbol_hint", "SELECT adv_id, (summary LIKE '%function%' OR summary LIKE '%call to%') AS symbol FROM advisories", ("advisories",))
def _(spark, sf):
    from ..operators.policy import has_symbol

    return table(spark, sf, "advisories").select("adv_id", has_symbol(F.col("summary")).alias("symbol"))
