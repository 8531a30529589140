"""A small clockwork of packages through the whole engine: ranges, paths, verdicts, fixes, what-if, grounding, reports, run log."""

import json

import pytest
from pyspark.sql import functions as F

from quaymaster.operators import advisories as A
from quaymaster.operators import cohesion as C
from quaymaster.operators import graph as G
from quaymaster.operators import grounding as GR
from quaymaster.operators import policy as P
from quaymaster.operators import remedy as RM
from quaymaster.operators import report as RP
from quaymaster.operators import runlog as RL
from quaymaster.operators import structure as ST
from quaymaster.operators import traverse as T


PACKAGES = [(10, "pypi", "orrery"), (11, "pypi", "gearbox"), (12, "pypi", "sprocket"), (13, "cargo", "pendulum"), (14, "cargo", "escapement"), (15, "npm", "dial"), (16, "npm", "dial-face"), (17, "npm", "lonely")]
VERSIONS = [
    (100, 10, "3.1", True), (110, 11, "0.9", False), (111, 11, "1.0", True), (120, 12, "2.0", False), (121, 12, "2.1", False), (122, 12, "2.2.0", True), (130, 13, "0.4.0", True),
    (140, 14, "1.0.0", False), (141, 14, "1.1.0", True), (150, 15, "5.0.0", True), (160, 16, "1.0.0", False), (161, 16, "2.0.0", True), (170, 17, "1.0.0", True),
]
#: orrery holds two versions of sprocket, one of them through gearbox.
RESOLVED = [(100, 120), (100, 111), (111, 121), (130, 140), (150, 160)]
ADVISORIES = [(7, "OSV-A", "teeth wear out", 8.1, False, "2022-03-04"), (8, "OSV-B", "stops at noon", 9.4, False, "2023-05-06"), (9, "OSV-C", "no flaw after all", 3.0, True, "2020-01-02"), (10, "OSV-D", "hands fall off", 6.5, False, "2021-09-09")]
ENTRIES = [
    (7, 12, {"ranges": [{"type": "ECOSYSTEM", "events": [{"introduced": "2.0"}, {"fixed": "2.2.0"}]}]}), (8, 14, {"versions": ["1.0.0"]}),
    (9, 16, {"ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "2.0.0"}]}]}), (10, 16, {"ranges": [{"type": "SEMVER", "events": [{"introduced": "0.5.0"}, {"last_affected": "1.9.9"}]}]}),
]


@pytest.fixture(scope="module")
def g(spark):
    class Graph:
        packages = spark.createDataFrame(PACKAGES, "pkg_id long, ecosystem string, name string")
        versions = spark.createDataFrame(VERSIONS, "ver_id long, pkg_id long, version string, is_default boolean")
        resolved = spark.createDataFrame(RESOLVED, "ver_id long, res_ver_id long")
        advisories = spark.createDataFrame(ADVISORIES, "adv_id long, osv_id string, summary string, severity double, withdrawn boolean, published string")
        aliases = spark.createDataFrame([("OSV-A", "CVE-2022-1111")], "osv_id string, alias string")
        entries = spark.createDataFrame([(a, p, json.dumps(e)) for a, p, e in ENTRIES], "adv_id long, pkg_id long, entry_json string")
        roots = spark.createDataFrame([(100,), (130,), (150,), (170,)], "root long")

    x = Graph()
    x.canon = A.canonical_ids(x.advisories, x.aliases).cache()
    x.named = x.advisories.join(x.canon.withColumnRenamed("canon_id", "advisory"), "osv_id")
    x.affected = A.affected_versions(x.entries, x.versions, x.packages).cache()
    x.paths = T.exposure_paths(x.roots, x.resolved, x.affected, x.named).cache()
    x.live = x.paths.where("NOT withdrawn")
    return x


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ranges_and_ids(g):
    assert rows(g.affected) == [(7, 120), (7, 121), (8, 140), (9, 160), (10, 160)]
    assert rows(g.canon) == [("OSV-A", "CVE-2022-1111"), ("OSV-B", "OSV-B"), ("OSV-C", "OSV-C"), ("OSV-D", "OSV-D")]
    assert rows(A.fixed_by_advisory(g.entries.where("adv_id IN (7, 9)"))) == [(7, ["2.2.0"]), (9, ["2.0.0"])]


def test_alias_groups(spark):
    a = spark.createDataFrame([("B-1",), ("A-1",), ("C-1",), ("D-1",)], "osv_id string")
    l = spark.createDataFrame([("B-1", "X"), ("A-1", "X"), ("C-1", "CVE-2"), ("C-1", "CVE-1")], "osv_id string, alias string")
    assert rows(A.canonical_ids(a, l)) == [("A-1", "A-1"), ("B-1", "A-1"), ("C-1", "CVE-1"), ("D-1", "D-1")]


def test_paths(g):
    got = sorted((r.root, r["rank"], r.advisory, r.depth, tuple(r.hops)) for r in g.paths.collect())
    assert got == [(100, 1, "CVE-2022-1111", 1, (100, 120)), (100, 2, "CVE-2022-1111", 2, (100, 111, 121)), (130, 1, "OSV-B", 1, (130, 140)), (150, 1, "OSV-D", 1, (150, 160)), (150, 2, "OSV-C", 1, (150, 160))]
    told = {(r.root, r["rank"]): r.rendered for r in T.rendered(g.paths, g.versions, g.packages).collect()}
    assert told[100, 2] == "[CVE-2022-1111  cvss=8.1] orrery@3.1 -> gearbox@1.0 -> sprocket@2.1" and told[150, 2] == "[OSV-C  cvss=3.0] dial@5.0.0 -> dial-face@1.0.0  !! WITHDRAWN"
    assert {r.depth for r in T.exposure_paths(g.roots, g.resolved, g.affected, g.named, max_depth=1).collect()} == {1}
    assert T.exposure_paths(g.roots, g.resolved, g.affected, g.named, max_paths=1).groupBy("root").count().where("count > 1").isEmpty()
    assert [x for (x,) in rows(G.roots(g.versions, g.resolved))] == [100, 122, 130, 141, 150, 161, 170]


def test_blast_radius(g):
    hit = T.blast_radius(g.versions.where("pkg_id = 12").select(F.col("pkg_id").alias("key"), "ver_id"), g.resolved, g.versions)
    assert {r.ver_id for r in hit.collect()} == {100, 111, 122}
    assert rows(RM.ripple(g.packages.where("pkg_id IN (12, 17)").select(F.col("name").alias("key"), "pkg_id"), g.versions, g.resolved)) == [("lonely", 1), ("sprocket", 3)]


def test_ladder(g, spark):
    got = {(r.root, r.advisory): (r.verdict, r.alert, r.n_paths, r.min_depth, r.severity) for r in P.verdicts(g.paths, g.versions).collect()}
    assert got == {(100, "CVE-2022-1111"): ("exposed", True, 2, 1, 8.1), (130, "OSV-B"): ("exposed", True, 1, 1, 9.4), (150, "OSV-D"): ("exposed", True, 1, 1, 6.5), (150, "OSV-C"): ("only_withdrawn_advisories", False, 1, 1, 3.0)}
    assert {r.root: r.verdict for r in P.verdicts(g.live, g.versions, "2022-01-01").collect()} == {100: "not_knowable_as_of_date", 130: "not_knowable_as_of_date", 150: "exposed"}
    assert {r.root for r in P.verdicts(g.live, g.versions, min_severity=7.0).where("alert").collect()} == {100, 130}
    schema = "root long, advisory string, node long, depth int, severity double, withdrawn boolean, published string"
    many = spark.createDataFrame(
        [(1, "a", 120, 1, 5.0, True, "2020-01-01"), (2, "a", 120, 1, 3.0, False, "2020-01-01"), (3, "a", 120, 5, 4.5, False, ""), (4, "a", 99, 1, 5.0, False, "2020-01-01"), (5, "a", 120, 6, 4.5, False, "2020-01-01"), (6, "a", 120, 1, 0.0, False, "2020-01-01")], schema
    )
    reach = P.reach_map(many.withColumn("reach", P.reach_prior(F.col("depth"), F.col("severity"), F.lit(False))))
    got = {r.root: (r.verdict, r.n_usable) for r in P.verdicts(many, g.versions, "2021-01-01", 4.0, reach).collect()}
    assert got == {1: ("only_withdrawn_advisories", 0), 2: ("below_severity_floor", 1), 3: ("not_knowable_as_of_date", 0), 4: ("only_noninstallable_evidence", 0), 5: ("present_but_unreachable", 0), 6: ("exposed", 1)}
    empty = P.with_empty_groups(spark.createDataFrame([(1,), (77,), (None,)], "root long"), P.verdicts(many, g.versions))
    assert {(r.root, r.verdict) for r in empty.collect()} >= {(77, "no_exposure_path"), (None, "not_grounded")}


def test_fixes(g, spark):
    greedy = {r.root: (r.from_version, r.to_version, r.is_major, r.n_adv, r.reason) for r in RM.greedy_fix(g.live, g.versions, g.packages, g.affected).collect()}
    assert greedy == {100: ("2.0", "2.2.0", False, 1, None), 130: ("1.0.0", "1.1.0", False, 1, None), 150: ("1.0.0", "2.0.0", True, 1, None)}
    cheap = {r.root: (r.to_version, r.cost, r.changed, r.clean) for r in RM.cheapest_fix(g.live, g.versions, g.packages, g.affected).collect()}
    assert cheap == {100: ("2.2.0", 1.0, True, True), 130: ("1.1.0", 1.0, True, True), 150: ("2.0.0", 1.35, True, True)}
    bumps = spark.createDataFrame([(100, 12, "2.2.0"), (100, 14, "7.7.7"), (150, 15, "5.0.0")], "root long, pkg_id long, to_version string")
    got = {r.root: r for r in RM.diff_manifests(bumps, g.roots.where("root IN (100, 150)"), g.versions, g.resolved, g.affected, g.named).collect()}
    d = got[100]
    assert (d.cleared, d.introduced, d.severity_before, d.severity_after, d.depth_before, d.depth_after, d.failures) == (["CVE-2022-1111"], [], 8.1, 0.0, 2, 1, 1)
    assert (got[150].cleared, got[150].introduced, got[150].failures) == ([], [], 0)


def test_fix_reasons(spark):
    v = spark.createDataFrame([(1, 1, "1.0.0"), (2, 1, "2.0.0"), (3, 2, "1.0.0"), (4, 3, "1.0.0"), (5, 3, "1.1.0-rc1")], "ver_id long, pkg_id long, version string")
    p = spark.createDataFrame([(i, "npm", f"p{i}") for i in (1, 2, 3)], "pkg_id long, ecosystem string, name string")
    av = spark.createDataFrame([(0, 1), (0, 3), (0, 4)], "adv_id long, ver_id long")
    paths = spark.createDataFrame([(9, 1, "a", 1), (9, 3, "b", 2), (9, 4, "c", 3)], "root long, node long, advisory string, rank int")
    got = {r.pkg_id: (r.to_version, r.reason) for r in RM.greedy_fix(paths, v, p, av, allow_major=False).collect()}
    assert got == {1: (None, "only a major bump is clean"), 2: (None, "no published version is free of advisories"), 3: (None, "no published version is free of advisories")}
    assert {r.pkg_id: r.is_major for r in RM.greedy_fix(paths, v, p, av).collect()}[1] is True


def test_structure(g):
    e = G.package_graph(g.resolved, g.versions)
    nodes = g.packages.select(F.col("pkg_id").alias("node"))
    s = {r.direction: r for r in ST.degree_stats(G.degrees(nodes, e)).collect()}
    assert (s["in"].n, s["in"].max, s["out"].max, s["in"].zero_frac) == (8, 2, 2, 0.5)
    c = C.component_stats(C.weak_components(nodes, e)).first()
    assert (c.components, c.largest, c.singletons, c.larger, c.members) == (4, 3, 1, 3, 7)
    assert {r.node: r.core for r in C.coreness(nodes, e).collect()} == {10: 2, 11: 2, 12: 2, 13: 1, 14: 1, 15: 1, 16: 1, 17: 0}


def test_grounding(g, spark):
    ids = A.id_index(g.advisories, g.aliases, g.canon).join(g.affected, "adv_id").join(g.versions, "ver_id").select("id", "pkg_id").distinct()
    ground = GR.Grounder(g.packages, g.versions, ids, [("clock strike", "cargo", "escapement")])
    asked = ["does CVE-2022-1111 touch us?", "the clock strike bug", "is sprocket ok", "what of dialface", "nobody knows this", "", None, "pkg:cargo/escapement@1.0.0", "gearbox and pendulum"]
    q = spark.createDataFrame(list(enumerate(asked)), "qid int, question string")
    got = {}
    for r in ground.ground(q).orderBy("qid", "pos").collect():
        got.setdefault(r.qid, []).append((r.name, r.via))
    assert got == {
        0: [("sprocket", "advisory")], 1: [("escapement", "incident")], 2: [("sprocket", "name")], 3: [("dial-face", "name-squashed")], 7: [("escapement", "purl")], 8: [("pendulum", "name"), ("gearbox", "name")],
    }
    assert all(r["count"] == 1 for r in ground.ground(q, 1).groupBy("qid").count().collect())


def test_reports(g):
    rep = RP.exposure_rows(g.paths, g.versions, g.packages).cache()
    told = {(r.root, r.advisory): (r.band, r.reason, r.alert, r.terminal) for r in rep.collect()}
    assert told[130, "OSV-B"] == ("critical", "exposed", True, "cargo/escapement@1.0.0") and told[150, "OSV-C"] == ("low", "only_withdrawn_advisories", False, "npm/dial-face@1.0.0")
    text = {r.root: r.markdown for r in RP.markdown(rep, RP.alerted_fixes(g.paths, rep, g.versions, g.packages, g.affected), g.versions, g.packages, "2024-01-01").collect()}
    assert "### OSV-D" in text[150] and "1.0.0 → **2.0.0**  **(MAJOR" in text[150] and "| OSV-C (low) | `only_withdrawn_advisories` |" in text[150] and "_1/1 exposures cleared by 1 bump(s)._" in text[150] and 170 not in text
    reached = T.walk(g.roots.select("root", F.col("root").alias("node")), T.resolved_edges(g.resolved), 12, hops=True).cache()
    bom = {r.root: json.loads(r.bom) for r in RP.cyclonedx(reached, rep, g.versions, g.packages, "2024-01-01").collect()}
    assert bom[100]["specVersion"] == "1.5" and [c["name"] for c in bom[100]["components"]] == ["orrery", "gearbox", "sprocket", "sprocket"] and bom[100]["vulnerabilities"][0]["id"] == "CVE-2022-1111" and bom[170]["vulnerabilities"] == []
    lock = {r.root: r.lock for r in RP.lock_files(reached, g.versions, g.packages).collect()}
    assert lock[100] == "gearbox==1.0\norrery==3.1\nsprocket==2.1\n" and lock[130] == ""
    assert json.loads(lock[150])["packages"] == {"": {"name": "generated", "version": "0.0.0"}, "node_modules/dial": {"version": "5.0.0"}, "node_modules/dial-face": {"version": "1.0.0"}}


def test_run_log(spark):
    e = spark.createDataFrame(
        [("r", 1, "propose", "a", "1", "2", None, ""), ("r", 2, "commit", "a", "1", "2", None, "b1"), ("r", 3, "propose", "b", "1", "3", None, ""), ("r", 4, "propose", "c", "1", "3", None, ""), ("r", 5, "rollback", "c", "1", "3", None, ""), ("r", 6, "status", "d", None, None, "escalated", "x")],
        "run string, seq int, kind string, pkg string, from_version string, to_version string, status string, why string",
    )
    assert rows(RL.snapshot(e)) == [("r", 6, 1, 1)]
    assert rows(RL.tentative(e)) == [("r", "b", "1", "3")]
    assert rows(RL.current_status(e).select("pkg", "status")) == [("a", "patched"), ("d", "escalated")]


def test_bisect():
    b = {"a": 1, "b": 2, "c": 3}
    assert RL.bisect_build(b, lambda s: True) == {}
    assert RL.bisect_build(b, lambda s: "b" not in s) == {"b": 2}
    assert RL.bisect_build(b, lambda s: not ({"a", "c"} <= set(s)) and len(s) < 3) == {"a": 1, "c": 3}
    assert RL.bisect_build(b, lambda s: len(s) < 2) == {"a": 1, "b": 2}


def test_routes(spark):
    t = spark.createDataFrame([("resolve", "npm"), ("resolve", "haskell"), ("patch", "npm")], "task string, ecosystem string")
    assert {(r.task, r.ecosystem): r.agent for r in P.route(t).collect()} == {("resolve", "npm"): "Resolver.npm", ("resolve", "haskell"): None, ("patch", "npm"): "PatchProposer"}


def test_call_graph_reach(spark):
    got = P.call_graph_reach(
        spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "a")], "root long, advisory string"), spark.createDataFrame([("a", "f"), ("b", "g")], "advisory string, symbol string"),
        spark.createDataFrame([(1, "main")], "root long, symbol string"), spark.createDataFrame([("main", "x"), ("x", "f"), ("f", "main")], "src string, dst string"),
    )
    assert {(r.root, r.advisory): r.reach for r in got.collect()} == {(1, "a"): "reachable", (1, "b"): "unreachable", (1, "c"): "undetermined", (2, "a"): "undetermined"}


def test_engine_from_raw_feeds(spark, tmp_path):
    import zipfile

    from quaymaster import ExposureGraph

    (tmp_path / "deps").mkdir()
    (tmp_path / "osv").mkdir()
    rec = {"ecosystem": "npm", "package": "app", "version": "1.0.0", "versions": ["1.0.0"], "nodes": [{"name": "lib", "version": "1.1.0", "relation": "DIRECT"}, {"name": "lib", "version": "1.2.0", "relation": "INDIRECT"}], "resolved": [{"from": ["app", "1.0.0"], "to": ["lib", "1.1.0"], "requirement": "^1.0.0"}]}
    (tmp_path / "deps" / "d.jsonl").write_text(json.dumps(rec) + "\n")
    with zipfile.ZipFile(tmp_path / "osv" / "npm.zip", "w") as z:
        z.writestr("A.json", json.dumps({"id": "A", "aliases": ["CVE-2020-7777"], "severity": [{"type": "CVSS_V3", "score": "9.1"}], "published": "2020-01-01", "affected": [{"package": {"ecosystem": "npm", "name": "lib"}, "ranges": [{"type": "SEMVER", "events": [{"introduced": "1.0.0"}, {"fixed": "1.2.0"}]}]}]}))
    made = ExposureGraph.build(spark, str(tmp_path / "deps"), str(tmp_path / "osv"))
    made.write(str(tmp_path / "graph"))
    e = ExposureGraph.read(spark, str(tmp_path / "graph"))
    assert [(r.advisory, r.verdict, r.min_depth) for r in e.audit().collect()] == [("CVE-2020-7777", "exposed", 1)]
    assert e.audit(as_of="2019-01-01", gate_reach=True).first().verdict == "not_knowable_as_of_date"
    f = e.fixes().first()
    assert (f.from_version, f.to_version) == ("1.1.0", "1.2.0") and e.cheapest_fixes().first().to_version == "1.2.0"
    assert e.what_if(e.fixes().select("root", "pkg_id", "to_version")).first().cleared == ["CVE-2020-7777"]
    assert "CVE-2020-7777" in e.markdown("2024-01-01").first().markdown and "npm/lib@1.1.0" in e.bills_of_materials("2024-01-01").first().bom
    assert json.loads(e.lock_files().first().lock)["packages"]["node_modules/lib"]["version"] == "1.1.0"
    name = spark.createDataFrame([("npm", "lib")], "ecosystem string, name string")
    assert e.blast_radius(name).count() == 1 and e.roots_of(spark.createDataFrame([("npm", "app")], "ecosystem string, name string")).count() == 1
    assert e.ground(spark.createDataFrame([(1, "is cve-2020-7777 in us")], "qid int, question string")).first().name == "lib"
    assert {r.component for r in e.components().collect()} == {min(r.pkg_id for r in e.packages.collect())} and e.components(strong=True).count() == 2
