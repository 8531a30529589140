"""The engine over one set of tables: every question takes many roots, packages or questions at once and gives a DataFrame.

    g = ExposureGraph.build(spark, dependencies="deps/*.jsonl", advisories="osv/")
    g.write("graph")                      # later: ExposureGraph.read(spark, "graph")
    g.audit(as_of="2024-01-01", min_severity=7.0)
    g.fixes()
    g.ground(questions)                   # DataFrame (qid, question)
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import advisories as A
from .operators import cohesion, graph, grounding, policy, remedy, report, traverse
from .plans.staging import staged
from .ship import ship
from .sources import readers

TABLES = ("packages", "versions", "resolved", "advisories", "affected", "aliases", "affected_versions", "canon")


@dataclass
class ExposureGraph:
    """packages (pkg_id, ecosystem, name), versions (ver_id, pkg_id, version, is_default[, published]), resolved (ver_id, res_ver_id),
    advisories (adv_id, osv_id, summary, severity, withdrawn, published), affected (adv_id, pkg_id, entry_json), aliases (osv_id, alias);
    affected_versions (adv_id, ver_id) and canon (osv_id, canon_id) are derived once unless they are given."""

    packages: DataFrame
    versions: DataFrame
    resolved: DataFrame
    advisories: DataFrame
    affected: DataFrame
    aliases: DataFrame
    affected_versions: DataFrame | None = None
    canon: DataFrame | None = None
    _made: dict = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        ship(self.packages.sparkSession)
        if self.affected_versions is None:
            self.affected_versions = staged(A.affected_versions(self.affected, self.versions, self.packages), "affected-versions")
        if self.canon is None:
            self.canon = staged(A.canonical_ids(self.advisories, self.aliases), "canon-ids")

    # ------------------------------------------------------------------------------------------------------ tables

    @classmethod
    def build(cls, spark: SparkSession, dependencies: str, advisories: str) -> ExposureGraph:
        """From dependency records in JSON lines and advisory archives."""
        ship(spark)
        deps = readers.tables_of_records(readers.dependency_records(spark, dependencies))
        adv = readers.tables_of_advisories(staged(readers.advisory_archives(spark, advisories), "records"))
        known = adv["affected"].join(deps["packages"].select("pkg_id"), "pkg_id", "left_semi")
        own = {**deps, **adv, "affected": known}
        made = {k: staged(own[k], k) for k in TABLES[:6]}
        for name, number, keys in (("packages", "pkg_id", ["ecosystem", "name"]), ("versions", "ver_id", ["pkg_id", "version"]), ("advisories", "adv_id", ["osv_id"])):
            if two := readers.collisions(made[name], number, *keys).first():
                raise ValueError(f"{name}: {two['one']} and {two['other']} have one hash; rename one of them")
        return cls(**made)

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> ExposureGraph:
        return cls(*readers.graph_tables(spark, path, *TABLES))

    def write(self, path: str) -> None:
        readers.write_tables({k: getattr(self, k) for k in TABLES}, path)

    def _once(self, key: str, make) -> DataFrame:
        if key not in self._made:
            self._made[key] = staged(make(), key)
        return self._made[key]

    @property
    def named_advisories(self) -> DataFrame:
        return self.advisories.join(self.canon.withColumnRenamed("canon_id", "advisory"), "osv_id")

    @property
    def roots(self) -> DataFrame:
        return self._once("roots", lambda: graph.roots(self.versions, self.resolved))

    @property
    def package_graph(self) -> DataFrame:
        return self._once("package-graph", lambda: graph.package_graph(self.resolved, self.versions))

    # --------------------------------------------------------------------------------------------------- questions

    def roots_of(self, names: DataFrame) -> DataFrame:
        """names (ecosystem, name) -> root: their default versions."""
        own = self.packages.join(names, ["ecosystem", "name"], "left_semi")
        return graph.default_version(self.versions).join(own, "pkg_id").select(F.col("ver_id").alias("root"))

    def exposure_paths(self, roots: DataFrame | None = None, max_depth: int = 12, max_paths: int = 200) -> DataFrame:
        make = lambda: traverse.exposure_paths(self.roots if roots is None else roots, self.resolved, self.affected_versions, self.named_advisories, max_depth, max_paths)
        return make() if roots is not None else self._once(f"paths-{max_depth}-{max_paths}", make)

    def audit(self, roots: DataFrame | None = None, as_of: str | None = None, min_severity: float = 0.0, gate_reach: bool = False) -> DataFrame:
        """root, advisory, verdict, alert, n_paths, n_usable, min_depth, severity."""
        p = self.exposure_paths(roots)
        return policy.verdicts(p, self.versions, as_of, min_severity, self.reach(p) if gate_reach else None)

    def reach(self, paths: DataFrame) -> DataFrame:
        return policy.reach_map(paths.withColumn("reach", policy.reach_prior(F.col("depth"), F.col("severity"), policy.has_symbol(F.col("summary")))))

    def report(self, roots: DataFrame | None = None, as_of: str | None = None, min_severity: float = 0.0) -> DataFrame:
        return report.exposure_rows(self.exposure_paths(roots, max_paths=400), self.versions, self.packages, as_of, min_severity)

    def markdown(self, generated: str, roots: DataFrame | None = None, as_of: str | None = None) -> DataFrame:
        rows = staged(self.report(roots, as_of), "rows")
        fixes = report.alerted_fixes(self.exposure_paths(roots, max_paths=400), rows, self.versions, self.packages, self.affected_versions)
        return report.markdown(rows, fixes, self.versions, self.packages, generated, as_of)

    def trees(self, roots: DataFrame | None = None, max_depth: int = 64) -> DataFrame:
        r = self.roots if roots is None else roots
        return traverse.walk(r.select("root", F.col("root").alias("node")), traverse.resolved_edges(self.resolved), max_depth, hops=True, name="trees")

    def bills_of_materials(self, generated: str, roots: DataFrame | None = None) -> DataFrame:
        return report.cyclonedx(self.trees(roots), self.report(roots), self.versions, self.packages, generated)

    def lock_files(self, roots: DataFrame | None = None) -> DataFrame:
        return report.lock_files(self.trees(roots), self.versions, self.packages)

    def blast_radius(self, names: DataFrame, max_up: int = 5, node_budget: int | None = 400_000) -> DataFrame:
        """names (ecosystem, name) -> key (pkg_id), ver_id of the default versions that reach the package, truncated."""
        own = self.packages.join(names, ["ecosystem", "name"], "left_semi")
        return traverse.blast_radius(self.versions.join(own.select("pkg_id"), "pkg_id", "left_semi").select(F.col("pkg_id").alias("key"), "ver_id"), self.resolved, self.versions, max_up, node_budget)

    def fixes(self, roots: DataFrame | None = None, allow_major: bool = True, order: str = "store") -> DataFrame:
        live = self.exposure_paths(roots).where(~F.col("withdrawn"))
        return remedy.greedy_fix(live, self.versions, self.packages, self.affected_versions, allow_major, order)

    def cheapest_fixes(self, roots: DataFrame | None = None, lam: float = 0.35) -> DataFrame:
        live = self.exposure_paths(roots).where(~F.col("withdrawn"))
        return remedy.cheapest_fix(live, self.versions, self.packages, self.affected_versions, lam)

    def what_if(self, bumps: DataFrame) -> DataFrame:
        """bumps (root, pkg_id, to_version) -> what they clear and introduce."""
        return remedy.diff_manifests(bumps, bumps.select("root").distinct(), self.versions, self.resolved, self.affected_versions, self.named_advisories)

    def ground(self, questions: DataFrame, max_terms: int = 8) -> DataFrame:
        if "grounder" not in self._made:
            ids = A.id_index(self.advisories, self.aliases, self.canon).join(self.affected_versions, "adv_id").join(self.versions.select("ver_id", "pkg_id"), "ver_id").select("id", "pkg_id").distinct()
            self._made["grounder"] = grounding.Grounder(self.packages, self.versions, staged(ids, "advisory-packages"))
        return self._made["grounder"].ground(questions, max_terms)

    def components(self, strong: bool = False) -> DataFrame:
        nodes = self.packages.select(F.col("pkg_id").alias("node"))
        return (cohesion.strong_components if strong else cohesion.weak_components)(nodes, self.package_graph)
