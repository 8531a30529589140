"""Raw feeds as DataFrames: dependency records in JSON lines, advisory archives, registry dumps in CSV, and this engine's own tables."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.staging import staged

#: Names of ecosystems as the feeds write them (fixed values).
ECOSYSTEM = {"npm": "npm", "pypi": "pypi", "maven": "maven", "cargo": "cargo", "crates.io": "cargo", "go": "go", "rubygems": "rubygems", "packagist": "packagist", "nuget": "nuget"}
DEPENDENCY_RECORD = "ecosystem STRING, package STRING, version STRING, versions ARRAY<STRING>, nodes ARRAY<STRUCT<name: STRING, version: STRING, relation: STRING>>, resolved ARRAY<STRUCT<`from`: ARRAY<STRING>, `to`: ARRAY<STRING>, requirement: STRING>>"
ADVISORY_RECORD = (
    "id STRING, aliases ARRAY<STRING>, summary STRING, severity ARRAY<STRUCT<type: STRING, score: STRING>>, withdrawn STRING, published STRING, "
    "affected ARRAY<STRUCT<package: STRUCT<ecosystem: STRING, name: STRING>, versions: ARRAY<STRING>, ranges: ARRAY<STRUCT<type: STRING, events: ARRAY<MAP<STRING,STRING>>>>>>"
)
#: Dependency kinds that ship with a package (fixed values).
RUNTIME = ("runtime", "normal", "", "compile", "provided")


def ecosystem(name):
    """The engine's name of an ecosystem; a part after a colon is dropped; unknown names stay, in lower case."""
    table = F.create_map(*[F.lit(x) for kv in ECOSYSTEM.items() for x in kv])
    own = F.lower(F.trim(F.substring_index(name, ":", 1)))
    return F.coalesce(table[own], own)


def dependency_records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DEPENDENCY_RECORD).json(path)


def advisory_archives(spark: SparkSession, path: str) -> DataFrame:
    """Zip archives of one JSON file for each advisory -> archive, member, and the record's fields; members that are no JSON are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")
    schema = T.StructType([T.StructField("archive", T.StringType()), T.StructField("member", T.StringType()), T.StructField("body", T.StringType())])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            for p, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for name in z.namelist():
                        if name.endswith(".json"):
                            yield pa.RecordBatch.from_arrays([pa.array([p.rsplit("/", 1)[-1]]), pa.array([name]), pa.array([z.read(name).decode("utf-8", "replace")])], names=schema.names)

    got = files.mapInArrow(run, schema).withColumn("r", F.from_json("body", ADVISORY_RECORD))
    return got.where("r.id IS NOT NULL").select("archive", "member", "r.*")


def csv_shards(spark: SparkSession, path: str, columns: list[str], pattern: str | None = None) -> DataFrame:
    """CSV files with a header -> the wanted columns; those a file lacks are null. pattern chooses among sibling files. Rows with another
    number of fields than the header are left out; csv_malformed has them."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "DROPMALFORMED")
    df = (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(path)
    return df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def csv_malformed(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """The rows that csv_shards leaves out, as text (column `row`)."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    reader = reader.option("pathGlobFilter", pattern) if pattern else reader
    schema = T.StructType([*reader.csv(path).schema.fields, T.StructField("_bad", T.StringType())])
    got = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").csv(path).where("_bad IS NOT NULL")
    return staged(got, "malformed").select(F.col("_bad").alias("row"))  # Spark reads the text of such rows beside parsed columns only


def collisions(df: DataFrame, number: str, *keys: str) -> DataFrame:
    """The numbers that stand for more than one key: ids are 64-bit hashes of natural keys, and must be told apart once after a build."""
    key = F.struct(*keys)
    return df.groupBy(number).agg(F.min(key).alias("one"), F.max(key).alias("other")).where("one <> other")


def runtime_dependencies(df: DataFrame, kind: str = "Dependency Kind", optional: str = "Optional Dependency") -> DataFrame:
    return df.where(F.lower(F.trim(F.coalesce(kind, F.lit("")))).isin(*RUNTIME) & ~F.lower(F.trim(F.coalesce(optional, F.lit("")))).isin("true", "t", "1"))


def graph_tables(spark: SparkSession, path: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{path}/{n}.parquet") for n in names]


def tables_of_records(records: DataFrame) -> dict[str, DataFrame]:
    """Dependency records -> packages, versions and resolved, with ids from hashes of the natural keys (the same in every run)."""
    eco = ecosystem(F.col("ecosystem"))
    ver = lambda n, v: F.xxhash64(eco, n, v)
    listed = records.select(eco.alias("ecosystem"), F.col("package").alias("name"), F.explode(F.array_union(F.coalesce("versions", F.array().cast("array<string>")), F.array("version"))).alias("version"), F.col("version").alias("latest"))
    nodes = records.select(eco.alias("ecosystem"), F.explode("nodes").alias("n")).select("ecosystem", "n.name", "n.version", F.lit(None).cast("string").alias("latest"))
    every = listed.unionByName(nodes).groupBy("ecosystem", "name", "version").agg(F.coalesce(F.max(F.col("version") == F.col("latest")), F.lit(False)).alias("is_default"))
    every = every.withColumn("pkg_id", F.xxhash64("ecosystem", "name")).withColumn("ver_id", F.xxhash64("ecosystem", "name", "version"))
    edges = records.select("ecosystem", F.explode("resolved").alias("r")).select("ecosystem", F.col("r.from").alias("a"), F.col("r.to").alias("b"))
    resolved = edges.select(ver(F.col("a")[0], F.col("a")[1]).alias("ver_id"), ver(F.col("b")[0], F.col("b")[1]).alias("res_ver_id")).distinct()
    return {"packages": every.select("pkg_id", "ecosystem", "name").distinct(), "versions": every.select("ver_id", "pkg_id", "version", "is_default"), "resolved": resolved}


def tables_of_advisories(records: DataFrame) -> dict[str, DataFrame]:
    """Advisory records -> advisories, affected and aliases; of two records with one id the first by archive and member stays."""
    from ..functions.scores import base_score
    from ..operators.advisories import first_records

    one = first_records(records, "id", ["archive", "member"]).withColumn("adv_id", F.xxhash64("id"))
    advisories = one.select("adv_id", F.col("id").alias("osv_id"), F.substring(F.coalesce("summary", F.lit("")), 1, 400).alias("summary"), base_score(F.col("severity")).alias("severity"), (F.length(F.coalesce("withdrawn", F.lit(""))) > 0).alias("withdrawn"), F.coalesce("published", F.lit("")).alias("published"))
    each = one.select("adv_id", F.explode("affected").alias("a")).where("a.package.name IS NOT NULL")
    eco = ecosystem(F.col("a.package.ecosystem"))
    affected = each.select("adv_id", F.xxhash64(eco, F.col("a.package.name")).alias("pkg_id"), F.to_json(F.struct("a.ranges", "a.versions")).alias("entry_json")).dropDuplicates(["adv_id", "pkg_id", "entry_json"])
    aliases = one.select(F.col("id").alias("osv_id"), F.explode("aliases").alias("alias")).distinct()
    return {"advisories": advisories, "affected": affected, "aliases": aliases}


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
