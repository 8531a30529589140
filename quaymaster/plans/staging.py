"""Staged tables: lineage ends in a Parquet table in the folder that the cluster shares, so a lost executor costs no recomputation."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LEFT: set[str] = set()
_HOOK: list[bool] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir, else the context's checkpoint folder. Where none is set, a folder of our own on a local master
    (tests); on a cluster, whose executors share no local folder, an error."""
    if at := spark.conf.get("spark.checkpoint.dir", None):
        return at.rstrip("/")
    sc = spark.sparkContext
    if (at := sc._jsc.sc().getCheckpointDir()).isDefined():
        return at.get().rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="qm-shared-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, deleted when Python ends if not before."""
    path = f"{shared_dir(spark)}/qm-{name}-{uuid.uuid4().hex}"
    if not _HOOK:
        _HOOK.append(True)
        atexit.register(_clear, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration())
    _LEFT.add(path)
    return path


def _delete(path: str, jvm, conf) -> None:
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def _clear(jvm, conf) -> None:
    """What results still read at the end of the application."""
    for path in list(_LEFT):
        try:
            _delete(path, jvm, conf)
        except Exception:  # noqa: BLE001 - the JVM may have gone before
            return
    _LEFT.clear()


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._qm_path = path
    return out


def staged_by(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df staged in as many buckets of its keys as there are shuffle partitions: joins and groups on the keys need no exchange of it,
    however often it is read."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = "qm_" + path.rsplit("-", 1)[-1]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._qm_path, out._qm_table = path, table
    return out


def drop(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    if path := getattr(df, "_qm_path", None):
        spark = df.sparkSession
        if table := getattr(df, "_qm_table", None):
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        _delete(path, spark._jvm, spark.sparkContext._jsc.hadoopConfiguration())
        _LEFT.discard(path)


def kept(spark: SparkSession, key: tuple, make) -> DataFrame:
    """make() staged once for each application and key."""
    have = spark.sparkContext.__dict__.setdefault("_qm_kept", {})
    if key not in have:
        have[key] = staged(make(), "-".join(str(k).rsplit("/", 1)[-1] for k in key))
    return have[key]
