"""The advisory feed and the run log as streams (beyond the batch engine): files arrive, repeats are dropped, findings are appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def advisory_stream(spark: SparkSession, path: str, schema: str, delay: str = "7 days") -> DataFrame:
    """Advisory rows (osv_id, published, ...) from Parquet files as they arrive; a repeated id within the delay is dropped."""
    rows = spark.readStream.schema(schema).parquet(path)
    return rows.withColumn("at", F.to_timestamp("published")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["osv_id"])


def affected_stream(advisories: DataFrame, affected: DataFrame, versions: DataFrame) -> DataFrame:
    """Each new advisory against the versions of its packages (stream with static tables)."""
    return advisories.join(affected, "adv_id").join(versions, "pkg_id").where("vkey >= lo_key AND vkey < hi_key").select("adv_id", "osv_id", "ver_id")


def append(stream: DataFrame, path: str, checkpoint: str):
    """Writes a stream to a Parquet table; with the checkpoint, each row once."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
