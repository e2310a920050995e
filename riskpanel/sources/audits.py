"""File-manifest drift and key-registry audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Path and SHA-256 of every file under a folder of protocol-sized files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select(F.col("path"), F.sha2("content", 256).alias("sha256"))


def manifest_drift(recorded: DataFrame, actual: DataFrame) -> DataFrame:
    """Recorded against actual digests: match, changed, missing or unrecorded."""
    a = actual.withColumnRenamed("sha256", "found")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("sha256").isNull(), "unrecorded").when(
        F.col("sha256") == F.col("found"), "match").otherwise("changed")
    return recorded.join(a, "path", "full_outer").select("path", status.alias("status"))


def registry_duplicates(registry: DataFrame, key: str) -> DataFrame:
    return registry.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def registry_overlap(registry: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    """Keys that an earlier registry already used (must be empty)."""
    return registry.select(key).intersect(prior.select(key))


def fresh_keys(registry: DataFrame, prior: DataFrame, key: str) -> DataFrame:
    return registry.select(key).distinct().join(prior.select(key).distinct(), key, "left_anti")


def registry_sources(registry: DataFrame, source: str, key: str) -> DataFrame:
    return registry.groupBy(source).agg(F.count_distinct(key).alias("keys"))
