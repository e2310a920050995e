"""Table sinks and scans: transition Parquet, CSV / JSON exports, tolerant replicate CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import tolerant_bool


def write_transitions(df: DataFrame, path: str) -> None:
    """Ragged trajectories as rows, one directory per split and interval; re-runs replace only their own."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "interval_min").parquet(path)


def write_table(df: DataFrame, path: str, form: str = "csv", compressed: bool = False) -> None:
    """CSV (optionally gzip), JSON lines or Parquet; the commit protocol makes the replacement atomic."""
    writer = df.write.mode("overwrite")
    if form == "csv":
        writer = writer.option("header", True)
    if compressed:
        writer = writer.option("compression", "gzip")
    getattr(writer, form)(path)


def blank_to_null(c: Column) -> Column:
    text = F.trim(c)
    return F.when(text != "", text)


def read_replicates(spark: SparkSession, path: str, numbers=(), booleans=(), integers=()) -> DataFrame:
    """Replicate CSV where blanks mean missing and booleans come in any case."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    cols = []
    for c in raw.columns:
        text = blank_to_null(F.col(c))
        if c in numbers:
            cols.append(text.try_cast("double").alias(c))
        elif c in integers:
            cols.append(text.try_cast("long").alias(c))
        elif c in booleans:
            cols.append(F.coalesce(tolerant_bool(text), F.lit(False)).alias(c))
        else:
            cols.append(text.alias(c))
    return raw.select(*cols)
