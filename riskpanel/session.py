"""Session defaults and durable intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("riskpanel")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The reliable folder the cluster names in ``spark.checkpoint.dir``; a scratch one only in a local session without it."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        named = spark.sparkContext.getCheckpointDir()
    return named


def materialise(df: DataFrame, label: str = "table", **options) -> DataFrame:
    """Write once to the shared folder and read back: later plans start from a columnar scan.

    This cuts lineage durably, so neither a lost executor nor a later query replays the
    upstream windows, and every reader prunes columns and pushes filters into the files. ``options`` go to the writer.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHARED: dict[tuple, DataFrame] = {}


def source_state(spark: SparkSession, folder: str) -> int:
    """A number that changes with the names, sizes or times of the files of a folder's tables; listed by the driver, without a job."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for table in files.globStatus(path) or []:
        for f in files.listStatus(table.getPath()) if table.isDirectory() else [table]:
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return hash(tuple(sorted(found)))


def shared_table(spark: SparkSession, scope: str, label: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table that several queries of one application read; built on first use."""
    key = (spark.sparkContext.applicationId, scope, label, source_state(spark, scope))
    if key not in _SHARED:
        _SHARED[key] = materialise(build(), "".join(c if c.isalnum() else "-" for c in label)[:40])
    return _SHARED[key]


def forget_shared_tables() -> None:
    """Forget the derived tables of this process so that the next query rebuilds them from the sources."""
    _SHARED.clear()
