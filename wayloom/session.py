"""Session helpers: local builder for tests, lineage cuts and shared scratch folders."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app_name: str = "wayloom") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset and Spark runs on one machine
    (tests) a temporary folder is made, once per session; a cluster without the setting is an error, since
    its executors don't see the driver's folders.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("wayloom.local.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="wayloom-ckpt-")
        spark.conf.set("wayloom.local.checkpoint.dir", named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for one table or one stream checkpoint."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives lost executors and keeps iterative plans short."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back, for results several branches use."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


#: Least bytes of a joined shuffle partition while tasks are kept fine.
FINE_BYTES = "16k"


@contextmanager
def fine_tasks(spark: SparkSession) -> Iterator[None]:
    """Keep small shuffles spread over all cores in the steps written within.

    Spark joins shuffle partitions below 1 MB. Frontiers of a search and windows of trips are few bytes, but each row
    costs much time in the task that reads it, so one task would do a round's whole work. Large shuffles are cut as before.
    """
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    before = spark.conf.get(name, None)
    spark.conf.set(name, FINE_BYTES)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def file_names(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a glob, on whatever file system the path names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(str(f.getPath()) for f in found or [])


def table_path(spark: SparkSession, key: str, name: str) -> str:
    """Place in the shared folder that is the same throughout an application."""
    app = spark.sparkContext.applicationId
    return os.path.join(shared_dir(spark), "wayloom-tables", app, uuid.uuid5(uuid.NAMESPACE_URL, key).hex, name)


def stored(spark: SparkSession, key: str, name: str, build) -> DataFrame:
    """A table built once per application and kept in the shared folder.

    Network tables are inputs of many jobs; like any preprocessing they are written once and
    then read. The path names the application, so nothing outlives or leaks between runs.
    """
    path = table_path(spark, key, name)
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
