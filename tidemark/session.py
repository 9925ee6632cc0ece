"""Session helpers: local session for tests and reliable materialisation."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, name: str = "tidemark") -> SparkSession:
    """Session for tests and the benchmark; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TIDEMARK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors reach.

    A private one is made only for a local session without a configured folder, as in
    tests; on a cluster an unset ``spark.checkpoint.dir`` is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        configured = spark.sparkContext.getCheckpointDir()
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="spark-tidemark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(configured)
    return configured.rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(jvm_path)


_written: dict[tuple[str, str], str] = {}


def materialize(df: DataFrame, key: str | None = None, partition: str | None = None, files: int | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage at a point several branches read, survives executor loss
    and keeps column pruning. With ``key`` the table is reused by later plans
    of the same application. With ``partition`` the table is partitioned by that column. ``files`` bounds
    the files of a small table, so that what reads it has no more tasks than that.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    if key is not None:
        known = _written.get((app, key))
        if known and _exists(spark, f"{known}/_SUCCESS"):
            return spark.read.parquet(known)
    path = f"{shared_folder(spark)}/tidemark/{app}/{uuid.uuid4().hex}"
    if files is not None:
        df = df.coalesce(files)
    if partition is not None:
        # adaptive execution merges small and splits large partitions of this exchange
        df = df.select(*[c for c in df.columns if c != partition], partition).hint("rebalance", partition)
    writer = df.write.mode("overwrite")
    (writer if partition is None else writer.partitionBy(partition)).parquet(path)
    if key is not None:
        _written[(app, key)] = path
    return spark.read.schema(df.schema).parquet(path)


def state_of(spark: SparkSession, folder: str) -> str:
    """Names, sizes and times of the files below ``folder``: changes when its data are replaced."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return ""
    listing, seen = files.listFiles(path, True), []
    while listing.hasNext():
        one = listing.next()
        seen.append(f"{one.getPath()}:{one.getLen()}:{one.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def materialized(spark: SparkSession, key: str) -> DataFrame | None:
    """The table written earlier under ``key`` by this application, if any."""
    known = _written.get((spark.sparkContext.applicationId, key))
    if known and _exists(spark, f"{known}/_SUCCESS"):
        return spark.read.parquet(known)
    return None
