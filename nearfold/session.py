"""Session set-up and the shared folder that staged tables and checkpoints use."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Upper bound for anything the library itself ships to every executor.
BROADCAST_BYTES = 128 * 1024 * 1024


def build_session(app: str = "nearfold", master: str | None = None, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, taken from ``spark.checkpoint.dir``.

    Only a local-mode session without that setting gets a temporary folder;
    a cluster without it is a configuration error, because executors cannot
    read the driver's local disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="nearfold-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, in one subfolder per application.

    Nothing is ever overwritten there; the subfolder can go once its application has ended.
    """
    run = f"nearfold-{spark.sparkContext.applicationId}"
    return os.path.join(shared_dir(spark), run, f"{name}-{uuid.uuid4().hex[:12]}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The written table cuts the lineage, survives executor loss, is computed
    once however often it is used, and carries a true file size, so that
    Catalyst broadcasts it only when it really is below
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """Split a scan that has fewer input splits than the cluster has cores.

    For work that is heavy per row, such as rewriting whole texts. A table with
    many files or row groups is returned as it is, without a shuffle. Meant for
    plain scans, whose partitions are known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)
