"""Session settings and durable scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_session(app_name: str = "biosieve", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on, so joins are sized and skew is split at run time."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_temporary: dict[str, str] = {}


def _checkpoint_root(spark: SparkSession) -> str:
    """Shared folder named by the cluster; a temporary one only where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _temporary.setdefault(context.applicationId, tempfile.mkdtemp(prefix="biosieve-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """Fresh path for an intermediate table in the shared folder."""
    return os.path.join(_checkpoint_root(spark), f"{name}-{uuid.uuid4().hex}")


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to reliable storage and continue from there.

    Rows and their partitions are fixed afterwards, so a lost executor re-reads files and never
    recomputes a different partitioning.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(_checkpoint_root(spark))
    return df.checkpoint(eager=True)


def task_count(spark: SparkSession) -> int:
    """Number of tasks that keeps the whole cluster busy."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle rows by ``keys`` into one partition per task.

    Adaptive execution merges partitions that are small in bytes; ahead of work that multiplies its
    rows, that would leave most of the cluster idle, so the number of partitions is fixed here.
    """
    return df.repartition(task_count(df.sparkSession), *keys)
