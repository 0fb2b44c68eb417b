"""Session settings and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# One shuffle task should hold about this much data and still fit in memory.
SHUFFLE_TASK_BYTES = 128 * 1024 * 1024

# Spark's own default, for a cluster of unknown size.
DEFAULT_PARTITIONS = 200
# More scan tasks than this keep the driver busy with scheduling alone.
MAX_SCAN_TASKS = 200_000
MIN_SPLIT_BYTES = 128 * 1024 * 1024
MAX_SPLIT_BYTES = 1024 * 1024 * 1024


def shuffle_partitions_for(cores: int | None = None, shuffle_bytes: int = 0) -> int:
    """Partitions for the largest expected shuffle, never fewer than the cores."""
    return max(cores or DEFAULT_PARTITIONS, -(-shuffle_bytes // SHUFFLE_TASK_BYTES))


def scan_split_bytes(scan_bytes: int = 0) -> int:
    """Bytes per scan task: Spark's default, more for a scan of very many tasks."""
    return min(max(MIN_SPLIT_BYTES, -(-scan_bytes // MAX_SCAN_TASKS)), MAX_SPLIT_BYTES)


def build_session(
    app_name: str = "tallyframe",
    master: str | None = None,
    cores: int | None = None,
    shuffle_bytes: int = 0,
    scan_bytes: int = 0,
    settings: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session with the settings the reports rely on.

    ``shuffle_bytes`` is the size of the largest expected shuffle and ``cores``
    the cluster's; adaptive execution merges partitions that turn out too
    small, so a high number costs little. ``scan_bytes`` is the size of the
    largest table. The session zone is UTC so
    that epoch columns do not depend on where the cluster runs.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.files.maxPartitionBytes": str(scan_split_bytes(scan_bytes)),
        "spark.sql.shuffle.partitions": str(shuffle_partitions_for(cores, shuffle_bytes)),
    }
    for key, value in {**defaults, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below a folder that all executors reach.

    That is the cluster's ``spark.checkpoint.dir`` or, where it is unset, the
    warehouse. A machine-local folder is never used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/tallyframe/{label}-{uuid.uuid4().hex}"
