"""Session helpers.

On a cluster the session is created by the platform; these helpers only fill in settings that are
unset, so a cluster's own choices (shuffle partitions, checkpoint folder, broadcast threshold) win.
"""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from runtime sizes (broadcast when a side turns out
# small, split skewed partitions, coalesce tiny ones); UTC keeps DATE/TIMESTAMP casts stable.
_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "groundwork") -> SparkSession:
    """A local session for tests and benchmarks (UI off, no ports beyond the driver's own)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GW_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


MAX_SHUFFLE_PARTITIONS = 100_000


def scale_settings(input_bytes: float, total_cores: int, target_partition_bytes: int = 1 << 30) -> dict[str, str]:
    """Settings sized for a big cluster run (e.g. 100 TB of samples on 1000 executors).

    * scans: 512 MB splits (whole row groups; fewer, larger scan tasks);
    * shuffles: enough partitions that each holds ~``target_partition_bytes`` (1 GB: fits a task's
      execution memory; sorts spill beyond it) of a shuffle as large as the input (the keep-first
      exchange carries every sample column), at least 3 waves of the cluster's cores and at most
      100,000 (beyond that the map × reduce block count, not the data, dominates); AQE coalesces small
      partitions and splits skewed ones. 100 TB on 4,000 cores → 100,000 partitions of ~1 GB;
    * skew: a partition is skewed above 5x the median and 1 GB (AQE splits it for joins);
    * broadcast: only tables under 64 MB broadcast automatically (lookups, per-well aggregates);
      everything that grows with the samples is a sort-merge join.
    """
    parts = min(MAX_SHUFFLE_PARTITIONS, max(3 * total_cores, int(input_bytes // target_partition_bytes) + 1))
    return {
        "spark.sql.files.maxPartitionBytes": str(512 << 20),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1 << 30),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 << 20),
    }


def apply_scale_settings(spark: SparkSession, input_bytes: float, total_cores: int | None = None,
                         override: bool = False) -> dict[str, str]:
    """Apply ``scale_settings`` to a session; values the cluster already set win unless ``override``."""
    cores = total_cores or spark.sparkContext.defaultParallelism
    applied = {}
    for k, v in scale_settings(input_bytes, cores).items():
        if override or spark.conf.get(k, None) in (None, _SPARK_DEFAULTS.get(k)):
            spark.conf.set(k, v)
            applied[k] = v
    return applied


# Spark's own defaults for the settings above (treated as "not set by the cluster").
_SPARK_DEFAULTS = {
    "spark.sql.files.maxPartitionBytes": "134217728b",
    "spark.sql.shuffle.partitions": "200",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64MB",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5.0",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256MB",
    "spark.sql.autoBroadcastJoinThreshold": "10MB",
}


def apply_defaults(spark: SparkSession) -> SparkSession:
    """Set the job defaults on an existing session, leaving any value the cluster already set."""
    for k, v in _DEFAULTS.items():
        if spark.conf.get(k, None) is None:
            spark.conf.set(k, v)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per context), wherever the driver was started."""
    sc = spark.sparkContext
    root = Path(__file__).resolve().parent
    if getattr(sc, "_groundwork_shipped", False) or not root.is_dir():
        return
    path = os.path.join(tempfile.mkdtemp(prefix="gw-package-"), "groundwork.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(path)
    sc._groundwork_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    Clusters name a shared folder there. Only a local master, where driver and executor are one process,
    falls back to a scratch folder of this machine; any other master without the setting is an error.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        d = tempfile.mkdtemp(prefix="gw-ckpt-", dir=os.environ.get("GW_SCRATCH", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # noqa: BLE001 - some sessions reject runtime core settings; the context dir suffices
            pass
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(d)
    return d
