"""Session construction and cluster-facing settings.

Everything here is plain SparkSession configuration. On a cluster the
session is built by the platform; ``get_session`` is for tests, the bench
and local runs. ``shared_dir`` is the one place the library asks where it
may write durable intermediate data (checkpoints, streaming state, written
tables): it reads ``spark.checkpoint.dir`` from the session and only
creates a private folder when that is unset (tests, laptops).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in the library assumes. AQE re-plans joins and
# shuffle partition counts at runtime and splits skewed partitions of
# inner joins; the session zone is pinned so timestamp arithmetic is the
# same on every executor.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Keep object-hash aggregation (quantile sketches, collect_list) in
    # hash mode for up to 1024 groups per task before the sort fallback.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "1024",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int = 8,
                app_name: str = "kpiforge") -> SparkSession:
    master = master or os.environ.get("KPIFORGE_MASTER", "local[8]")
    builder = SparkSession.builder.master(master).appName(app_name)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    builder = (builder
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("KPIFORGE_DRIVER_MEM", "16g")))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shared_dir(spark)
    return spark


_private_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Durable folder for checkpoints and written intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one (or the
    context's checkpoint folder); otherwise — tests, local runs — makes a
    fresh private folder once per application and registers it with
    ``setCheckpointDir`` (the conf itself cannot be changed at runtime).
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        app = spark.sparkContext.applicationId
        d = _private_dirs.get(app) or spark.sparkContext.getCheckpointDir()
        if not d:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all nodes share")
            d = tempfile.mkdtemp(prefix="kpiforge-ckpt-")
        _private_dirs[app] = d
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path under the shared folder (never reused)."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def cluster_conf(total_cores: int, executor_mem_gb: int = 16, cores_per_executor: int = 4) -> dict[str, str]:
    """Suggested settings for a large cluster (e.g. 1000 executors × 4
    cores reading ~100 TB): enough shuffle partitions that a post-shuffle
    partition of the widest stage stays around the AQE advisory size
    (AQE coalesces small ones), input splits of 256 MB, skew split on.
    Apply with ``SparkSession.builder.config(map=...)`` or spark-submit."""
    per_task_gb = executor_mem_gb / max(1, cores_per_executor)
    advisory_mb = 256 if per_task_gb >= 4 else 128
    return {
        **{k: v for k, v in BASE_CONF.items() if not k.startswith("spark.ui")},
        "spark.sql.shuffle.partitions": str(max(200, 3 * total_cores)),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{advisory_mb}m",
        "spark.sql.files.maxPartitionBytes": "256m",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{4 * advisory_mb}m",
        "spark.sql.autoBroadcastJoinThreshold": "64m",
    }
