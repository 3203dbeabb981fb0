"""Session helpers: sane defaults for local runs and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "schedlens") -> SparkSession:
    """A local session for tests and the bench (UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SCHEDLENS_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts and intermediate tables.

    Uses the cluster's ``spark.checkpoint.dir``. Only a local master may run
    without it: there a fresh folder is created and registered. On a cluster
    each executor would write to a disk of its own, so that is refused.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not _is_local(sc.master):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on {sc.master}")
        conf = tempfile.mkdtemp(prefix="schedlens-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/schedlens-{name}-{uuid.uuid4().hex[:12]}"


def cut(df, name: str = "stage"):
    """Cut lineage at a stage boundary: write the stage as a Parquet table in
    the shared ``spark.checkpoint.dir`` and read it back.

    One computation (a reliable RDD checkpoint would compute the plan twice),
    survives executor loss, and later plans start from a small columnar scan
    with pushdown and pruning instead of the whole upstream plan.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.parquet(path)


def scale_settings(input_bytes: int, partition_bytes: int = 512 << 20) -> dict[str, str]:
    """SQL settings sized for an input of ``input_bytes`` on a cluster.

    Shuffle partitions start at about one per ``partition_bytes`` of input (at
    least 200, no upper limit) so no reducer has to hold more than it can sort in
    memory; AQE then coalesces small partitions and splits skewed join
    partitions at run time. Scan splits match the partition size.
    """
    n = max(200, -(-int(input_bytes) // int(partition_bytes)))
    size = f"{max(1, partition_bytes >> 20)}m"
    return {
        "spark.sql.shuffle.partitions": str(n),
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }


def apply_scale_settings(spark: SparkSession, input_bytes: int, **kw) -> dict[str, str]:
    """Set :func:`scale_settings` on a running session (runtime SQL settings only)."""
    conf = scale_settings(input_bytes, **kw)
    for k, v in conf.items():
        spark.conf.set(k, v)
    return conf
