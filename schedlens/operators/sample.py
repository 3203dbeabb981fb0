"""Deterministic samples of the trace by machine or by job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_machines_from_usage(rate: int, usage: DataFrame) -> DataFrame:
    """Usage on machines with ``id % rate == 0``; no machine reads as id 0."""
    return usage.where(F.coalesce(F.col("machine_info.id"), F.lit(0)) % rate == 0)


def sample_machines_from_tasks(rate: int, tasks: DataFrame) -> DataFrame:
    """Task events with a machine whose id is a multiple of ``rate``."""
    return tasks.where(F.col("machine_info").isNotNull()
                       & (F.coalesce(F.col("machine_info.id"), F.lit(0)) % rate == 0))


def sample_machines_from_machines(rate: int, machines: DataFrame) -> DataFrame:
    return machines.where(F.coalesce(F.col("info.id"), F.lit(0)) % rate == 0)


def sample_jobs_from_tasks(rate: int, tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("info.job.id") % rate == 0)


def sample_jobs_from_usage(rate: int, usage: DataFrame) -> DataFrame:
    return usage.where(F.col("task_info.job.id") % rate == 0)


def sample_path(base: str, rate: int, name: str) -> str:
    return f"{base.rstrip('/')}/sample{rate}_{name}"


def _write(df: DataFrame, path: str) -> str:
    """Files of Spark's advisory partition size: a rebalance splits and merges by bytes."""
    df.hint("rebalance").write.mode("overwrite").parquet(path)
    return path


def write_machine_sample(base: str, rate: int, tasks: DataFrame, usage: DataFrame) -> tuple[str, str]:
    """Write the machine sample (``tasks``, ``usage``); returns the two paths."""
    return (_write(sample_machines_from_tasks(rate, tasks), sample_path(base, rate, "tasks")),
            _write(sample_machines_from_usage(rate, usage), sample_path(base, rate, "usage")))


def write_job_sample(base: str, rate: int, tasks: DataFrame, usage: DataFrame) -> tuple[str, str]:
    return (_write(sample_jobs_from_tasks(rate, tasks), sample_path(base, rate, "job-tasks")),
            _write(sample_jobs_from_usage(rate, usage), sample_path(base, rate, "job-usage")))


def read_machine_sample(spark: SparkSession, base: str, rate: int) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(sample_path(base, rate, "tasks")),
            spark.read.parquet(sample_path(base, rate, "usage")))


def read_job_sample(spark: SparkSession, base: str, rate: int) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(sample_path(base, rate, "job-tasks")),
            spark.read.parquet(sample_path(base, rate, "job-usage")))
